"""The query pipeline: a row per query through the states Pending, Retrieved and Answered."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernspark import schema
from fernspark.functions import templates
from fernspark.operators import retrieval
from fernspark.operators.nodes import prompted

PENDING, RETRIEVED, ANSWERED = "Pending", "Retrieved", "Answered"
SEPARATOR = "\n---\n"

ANSWER = "Answer this question from the context alone, completely and in Markdown, or say that the context doesn't answer it:\n{{ question }}\n\nContext:\n---\n{{ documents }}\n---\n"
SUBQUESTIONS = "Write {{ num_questions }} questions, one a line, that together help to answer this one:\n{{ question }}\n"
SUMMARY = "Summarise these documents as far as they bear on the question.\nQuestion: {{ question }}\n\n---\n{{ documents }}\n---\n"


class StateError(ValueError):
    """A step that doesn't fit the queries' state."""


def queries(spark: SparkSession, questions: Iterable[str]) -> DataFrame:
    """Pending queries, numbered in order; ``current`` begins as the question."""
    rows = [(i, q) for i, q in enumerate(questions)]
    return as_queries(spark.createDataFrame(rows, "qid bigint, original string"))


def as_queries(df: DataFrame) -> DataFrame:
    """Rows of ``qid, original`` as pending queries."""
    null = lambda kind: F.lit(None).cast(kind)
    return df.select(
        F.col("qid").cast("bigint").alias("qid"), "original", F.col("original").alias("current"), F.lit(PENDING).alias("state"),
        null("array<float>").alias("embedding"), null("struct<indices:array<int>,values:array<float>>").alias("sparse_embedding"),
        F.array().cast(f"array<{schema.DOCUMENT}>").alias("documents"), F.array().cast(f"array<{schema.EVENT}>").alias("history"),
    )


def _event(kind: str, before: Column, after: Column, documents: Column | None = None) -> Column:
    docs = documents if documents is not None else F.lit(None).cast(f"array<{schema.DOCUMENT}>")
    return F.array(F.struct(F.lit(kind).alias("kind"), before.alias("before"), after.alias("after"), docs.alias("documents")))


def transformed(df: DataFrame, new: Column) -> DataFrame:
    """``current`` becomes ``new``, and the change is logged."""
    out = df.withColumn("_new", new)
    return out.withColumn("history", F.concat("history", _event("Transformed", F.col("current"), F.col("_new")))).withColumn("current", F.col("_new")).drop("_new")


def by_rank(entries: Column) -> Column:
    """Structs in the order of their ``rank``; maps inside, which have no order, are no hindrance."""
    return F.array_sort(entries, lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0))


def retrieved(df: DataFrame, found: DataFrame) -> DataFrame:
    """Appends the documents of ``found`` (``qid, rank, content, metadata``), in rank order, and logs them alone."""
    per = found.groupBy("qid").agg(F.transform(by_rank(F.collect_list(F.struct("rank", F.struct("content", "metadata").alias("doc")))), lambda x: x["doc"]).alias("_docs"))
    out = df.join(per, "qid", "left").withColumn("_docs", F.coalesce(F.col("_docs").cast(f"array<{schema.DOCUMENT}>"), F.array().cast(f"array<{schema.DOCUMENT}>")))
    logged = F.concat("history", _event("Retrieved", F.col("current"), F.lit(""), F.col("_docs")))
    return out.withColumn("documents", F.concat("documents", "_docs")).withColumn("history", logged).withColumn("state", F.lit(RETRIEVED)).select(df.columns)


def answered(df: DataFrame, answer: Column) -> DataFrame:
    """``current`` becomes the answer; this isn't logged."""
    return df.withColumn("current", answer).withColumn("state", F.lit(ANSWERED))


def sorted_documents(df: DataFrame) -> DataFrame:
    """Documents in the order of their contents."""
    keyed = F.transform("documents", lambda d: F.struct(d["content"].alias("content"), F.to_json(d["metadata"]).alias("j")))
    back = F.transform(F.array_sort(keyed), lambda d: F.struct(d["content"].alias("content"), F.from_json(d["j"], "map<string,string>").alias("metadata")))
    return df.withColumn("documents", back.cast(df.schema["documents"].dataType))


def context_documents(document_template: str | None = None) -> Column:
    """What an answer is based on: ``current`` if it was changed after the last retrieval, else the documents, joined."""
    events = F.filter("history", lambda e: e["kind"] == "Retrieved")
    uses_current = F.coalesce((F.col("current") != "") & (F.try_element_at(events, F.lit(-1))["before"] != F.col("current")), F.lit(False))
    docs = F.array_join(F.transform("documents", lambda d: d["content"]), SEPARATOR) if document_template is None else _each_rendered(document_template)
    return F.when(uses_current, F.col("current")).otherwise(docs)


def _each_rendered(template: str) -> Column:
    import json

    @F.pandas_udf("string")
    def run(documents: pd.Series) -> pd.Series:
        return documents.map(lambda j: SEPARATOR.join(templates.render(template, d) for d in json.loads(j)), na_action="ignore")

    return run(F.to_json("documents"))


def prompt_context(document_template: str | None = None) -> Column:
    return F.to_json(F.struct(F.col("original").alias("question"), "original", "current", context_documents(document_template).alias("documents")))


def answer_prompt(template: str = ANSWER, document_template: str | None = None) -> Column:
    """The prompt of each query, rendered."""
    return templates.rendered(template, prompt_context(document_template))


Step = Callable[[DataFrame], DataFrame]


def embed_query(model: Any) -> Step:
    """``embedding`` of ``current``; not logged."""

    def step(df: DataFrame) -> DataFrame:
        run = F.pandas_udf(lambda x: pd.Series([[float(v) for v in e] for e in model.embed(list(x.fillna("")))]), "array<float>")
        return df.withColumn("embedding", run("current"))

    return step


def sparse_embed_query(model: Any) -> Step:
    def step(df: DataFrame) -> DataFrame:
        kind = "struct<indices:array<int>,values:array<float>>"
        run = F.pandas_udf(lambda x: pd.DataFrame([{"indices": i, "values": v} for i, v in model.sparse_embed(list(x.fillna("")))], columns=["indices", "values"]), kind)
        return df.withColumn("sparse_embedding", run("current"))

    return step


def generate_subquestions(model: Any, n: int = 5, template: str = SUBQUESTIONS) -> Step:
    """``current`` becomes the model's further questions."""

    def step(df: DataFrame) -> DataFrame:
        asked = templates.rendered(template, F.to_json(F.struct(F.col("original").alias("question"), F.lit(n).alias("num_questions"))))
        return transformed(prompted(df, model, asked, "_said"), F.col("_said")).drop("_said")

    return step


def summarise(model: Any, template: str = SUMMARY) -> Step:
    """``current`` becomes the model's summary of the documents."""

    def step(df: DataFrame) -> DataFrame:
        docs = F.array_join(F.transform("documents", lambda d: d["content"]), SEPARATOR)
        asked = templates.rendered(template, F.to_json(F.struct(F.col("original").alias("question"), docs.alias("documents"))))
        return transformed(prompted(df, model, asked, "_said"), F.col("_said")).drop("_said")

    return step


def retrieve_from(corpus: DataFrame, strategy: Any = None, *, key: str = "id", text: str = "chunk", metadata: str | Column | None = "metadata", vector: str = "embedding", search: Callable[..., DataFrame] | None = None) -> Step:
    """Documents from a corpus by a strategy: similarity, hybrid (text and dense), or a custom one."""

    def step(df: DataFrame) -> DataFrame:
        chosen = strategy or retrieval.SimilaritySingleEmbedding()
        if isinstance(chosen, retrieval.CustomStrategy):
            found = chosen.run(corpus, df)
        elif search is not None:
            found = search(corpus, df, chosen)
        elif isinstance(chosen, retrieval.HybridSearch):
            found = retrieval.hybrid_convex(corpus, df.select("qid", "current", "embedding"), chosen, key=key, text=text, vector=vector)
        else:
            found = retrieval.similarity(corpus, df.select("qid", "embedding"), chosen, key=key, vector=vector)
        if "rank" not in found.columns:
            found = retrieval.ranked(found, 1 << 30, key=key)
        about = F.create_map().cast("map<string,string>") if metadata is None else F.col(metadata) if isinstance(metadata, str) else metadata
        rows = corpus.select(F.col(key).alias("id"), F.col(text).alias("content"), F.map_concat(about, F.create_map(F.lit("id"), F.col(key).cast("string"))).alias("metadata"))
        return retrieved(df, found.select("qid", "rank", F.col(key).alias("id")).join(rows, "id"))

    return step


def answer_simple(model: Any, template: str = ANSWER, document_template: str | None = None) -> Step:
    def step(df: DataFrame) -> DataFrame:
        return answered(prompted(df, model, answer_prompt(template, document_template), "_said"), F.col("_said")).drop("_said")

    return step


@dataclass(frozen=True)
class QueryPipeline:
    """Steps in order; each is checked against the state that the steps before leave."""

    steps: tuple[Step, ...] = ()
    state: str = PENDING
    taps: tuple[Callable[[str, DataFrame], None], ...] = ()

    def _then(self, step: Step, allowed: tuple[str, ...], state: str, tap: str | None = None) -> QueryPipeline:
        if self.state not in allowed:
            raise StateError(f"{self.state} queries can't take this step")

        def run(df: DataFrame) -> DataFrame:
            out = step(df)
            for t in self.taps if tap else ():
                t(tap, out)
            return out

        return replace(self, steps=(*self.steps, run), state=state)

    def evaluate_with(self, evaluator: Callable[[str, DataFrame], None]) -> QueryPipeline:
        """Later retrievals and answers are shown to the evaluator."""
        return replace(self, taps=(*self.taps, evaluator))

    def then_transform_query(self, step: Step) -> QueryPipeline:
        return self._then(step, (PENDING,), PENDING)

    def then_retrieve(self, step: Step) -> QueryPipeline:
        return self._then(step, (PENDING, RETRIEVED), RETRIEVED, "retrieved")

    def then_transform_response(self, step: Step) -> QueryPipeline:
        return self._then(step, (RETRIEVED,), RETRIEVED)

    def then_answer(self, step: Step) -> QueryPipeline:
        return self._then(step, (RETRIEVED,), ANSWERED, "answered")

    def run(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s(df)
        return df

    def query(self, spark: SparkSession, question: str) -> Any:
        """One question's row."""
        return self.run(queries(spark, [question])).first()

    def query_all(self, spark: SparkSession, questions: Iterable[str]) -> DataFrame:
        """All questions' rows, in their order."""
        return self.run(queries(spark, questions)).orderBy("qid")


# --- evaluation -------------------------------------------------------------------------------------------------------


def evaluation_dataset(prepared: DataFrame, retrieved_rows: DataFrame | None = None, answered_rows: DataFrame | None = None) -> DataFrame:
    """``question, answer, contexts, ground_truth`` per prepared question (``question`` and perhaps ``ground_truth``).

    Repeated questions are one, with the greatest ground truth. Contexts and answers come from queries by ``original``.
    """
    truth = F.coalesce(F.max("ground_truth"), F.lit("")) if "ground_truth" in prepared.columns else F.lit("")
    out = prepared.groupBy("question").agg(truth.alias("ground_truth"), F.count("*").alias("_n"))
    empty = F.array().cast("array<string>")
    if retrieved_rows is not None:
        docs = retrieved_rows.groupBy(F.col("original").alias("question")).agg(F.max_by(F.transform("documents", lambda d: d["content"]), "qid").alias("contexts"))
        out = out.join(docs, "question", "left")
    if answered_rows is not None:
        out = out.join(answered_rows.groupBy(F.col("original").alias("question")).agg(F.max_by("current", "qid").alias("answer")), "question", "left")
    for c, v in (("contexts", empty), ("answer", F.lit(""))):
        out = out.withColumn(c, F.coalesce(c, v) if c in out.columns else v)
    return out.select("question", "answer", "contexts", "ground_truth")


def unknown_questions(prepared: DataFrame, rows: DataFrame) -> DataFrame:
    """Questions of queries that weren't prepared: an evaluation refuses them."""
    return rows.select(F.col("original").alias("question")).distinct().join(prepared.select("question"), "question", "left_anti")


def answers_as_ground_truth(dataset: DataFrame) -> DataFrame:
    return dataset.withColumn("ground_truth", F.col("answer"))


def dataset_json(dataset: DataFrame) -> DataFrame:
    """One JSON object per line, keys sorted, lines by question: an array would gather the dataset in one task."""
    return dataset.orderBy("question").select(F.to_json(F.struct("answer", "contexts", "ground_truth", "question")).alias("json"))
