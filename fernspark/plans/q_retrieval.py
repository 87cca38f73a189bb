"""Queries of retrieval, the query pipeline and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernspark.functions import scalar, stemming
from fernspark.operators import models, querying, retrieval, textindex, vectorindex
from fernspark.plans.registry import query
from fernspark.session import fresh_path
from fernspark.tables import table

#: Searches ask with every vector whose id is divisible by this, against all.
ASKS = 100
DIGITS = 6


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % ASKS == 0).select(F.col("vec_id").alias("qid"), "embedding")


def _knn(metric: str, order: str, where: str = "true", asks: int = ASKS, k: int = 10) -> str:
    return f"""
    WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % {asks} = 0),
    s AS (SELECT qid, vec_id AS id, round({metric}, {DIGITS}) AS score FROM q, (SELECT * FROM embeddings WHERE {where}))
    SELECT qid, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score {order}, id) AS rank FROM s) WHERE rank <= {k}
    """


COSINE, L2, DOT = (f"list_{f}(embedding::DOUBLE[], q.v)" for f in ("cosine_similarity", "distance", "inner_product"))


def _similar(spark: SparkSession, sf_dir: str, metric: str, keep: str | None = None) -> DataFrame:
    return retrieval.similarity(_vectors(spark, sf_dir), _asked(spark, sf_dir), retrieval.SimilaritySingleEmbedding(10, keep, metric), digits=DIGITS)


@query(_knn(COSINE, "DESC"))
def sim_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to every hundredth one by cosine."""
    return _similar(spark, sf_dir, "cosine")


@query(_knn(L2, "ASC"))
def sim_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir, "l2")


@query(_knn(DOT, "DESC"))
def sim_dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir, "dot")


@query(_knn(f"1 - {COSINE}", "ASC"))
def sim_cosine_distance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir, "cosine_distance")


@query(_knn(COSINE, "DESC", where="label = 3"))
def sim_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate before the ranking."""
    return _similar(spark, sf_dir, "cosine", "label = 3")


@query(_knn(COSINE, "DESC", where="label = 3"))
def sim_key_value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ``key=value`` filter on metadata."""
    docs = _vectors(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))
    return retrieval.similarity(docs, _asked(spark, sf_dir), retrieval.SimilaritySingleEmbedding(10, retrieval.key_value_filter('label = "3"')), digits=DIGITS)


@query(_knn(L2, "ASC", asks=1))
def sim_query_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector asks: blocks of queries against shards."""
    asked = _vectors(spark, sf_dir).withColumnRenamed("id", "qid")
    return retrieval.similarity(_vectors(spark, sf_dir), asked, retrieval.SimilaritySingleEmbedding(10, None, "l2"), digits=DIGITS, broadcast_queries=0)


def _sparse(df: DataFrame) -> DataFrame:
    """The vectors' components over 0.15 as sparse vectors."""
    pairs = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda p: p["v"] > 0.15)
    return df.withColumn("sparse", F.struct(F.transform(pairs, lambda p: p["i"]).alias("indices"), F.transform(pairs, lambda p: p["v"]).alias("values")))


_SPARSE = """sp AS (SELECT vec_id, i, w FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS w FROM embeddings) WHERE w > 0.15::FLOAT),
ss AS (SELECT a.vec_id AS qid, b.vec_id AS id, sum(a.w::DOUBLE * b.w::DOUBLE) AS score FROM sp a JOIN sp b USING (i) WHERE a.vec_id % 100 = 0 GROUP BY 1, 2)"""


@query(f"WITH {_SPARSE} SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ss) WHERE rank <= 10")
def sim_sparse_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sparse(_vectors(spark, sf_dir))
    found = retrieval.sparse_similarity(docs, docs.where(F.col("id") % ASKS == 0).select(F.col("id").alias("qid"), "sparse"))
    return found.select("qid", "id", F.round("score", DIGITS).alias("score"), "rank")


_RANKED = "SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY {} , id) AS rank FROM {}"
_FUSED = """, f AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ({}) GROUP BY qid, id)
SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10"""


@query(
    f"""WITH {_SPARSE}, q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
    ds AS (SELECT qid, vec_id AS id, {COSINE} AS score FROM q, embeddings),
    a AS (SELECT * FROM ({_RANKED.format('score DESC', 'ds')}) WHERE rank <= 20), b AS (SELECT * FROM ({_RANKED.format('score DESC', 'ss')}) WHERE rank <= 20)"""
    + _FUSED.format("SELECT * FROM a UNION ALL SELECT * FROM b")
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and sparse candidates fused by rank."""
    docs = _sparse(_vectors(spark, sf_dir))
    asked = docs.where(F.col("id") % ASKS == 0).select(F.col("id").alias("qid"), "embedding", "sparse")
    found = retrieval.hybrid_rrf(docs, asked, retrieval.HybridSearch(10, 20))
    return found.select("qid", "id", F.round("score", DIGITS).alias("score"), "rank")


@query(
    f"""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
    ds AS (SELECT qid, vec_id AS id, round({COSINE}, 6) AS c, round({L2}, 6) AS d FROM q, embeddings),
    a AS (SELECT * FROM ({_RANKED.format('c DESC', 'ds')}) WHERE rank <= 10), b AS (SELECT * FROM ({_RANKED.format('d', '(SELECT ds.* FROM ds JOIN embeddings e ON e.vec_id = ds.id WHERE e.label < 5)')}) WHERE rank <= 10)"""
    + _FUSED.format("SELECT * FROM a UNION ALL SELECT * FROM b")
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings, of all vectors by cosine and of half the labels by distance, fused."""
    a = _similar(spark, sf_dir, "cosine")
    b = _similar(spark, sf_dir, "l2", "label < 5")
    return retrieval.reciprocal_rank_fusion([a, b]).select("qid", "id", F.round("score", DIGITS).alias("score"), "rank")


_BM25 = """w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z]+'), lambda x: x <> '') AS t FROM documents),
p AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM w) GROUP BY id, term),
n AS (SELECT count(*)::DOUBLE AS n, sum(len(t))::DOUBLE / count(*) AS avgdl FROM w), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qw AS (SELECT DISTINCT item_id AS qid, unnest(list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z]+'), lambda x: x <> '')) AS term FROM benchmark),
bm AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN qw USING (term) JOIN df USING (term), n GROUP BY qid, id)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item, whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("current"))


@query(f"WITH {_BM25} SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM bm) WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("chunk"))
    return retrieval.TextIndex.of(docs).best(_questions(spark, sf_dir), 10, digits=DIGITS)


def _stems() -> str:
    """Porter's steps in SQL: ``st (term, stem)`` of the words of ``v (term)``."""
    some, two, one = "[^aeiouy]*[aeiouy]+[^aeiouy].*", "[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy].*", "[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]*"
    short = "[^aeiouy][aeiouy][^aeiouywxY]$"
    has = lambda w, p: f"regexp_matches({w}, '{p}')"

    def ruled(rules: tuple[tuple[str, str], ...], stem: str) -> str:
        cases = [f"WHEN ends_with(w, '{e}') THEN CASE WHEN {has(f'left(w, length(w) - {len(e)})', f'^(?:{stem})$')}{' AND ' + has('w', '[st]ion$') if e == 'ion' else ''} THEN left(w, length(w) - {len(e)}) || '{new}' ELSE w END" for e, new in sorted(rules, key=lambda r: -len(r[0]))]
        return f"CASE {' '.join(cases)} ELSE w END"

    doubled = "|".join(2 * c for c in "bcdfghjkmnpqrtvwx")
    bare = "left(w, length(w) - 1)"
    steps = [
        "regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')",
        ruled(stemming.STEP_1A, ".*"),
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {has('w', f'^{some}eed$')} THEN left(w, length(w) - 1) ELSE w END WHEN {has('w', '^.*[aeiouy].*ed$')} THEN left(w, length(w) - 2) || '+' WHEN {has('w', '^.*[aeiouy].*ing$')} THEN left(w, length(w) - 3) || '+' ELSE w END",
        f"CASE WHEN NOT ends_with(w, '+') THEN w WHEN {has(bare, '(at|bl|iz)$')} THEN {bare} || 'e' WHEN {has(bare, f'({doubled})$')} THEN left(w, length(w) - 2) WHEN {has(bare, f'^(?:{one})$')} AND {has(bare, short)} THEN {bare} || 'e' ELSE {bare} END",
        f"CASE WHEN {has('w', '^.*[aeiouy].*[yY]$')} THEN {bare} || 'i' ELSE w END",
        ruled(stemming.STEP_2, some),
        ruled(stemming.STEP_3, some),
        ruled(stemming.STEP_4, two),
        f"CASE WHEN ends_with(w, 'e') AND ({has(bare, f'^(?:{two})$')} OR ({has(bare, f'^(?:{one})$')} AND NOT {has(bare, short)})) THEN {bare} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {has('w', f'^(?:{two})$')} THEN {bare} ELSE w END",
        "lower(w)",
    ]
    made = ["s0 AS (SELECT term, term AS w FROM v)"] + [f"s{i + 1} AS (SELECT term, {step} AS w FROM s{i})" for i, step in enumerate(steps)]
    return ", ".join(made) + f", st AS (SELECT term, CASE WHEN length(term) > 2 THEN w ELSE term END AS stem FROM s{len(steps)})"


_WORDS = "list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z]+'), lambda x: x <> '' AND x NOT IN (" + ", ".join(f"'{w}'" for w in stemming.STOP) + "))"


@query(
    f"""WITH w AS (SELECT doc_id AS id, {_WORDS} AS t FROM documents), qt AS (SELECT item_id AS qid, unnest({_WORDS}) AS term FROM benchmark), wt AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM w),
    v AS (SELECT DISTINCT term FROM (SELECT term FROM wt UNION ALL SELECT term FROM qt)), {_stems()},
    p AS (SELECT id, stem, count(*) AS tf, any_value(dl) AS dl FROM wt JOIN st USING (term) GROUP BY id, stem),
    n AS (SELECT count(*)::DOUBLE AS n, sum(len(t))::DOUBLE / count(*) AS avgdl FROM w), df AS (SELECT stem, count(*) AS df FROM p GROUP BY stem), qw AS (SELECT DISTINCT qid, stem FROM qt JOIN st USING (term)),
    bm AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN qw USING (stem) JOIN df USING (stem), n GROUP BY qid, id)
    SELECT qid, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 10"""
)
def stored_text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against all documents through a stored index of stems."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("chunk"))
    index = textindex.StoredTextIndex.build(docs, fresh_path(spark, "text-index"))
    return index.search(_questions(spark, sf_dir), 10, digits=DIGITS)


@query(
    f"""WITH {_BM25}, e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    docs AS (SELECT d.doc_id AS id, e.v FROM documents d JOIN e ON e.vec_id = d.doc_id), q AS (SELECT vec_id AS qid, v FROM e JOIN benchmark ON item_id = vec_id),
    ds AS (SELECT qid, id, list_cosine_similarity(docs.v, q.v) AS dense FROM q, docs), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, id) AS r FROM ds) WHERE r <= 200),
    every AS (SELECT q.qid, docs.id, bm.score AS lexical FROM q CROSS JOIN docs LEFT JOIN bm ON bm.qid = q.qid AND bm.id = docs.id),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC NULLS LAST, id) AS r FROM every) WHERE r <= 200),
    c AS (SELECT l.qid, l.id, 0.8 * (dense + 1) / (max(dense) OVER (PARTITION BY l.qid) + 1) + 0.2 * lexical / max(lexical) OVER (PARTITION BY l.qid) AS score FROM l JOIN d ON l.qid = d.qid AND l.id = d.id)
    SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, id) AS rank FROM c) WHERE rank <= 10"""
)
def hybrid_convex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and vector scores of documents with a vector, each over its largest, weighted; idf and lengths are those of these documents' table."""
    e = table(spark, sf_dir, "embeddings")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("chunk"))
    docs = texts.join(e.select(F.col("vec_id").alias("id"), "embedding"), "id")
    asked = _questions(spark, sf_dir).join(e.select(F.col("vec_id").alias("qid"), "embedding"), "qid")
    index = retrieval.TextIndex.of(texts)
    found = retrieval.hybrid_convex(docs.where("embedding is not null"), asked, retrieval.HybridSearch(10, 200), index=index)
    return found.select("qid", "id", F.round("score", DIGITS).alias("score"), "rank")


@query("SELECT vec_id AS id, label FROM embeddings WHERE label = 7 ORDER BY vec_id LIMIT 10")
def custom_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's SQL with bound parameters."""
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("fernspark_vectors")
    return retrieval.custom_sql(spark, "SELECT vec_id AS id, label FROM fernspark_vectors WHERE label = :label ORDER BY vec_id LIMIT 10", label=7)


@query()
def stored_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector found through a stored index of half of the vectors, to which the other half is added."""
    vectors = _vectors(spark, sf_dir)
    first = vectorindex.VectorIndex.build(vectors.where("pmod(id, 2) = 0"), fresh_path(spark, "vector-index"))
    first.add(vectors.where("pmod(id, 2) = 1"))
    return vectorindex.VectorIndex.load(spark, first.path).search(_asked(spark, sf_dir), 10, digits=DIGITS)


# --- the query pipeline -----------------------------------------------------------------------------------------------


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a question; of the documents with a vector the ten nearest to the item's own by cosine are found."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("original"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    vectors = _vectors(spark, sf_dir)
    asked = vectors.select(F.col("id").alias("qid"), "embedding").join(b.select("qid"), "qid")
    near = retrieval.similarity(vectors.join(docs.select("id"), "id"), asked, retrieval.SimilaritySingleEmbedding(10), digits=DIGITS)
    return querying.retrieved(querying.as_queries(b), near.select("qid", "rank", "id").join(docs, "id"))


_DOCS = f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings), q AS (SELECT item_id AS qid, text AS original FROM benchmark),
near AS (SELECT item_id AS qid, doc_id, text AS content, round({COSINE}, {DIGITS}) AS score FROM (SELECT item_id, embedding AS v FROM benchmark JOIN e ON vec_id = item_id) q, documents JOIN e ON vec_id = doc_id),
d AS (SELECT * FROM (SELECT qid, content, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM near) WHERE rank <= 10)"""
_PROMPT = "replace(replace('" + querying.ANSWER.replace("'", "''") + "', '{{ question }}', original), '{{ documents }}', %s)"


@query(f"WITH {_DOCS}, j AS (SELECT qid, string_agg(content, chr(10) || '---' || chr(10) ORDER BY rank) AS docs FROM d GROUP BY qid) SELECT qid, {_PROMPT % "coalesce(docs, '')"} AS prompt FROM q LEFT JOIN j USING (qid)")
def answer_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of an answer from documents."""
    return _retrieved(spark, sf_dir).select("qid", querying.answer_prompt().alias("prompt"))


@query(f"WITH {_DOCS} SELECT qid, {_PROMPT % chr(39).join(['', 'a summary', ''])} AS prompt FROM q")
def answer_uses_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a transformed response, the prompt has that in place of documents."""
    return querying.transformed(_retrieved(spark, sf_dir), F.lit("a summary")).select("qid", querying.answer_prompt().alias("prompt"))


@query(f"WITH {_DOCS} SELECT qid, coalesce(string_agg(content, '|' ORDER BY content), '') AS contents, count(content)::INT AS documents FROM q LEFT JOIN d USING (qid) GROUP BY qid")
def doc_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their contents."""
    return querying.sorted_documents(_retrieved(spark, sf_dir)).select("qid", F.array_join(F.transform("documents", lambda d: d["content"]), "|").alias("contents"), F.size("documents").alias("documents"))


@query(f"WITH {_DOCS} SELECT qid, 'Retrieved>Transformed' AS kinds, original AS first_before, 'a summary' AS last_after, 'Retrieved' AS state FROM q")
def query_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = querying.transformed(_retrieved(spark, sf_dir), F.lit("a summary"))
    return df.select("qid", F.array_join(F.transform("history", lambda e: e["kind"]), ">").alias("kinds"), F.col("history")[0]["before"].alias("first_before"), F.col("history")[1]["after"].alias("last_after"), "state")


@query("SELECT item_id AS qid, 'Answered' AS state, 'Answer this question' AS current, 'Retrieved' AS kinds, 2 AS documents FROM benchmark")
def query_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embed, retrieve two and answer, with the offline models."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("chunk"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    model = models.HashEmbedder(64)
    corpus = querying.embed_query(model)(docs.withColumn("current", F.col("chunk"))).drop("current")
    p = (
        querying.QueryPipeline()
        .then_transform_query(querying.embed_query(model))
        .then_retrieve(querying.retrieve_from(corpus, retrieval.SimilaritySingleEmbedding(2)))
        .then_answer(querying.answer_simple(models.EchoPrompt(3)))
    )
    asked = querying.as_queries(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("original")))
    return p.run(asked).select("qid", "state", "current", F.array_join(F.transform("history", lambda e: e["kind"]), ">").alias("kinds"), F.size("documents").alias("documents"))


@query(
    f"""WITH {_DOCS}, t AS (SELECT d.qid, rank, content, list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS dw,
      list_distinct(list_filter(regexp_split_to_array(lower(original), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS qw FROM d JOIN q USING (qid)),
    s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY len(list_intersect(qw, dw))::DOUBLE / len(qw) DESC, rank) AS r FROM t)
    SELECT qid, coalesce(string_agg(content, '|' ORDER BY r), '') AS contents FROM q LEFT JOIN (SELECT * FROM s WHERE r <= 2) USING (qid) GROUP BY qid"""
)
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two documents with most of the question's words."""
    df = retrieval.rerank(_retrieved(spark, sf_dir), models.OverlapReranker(), 2)
    return df.select("qid", F.array_join(F.transform("documents", lambda d: d["content"]), "|").alias("contents"))


_DATASET = f"WITH {_DOCS}, c AS (SELECT qid, list(content ORDER BY rank) AS contexts FROM d GROUP BY qid), x AS (SELECT original AS question, arg_max(coalesce(contexts, []), qid) AS contexts FROM q LEFT JOIN c USING (qid) GROUP BY original)"


@query(f"{_DATASET} SELECT question, 'said' AS answer, array_to_string(contexts, '|') AS contexts, '' AS ground_truth FROM x")
def ragas_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts and answers by question."""
    r = _retrieved(spark, sf_dir)
    data = querying.evaluation_dataset(r.select(F.col("original").alias("question")), r, querying.answered(r, F.lit("said")))
    return data.withColumn("contexts", F.array_join("contexts", "|"))


@query(f"{_DATASET} SELECT question, 'said' AS answer, 'said' AS ground_truth FROM x")
def ragas_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers become the ground truth."""
    r = _retrieved(spark, sf_dir)
    data = querying.evaluation_dataset(r.select(F.col("original").alias("question")), None, querying.answered(r, F.lit("said")))
    return querying.answers_as_ground_truth(data).select("question", "answer", "ground_truth")


@query("SELECT DISTINCT text AS question FROM benchmark WHERE text NOT IN (SELECT text FROM benchmark WHERE length(text) > 400)")
def ragas_unknown_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set knows the long questions."""
    r = _retrieved(spark, sf_dir)
    return querying.unknown_questions(r.where(F.char_length("original") > 400).select(F.col("original").alias("question")), r)


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_distance(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS apart FROM embeddings")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(scalar.dot("embedding", "embedding")), DIGITS).alias("norm"), F.round(scalar.l2("embedding", F.reverse("embedding")), DIGITS).alias("apart"))
