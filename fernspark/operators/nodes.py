"""Node transformations: ids, chunkers, embedders, metadata from prompts, code analysis. All take and return DataFrames of nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernspark import schema
from fernspark.functions import code as codes
from fernspark.functions import html, scalar, splitters, templates

Stage = Callable[[DataFrame], DataFrame]

SPARSE = "struct<indices:array<int>,values:array<float>>"
#: A text's vector in Arrow.
ARROW = {"array<float>": pa.list_(pa.list_(pa.float32())), SPARSE: pa.list_(pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))]))}


def nodes(df: DataFrame, *, path: str | Column, chunk: str | Column, metadata: Column | None = None, error: Column | None = None, size: Column | None = None, beside: tuple[str, ...] = ()) -> DataFrame:
    """Rows as nodes: ``original_size`` is the chunk's length in bytes, ``offset`` 0, the id follows from path and chunk. Columns named by ``beside`` stay."""
    text = scalar.col(chunk)
    return df.select(
        scalar.node_id(path, chunk).alias("id"), scalar.col(path).cast("string").alias("path"), text.alias("chunk"),
        (metadata if metadata is not None else F.create_map().cast("map<string,string>")).alias("metadata"),
        F.lit(None).cast("map<string,array<float>>").alias("vectors"), F.lit(None).cast(f"map<string,{SPARSE}>").alias("sparse_vectors"),
        F.lit(schema.SINGLE).alias("embed_mode"), (size if size is not None else F.octet_length(text)).cast("bigint").alias("original_size"),
        F.lit(0).cast("bigint").alias("offset"), (error if error is not None else F.lit(None)).cast("string").alias("error"), *beside,
    )


def with_ids(df: DataFrame) -> DataFrame:
    """The id again, after path or chunk changed."""
    return df.withColumn("id", scalar.node_id("path", "chunk"))


#: Rows of an Arrow batch that are Python objects at once; the batch itself may have thousands of long texts.
ROWS = 64


def parts_of(batches: Iterator[pa.Array], rows: int = ROWS) -> Iterator[pa.Array]:
    for x in batches:
        for i in range(0, len(x), rows):
            yield x.slice(i, rows)


def mapped(f: Callable[[str], str | None], column: str = "chunk") -> Stage:
    """Applies a Python function to a text column in Arrow batches; what it raises becomes the row's error."""

    def stage(df: DataFrame) -> DataFrame:
        @F.arrow_udf("struct<value:string,error:string>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for x in parts_of(batches):
                out = []
                for t in x.to_pylist():
                    try:
                        out.append((None if t is None else f(t), None))
                    except Exception as e:  # noqa: BLE001  any failure is the row's
                        out.append((t, f"{type(e).__name__}: {e}"))
                yield pa.StructArray.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in (0, 1)], ["value", "error"])

        done = df.withColumn("_done", F.when(F.col("error").isNull(), run(F.col(column))))
        return done.withColumn(column, F.when(F.col("error").isNull(), F.col("_done.value")).otherwise(F.col(column))).withColumn("error", F.coalesce("error", "_done.error")).drop("_done")

    return stage


def html_to_markdown(df: DataFrame) -> DataFrame:
    """Each node's HTML as Markdown."""
    return with_ids(mapped(html.to_markdown)(df))


def _exploded(df: DataFrame, split: Callable[[str, str | None], list[str]], *, offsets: bool = False) -> DataFrame:
    """A node per chunk; size, metadata and the rest are the parent's. Rows with an error pass as they are; a failure to split is an error row."""

    @F.arrow_udf("struct<parts:array<string>,starts:array<bigint>,error:string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, paths in ((t.slice(i, ROWS), p.slice(i, ROWS)) for t, p in batches for i in range(0, len(t), ROWS)):
            out = []
            for t, p in zip(texts.to_pylist(), paths.to_pylist(), strict=True):
                try:
                    parts = split(t, p) if t else []
                    out.append((parts, list(accumulate((len(x.encode()) for x in parts[:-1]), initial=0)) if offsets else [], None))
                except Exception as e:  # noqa: BLE001
                    out.append(([], [], f"{type(e).__name__}: {e}"))
            kinds = pa.list_(pa.string()), pa.list_(pa.int64()), pa.string()
            yield pa.StructArray.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], ["parts", "starts", "error"])

    cols = df.columns
    done = df.withColumn("_done", F.when(F.col("error").isNull(), run("chunk", "path")))
    failed = F.coalesce("error", "_done.error")
    # A row with an error keeps one node; a text without chunks has none.
    parts = F.when(failed.isNotNull(), F.array("chunk")).otherwise(F.col("_done.parts"))
    if offsets:
        done = done.withColumn("_starts", F.when(failed.isNull(), F.col("_done.starts")))
    out = done.withColumn("error", failed).select("*", F.posexplode(parts).alias("_k", "_part")).withColumn("chunk", F.col("_part"))
    if offsets:
        out = out.withColumn("offset", F.coalesce(F.col("_starts")[F.col("_k")], F.col("offset")))
    return with_ids(out.select(cols))


def chunk_text(most: int | None = None, span: tuple[int, int] | None = None) -> Stage:
    return lambda df: _exploded(df, lambda t, _: splitters.text_chunks(t, most, span))


def chunk_markdown(most: int | None = None, span: tuple[int, int] | None = None) -> Stage:
    return lambda df: _exploded(df, lambda t, _: splitters.markdown_chunks(t, most, span))


def chunk_code(language: str = "python", most_bytes: int = 1500, least_bytes: int = 0) -> Stage:
    """Chunks of source code; ``offset`` is the running sum of the chunks' bytes before."""
    return lambda df: _exploded(df, lambda t, _: codes.chunks(t, language, most_bytes, least_bytes), offsets=True)


def chunk_lines(df: DataFrame) -> DataFrame:
    """A node per line that isn't blank, in the JVM alone."""
    lines = F.filter(F.split(F.coalesce("chunk", F.lit("")), "\n"), lambda x: scalar.trimmed(x) != "")
    return with_ids(df.withColumn("chunk", F.explode(F.when(F.col("error").isNull(), lines).otherwise(F.array("chunk")))))


def put_metadata(df: DataFrame, pairs: Column) -> DataFrame:
    """Adds a map's entries to the metadata; its keys win. Null values are left out."""
    new = F.map_filter(pairs, lambda _, v: v.isNotNull())
    old = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return df.withColumn("metadata", F.map_concat(old, F.coalesce(new, F.create_map().cast("map<string,string>"))))


def outline_code(least_bytes: int = 0) -> Stage:
    """``Outline``: Python code without function bodies, for chunks of at least ``least_bytes``; code that doesn't parse is an error."""

    def stage(df: DataFrame) -> DataFrame:
        found = df.withColumn("_outline", F.col("chunk"))
        found = mapped(lambda t: codes.outline(t, least_bytes), "_outline")(found)
        return put_metadata(found, F.create_map(F.lit("Outline"), F.when(F.col("error").isNull(), F.col("_outline")))).drop("_outline")

    return stage


def references_and_definitions(df: DataFrame) -> DataFrame:
    """``References (code)`` and ``Definitions (code)`` of Python code, comma-joined, sorted, once each; empty ones are left out."""

    def both(t: str) -> str:
        refs, defs = codes.references_and_definitions(t)
        return ",".join(refs) + "\n" + ",".join(defs)

    found = mapped(both, "_both")(df.withColumn("_both", F.col("chunk")))
    part = lambda n: F.when(F.col("error").isNull(), F.nullif(F.split_part("_both", F.lit("\n"), F.lit(n)), F.lit("")))
    return put_metadata(found, F.create_map(F.lit("References (code)"), part(1), F.lit("Definitions (code)"), part(2))).drop("_both")


# --- prompts ----------------------------------------------------------------------------------------------------------

_QA = "Write {n} questions that the {what} below answers, each with its answer, as lines beginning with Q: and A:.\n\n"
PROMPTS = {
    "Questions and Answers (text)": _QA.format(n="{{ questions }}", what="text") + "{{ chunk }}",
    "Questions and Answers (code)": _QA.format(n="{{ questions }}", what="code") + "{% if outline %}The file's outline:\n{{ outline }}\n\n{% endif %}{{ chunk }}",
    "Summary": "Summarise the text below in a few sentences, without adding anything.\n\n{{ chunk }}",
    "Title": "Give the text below one short title that fits it.\n\n{{ chunk }}",
    "Keywords": "List the keywords of the text below, separated by commas.\n\n{{ chunk }}",
    "Outline": "Shorten this outline of a file to what matters for the code below. Answer with one fenced block.\n\n{{ outline }}\n\n{{ chunk }}",
}


def prompted(df: DataFrame, model: Any, prompt: Column, into: str) -> DataFrame:
    """Adds the column ``into``: the model's answer to each row's prompt, one client per Python worker."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(model.prompt, na_action="ignore")

    return df.withColumn(into, run(prompt))


def metadata_from_prompt(key: str, model: Any, template: str | None = None, questions: int = 5) -> Stage:
    """A metadata entry written by a model: questions and answers, summary, title or keywords."""

    def stage(df: DataFrame) -> DataFrame:
        outline = F.coalesce(F.element_at("metadata", F.lit("Outline")), F.lit(""))
        context = F.to_json(F.struct("chunk", F.lit(questions).alias("questions"), outline.alias("outline")))
        made = prompted(df, model, F.when(F.col("error").isNull(), templates.rendered(template or PROMPTS[key], context)), "_answer")
        return put_metadata(made, F.create_map(F.lit(key), F.col("_answer"))).drop("_answer")

    return stage


def compress_outline(model: Any, template: str | None = None) -> Stage:
    """Rewrites ``Outline``, where there is one, by a model; of the answer the first fenced block counts."""

    def stage(df: DataFrame) -> DataFrame:
        outline = F.element_at("metadata", F.lit("Outline"))
        context = F.to_json(F.struct("chunk", outline.alias("outline")))
        asked = F.when(outline.isNotNull() & F.col("error").isNull(), templates.rendered(template or PROMPTS["Outline"], context))
        made = prompted(df, model, asked, "_answer")
        return put_metadata(made, F.create_map(F.lit("Outline"), scalar.fenced_code("_answer"))).drop("_answer")

    return stage


# --- embeddings -------------------------------------------------------------------------------------------------------


def _embedded(df: DataFrame, into: str, kind: str, call: Callable[[list[str]], list], batch_size: int) -> DataFrame:
    @F.arrow_udf(f"array<{kind}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in parts_of(batches, batch_size):
            rows = [[] if r is None else r for r in x.to_pylist()]
            texts = [t or "" for r in rows for t in r]
            made = call(texts) if texts else []
            at = iter(made)
            # a model that gives too few leaves the rows without vectors
            yield pa.array([[next(at) for _ in r] for r in rows] if len(made) == len(texts) else [None] * len(rows), ARROW[kind])

    pairs = scalar.embeddables("chunk", "metadata", F.col("embed_mode"))
    made = df.withColumn("_pairs", F.when(F.col("error").isNull(), pairs)).withColumn("_vectors", run(F.transform("_pairs", lambda p: p["text"])))
    return made.withColumn(into, F.when(F.col("_vectors").isNotNull(), F.map_from_arrays(F.transform("_pairs", lambda p: p["field"]), "_vectors"))).drop("_pairs", "_vectors")


def embed(model: Any, batch_size: int = 256) -> Stage:
    """``vectors`` by the model, of the texts that each row's ``embed_mode`` asks for."""
    return lambda df: _embedded(df, "vectors", "array<float>", lambda t: [[float(x) for x in v] for v in model.embed(t)], batch_size)


def sparse_embed(model: Any, batch_size: int = 256) -> Stage:
    """``sparse_vectors`` by the model."""
    return lambda df: _embedded(df, "sparse_vectors", SPARSE, lambda t: [{"indices": i, "values": v} for i, v in model.sparse_embed(t)], batch_size)


# --- token counts -----------------------------------------------------------------------------------------------------


def counted_tokens(text: str | Column, make: Callable[[], Callable[[str], int]]) -> Column:
    """Tokens of a text by any counter, which each Python worker makes once; null counts 0. For an estimate in the JVM see ``scalar.token_estimate``."""

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = make()
        for x in batches:
            yield x.map(lambda t: 0 if t is None else count(t)).astype("int64")

    return run(scalar.col(text))


def rank_file_counter(path: str, pattern: str) -> Callable[[], Callable[[str], int]]:
    """A counter of byte-pair tokens from a local rank file (base64 token, rank), read on the driver; needs the tiktoken library."""
    import base64

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}

    def make() -> Callable[[str], int]:
        import tiktoken

        enc = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda t: len(enc.encode_ordinary(t))

    return make
