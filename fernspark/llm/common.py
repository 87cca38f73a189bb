"""What several operators share: the shared scratch folder, sliced Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernspark.session import fresh_path

#: Python objects of about this many bytes of text are made at a time.
SLICE_BYTES = 4 << 20

#: Tables written within :func:`temporary_tables`, innermost last.
_within: list[list[DataFrame]] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and outlives executors."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fernspark_path = path
    if _within:
        _within[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`written` made and that nothing reads any more."""
    path = getattr(df, "_fernspark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextmanager
def temporary_tables() -> Iterator[list[DataFrame]]:
    """Deletes, at its end, the intermediate tables that operators wrote within it; results must be stored before.

    Operators return lazy DataFrames that read such tables, so only the caller knows when they are no longer needed::

        with temporary_tables():
            simhash.near_duplicates(docs).write.parquet(out)

    What is taken out of the list that it gives, stays.
    """
    made: list[DataFrame] = []
    _within.append(made)
    try:
        yield made
    finally:
        _within.pop()
        for df in made:
            discard(df)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = SLICE_BYTES, most_rows: int = 2000, sizes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece's ``column`` (or, if given, ``sizes``) holds about ``most_bytes``; a single longer value stays whole."""
    if sizes is None:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def sliced(texts: pa.Array, f: Callable[[list[str | None]], pa.Array]) -> pa.Array:
    """``f`` of the strings of a slice of ``texts`` at a time, joined: Python objects of a slice alone are held."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = [f(part.column(0).to_pylist()) for part in slices(batch, "text")]
    return pa.concat_arrays(parts) if parts else f([])


def signature(edges: DataFrame) -> tuple:
    """A count and an order-free hash of the rows."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges``: long ``u`` and ``v``, in any order, with repeats or loops. Returns ``node, root`` for every node of an
    edge between two different nodes; root is the smallest node of the component. Each round is two aggregations with
    map-side partial minima and two equi-joins; the rounds grow with the logarithm of the component's size. Tables of
    links stay distributed; only a count and a hash of them reach the driver.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = signature(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        small = written(small)
        now = signature(small)
        discard(large)
        discard(e)
        e = small
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
