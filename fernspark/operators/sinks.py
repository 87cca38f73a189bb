"""Sinks and caches over Parquet tables. Writes are by id, so a repeated run or task leaves the same table."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from fernspark import schema
from fernspark.functions import scalar


#: The column that names a row's folder in a sink's table.
PART = "_part"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def first_wins(df: DataFrame, key: str = "id", order: tuple[Column, ...] = ()) -> DataFrame:
    """One row per key: the first by ``order``, then by all that can be ordered."""
    rest = [F.col(f.name) for f in df.schema if f.dataType.typeName() not in ("map", "variant") and f.name != key and "map<" not in f.dataType.simpleString()]
    if not order and not rest:
        return df.dropDuplicates([key])
    w = Window.partitionBy(key).orderBy(*order, *rest)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_if_absent(table: DataFrame | None, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` whose key the table lacks, one per key."""
    rows = first_wins(new, key)
    return rows if table is None else rows.join(table.select(key), key, "left_anti")


def upsert(table: DataFrame | None, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """The table after last-write-wins by key: new rows replace old ones; of several new ones the last by ``order``."""
    rows = first_wins(new, key, (F.desc_nulls_last(order),) if order else ())
    if table is None:
        return rows
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def dense_column(field_name: str | Column) -> Column:
    """``vector_<field>`` as a column name."""
    return F.concat(F.lit("vector_"), scalar.column_name_plain(field_name))


@dataclass(eq=False)
class MemorySink:
    """Keeps rows of all runs under a counter, repeats included; for tests and small results."""

    rows: dict[int, dict] = field(default_factory=dict)

    def setup(self, spark: SparkSession) -> None:
        pass

    def store(self, df: DataFrame) -> int:
        new = [r.asDict(recursive=True) for r in df.toLocalIterator()]
        for r in new:
            self.rows[len(self.rows)] = r
        return len(new)

    def get(self, key: int) -> dict | None:
        return self.rows.get(key)

    def get_all(self) -> list[tuple[int, dict]]:
        return list(self.rows.items())


@dataclass(eq=False)
class ParquetSink:
    """A table by id. ``mode``: ``insert`` leaves rows that are there, ``upsert`` replaces them, ``append`` adds all rows.

    ``vectors`` maps embedded fields to their lengths, and only these are stored; ``metadata`` names keys that become columns
    (``meta_<name>``). ``missing``: what a row without a configured vector or key is: ``error``, ``empty`` or ``null``.
    ``order`` names columns of the rows to store, not stored themselves, by which the first of several new rows of an id is the one that stays; without it that is the first by all columns but maps.

    Rows lie in ``parts`` folders by a hash of their id, a number that a table keeps from its first write. An upsert rewrites only the folders that its rows touch, from a copy written
    beside the table; a reader always finds a table, and a run that fails midway is mended by running it again, as writes are by id.
    """

    path: str
    mode: str = "insert"
    vectors: dict[str, int | None] = field(default_factory=dict)
    sparse: tuple[str, ...] = ()
    metadata: tuple[str, ...] = ()
    missing: str = "null"
    parts: int = 64
    order: tuple[str, ...] = ()

    def with_vector(self, name: str = schema.COMBINED, size: int | None = None) -> ParquetSink:
        self.vectors[name] = size
        return self

    def with_sparse_vector(self, name: str = schema.COMBINED) -> ParquetSink:
        self.sparse = (*self.sparse, name)
        return self

    def with_metadata(self, *names: str) -> ParquetSink:
        self.metadata = (*self.metadata, *names)
        return self

    def setup(self, spark: SparkSession) -> None:
        if self.mode not in ("insert", "upsert", "append"):
            raise ValueError("modes are insert, upsert and append")

    def shaped(self, df: DataFrame) -> DataFrame:
        """The columns that are stored."""
        out = df.select("id", "path", "chunk", "metadata", "embed_mode", "original_size", "offset", "vectors", "sparse_vectors")
        for name, size in self.vectors.items():
            v = F.element_at("vectors", F.lit(name))
            if size is not None:
                v = F.when(v.isNull() | (F.size(v) == size), v).otherwise(F.raise_error(F.lit(f"the vector {name} hasn't {size} values")).cast("array<float>"))
            out = out.withColumn(_plain("vector_", name), self._or(v, F.array().cast("array<float>"), name))
        for name in self.sparse:
            out = out.withColumn(_plain("sparse_", name), F.element_at("sparse_vectors", F.lit(name)))
        for name in self.metadata:
            out = out.withColumn(_plain("meta_", name), self._or(F.element_at("metadata", F.lit(name)), F.lit(None).cast("string"), name))
        return out.drop("vectors", "sparse_vectors") if self.vectors or self.sparse else out

    def _or(self, value: Column, empty: Column, name: str) -> Column:
        if self.missing == "error":
            return F.coalesce(value, F.raise_error(F.lit(f"{name} is missing")).cast("array<float>" if name in self.vectors else "string"))
        return F.coalesce(value, empty) if self.missing == "empty" else value

    def read(self, spark: SparkSession) -> DataFrame | None:
        table = self._stored(spark)
        return None if table is None else table.drop(PART)

    def _stored(self, spark: SparkSession) -> DataFrame | None:
        if not exists(spark, f"{self.path}/_parts"):
            return None
        try:
            return spark.read.option("mergeSchema", "true").parquet(self.path)
        except AnalysisException:  # no row has been written yet
            return None

    def store(self, df: DataFrame) -> int:
        """Stores the rows and tells how many were written; they are counted as they are written."""
        spark, table = df.sparkSession, self._stored(df.sparkSession)
        if table is None:  # Spark doesn't read names that begin with an underscore as data
            spark.createDataFrame([(self.parts,)], "parts int").coalesce(1).write.mode("ignore").parquet(f"{self.path}/_parts")
        parts = spark.read.parquet(f"{self.path}/_parts").first()[0]
        if self.order and self.mode != "append":  # metadata is a map, by which rows can't be ordered
            df = first_wins(df, "id", tuple(F.col(c) for c in self.order))
        new = self.shaped(df)
        new = new.withColumn(PART, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
        if self.mode == "append":
            return self._write(new, "append", parts)
        if self.mode == "insert":
            return self._write(self._absent(table, new), "append", parts)
        aside = f"{self.path}.new-{uuid.uuid4().hex}"
        rows = new if self.order else first_wins(new)
        if table is None:
            return self._write(rows, "append", parts)
        try:
            rows.write.parquet(f"{aside}/rows")
            rows = spark.read.schema(rows.schema).parquet(f"{aside}/rows")
            touched = [r[0] for r in rows.select(PART).distinct().collect()]  # at most ``parts``
            old = table.where(F.col(PART).isin(touched)).join(rows.select("id"), "id", "left_anti")
            old.unionByName(rows, allowMissingColumns=True).repartition(max(1, min(len(touched), parts)), PART).write.partitionBy(PART).parquet(f"{aside}/table")
            if touched:
                spark.read.parquet(f"{aside}/table").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
            return rows.count()
        finally:
            delete(spark, aside)

    def _absent(self, table: DataFrame | None, new: DataFrame) -> DataFrame:
        if not self.order:
            return insert_if_absent(table, new)
        return new if table is None else new.join(table.select("id"), "id", "left_anti")

    def _write(self, df: DataFrame, mode: str, parts: int) -> int:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).repartition(parts, PART).write.mode(mode).partitionBy(PART).parquet(self.path)
        try:
            return seen.get["n"]
        except Py4JJavaError:  # a plan that turned out empty is cut down to nothing and reports no count
            return 0


def _plain(prefix: str, name: str) -> str:
    return prefix + "".join(c if c.isalnum() else "_" for c in name.lower())


def key_values(df: DataFrame) -> DataFrame:
    """``key``: path and id joined by a colon; ``value``: the node as JSON. What key-value stores and message queues get."""
    return df.select(F.concat_ws(":", F.coalesce("path", F.lit("")), "id").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


@dataclass(eq=False)
class QueueSink:
    """Writes key and value to a message queue through Spark's own connector (``format`` kafka), or to a table of another format."""

    format: str = "kafka"
    options: dict[str, str] = field(default_factory=dict)

    def setup(self, spark: SparkSession) -> None:
        pass

    def store(self, df: DataFrame) -> int:
        out = key_values(df)
        out.write.format(self.format).options(**self.options).mode("append").save()
        return out.count()


def points(df: DataFrame, configured: tuple[str, ...]) -> DataFrame:
    """A vector store's points: payload of metadata, path and content, and the configured vectors alone, by name where there are several."""
    kept = F.map_filter("vectors", lambda k, _: k.isin(*configured))
    payload = F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("path"), F.col("path"), F.lit("content"), F.col("chunk")))
    bad = F.col("vectors").isNull()
    return df.select("id", payload.alias("payload"), F.when(bad, F.raise_error(F.lit("a node has no vectors")).cast("map<string,array<float>>")).otherwise(kept).alias("vectors"))


@dataclass(eq=False)
class NodeCache:
    """Ids of nodes seen, as a Parquet table of ``id`` and ``path`` under a key prefix."""

    path: str
    prefix: str = ""

    def _key(self) -> Column:
        return F.concat_ws(".", F.lit(self.prefix), "id") if self.prefix else F.col("id")

    def ids(self, spark: SparkSession) -> DataFrame | None:
        return spark.read.parquet(self.path) if exists(spark, self.path) else None

    def get(self, spark: SparkSession, node_id: str) -> bool:
        ids = self.ids(spark)
        return ids is not None and not ids.where(F.col("key") == (f"{self.prefix}.{node_id}" if self.prefix else node_id)).isEmpty()

    def set(self, df: DataFrame) -> None:
        """Marks nodes; those marked already are left."""
        new = df.select(self._key().alias("key"), "path").groupBy("key").agg(F.min("path").alias("path"))
        known = self.ids(df.sparkSession)
        (new if known is None else new.join(known, "key", "left_anti")).write.mode("append").parquet(self.path)

    def filter(self, df: DataFrame) -> DataFrame:
        """Nodes not cached, one per id, which are marked at once. Rows with an error stay. What is returned was fixed before the marking.

        It is kept in memory and on disk until the caller unpersists it. A node counts as cached from now on, also if a later step fails; to run it again, clear the cache.
        """
        known = self.ids(df.sparkSession)
        good = first_wins(df.where("error is null"))
        if known is not None:
            good = good.withColumn("_key", self._key()).join(known.select(F.col("key").alias("_key")), "_key", "left_anti").drop("_key")
        kept = good.unionByName(df.where("error is not null")).select(df.columns).persist()
        self.set(kept.where("error is null"))
        return kept

    def clear(self, spark: SparkSession) -> None:
        delete(spark, self.path)


def absent(df: DataFrame, cached: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't cached, one per key; without side effects."""
    return first_wins(df, key).join(cached.select(key), key, "left_anti")


def swap(df: DataFrame, path: str) -> None:
    """Replaces a table that ``df`` may read: written beside it, then renamed; between the two renames there is none for a moment."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    P = spark._jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(P(path)):
        fs.rename(P(path), P(old))
    fs.rename(P(new), P(path))
    fs.delete(P(old), True)


def message_store(path: str, messages: DataFrame, *, overwrite: tuple[Any, ...] | None = None) -> None:
    """Appends messages to a history table, or replaces the given conversations."""
    spark = messages.sparkSession
    if overwrite is None:
        messages.write.mode("append").parquet(path)
        return
    old = spark.read.parquet(path).where(~F.col("conv_id").isin(*overwrite)) if exists(spark, path) else messages.limit(0)
    swap(old.unionByName(messages), path)
