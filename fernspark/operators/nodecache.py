"""A cache of node ids in hash buckets, with Bloom sketches that let new ids pass without a look at the ids.

Two bucketed tables lie in the cache's folder. ``sketches`` has bitmaps of 32,768 bits, a row per block and append; an id belongs to one block and sets ``HASHES`` of its bits.
``ids`` has the marked ids, in buckets by id. Rows that are looked up are shuffled to the sketches' buckets, those that a sketch doesn't rule out to the ids' buckets;
neither table is shuffled. Sketches are written before the ids: what a killed run leaves are bits without ids, which cost a look and change nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernspark.operators import sinks
from fernspark.session import fresh_path

#: Bits of a sketch, as Spark's bitmap functions have them.
BITS = 32_768
#: Bits that an id sets in its block.
HASHES = 4
#: Ids of a block up to which about one new id in 100 isn't ruled out.
BLOCK_IDS = 3_000


@dataclass(eq=False)
class BucketedCache:
    """Ids of nodes seen, under a key prefix. Takes the place of :class:`~fernspark.operators.sinks.NodeCache`.

    ``expected``: about how many ids the cache will hold, and ``buckets``: in how many tasks it is read; both are fixed by the first marking. With more ids than expected, sketches
    rule out less and more rows go to the exact join; results stay the same, and :meth:`rebuild` makes room. Nodes without an id are never cached. Of two runs that filter
    at the same time both may let a node through, as with any cache that marks after it looks; marking twice is harmless.
    """

    path: str
    prefix: str = ""
    expected: int = 10_000_000
    buckets: int = 64

    def __post_init__(self) -> None:
        if self.expected < 1 or self.buckets < 1:
            raise ValueError("a cache expects at least one id and has at least one bucket")

    # --- tables ---

    def _about(self, spark: SparkSession) -> tuple[str, int, int] | None:
        """The generation's folder, its buckets and its blocks; the newest counts."""
        if not sinks.exists(spark, f"{self.path}/about"):
            return None
        r = spark.read.parquet(f"{self.path}/about").orderBy(F.desc("generation")).first()
        return None if r is None else (f"{self.path}/{r.generation:06d}", r.buckets, r.blocks)

    def _start(self, generation: int, buckets: int, expected: int) -> tuple[str, int, int]:
        return f"{self.path}/{generation:06d}", buckets, max(1, -(-expected // BLOCK_IDS))

    def _announce(self, spark: SparkSession, generation: int, about: tuple[str, int, int]) -> None:
        spark.createDataFrame([(generation, about[1], about[2])], "generation int, buckets int, blocks long").coalesce(1).write.mode("append").parquet(f"{self.path}/about")

    def _first(self, spark: SparkSession) -> tuple[str, int, int]:
        about = self._start(1, self.buckets, self.expected)
        self._announce(spark, 1, about)
        return about

    @staticmethod
    def _name(folder: str, kind: str) -> str:
        return f"fernspark_cache_{hashlib.sha256(folder.encode()).hexdigest()[:24]}_{kind}"

    def _table(self, spark: SparkSession, about: tuple[str, int, int], kind: str) -> str:
        """The table's name; the catalog learns of it here, as only tables of a catalog have buckets."""
        folder, buckets, _ = about
        name = self._name(folder, kind)
        columns, by = ("key STRING, path STRING", "key") if kind == "ids" else ("block BIGINT, bits BINARY", "block")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}")  # a relative location would lie in the warehouse
        location = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString().replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{location}'")
        spark.catalog.refreshTable(name)  # other sessions may have added files
        return name

    def ids(self, spark: SparkSession) -> DataFrame | None:
        """``key, path`` of all marked nodes; a key may be there twice if two runs marked it at the same time."""
        about = self._about(spark)
        return None if about is None else spark.table(self._table(spark, about, "ids"))

    # --- sketches ---

    def _key(self) -> Column:
        return F.concat(F.lit(f"{self.prefix}."), F.col("id").cast("string")) if self.prefix else F.col("id").cast("string")

    @staticmethod
    def _block(key: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))

    @staticmethod
    def _bits(key: str) -> Column:
        """The positions of a key's bits in its block, from a hash that doesn't depend on the block's."""
        return F.array(*[F.pmod(F.xxhash64(F.lit(i), key), F.lit(BITS)).cast("long") for i in range(HASHES)])

    def _sketches(self, spark: SparkSession, about: tuple[str, int, int]) -> DataFrame:
        """One bitmap per block; the buckets are by block, so nothing is shuffled."""
        return spark.table(self._table(spark, about, "sketches")).groupBy(F.col("block").alias("_block")).agg(F.bitmap_or_agg("bits").alias("_sketch"))

    @staticmethod
    def _held(sketch: str, positions: str) -> Column:
        """Whether the sketch has all the positions; a null sketch has none."""
        byte = lambda p: F.conv(F.hex(F.substring(sketch, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        return F.coalesce(F.forall(positions, lambda p: F.bit_get(byte(p), (p % 8).cast("int")) == 1), F.lit(False))

    def _looked_up(self, rows: DataFrame, about: tuple[str, int, int]) -> DataFrame:
        """Rows (with ``_key``) beside ``_maybe``: false where the sketch rules out that the key is marked."""
        found = rows.withColumn("_block", self._block("_key", about[2])).withColumn("_at", self._bits("_key"))
        found = found.join(self._sketches(rows.sparkSession, about), "_block", "left")
        return found.withColumn("_maybe", self._held("_sketch", "_at")).drop("_block", "_at", "_sketch")

    def _absent(self, rows: DataFrame) -> DataFrame:
        """Rows (with ``_key``) that aren't marked."""
        about = self._about(rows.sparkSession)
        if about is None:
            return rows
        looked = self._looked_up(rows, about)
        ids = rows.sparkSession.table(self._table(rows.sparkSession, about, "ids")).select(F.col("key").alias("_key"))
        exact = looked.where("_maybe").join(ids, "_key", "left_anti").select(*rows.columns)
        return looked.where("not _maybe").select(*rows.columns).unionByName(exact)

    # --- what users call ---

    def get(self, spark: SparkSession, node_id: str) -> bool:
        """Whether a node is marked; reads one bucket."""
        ids = self.ids(spark)
        return ids is not None and not ids.where(F.col("key") == (f"{self.prefix}.{node_id}" if self.prefix else node_id)).isEmpty()

    def absent(self, df: DataFrame) -> DataFrame:
        """Rows whose id isn't marked, repeats included; without side effects."""
        return self._absent(df.withColumn("_key", self._key())).drop("_key")

    def set(self, df: DataFrame) -> None:
        """Marks nodes; those marked already are left."""
        spark = df.sparkSession
        about = self._about(spark) or self._first(spark)
        new = df.select(self._key().alias("_key"), "path").where("_key is not null").groupBy("_key").agg(F.min("path").alias("path"))
        rows = _written(self._absent(new))
        self._add(rows, about)

    def _add(self, rows: DataFrame, about: tuple[str, int, int]) -> None:
        spark = rows.sparkSession
        spread = rows.select(self._block("_key", about[2]).alias("block"), F.explode(self._bits("_key")).alias("_at"))
        bits = spread.groupBy("block").agg(F.bitmap_construct_agg("_at").alias("bits"))
        # A task per bucket or less, so that an append adds at most one file to a bucket.
        bits.repartition(about[1], "block").write.insertInto(self._table(spark, about, "sketches"))
        rows.select(F.col("_key").alias("key"), "path").repartition(about[1], "key").write.insertInto(self._table(spark, about, "ids"))

    def filter(self, df: DataFrame) -> DataFrame:
        """Nodes that aren't marked, one per id, which are marked at once. Rows with an error, and nodes without an id, stay.

        What is returned is a written table in the shared folder, so a lost executor can't make it again from a cache that has changed. A node counts
        as cached from now on, also if a later step fails; to run it again, clear the cache.
        """
        spark = df.sparkSession
        is_good = "error is null and id is not null"
        # Ids alone are looked up. Whole rows are shuffled once, by id, or not at all where few ids are new and Spark broadcasts them.
        new = _written(self.absent(df.where(is_good).select("id").distinct()))
        good = sinks.first_wins(df.where(is_good).join(new, "id", "left_semi"))
        kept = _written(good.unionByName(df.where(f"not ({is_good})")).select(df.columns))
        self._add(kept.where(is_good).select(self._key().alias("_key"), "path"), self._about(spark) or self._first(spark))
        return kept

    def rebuild(self, spark: SparkSession, expected: int | None = None, buckets: int | None = None) -> None:
        """Writes the cache anew, for so many ids (by default twice those it has) and buckets, each id once; until that is done readers find the old tables, which stay.

        No one may mark meanwhile.
        """
        about = self._about(spark)
        if about is None:
            return
        rows = _written(self.ids(spark).groupBy(F.col("key").alias("_key")).agg(F.min("path").alias("path")))
        generation = int(about[0].rsplit("/", 1)[1]) + 1
        grown = self._start(generation, buckets or about[1], expected or max(1, 2 * rows.count()))
        self._add(rows, grown)
        self._announce(spark, generation, grown)

    def clear(self, spark: SparkSession) -> None:
        about = self._about(spark)
        for g in range(1, int(about[0].rsplit("/", 1)[1]) + 1 if about else 1):
            for kind in ("ids", "sketches"):
                spark.sql(f"DROP TABLE IF EXISTS {self._name(f'{self.path}/{g:06d}', kind)}")
        sinks.delete(spark, self.path)


def _written(df: DataFrame) -> DataFrame:
    path = fresh_path(df.sparkSession, "cached")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
