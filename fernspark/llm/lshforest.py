"""Approximate nearest neighbours by a hash-prefix forest (LSH forest): sorted arrays of long hash strings.

A tree is the ascending array of its vectors' hash strings: 64 sign bits of random projections, taken around the sample's mean.
A query descends in every tree to its longest matching prefixes (two binary searches per depth) and ascends in all trees
at once, a bit at a time, until the ranges of equal prefixes hold enough candidates. Candidates are then compared exactly.

The index is parted twice, so that each task has a forest of bounded size and a bounded block of queries. The strings of one more tree, in
order, are cut into ranges; a query goes to the ranges where the sample's vectors nearest to it lie, as many of them as needed. Ranges with more
vectors than a task holds are dealt to several shards, and a query goes to all shards of its ranges.

How many ranges and candidates are needed depends on the vectors alone: those in clusters need few, those spread evenly nearly all. So it is
measured: for a bounded sample of queries the true neighbours in the whole table are found, and with each how far the routing and the ascent must go to reach
it; the smallest numbers that reach the recall wanted are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernspark.llm.common import discard, written

#: Trees of a forest, bits of a hash string.
TREES, DEPTH = 64, 64
#: The recall that routing and ascent are fitted to, and the queries that it is measured with.
RECALL, MEASURED = 0.95, 128
#: The ascent goes on until at least so many candidates, repeats between trees counted.
LEAST = 2000
#: Vectors of a shard and queries of a block, about.
SHARD, BLOCK = 16384, 4096
#: Ranges at most, vectors of the sample in each and at least; the sample is what ranges, mean and routing are fitted on. Everything is indexed.
RANGES, PER_RANGE, LEAST_SAMPLE = 2048, 32, 4096


def planes(dim: int, trees: int = TREES, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((trees * DEPTH, dim))


def strings(x: np.ndarray, normals: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Hash strings as unsigned 64-bit numbers, one row per tree; the first bit of a string is the highest."""
    out = np.empty((len(normals) // DEPTH, len(x)), np.uint64)
    for t in range(len(out)):
        bits = (x - centre) @ normals[t * DEPTH : (t + 1) * DEPTH].T > 0
        out[t] = np.packbits(bits, axis=1).view(">u8")[:, 0]
    return out


def leading(bits: np.ndarray) -> np.ndarray:
    """Leading zero bits of unsigned 64-bit numbers."""
    out = np.zeros(bits.shape, np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        empty = bits >> np.uint64(64 - step) == 0
        out += np.where(empty, step, 0)
        bits = np.where(empty, bits << np.uint64(step), bits)
    return out + (bits == 0)


class Forest:
    """The sorted arrays of one shard."""

    def __init__(self, vectors: np.ndarray, normals: np.ndarray, centre: np.ndarray):
        self.vectors, self.normals, self.centre = vectors, normals, centre
        self.strings = strings(vectors, normals, centre)
        self.order = np.argsort(self.strings, axis=1, kind="stable")
        self.keys = np.take_along_axis(self.strings, self.order, axis=1)

    def ranges(self, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings that share ``depth`` bits with each of ``keys`` begin and end in each tree."""
        mask = np.uint64(((1 << depth) - 1) << (DEPTH - depth)) if depth else np.uint64(0)
        first = keys & mask
        a = np.stack([np.searchsorted(self.keys[t], first[t], "left") for t in range(len(keys))])
        b = np.stack([np.searchsorted(self.keys[t], first[t] | ~mask, "right") for t in range(len(keys))])
        return a, b

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query the rows whose strings share the prefix at which the ascent stopped, in any tree."""
        keys = strings(queries, self.normals, self.centre)
        trees, n = keys.shape
        low, high = np.zeros((trees, n), np.int64), np.full((trees, n), len(self.vectors))
        done = np.zeros(n, bool)
        # Ascending from the longest prefixes; each depth of each tree is a range of its sorted array.
        for depth in range(DEPTH, -1, -1):
            todo = np.flatnonzero(~done)
            if not len(todo):
                break
            a, b = self.ranges(keys[:, todo], depth)
            full = (b - a).sum(axis=0) >= enough
            at = todo[full] if depth else todo
            keep = full if depth else slice(None)
            low[:, at], high[:, at] = a[:, keep], b[:, keep]
            done[at] = True
        hit = np.zeros(len(self.vectors), bool)
        for i in range(n):
            for t in range(trees):
                hit[self.order[t, low[t, i] : high[t, i]]] = True
            yield np.flatnonzero(hit)
            hit[:] = False

    def needed(self, queries: np.ndarray, rows: list[np.ndarray]) -> list[np.ndarray]:
        """For each query and each of its rows the share of the shard that ``enough`` must exceed for the ascent to reach the row."""
        keys = strings(queries, self.normals, self.centre)
        held = np.zeros((DEPTH + 2, len(queries)))  # candidates by depth; beyond the last one none
        for depth in range(DEPTH, -1, -1):
            a, b = self.ranges(keys, depth)
            held[depth] = (b - a).sum(axis=0)
        out = []
        for i, r in enumerate(rows):
            meets = leading(self.strings[:, r] ^ keys[:, i : i + 1]).max(axis=0) if len(r) else np.empty(0, np.int64)
            out.append(held[meets + 1, i] / len(self.vectors))
        return out


def nearest_rows(d: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest distances; equal ones at the end are all kept."""
    return np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))


def search_block(forest: Forest, queries: np.ndarray, k: int, share: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query up to ``k`` nearest candidates' rows and distances; equal distances at the end are all kept."""
    enough = max(least, int(share * len(forest.vectors)) + 1)
    for q, rows in zip(queries, forest.candidates(queries, enough), strict=True):
        d = np.sqrt(((forest.vectors[rows] - q) ** 2).sum(axis=1))
        near = nearest_rows(d, k)
        yield rows[near], d[near]


class Routing:
    """Ranges of one tree's strings, and the sample's vectors in each."""

    def __init__(self, sample: np.ndarray, ranges: int, seed: int):
        self.centre, self.normals = sample.mean(axis=0), planes(sample.shape[1], 1, seed + 1)
        key = strings(sample, self.normals, self.centre)[0]
        ordered = np.sort(key)
        self.bounds = np.unique(ordered[[i * len(ordered) // ranges for i in range(1, ranges)]]) if ranges > 1 else ordered[:0]
        self.sample, self.norms, self.where = sample.astype(np.float32), (sample**2).sum(axis=1).astype(np.float32), self.range_of(sample)

    def range_of(self, vectors: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, strings(vectors, self.normals, self.centre)[0], "right")

    def by_nearness(self, queries: np.ndarray) -> Iterator[np.ndarray]:
        """For each query all ranges that the sample reaches: first those of the nearest sample vectors."""
        for i in range(0, len(queries), 256):
            q = queries[i : i + 256].astype(np.float32)
            for d in self.norms - 2 * (q @ self.sample.T):
                order = self.where[np.argsort(d, kind="stable")]
                seen, first = np.unique(order, return_index=True)
                yield seen[np.argsort(first)]


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of the rows that take part."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    )


def drawn(df: DataFrame, key: str, share: float) -> DataFrame:
    """The rows whose hashed key falls below a share, the same ones each time."""
    return df.where(F.pmod(F.xxhash64(F.lit(5), key), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30))))


_FOUND = [("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("need", pa.float64()), ("nth", pa.int32())]


class Index:
    """The vectors of a table, written once in ranges and shards; any number of query sets can be answered from it."""

    def __init__(self, table: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK, ranges: int = RANGES, seed: int = 7):
        self.spark, self.k, self.id_col, self.vector_col, self.shard, self.block, self.seed = table.sparkSession, k, id_col, vector_col, shard, block, seed
        base = usable(table, id_col, vector_col)
        dims = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        self.dim = dims[0]["d"] if dims else 0
        # -0.0 and 0.0 are equal in a distance; so they are in a key.
        base = base.where(F.size("v") == self.dim).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
        few = base.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
        entries = written(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
        self.n = entries.count()
        if not self.n:
            return
        ranges = max(1, min(ranges, -(-self.n // shard)))
        size = max(LEAST_SAMPLE, ranges * PER_RANGE)
        sample = drawn(entries, "v", 2 * size / self.n).select("v").orderBy(F.xxhash64(F.lit(seed), "v")).limit(size).toArrow()
        self.sent = self.spark.sparkContext.broadcast(Routing(matrix((sample if sample.num_rows else entries.select("v").limit(1).toArrow()).column("v"), self.dim), ranges, seed))
        sent, dim = self.sent, self.dim

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.range_of(matrix(b.column("v"), dim)).astype(np.int32))], [*b.schema.names, "s"])

        stored = written(entries.mapInArrow(placed, "v array<double>, ids array<long>, s int"))
        discard(entries)
        self.shards = {r["s"]: -(-r["count"] // shard) for r in stored.groupBy("s").count().collect()}  # as many rows as ranges
        self.stored = stored.select("s", F.pmod(F.xxhash64("v"), self._of_range(self.shards)).cast("int").alias("part"), "v", "ids")

    @staticmethod
    def _of_range(numbers: dict[int, int]) -> Column:
        return F.create_map(*[F.lit(x) for item in numbers.items() for x in item])[F.col("s")]

    def routed(self, queries: DataFrame) -> DataFrame:
        """``query_id, v, to``: each query with the ranges to go to, nearest first."""
        sent, dim = self.sent, self.dim
        asked = usable(queries, self.id_col, self.vector_col).where(F.size("v") == dim).groupBy(F.col("id").alias("query_id")).agg(F.min("v").alias("v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                order = [x.astype(np.int32) for x in sent.value.by_nearness(matrix(b.column("v"), dim))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(order, pa.list_(pa.int32()))], [*b.schema.names, "to"])

        return written(asked.mapInArrow(run, "query_id long, v array<double>, to array<int>"))

    def _in_cells(self, vectors: DataFrame, queries: DataFrame, by: list[str], look: Callable) -> DataFrame:
        """``query_id, id, score, need, nth`` of what ``look`` finds by forest and queries, a cell of ``by`` a task."""
        sent, dim, k, seed = self.sent, self.dim, self.k, self.seed

        def run(cell: pa.Table) -> pa.Table:
            asks = pa.chunked_array(cell.column("query_id")).is_valid().to_numpy()
            out: list[list] = [[] for _ in _FOUND]
            if asks.any() and not asks.all():
                vectors, who = cell.filter(pa.array(~asks)), cell.filter(pa.array(asks))
                forest = Forest(matrix(vectors.column("v"), dim), planes(dim, seed=seed), sent.value.centre)
                ids, names, nth = vectors.column("ids").to_pylist(), who.column("query_id").to_pylist(), who.column("nth").to_pylist()
                for name, place, (rows, d, need) in zip(names, nth, look(forest, matrix(who.column("v"), dim)), strict=True):
                    found = sorted((x, y, z) for r, x, z in zip(rows.tolist(), d.tolist(), need.tolist(), strict=True) for y in ids[r] if y != name)[:k]
                    for column, values in zip(out, ([name] * len(found), [y for _, y, _ in found], [x for x, _, _ in found], [z for _, _, z in found], [place] * len(found)), strict=True):
                        column.extend(values)
            return pa.table({x: pa.array(c, kind) for (x, kind), c in zip(_FOUND, out, strict=True)})

        null = lambda kind: F.lit(None).cast(kind)
        both = vectors.select(*by, null("long").alias("query_id"), "v", "ids", null("int").alias("nth")).unionByName(queries.select(*by, "query_id", "v", null("array<long>").alias("ids"), "nth"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
        found = both.groupBy(*by).applyInArrow(run, "query_id long, id long, score double, need double, nth int")
        return found.withColumn("rank", rank).where(F.col("rank") <= self.k)

    def fit(self, routed: DataFrame, *, recall: float = RECALL, measured: int = MEASURED) -> tuple[int, float]:
        """Ranges that a query must go to, and the share of a shard that the ascent must exceed, for ``recall`` of the true neighbours.

        About ``measured`` of the queries are compared with every vector; half of what may be missed goes to each of the two.
        """

        def look(forest: Forest, q: np.ndarray) -> Iterator[tuple]:
            d = [np.sqrt(((forest.vectors - x) ** 2).sum(axis=1)) for x in q]
            rows = [nearest_rows(x, self_k + 1) for x in d]
            return ((r, x[r], need) for r, x, need in zip(rows, d, forest.needed(q, rows), strict=True))

        self_k = self.k
        some = drawn(routed, "query_id", measured / max(1, routed.count())).limit(2 * measured)
        some = some.select(F.explode(F.array(*[F.lit(s) for s in sorted(self.shards)])).alias("s"), "query_id", "v", "to").withColumn("part", F.explode(F.sequence(F.lit(0), self._of_range(self.shards) - 1)))
        some = some.withColumn("nth", F.array_position("to", F.col("s")).cast("int"))
        true = self._in_cells(self.stored, some, ["s", "part"], look).select("need", "nth").collect()  # k rows a measured query
        if not true:
            return len(self.shards), float(TREES)
        at = min(len(true) - 1, int(np.ceil((1.0 + recall) / 2 * len(true))))
        return sorted(r["nth"] or len(self.shards) for r in true)[at], sorted(r["need"] for r in true)[at]

    def search(self, routed: DataFrame, probes: int, share: float, *, least: int = LEAST) -> DataFrame:
        """``query_id, rank, <id_col>, score``: the nearest found in the first ``probes`` ranges of each query, the ascent exceeding ``share`` of a shard and ``least``."""

        def look(forest: Forest, q: np.ndarray) -> Iterator[tuple]:
            return ((rows, d, np.zeros(len(rows))) for rows, d in search_block(forest, q, k, share, least))

        k = self.k + 1
        visits = routed.select("query_id", "v", F.posexplode(F.slice("to", 1, probes)).alias("nth", "s"))
        blocks = {r["s"]: -(-r["count"] // self.block) for r in visits.groupBy("s").count().collect()}  # as many rows as ranges
        every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
        left = self.stored.withColumn("blocks", self._of_range(blocks)).where("blocks is not null").withColumn("b", every(F.col("blocks")))
        right = visits.withColumn("part", every(self._of_range(self.shards))).withColumn("b", F.pmod(F.xxhash64("query_id"), self._of_range(blocks)).cast("int"))
        return self._in_cells(left, right, ["s", "part", "b"], look).select("query_id", "rank", F.col("id").alias(self.id_col), "score")


def nearest(table: DataFrame, queries: DataFrame, *, recall: float = RECALL, least: int = LEAST, **how) -> DataFrame:
    """Each query's ``k`` nearest rows of ``table`` found, by Euclidean distance in double precision. ``how``: the parameters of :class:`Index`.

    Both tables have ``<id_col>`` and ``<vector_col>``. Returns ``query_id, rank int`` from 1, ``<id_col>``, ``score double`` (the distance of the
    original vectors), nearest first, ties to the smaller id. A query's own id is never a candidate. Vectors that are null, zero,
    of another length than most, or hold null or non-finite components take no part on either side; so do rows with a null id. Rows with the same id are
    a candidate each; of queries with the same id the smallest vector asks. Fewer candidates than ``k`` in the ranges that a query goes to give fewer rows, and empty tables give none. Other columns aren't read.

    Equal vectors are one entry of the index with their ``k + 1`` smallest ids, which is all that a result can show, so a
    vector with very many copies can't crowd a shard. Mean, ranges and routing are fitted on at most ``max(LEAST_SAMPLE, ranges * PER_RANGE)`` vectors, and what
    reaches ``recall`` is measured with about ``MEASURED`` queries against all vectors; every vector is indexed.
    """
    index = Index(table, **how)
    none = table.sparkSession.createDataFrame([], f"query_id long, rank int, `{index.id_col}` long, score double")
    if not index.n:
        return none
    routed = index.routed(queries)
    if routed.isEmpty():
        return none
    return index.search(routed, *index.fit(routed, recall=recall), least=least)
