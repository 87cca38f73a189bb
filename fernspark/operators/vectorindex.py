"""A stored vector index: lists around coarse centroids, residuals as product-quantised codes, exact reranking.

A vector lies in the list of its nearest centroid, and a code of a byte per subspace tells its residual. A query looks through the lists nearest to it: sums from a
table of its distances to the code words give approximate distances, the best of which are compared by the vectors themselves. How many lists and how
many candidates a search takes is fitted on vectors of the index when it is built, so that the recall aimed at is reached, and can be given.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernspark.operators.retrieval import DEFAULT_TOP_K, METRICS, ranked

#: Vectors that centroids and code books are learned from at most, and vectors that the search is fitted on.
SAMPLE, FITTED_ON = 65_536, 128
#: Rounds of k-means.
ROUNDS = 10
#: Code words of a subspace: a byte.
CODES = 256
#: Rows of a list, and queries, that one task compares, about.
SHARD, BLOCK = 65_536, 1024
#: Rows and queries of candidates that are broadcast at most.
BROADCAST_ROWS = 500_000

STORED = "list int, id long, vector array<float>, code binary"


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centroids of ``x`` by Lloyd's rounds from distinct rows; an empty one moves to the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        label, far = nearest(x, centres)
        order = np.argsort(label, kind="stable")
        n = np.bincount(label, minlength=len(centres))
        full = n > 0
        starts = (np.cumsum(n) - n)[full]
        centres[full] = np.add.reduceat(x[order], starts, axis=0) / n[full][:, None]
        lost = np.flatnonzero(~full)
        centres[lost] = x[np.argsort(-far, kind="stable")[: len(lost)]]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :], 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the squared distance to it, a slice of rows at a time."""
    label, far = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, (1 << 22) // len(centres))
    for i in range(0, len(x), step):
        d = distances(x[i : i + step], centres)
        label[i : i + step] = d.argmin(axis=1)
        far[i : i + step] = d[np.arange(len(d)), label[i : i + step]]
    return label, far


@dataclass(frozen=True)
class Codec:
    """Coarse centroids and a code book per subspace (padded with zeros to a multiple of their number)."""

    centres: np.ndarray
    books: np.ndarray

    @staticmethod
    def learn(x: np.ndarray, lists: int, subspaces: int, seed: int = 0) -> Codec:
        centres = kmeans(x, lists, seed=seed)
        rest = _parts(x - centres[nearest(x, centres)[0]], subspaces)
        books = np.zeros((subspaces, CODES, rest.shape[2]))
        for m in range(subspaces):
            found = kmeans(rest[:, m], CODES, seed=seed + 1 + m)
            books[m, : len(found)] = found
            books[m, len(found) :] = found[0]
        return Codec(centres, books)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each row."""
        label, _ = nearest(x, self.centres)
        rest = _parts(x - self.centres[label], len(self.books))
        return label, np.stack([nearest(rest[:, m], self.books[m])[0] for m in range(len(self.books))], axis=1).astype(np.uint8)

    def approximate(self, query: np.ndarray, label: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of a query to vectors of a list, from their codes."""
        rest = _parts((query - self.centres[label])[None], len(self.books))[0]
        table = ((self.books - rest[:, None]) ** 2).sum(axis=2)
        return table[np.arange(len(self.books)), codes].sum(axis=1)

    def pack(self) -> bytes:
        return json.dumps({"centres": self.centres.tolist(), "books": self.books.tolist()}).encode()

    @staticmethod
    def unpack(data: bytes) -> Codec:
        found = json.loads(data)
        return Codec(np.array(found["centres"]), np.array(found["books"]))


def _parts(x: np.ndarray, n: int) -> np.ndarray:
    """Rows cut into ``n`` equal parts."""
    width = -(-x.shape[1] // n)
    return np.pad(x, ((0, 0), (0, n * width - x.shape[1]))).reshape(len(x), n, width)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


@dataclass
class VectorIndex:
    """An index in a folder; what it has in memory is bounded by its lists and dimension."""

    spark: SparkSession
    path: str
    codec: Codec
    dim: int
    metric: str
    probes: int
    candidates: int

    @staticmethod
    def build(
        vectors: DataFrame, path: str, *, metric: str = "l2", lists: int | None = None, subspaces: int = 16, recall: float = 0.95, k: int = DEFAULT_TOP_K, sample: int = SAMPLE, key: str = "id", vector: str = "embedding"
    ) -> VectorIndex:
        """Learns from a sample of at most ``sample`` vectors and stores all; ``lists`` is about the root of their number by default, at most 4096.

        Vectors take part that have the most frequent length and finite entries only, and for cosine aren't zero; they count as scaled to length 1 there. ``metric``: l2, cosine
        or cosine_distance. The sample is drawn by a hash of key and vector, so it is the same again. ``probes`` and ``candidates`` are the smallest powers of two, or everything, that
        find ``recall`` of the ``k`` nearest of about ``FITTED_ON`` vectors of the sample among all.
        """
        if metric not in ("l2", "cosine", "cosine_distance"):
            raise ValueError("metrics are l2, cosine and cosine_distance")
        spark = vectors.sparkSession
        size = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        if size is None:
            raise ValueError("no vectors")
        dim, n = size
        rows = _usable(vectors, key, vector, dim, metric)
        drawn = rows.where(F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30)).limit(2 * sample)
        got = drawn.select("id", "vector").toArrow()
        if not got.num_rows:
            raise ValueError("no vectors")
        x = _scaled(_matrix(got.column("vector").combine_chunks(), dim), metric)
        codec = Codec.learn(x, lists or max(1, min(4096, round(n**0.5))), min(subspaces, dim))
        _one_file(spark, f"{path}/codec", codec.pack())
        index = VectorIndex(spark, path, codec, dim, metric, 1, k)
        index.add(rows, key="id", vector="vector")
        index._fit(got.slice(0, FITTED_ON), recall, k)
        _one_file(spark, f"{path}/settings", json.dumps({"dim": dim, "metric": metric, "probes": index.probes, "candidates": index.candidates}).encode())
        return index

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        settings = json.loads(spark.read.parquet(f"{path}/settings").first()[0])
        codec = Codec.unpack(bytes(spark.read.parquet(f"{path}/codec").first()[0]))
        return VectorIndex(spark, path, codec, settings["dim"], settings["metric"], settings["probes"], settings["candidates"])

    def add(self, vectors: DataFrame, *, key: str = "id", vector: str = "embedding") -> None:
        """Appends vectors to their lists; nothing that is stored is read or written again. Those of another length or with entries that aren't finite are left out."""
        sent, dim, metric = self.spark.sparkContext.broadcast(self.codec), self.dim, self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 4096):
                    part = batch.slice(i, 4096)
                    label, code = sent.value.encode(_scaled(_matrix(part.column("vector"), dim), metric))
                    yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), part.column("id"), part.column("vector"), pa.array([c.tobytes() for c in code], pa.binary())], ["list", "id", "vector", "code"])

        coded = _usable(vectors, key, vector, dim, metric).mapInArrow(run, STORED)
        # By range of list and id, so a list that many vectors lie in is several partitions and files.
        coded.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.mode("append").partitionBy("list").parquet(f"{self.path}/lists")

    def stored(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, k: int = DEFAULT_TOP_K, *, probes: int | None = None, candidates: int | None = None, vector: str = "embedding", digits: int | None = None) -> DataFrame:
        """``qid, id, score, rank``: the nearest vectors found; scores are exact, ties go to the smaller id. Queries that couldn't be in the index have no rows."""
        asked = _usable(queries, "qid", vector, self.dim, self.metric).select(F.col("id").alias("qid"), F.col("vector").alias("q")).persist()
        found = self._candidates(asked, probes or self.probes, max(k, candidates or self.candidates))
        measure, larger = METRICS[self.metric]
        small = asked.count() <= BROADCAST_ROWS
        near = found.join(F.broadcast(asked) if small else asked, "qid")
        exact = self.stored().select("list", "id", "vector").join(near, ["list", "id"]).select("qid", "id", measure("vector", "q").alias("score"))
        if digits is not None:
            exact = exact.withColumn("score", F.round("score", digits))
        return ranked(exact, k, larger=larger)

    def _candidates(self, asked: DataFrame, probes: int, keep: int) -> DataFrame:
        """``qid, list, id``: the ``keep`` best of each query by approximate distance in its ``probes`` nearest lists.

        A list's rows and the queries that look into it are dealt to cells of about ``SHARD`` by ``BLOCK``, a bounded task each.
        """
        sent, dim, metric = self.spark.sparkContext.broadcast(self.codec), self.dim, self.metric

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = distances(_scaled(_matrix(batch.column("q"), dim), metric), sent.value.centres)
                    most = min(probes, d.shape[1])
                    at = np.argpartition(d, most - 1, axis=1)[:, :most]
                    row = np.repeat(np.arange(len(d)), most)
                    yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(row)), pa.array(at.ravel().astype(np.int32)), batch.column("q").take(pa.array(row))], ["qid", "list", "q"])

        looks = asked.mapInArrow(lists, "qid long, list int, q array<float>")
        rows = self.stored().select("list", "id", "code")
        sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
        crowds = looks.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        shape = F.broadcast(sizes.join(crowds, "list"))  # a row per list
        mine = lambda what, k: F.pmod(F.xxhash64(what), F.col(k)).cast("int")
        every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
        null = lambda kind: F.lit(None).cast(kind)
        left = rows.join(shape, "list").select("list", mine("id", "shards").alias("s"), every("blocks").alias("b"), "id", "code", null("long").alias("qid"), null("array<float>").alias("q"))
        right = looks.join(shape, "list").select("list", every("shards").alias("s"), mine("qid", "blocks").alias("b"), null("long").alias("id"), null("binary").alias("code"), "qid", "q")

        def compare(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            is_row = table.column("id").is_valid()
            have, asks = table.filter(is_row), table.filter(pc.invert(is_row))
            q, at, far = [], [], []
            if have.num_rows and asks.num_rows:
                codes = np.frombuffer(b"".join(have.column("code").to_pylist()), np.uint8).reshape(have.num_rows, -1)
                label = have.column("list")[0].as_py()
                for i, v in enumerate(_scaled(_matrix(asks.column("q").combine_chunks(), dim), metric)):
                    d = sent.value.approximate(v, label, codes)
                    best = np.arange(len(d)) if len(d) <= keep else np.argpartition(d, keep - 1)[:keep]
                    q.append(np.full(len(best), i)), at.append(best), far.append(d[best])
            take = lambda column, where: column.take(pa.array(np.concatenate(where) if where else np.empty(0, np.int64), pa.int64()))
            return pa.table({"qid": take(asks.column("qid"), q), "list": take(have.column("list"), at), "id": take(have.column("id"), at), "far": pa.array(np.concatenate(far) if far else [], pa.float64())})

        found = left.unionByName(right).groupBy("list", "s", "b").applyInArrow(compare, "qid long, list int, id long, far double")
        return ranked(found, keep, larger=False, score="far").select("qid", "list", "id")

    def _fit(self, some: pa.Table, recall: float, k: int) -> None:
        """Sets ``probes`` and ``candidates``: all sizes at once on about ``FITTED_ON`` vectors and every stored one, in one job."""
        x = _scaled(_matrix(some.column("vector").combine_chunks(), self.dim), self.metric)
        sent, metric, dim = self.spark.sparkContext.broadcast((self.codec, x)), self.metric, self.dim
        order = np.argsort(np.argsort(distances(x, self.codec.centres), axis=1), axis=1)  # the rank of each list for each query
        sent_order = self.spark.sparkContext.broadcast(order)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                label = batch.column("list").to_numpy()
                v = _scaled(_matrix(batch.column("vector"), dim), metric)
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(v), -1) if len(v) else np.empty((0, 1), np.uint8)
                codec, asks = sent.value
                for i, q in enumerate(asks):
                    exact = distances(q[None], v)[0]
                    near = np.empty(len(v))
                    for one in np.unique(label):
                        near[label == one] = codec.approximate(q, int(one), codes[label == one])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(v), i, np.int32)), batch.column("id"), pa.array(exact), pa.array(near), pa.array(sent_order.value[i][label].astype(np.int32))], ["qid", "id", "exact", "near", "turn"]
                    )

        every = self.stored().select("list", "id", "vector", "code").mapInArrow(run, "qid int, id long, exact double, near double, turn int")
        best = ranked(every, k, larger=False, score="exact").select("qid", "id", "near", "turn").toPandas()  # k rows a query
        probes = _least(best["turn"].to_numpy() + 1, recall + (1 - recall) / 2, len(self.codec.centres))
        # How many vectors of the lists looked into are nearer by their codes than each of these.
        edges = self.spark.createDataFrame(best[best["turn"] < probes][["qid", "near"]].astype({"qid": "int32"}), "qid int, edge double")
        ahead = every.where(F.col("turn") < probes).join(F.broadcast(edges), "qid").where("near < edge").groupBy("qid", "edge").agg(F.count("*").alias("n"))
        n = ahead.toPandas()["n"].to_numpy() + 1
        seen = np.concatenate([n, np.ones(max(0, int((best["turn"] < probes).sum()) - len(n)))])
        self.probes, self.candidates = probes, max(k, _least(seen, min(1.0, recall * len(best) / max(1, len(seen))), 1 << 40))


def _least(values: np.ndarray, share: float, most: int) -> int:
    """The smallest power of two, or ``most``, that at least ``share`` of the values don't exceed."""
    size = 1
    while size < most and (values <= size).mean() < share:
        size *= 2
    return min(size, most)


def _usable(vectors: DataFrame, key: str, vector: str, dim: int, metric: str) -> DataFrame:
    v = F.col(vector).cast("array<float>")
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    rows = vectors.where(F.col(key).isNotNull() & (F.size(v) == dim) & finite)
    rows = rows if metric == "l2" else rows.where(F.exists(v, lambda c: c != 0))
    return rows.select(F.col(key).cast("long").alias("id"), v.alias("vector"))


def _scaled(x: np.ndarray, metric: str) -> np.ndarray:
    return x if metric == "l2" else x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _one_file(spark: SparkSession, path: str, data: bytes) -> None:
    spark.createDataFrame([(bytearray(data),)], "data binary").coalesce(1).write.parquet(path)
