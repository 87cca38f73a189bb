"""Whitening of embeddings from an exact scatter matrix.

Entries become integers. Their scatter is summed modulo several primes below 2^20: residues are so small that a matrix product of 2^14 rows in
doubles is exact, and so are sums modulo a prime, in whatever order tasks end. The Chinese remainder theorem gives the sums as integers, from which the covariance
is rounded once, entry by entry; large means cancel nothing. Only matrices of the dimension, never rows, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernspark.llm.common import slices

SCALE, SHIFT = 64, 1_000_000
#: Entries at least this large in absolute value have no integer that fits a long with room to spare; they count as not finite.
LARGEST = 2.0**55
PRIMES_BELOW, GEMM_ROWS = 1 << 20, 1 << 14
#: Partial sums are added up in so many groups first.
SALTS = 64
#: Bytes of vectors worked on at a time.
BATCH_BYTES = 8 << 20


def usable(vec: Column) -> Column:
    """Whether a vector has entries and all of them are finite numbers below ``LARGEST``."""
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False))), F.lit(False))


def primes(bound: int) -> list[int]:
    """The largest primes below ``PRIMES_BELOW`` whose product exceeds twice ``bound``, so that residues tell all integers up to ``bound`` in absolute value apart."""
    sieve = np.ones(PRIMES_BELOW, bool)
    sieve[:2] = False
    for i in range(2, int(PRIMES_BELOW**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    found, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > 2 * bound:
            return found
        found.append(p)
        product *= p
    raise ValueError("the sums are too large for the primes")


def matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their vectors ``_v`` as a matrix of integers."""
    for batch in batches:
        for part in slices(batch, "_v", most_rows=max(1, min(GEMM_ROWS, BATCH_BYTES // (8 * dim))), sizes=np.zeros(batch.num_rows)):
            column = part.column("_v")
            flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), dim)
            yield part, np.floor(SCALE * flat).astype(np.int64) + SHIFT


def residues(batches: Iterator[pa.RecordBatch], dim: int, moduli: list[int]) -> Iterator[pa.RecordBatch]:
    """A task's products of ``[1, x]`` with itself modulo each prime: a row per prime and row of the matrix."""
    total = np.zeros((len(moduli), dim + 1, dim + 1), np.int64)
    for _, x in matrices(batches, dim):
        one = np.ones((len(x), 1), np.int64)
        for k, p in enumerate(moduli):
            r = np.concatenate([one, x], axis=1) % p
            r = np.where(r > p // 2, r - p, r).astype(np.float64)  # at most 2^19, so a product of 2^14 rows is at most 2^52
            total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
    salt = TaskContext.get().partitionId() % SALTS
    for k in range(len(moduli)):
        cells = pa.ListArray.from_arrays(pa.array(np.arange(dim + 2, dtype=np.int32) * (dim + 1)), pa.array(total[k].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dim + 1, k, np.int32)), pa.array(np.arange(dim + 1, dtype=np.int32)), pa.array(np.full(dim + 1, salt, np.int32)), cells], ["prime", "line", "salt", "cells"])


def reconstructed(parts: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Integers, as Python's, from their residues along the first axis; those over half the product are negative."""
    product = reduce(lambda a, b: a * b, moduli, 1)
    value = sum(((r.astype(object) * (product // p)) * pow(product // p, -1, p) for p, r in zip(moduli, parts, strict=True)), np.zeros(parts.shape[1:], object))
    value = value % product
    return np.where(value > product // 2, value - product, value)


@dataclass
class Whitening:
    """A fit: number of vectors, sums of their integers, eigenvalues in falling order and their unit vectors as columns."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float
    vec_col: str

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def firm(self) -> np.ndarray:
        """Which components have an eigenvalue beyond rounding; the others have no scale to divide by."""
        return self.eigenvalues > max(self.eigenvalues[:1].tolist() + [0.0]) * self.dim * np.finfo(float).eps

    @property
    def explained(self) -> list[float | None]:
        return [max(e, 0.0) / self.trace if self.trace > 0 else None for e in self.eigenvalues.tolist()]

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Integers less the whole part of the mean, the remainders, and ``x - S / n`` rounded once."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        y = x - whole
        return y, rest, y - rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Scores of the components; NaN where a component isn't firm."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.centred(x)[2] @ self.vectors / np.where(self.firm, np.sqrt(np.abs(self.eigenvalues)), np.nan)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The exact sum over dimensions of ``(n * x - S)^2``; null from 10^38 on."""
        y, rest, _ = self.centred(x)
        if self.dim * (self.n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 < 1 << 63:
            return pa.array(((self.n * y - rest) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        t = self.n * y.astype(object) - rest.astype(object)
        return pa.array([Decimal(v) if v < 10**38 else None for v in (t * t).sum(axis=1).tolist()], pa.decimal128(38, 0))

    def transform(self, vectors: DataFrame, *, id_col: str = "vec_id") -> DataFrame:
        """``<id_col>, deviation decimal(38,0), whitened array<double>`` (by component) of each row of ``vectors`` that was fitted or could have been."""
        src = _valid(vectors, self.vec_col, self.dim, id_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x in matrices(batches, self.dim):
                w = self.whitened(x)
                scores = pa.array(w.ravel(), mask=np.isnan(w).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), scores)
                yield pa.RecordBatch.from_arrays([part.column(id_col), self.deviation(x), lists], [id_col, "deviation", "whitened"])

        return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")

    def identity_error(self, vectors: DataFrame) -> float | None:
        """The largest absolute entry of the scores' covariance less the identity, over firm components; null without any.

        Each task centres its own scores and hands on a count, means and a scatter matrix, which are merged as partial variances are.
        """
        if not self.firm.any():
            return None
        k = int(self.firm.sum())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = _Moments(k)
            for _, x in matrices(batches, self.dim):
                w = self.whitened(x)[:, self.firm]
                mean = w.mean(axis=0)
                state.add(len(w), mean, (w - mean).T @ (w - mean))
            yield state.row(TaskContext.get().partitionId() % SALTS)

        def merged(table: pa.Table) -> pa.Table:
            state = _Moments.of(table, k)
            return pa.Table.from_batches([state.row(table.column("salt")[0].as_py())])

        schema = "salt int, n long, mean binary, scatter binary"
        parts = _valid(vectors, self.vec_col, self.dim).mapInArrow(run, schema).groupBy("salt").applyInArrow(merged, schema)
        state = _Moments.of(parts.toArrow(), k)
        return float(np.abs(state.scatter / state.n - np.eye(k)).max())


class _Moments:
    """Count, means and centred scatter of rows, merged pairwise."""

    def __init__(self, k: int):
        self.n, self.mean, self.scatter = 0, np.zeros(k), np.zeros((k, k))

    @classmethod
    def of(cls, table: pa.Table, k: int) -> _Moments:
        state = cls(k)
        for r in table.to_pylist():
            state.add(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["scatter"]).reshape(k, k))
        return state

    def add(self, n: int, mean: np.ndarray, scatter: np.ndarray) -> None:
        if n:
            apart = mean - self.mean
            both = self.n + n
            self.scatter = self.scatter + scatter + np.outer(apart, apart) * (self.n * n / both)
            self.mean = self.mean + apart * (n / both)
            self.n = both

    def row(self, salt: int) -> pa.RecordBatch:
        binary = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([salt], pa.int32()), pa.array([self.n], pa.int64()), binary(self.mean), binary(self.scatter)], ["salt", "n", "mean", "scatter"])


def _valid(vectors: DataFrame, vec_col: str, dim: int | None = None, *more: str) -> DataFrame:
    """The rows that take part: the columns ``more`` and the vector as doubles, ``_v``."""
    rows = vectors.where(usable(vectors[vec_col])) if dim is None else vectors.where(usable(vectors[vec_col]) & (F.size(vectors[vec_col]) == dim))
    return rows.select(*[vectors[c] for c in more], vectors[vec_col].cast("array<double>").alias("_v"))


def fit(vectors: DataFrame, *, components: int = 32, vec_col: str = "embedding") -> Whitening | None:
    """The whitening of all vectors of the table; null if it has none that takes part.

    An entry c counts as the integer ``floor(64 * c) + 1000000``. Vectors that are null or empty, or have a null entry, one that isn't finite or one of ``LARGEST``
    or more, take no part; nor do vectors of another length than the most frequent one (of equally frequent ones the shorter). Repeated rows count
    each. Components whose eigenvalue is zero but for rounding (repeated or few vectors) come last and have null scores.

    Three passes over the vectors, none of which shuffles them: their number and largest entry, which tell how many primes are needed; products modulo each prime; and, for
    :meth:`Whitening.identity_error`, the covariance of the scores.
    """
    found = (
        _valid(vectors, vec_col)
        .groupBy(F.size("_v").alias("dim"))
        .agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("_v", F.abs))).alias("most"))
        .orderBy(F.desc("n"), "dim")
        .first()
    )
    if found is None:
        return None
    dim, n, most = found["dim"], found["n"], int(SCALE * found["most"]) + 1 + SHIFT
    moduli = primes(n * most * most)

    def added(table: pa.Table) -> pa.Table:
        width = dim + 1
        cells = pc.list_flatten(table.column("cells").combine_chunks()).to_numpy().reshape(-1, width)
        total = cells.sum(axis=0) % moduli[table.column("prime")[0].as_py()]
        return table.slice(0, 1).set_column(3, "cells", pa.array([total], pa.list_(pa.int64())))

    schema = "prime int, line int, salt int, cells array<long>"
    parts = _valid(vectors, vec_col, dim).mapInArrow(lambda it: residues(it, dim, moduli), schema)
    sums = parts.groupBy("prime", "line", "salt").applyInArrow(added, schema).groupBy("prime", "line").applyInArrow(added, schema).toArrow()
    cells = np.zeros((len(moduli), dim + 1, dim + 1), np.int64)
    cells[sums.column("prime").to_numpy(), sums.column("line").to_numpy()] = np.array(sums.column("cells").to_pylist())
    total = reconstructed(cells, moduli)
    n, s = total[0, 0], total[0, 1:]
    covariance = ((n * total[1:, 1:] - np.outer(s, s)) / (n * n)).astype(np.float64)  # of integers of any size, rounded once
    values, vecs = np.linalg.eigh(covariance)
    k = min(components, dim)
    return Whitening(int(n), [int(v) for v in s], values[::-1][:k].copy(), vecs[:, ::-1][:, :k].copy(), float(np.trace(covariance)), vec_col)
