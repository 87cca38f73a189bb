"""Whitening: exact integers against Python's, scores against numpy, odd vectors."""

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from fernspark.llm import entries, whitening


def brute(rows, components):
    """``id, component, n, deviation, whitened, explained`` by whole-table numpy on exact integers."""
    ok = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(c) < 2.0**55 for c in v)]
    dims = sorted({len(v) for _, v in ok}, key=lambda d: (-sum(len(v) == d for _, v in ok), d))
    ok = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in ok if len(v) == dims[0]] if dims else []
    if not ok:
        return []
    n, d = len(ok), dims[0]
    s = [sum(x[j] for _, x in ok) for j in range(d)]
    cov = np.array([[float(Fraction(n * sum(x[a] * x[b] for _, x in ok) - s[a] * s[b], n * n)) for b in range(d)] for a in range(d)])
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    out = []
    for i, x in ok:
        centred = np.array([float(Fraction(n * x[j] - s[j], n)) for j in range(d)])
        for k in range(min(components, d)):
            firm = e[k] > e[0] * d * np.finfo(float).eps
            out.append((i, k + 1, n, sum((n * x[j] - s[j]) ** 2 for j in range(d)), abs(float(centred @ q[:, k]) / math.sqrt(e[k])) if firm else None, max(e[k], 0) / np.trace(cov) if np.trace(cov) > 0 else None))
    return out


def rows_of(spark, rows, components=32, partitions=4):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cells string, n int").repartition(partitions)
    fit = whitening.fit(df, components=components)
    if fit is None:
        return [], None
    got = []
    for r in fit.transform(df).collect():
        got += [(r.vec_id, k, fit.n, int(r.deviation), None if w is None else abs(w), fit.explained[k - 1]) for k, w in enumerate(r.whitened, 1)]
    return got, fit.identity_error(df)


def same(got, want, tolerance=1e-8):
    key = lambda r: (r[0] if r[0] is not None else -1, r[1], r[3])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want, strict=True):
        assert (g[4] is None) == (w[4] is None) and (g[4] is None or abs(g[4] - w[4]) <= tolerance * max(1, abs(w[4]))), (g, w)
        assert (g[5] is None) == (w[5] is None) and (g[5] is None or abs(g[5] - w[5]) <= 1e-6 * max(w[5], 1e-9)), (g, w)


def test_scores_by_brute_force(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(6, 6)) * np.array([9, 5, 3, 1, 0.5, 0.3])[:, None]
    rows = [(i, (rng.normal(size=6) @ mix).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [math.nan] + [0.0] * 5), (904, [math.inf] + [0.0] * 5), (905, [1.0, 2.0]), (906, [0.0] * 6), (907, [1e300] + [0.0] * 5)]
    got, error = rows_of(spark, rows)
    same(got, brute(rows, 32))
    assert len(got) == 303 * 6 and error < 1e-9


def test_large_integers_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(int(v)) for v in rng.integers(-(2**50), 2**50, 3)]) for i in range(40)]
    got, error = rows_of(spark, rows)
    assert {(g[0], g[3]) for g in got} == {(w[0], w[3]) for w in brute(rows, 3)} and error < 1e-6  # deviations beyond a long


def test_few_and_repeated_vectors(spark):
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [1.0, 2.0, 5.0]), (2, [3.0, 2.0, 1.0]), (2, [3.0, 2.0, 1.0])]):
        got, error = rows_of(spark, rows, components=2)
        same(got, brute(rows, 2))
        assert error is None or error < 1e-9


def test_a_third_in_one_place_and_small_spread_on_a_large_mean(spark):
    rows = [(i, [5e9, 5e9 + (i % 3) / 64] if i % 3 else [5e9 + 1 / 64, 5e9]) for i in range(90)]
    got, error = rows_of(spark, rows)
    same(got, brute(rows, 32))
    assert error < 1e-9


def test_residues_give_the_integers_back():
    rng = np.random.default_rng(6)
    values = [0, 1, -1, 10**40, -(10**40), *[int(v) for v in rng.integers(-(2**62), 2**62, 20)]]
    moduli = whitening.primes(10**40)
    parts = np.array([[v % p for v in values] for p in moduli])
    assert whitening.reconstructed(parts, moduli).tolist() == values
    assert all(p < 1 << 20 and all(p % q for q in range(2, 1024)) for p in moduli)


def test_query(spark, sf):
    got = entries.QUERIES["op11_whitening"](spark, sf)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.limit(10**6).collect()], 32)
    rows = [(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got.collect()]
    same(rows, want)
    assert got.agg(F.countDistinct("identity_error"), F.max("identity_error")).first()[0] == 1 and got.first().identity_error < 1e-9


def test_empty_table(spark):
    assert whitening.fit(spark.createDataFrame([], "vec_id long, embedding array<float>")) is None
