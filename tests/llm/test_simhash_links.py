"""SimHash: no link is lost whatever the cells, in either way of sharing out the threshold; one row of each group stays."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernspark.llm import simhash
from fernspark.llm.common import components, temporary_tables, written


def signed(x):
    return int(np.uint64(x).view(np.int64))


def brute_groups(prints):
    """Each fingerprint's group within 4 bits, as a set of sets."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    groups = defaultdict(set)
    for p in prints:
        groups[find(p)].add(signed(p))
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def planted():
    rng = np.random.default_rng(11)
    prints = []
    for s in rng.integers(0, 1 << 63, 60, dtype=np.uint64).tolist():
        prints.append(s)
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False).tolist():
            s ^= 1 << b
        prints.append(s)
    crowd = int(rng.integers(0, 1 << 63, dtype=np.uint64))  # many in one anchor
    for _ in range(60):
        s = crowd
        for b in rng.choice(64, int(rng.integers(1, 8)), replace=False).tolist():
            s ^= 1 << b
        prints.append(s)
    return prints


@pytest.mark.parametrize("products", [False, True])
@pytest.mark.parametrize("cell", [1, 3, 7, 8192])
def test_no_link_is_lost(spark, cell, products):
    prints = planted()
    fps = spark.createDataFrame([(signed(p),) for p in set(prints)], "fp long")
    found = defaultdict(set)
    for r in components(simhash.links(fps, cell=cell, products=products)).collect():
        found[r.root].add(r.node)
    assert {frozenset(g) for g in found.values()} == brute_groups(prints)


def test_crowded_anchors_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(simhash, "HOT_SHARE", 0.01)
    prints = planted()
    fps = spark.createDataFrame([(signed(p),) for p in set(prints)], "fp long")
    found = defaultdict(set)
    for r in components(simhash.links(fps, cell=3)).collect():
        found[r.root].add(r.node)
    assert {frozenset(g) for g in found.values()} == brute_groups(prints)


def test_near_anchors():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 40)
    homes = np.unique(simhash.near_golay(np.arange(0, 1 << 23, 37))[0][1])
    assert len(homes) == 4096
    near = simhash.near_golay(words)
    for i, w in enumerate(words.tolist()):
        d = np.bitwise_count(homes ^ w)
        for anchors, at in zip(near, ((0, 1, 2, 3), (4,), (5,)), strict=True):
            assert sorted(anchors[1][anchors[0] == i].tolist()) == sorted(homes[np.isin(d, at)].tolist())
    homes = np.unique(simhash.near_hamming(np.arange(1 << 18))[0][1])
    assert len(homes) == 1 << 14
    words = rng.integers(0, 1 << 18, 40)
    near = simhash.near_hamming(words)
    low = (1 << 15) - 1
    for i, w in enumerate(words.tolist()):
        d, e = np.bitwise_count((homes ^ w) & low), np.bitwise_count((homes ^ w) >> 15)
        assert homes[(d <= 1) & (e == 0)].tolist() == [near[0][1][i]]
        assert sorted(near[1][1][near[1][0] == i].tolist()) == sorted(homes[((d == 2) & (e == 0)) | ((d <= 1) & (e == 1))].tolist())


@pytest.mark.parametrize("products", [False, True])
def test_any_pair_within_four_bits_meets(products):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, 4, replace=False).tolist():
            y[i] ^= np.uint64(1 << b)
    row, anchor, home = simhash.anchors(x, products=products)
    homes = set(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
    row, anchor, _ = simhash.anchors(y, products=products)
    met = {r for r, a in zip(row.tolist(), anchor.tolist(), strict=True) if (r, a) in homes}
    assert len(met) == len(x)


def test_one_row_of_each_group_stays(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven", "alpha beta gamma delta"
    rows = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (3, a, "y"), (1, a, "x"), (1, a, "z"), (5, c, None), (2, c, "x"), (None, a, "n"), (7, None, "q"), (8, "", "q")]
    docs = spark.createDataFrame([(*r, {"m": "1"}, r[0]) for r in rows], "doc_id long, text string, fp string, component_id map<string,string>, _a long")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "", r.fp) for r in kept.collect())
    assert [(d, t) for d, t, _ in got] == [(0, a), (1, a), (1, b), (2, c), (7, "")] and got[1][2] in ("x", "z") and got[3][2] == "x"
    assert sorted((r.doc_id or 0, r.text or "", r.fp) for r in simhash.keep_first(docs.orderBy(F.desc("fp"))).collect()) == got  # the choice is not by order
    assert simhash.keep_first(docs.limit(0)).collect() == [] and simhash.keep_first(docs.limit(0)).columns == docs.columns


def test_keep_first_by_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 40, f"word{i % 50} " * 6) for i in range(300)], "doc_id long, text string")
    want = sorted(map(tuple, simhash.keep_first(docs).collect()))
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(simhash, "HOT_SHARE", 0.01)
    assert sorted(map(tuple, simhash.keep_first(docs).collect())) == want and len({t for _, t in want}) == len(want) == 50


def test_temporary_tables_go(spark, tmp_path):
    import os

    df = spark.range(5)
    with temporary_tables() as made:
        t = written(df)
        path = t._fernspark_path.removeprefix("file://")
        assert os.path.exists(path) and len(made) == 1
    assert not os.path.exists(path)
    with temporary_tables() as made:
        t = written(df)
        made.remove(t)
    assert t.count() == 5
