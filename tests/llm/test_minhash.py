"""MinHash: groups by brute force on full sets, however tables and cells are cut; odd rows."""

import random
import re

import numpy as np
import pytest

from fernspark.llm import entries, minhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(docs, words=5, percent=85):
    """``id, n_shingles, component_id, kept`` by comparing all pairs of sets of texts."""
    sets = []
    for _, text in docs:
        w = WORD.findall((text or "").encode().lower())
        sets.append(frozenset(b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    unique = sorted({s for s in sets if s}, key=len)
    root = {s: s for s in unique}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(unique):
        for b in unique[:i]:
            if 100 * len(a & b) >= percent * len(a | b) and find(a) is not find(b):
                root[find(b)] = find(a)
    least = {}
    for (i, _), s in zip(docs, sets, strict=True):
        if s and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    out = []
    for (i, _), s in zip(docs, sets, strict=True):
        c = least.get(find(s)) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def planted(seed=1):
    """Copies, near copies at the threshold, a group whose copies are alike only by way of their original, chains, shared passages, odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def changed(words, edits):
        words = list(words)
        for at in rng.sample(range(len(words)), edits):
            words[at] = f"x{rng.random()}"
        return words

    docs = []
    for n in (30, 60, 150, 400):
        for _ in range(8):
            base = text(n)
            docs += [base, base, *[changed(base, e) for e in range(1, 2 + n // 30)]]
    base = text(200)
    docs += [base] + [changed(base, 3) for _ in range(40)]
    step = text(150)
    for _ in range(15):
        docs.append(step)
        step = changed(step, 2)
    passage = text(120)
    docs += [text(100) + passage + text(100) for _ in range(30)]
    docs += [["One", "two"], ["one", "TWO"], ["one", "two", "three"], ["a", "b", "c", "d", "e", "f"], text(5000)]
    docs.append(changed(docs[-1], 60))
    texts = [" ".join(d) for d in docs]
    texts += [None, "", " \t\x0b", "É é", "é é", "one\x1ctwo", texts[0].upper(), texts[1].replace(" ", "\n\t")]
    rng.shuffle(texts)
    rows = [(i * 3 + 2, t) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, rows[7][1]), (None, None), (None, "only here and nowhere else in the table"), (rows[3][0], rows[11][1])]
    return rows


@pytest.mark.parametrize("cell, rows", [(1 << 20, 4096), (700, 7)])
def test_groups_by_brute_force(spark, cell, rows):
    docs = planted()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, node int, sketch string")
    got = minhash.near_duplicates(df, cell=cell, rows=rows)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs)


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, entries.QUERIES["op12_minhash"](spark, sf).collect()), key=repr) == brute(docs)


def test_tables_pair_shared_half_keys():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 32, (1, minhash.HASHES), dtype=np.uint32)
    b = a.copy()
    b[0, 4:] = rng.integers(0, 1 << 32, minhash.HASHES - 4, dtype=np.uint32)  # half keys 0 and 1 of the first collection stay
    b[0, -2:] = a[0, -2:]  # and the last of the second
    ha, hb = minhash.half_keys(a), minhash.half_keys(b)
    assert np.flatnonzero(ha[0] == hb[0]).tolist() == [0, 1, 2 * minhash.HALVES - 1]
    full = np.array([(1 << 2 * minhash.HALVES) - 1])
    (row, ka), (_, kb) = minhash.table_keys(ha, full), minhash.table_keys(hb, full)
    assert len(ka) == minhash.HALVES**2 == len(set(ka.tolist())) and not row.any()
    shared = np.array([0b11 | 1 << 2 * minhash.HALVES - 1])
    assert set(ka.tolist()) & set(kb.tolist()) == set(minhash.table_keys(ha, shared)[1].tolist()) and len(set(ka.tolist()) & set(kb.tolist())) == 2


def test_minhashes_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(400):
        pool = rng.integers(0, 1 << 63, 460, dtype=np.uint64)
        a, b = np.unique(pool[:430]), np.unique(pool[30:])
        agree.append((minhash.sketch(a) == minhash.sketch(b)).mean())
    assert abs(np.mean(agree) - 400 / 460) < 0.01 and min(agree) * minhash.HASHES >= minhash.LEAST_AGREE


def test_links_span_groups_between_homes_and_visitors():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [9], [], [9])]
    every = list(range(6))
    assert minhash.confirm(every, every, sets, np.arange(6), 80) == [(0, 1), (1, 2), (3, 5)]
    assert minhash.confirm([2], [0, 1], sets, np.array([0, 0, 2, 3, 4, 5]), 80) == [(2, 1)]
    assert minhash.confirm(every, every, sets, np.zeros(6, np.int64), 80) == []


def test_empty_tables(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = minhash.near_duplicates(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == [(1, 0, 1, True), (None, 0, None, True)]
