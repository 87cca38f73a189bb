"""Filter audit: every order against brute force, chains of one hash, odd rows."""

import re
from itertools import permutations

import pytest

from fernspark.llm import filteraudit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    words = WORD.findall(text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def brute(docs, labels):
    """Rows by applying every filter of every order to a list of documents, one after the other."""
    rows = []
    bad = []
    for i, text, part in docs:
        text = text or ""
        failed = {k for k, v in fails(text).items() if v}
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs):
            failed.add("E")
        bad.append((part or "", failed, any(a == i and q == 1 for a, q, _ in labels if i is not None), any(a == i and t == 1 for a, _, t in labels if i is not None)))
    for part in {b[0] for b in bad}:
        own = [b for b in bad if b[0] == part]
        removed_at = {}
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                here = [b for b in left if x in b[1]]
                gone = [b for b in own if not any(b is y for y in left)]
                left = [b for b in left if x not in b[1]]
                removed_at[order, x] = len(here)
                rows.append([part, "".join(order), step, len(left), len(here), sum(x in b[1] for b in gone), sum(b[1] == {x} for b in own), sum(b[2] for b in here), sum(b[3] for b in here), x])
        for r in rows:
            if r[0] == part:
                r[9] = sum(n for (_, x), n in removed_at.items() if x == r[9]) if isinstance(r[9], str) else r[9]
    return sorted(map(tuple, rows))


LONG = " ".join(f"word{i}" for i in range(120))
DOCS = [
    (3, LONG, "en"), (1, LONG, "de"), (7, LONG, "en"), (7, LONG, "en"), (1, LONG, "de"), (None, LONG, "en"), (None, LONG, None), (5, None, "en"), (2, "", "en"), (9, None, None),
    (10, "AB cd\x0b#", "en"), (11, "a " * 150, ""), (12, LONG + " é x|y", "de"), (13, LONG.upper(), "en"), (14, "a\x85b\x1cc " * 130, "en"), (15, "a " * 150, "en"), (4, LONG.upper(), "en"),
]
LABELS = [(3, 1, 0), (3, 0, 1), (7, 1, 1), (None, 1, 1), (10, None, 1), (12, 0, None), (15, 1, 0), (99, 1, 1)]


@pytest.mark.parametrize("held", [1, 1 << 20])
@pytest.mark.parametrize("tasks", [1, 5])
def test_orders_by_brute_force(spark, held, tasks):
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, lang string, hash string, mask int").repartition(tasks)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    masks = filteraudit.outcomes(docs, held=held)
    assert sorted(tuple(r) for r in filteraudit.audit(masks, labels).collect()) == brute(DOCS, LABELS)
    twins = {i for i, t, _ in DOCS if i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in DOCS)}
    assert {r.id for r in filteraudit.duplicates(masks).collect()} == twins


def test_texts_of_one_hash_stay_apart():
    rows = [(8, "a", 4, "en"), (8, "b", 2, "en"), (8, "a", 3, "de"), (8, "b", 2, "de"), (8, "b", None, "de")]
    one = list(filteraudit._collapsed(rows[:2], [Text_has_a], 1 << 20)) + list(filteraudit._collapsed(rows[2:], [Text_has_a], 1 << 20))
    out = sorted(filteraudit._decided(sorted(one, key=lambda r: r[0]), 2), key=repr)
    assert out == sorted([(3, "de", 1, 1), (4, "en", 3, 1), (2, "en", 0, 1), (2, "de", 0, 1), (None, "de", 0, 1)], key=repr)


def Text_has_a(t):
    return "a" in t.text


def test_long_texts_and_other_filters(spark):
    text = "lorem ipsum " * 900_000  # over SPLIT_AT_ONCE
    assert filteraudit.Text(text).words == (1_800_000, 2)
    docs = spark.createDataFrame([(1, text, "en"), (2, text, "en")], "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in filteraudit.outcomes(docs, tests={"L": lambda t: len(t.text) > 5}).collect()) == [(1, "en", 1, 1), (2, "en", 3, 1)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filteraudit.interactions(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
