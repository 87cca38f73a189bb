"""Topological order of tool calls: chains, tangles, cycles, both ways of sorting, against a plain search."""

import random

import pytest

from fernspark.llm import entries, toolcalls

PLACES = toolcalls.PLACES


def brute_keys(calls):
    """(conv, call) -> order_key; calls: (conv, turn, index, id, needs) with each id once in a conversation."""
    place = {(c, i): t * PLACES + k for c, t, k, i, _ in calls}
    needs = {(c, i): [(c, n) for n in dict.fromkeys(after or []) if (c, n) in place] for c, _, _, i, after in calls}
    key: dict = {}
    while True:
        ready = [x for x in place if x not in key and all(n in key for n in needs[x])]
        if not ready:
            return {x: key.get(x) for x in place}
        for x in ready:
            key[x] = max([place[x]] + [key[n] + 1 for n in needs[x]])


def keys(spark, calls):
    table = spark.createDataFrame([(c, t, k, i, "t", "{}", a) for c, t, k, i, a in calls], toolcalls.CALL)
    rows = toolcalls.link(table, spark.createDataFrame([], toolcalls.RESULT), {"t": {}}).collect()
    return {(r.conv_id, r.call_id): r.order_key for r in rows}


def tangles():
    rng = random.Random(4)
    calls = [(1, t, 0, f"c{t}", [f"c{t + 1}"] if t < 299 else []) for t in range(300)]  # every call needs the next
    calls += [(2, t, 0, f"c{t}", [f"c{t - 1}"] if t else []) for t in range(50)]  # every call needs the one before
    calls += [(3, 0, 0, "a", ["b"]), (3, 1, 0, "b", ["c"]), (3, 2, 0, "c", ["a"]), (3, 3, 0, "d", ["c"]), (3, 4, 0, "e", ["gone"]), (3, 5, 0, "f", ["f"]), (3, 6, 1, "g", ["h", "e", "h"]), (3, 6, 2, "h", None)]
    for conv in range(4, 30):  # the same identifiers in each
        n = rng.randrange(1, 12)
        calls += [(conv, t // 2, t % 2, f"c{t}", [f"c{rng.randrange(n)}" for _ in range(rng.randrange(3))]) for t in range(n)]
    return calls


@pytest.mark.parametrize("most", [2048, 5, 0])
def test_order_keys(spark, monkeypatch, most):
    calls = tangles()
    if most < 2048:  # a round of jobs per call of a chain
        calls = [c for c in calls if c[0] != 1 or c[1] >= 294]
    monkeypatch.setattr(toolcalls.order_keys, "__defaults__", (most,))
    want = brute_keys(calls)
    assert keys(spark, calls) == want and None in want.values()
    for c, t, k, i, _ in calls:
        if c == 2:
            assert want[c, i] == t * PLACES + k


def test_a_chain_of_two_thousand(spark):
    n = 1000  # calls and as many needs
    calls = [(1, t, 0, f"c{t}", [f"c{t + 1}"] if t < n - 1 else []) for t in range(n)]
    assert keys(spark, calls) == brute_keys(calls)


def test_duplicates_keep_their_place(spark):
    calls = spark.createDataFrame(
        [(1, 0, 0, "a", "t", "{}", ["b"]), (1, 3, 0, "a", "t", "{}", []), (1, 2, 0, "b", "t", "{}", ["c"]), (1, None, 0, "c", "t", "{}", []), (1, 4, 0, None, "t", "{}", ["a"])], toolcalls.CALL
    )
    got = {(r.call_id, r.turn): (r.order_key, r.status) for r in toolcalls.link(calls, spark.createDataFrame([], toolcalls.RESULT), {"t": {}}).collect()}
    assert got[("a", 3)] == (3 * PLACES, "duplicate") and got[(None, 4)] == (4 * PLACES, "unnamed") and len(got) == 5


def test_very_long_arguments_and_results(spark):
    text = "é" * 2_000_000
    calls = spark.createDataFrame([(1, 0, 0, "a", "reply", '{"prompt":"' + text + '","turn":0}', [])], toolcalls.CALL)
    results = spark.createDataFrame([(1, 1, "a", text), (1, 2, "a", text + "x")], toolcalls.RESULT)
    rows = toolcalls.link(calls, results, {"reply": entries.REPLY}, extras=True).collect()
    assert sorted(r.status for r in rows) == ["extra", "linked"] and all(len(r.json) > 2_000_000 for r in rows) and next(r.valid for r in rows if r.status == "linked")


def test_contents_are_not_in_the_hash_table(spark, sf):
    plan = entries.op9_tool_calls(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Python" not in plan


@pytest.mark.parametrize("most", [toolcalls.MOST_SORTED, 0])
def test_calls_without_a_turn(spark, monkeypatch, most):
    monkeypatch.setattr(toolcalls.order_keys, "__defaults__", (most,))
    calls = [
        (1, None, 0, "a", []), (1, 2, 0, "b", ["a"]), (1, 3, 0, "c", ["b", "gone"]), (1, 4, 0, "d", []), (1, 5, 0, "e", ["d"]), (1, 6, None, "f", ["d"]),
        (2, None, 0, "x", []), (2, 3, 0, "x", []), (2, 1, 0, "y", ["x"]),
    ]
    table = spark.createDataFrame([(c, t, k, i, "t", "{}", a) for c, t, k, i, a in calls], toolcalls.CALL)
    rows = toolcalls.link(table, spark.createDataFrame([], toolcalls.RESULT), {"t": {}}).collect()
    got = {(r.conv_id, r.call_id, r.turn): (r.order_key, r.missing_after, r.status) for r in rows}
    p = PLACES
    assert got == {
        (1, "a", None): (None, 0, "pending"), (1, "b", 2): (None, 0, "pending"), (1, "c", 3): (None, 1, "pending"), (1, "d", 4): (4 * p, 0, "pending"), (1, "e", 5): (5 * p, 0, "pending"),
        (1, "f", 6): (None, 0, "pending"), (2, "x", None): (None, 0, "duplicate"), (2, "x", 3): (3 * p, 0, "pending"), (2, "y", 1): (3 * p + 1, 0, "pending"),
    }
