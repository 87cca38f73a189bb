"""Streams with state: the limited record log, expiring deduplication and messages from parts, over restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fernspark.operators import messages as batch
from fernspark.sources import loaders
from fernspark.sources.permits import Ledger, Permits
from fernspark.streaming import stateful, streams


class Log:
    def __init__(self, options):
        self.path = options["log"]

    def end(self):
        with open(self.path) as f:
            return json.load(f)["end"]

    def read(self, start, stop):
        return ((str(i), f"v{i}") for i in range(start, stop))


def make(options):
    return Log(options)


def clock(options):
    with open(options["log"]) as f:
        return json.load(f)["now"]


def test_permits_bound_every_span():
    r = random.Random(5)
    for rate, burst in ((3, None), (0.5, 4), (100.25, 7)):
        p, now, available, seen = Permits.start(rate, burst, 10, 0.0), 0.0, 10, []
        for _ in range(400):
            now += r.choice((0, 0.01, 0.3, 2.5))
            available += r.choice((0, 1, 50))
            before = p.end
            assert before <= p.admit(available, now - r.choice((0, 0, 1))) <= max(before, available)
            seen.append((p.at, p.end - before))
        most = max(1.0, rate) if burst is None else burst
        for i in range(0, len(seen), 7):
            total = 0
            for t, n in seen[i:]:
                total += n
                assert total <= most + rate * (t - seen[i][0]) + 1e-6
    with pytest.raises(ValueError, match="rate"):
        Permits.start(0, None, 0, 0.0)
    with pytest.raises(ValueError, match="burst"):
        Permits.start(1, 0.5, 0, 0.0)


def test_ledger(tmp_path):
    ledger = Ledger(f"file://{tmp_path}/a/ledger")
    assert ledger.load() is None
    p = Permits.start(3, None, 7, 1.5)
    p.admit(9, 2.0)
    ledger.save(p)
    assert Ledger(f"{tmp_path}/a/ledger").load() == p
    faster = p.with_rate(0.5, None)
    assert (faster.end, faster.held) == (9, 1.0)


def test_record_log_keeps_its_rate_over_restarts(tmp_path):
    log = tmp_path / "log"
    options = {"client": f"{__name__}:make", "clock": f"{__name__}:clock", "log": str(log), "rows_per_second": "3", "ledger": str(tmp_path / "ledger")}

    def at(now, end=1000):
        log.write_text(json.dumps({"end": end, "now": now}))
        return loaders._RecordReader(options).latestOffset()["offset"]  # a new reader, as after a restart

    assert [at(0), at(0), at(0.4), at(1), at(1), at(3600), at(3600)] == [3, 3, 4, 6, 6, 9, 9]
    assert at(3601, end=10) == 10 and at(3602, end=10) == 10 and at(3602) == 13
    reader = loaders._RecordReader(options)
    assert [(p.start, p.stop) for p in reader.partitions({"offset": 9}, {"offset": 13})] == [(9, 13)]
    with pytest.raises(ValueError, match="before the checkpoint"):
        reader.partitions({"offset": 14}, {"offset": 13})
    with pytest.raises(ValueError, match="ledger"):
        loaders._RecordReader({"client": "x:y", "rows_per_second": "3"})


def test_limited_stream_admits_what_its_clock_allows(spark, tmp_path):
    log, counts = tmp_path / "log", []
    for now in (0, 1, 1, 10):
        log.write_text(json.dumps({"end": 8, "now": now}))
        s = loaders.records(spark, "tests.test_stateful:make", rows_per_second=3, ledger=f"{tmp_path}/ledger", clock="tests.test_stateful:clock", log=str(log))
        run(s, tmp_path, "out")
        counts.append(spark.read.parquet(f"{tmp_path}/out").count())
    assert counts == [3, 6, 6, 8]
    assert sorted((r.offset, r.key, r.value) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(i, str(i), f"v{i}") for i in range(8)]


def run(df, tmp_path, name):
    streams.drained(streams.stored(df, lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/{name}/n={n}"), f"{tmp_path}/{name}-state"))



@pytest.fixture
def one_partition(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    stateful.with_state_on_disk(spark)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def once_brute(rows, span):
    last, out = {}, []
    for t, k, v in sorted(rows, key=lambda r: (r[0], str(r))):
        if k not in last or t - last[k] > span:
            last[k] = t
            out.append((t, k, v))
    return sorted(out, key=str)


def test_expiring_deduplication_equals_a_pass_in_order(spark, tmp_path, one_partition):
    r = random.Random(2)
    rows = [(r.randrange(0, 1000), r.choice(["a", "b", None, "c"]), r.randrange(3)) for _ in range(120)]
    shape = "t long, key string, v int"
    for a, b in ((0, 500), (500, 1000)):  # a run each, from the checkpoint of the one before
        spark.createDataFrame([x for x in rows if a <= x[0] < b], shape).withColumn("time", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = streams.files(spark, f"{tmp_path}/in", f"{shape}, time timestamp", files_per_batch=1)
        run(stateful.once_within(s, "key", "time", 60, late="30 seconds"), tmp_path, "out")
    found = sorted(((x.t, x.key, x.v) for x in spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert found == once_brute(rows, 60) and len(found) < 60


def test_messages_from_shuffled_and_repeated_parts(spark, tmp_path, one_partition):
    r, parts = random.Random(3), []
    for conv in range(3):
        for seq in range(8):
            call = seq % 3 if seq % 2 else None
            parts.append((conv, seq, None if seq == 4 else f"{conv}.{seq} ", call, f"i{seq}" if call is not None else None, f"n{call}" if call is not None else None, "{é" if call is not None else None, seq, 1, None, seq == 7))
    given = parts + r.sample(parts, 10) + [(0, None, "x", *[None] * 7, False)]
    given = [x for x in given if x[:2] != (2, 5)]  # a gap that never closes
    r.shuffle(given)
    later = [(9, 1, "late", *[None] * 7, False)]
    for n, some in enumerate((given[::2], given[1::2], later)):
        at = F.timestamp_seconds(F.coalesce("seq", F.lit(0)) + F.lit(10_000 if some is later else 1_000))
        spark.createDataFrame(some, stateful.PART).withColumn("time", at).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(stateful.messages(streams.files(spark, f"{tmp_path}/in", f"{stateful.PART}, time timestamp", files_per_batch=1)), tmp_path, "out")
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    closed = {x.conv_id: x for x in out if x.status == "closed"}
    assert set(closed) == {0, 1}
    table = spark.createDataFrame(parts, stateful.PART)
    texts = {x.conv_id: x.text for x in batch.joined_deltas(table).collect()}
    calls = {}
    for x in batch.joined_tool_calls(table.where("index is not null"), ("conv_id",)).collect():
        calls.setdefault(x.conv_id, {})[x["index"]] = (x.id, x.name, x.args)
    for conv, x in closed.items():
        assert x.text == texts[conv] and {c["index"]: (c.id, c.name, c.args) for c in x.tool_calls} == calls[conv]
        assert (x.seq, x.prompt_tokens, x.completion_tokens, x.total_tokens) == (7, 28, 8, 0)
        assert "".join(y.delta for y in sorted((y for y in out if y.conv_id == conv), key=lambda y: y.seq)) == x.text
    assert [(x.status, x.seq) for x in out if x.conv_id == 2 and x.status != "open"] == [("timed_out", 7)]  # the rest over the gap
    assert max(x.seq for x in out if x.conv_id == 2 and x.status == "open") == 4 and not [x for x in out if x.conv_id == 9]


def test_held_parts_are_put_together_over_gaps():
    import pandas as pd

    def parts(*seqs, last=()):
        return pd.DataFrame([{"seq": s, "delta": str(s), "index": None, "id": None, "name": None, "args": None, **dict.fromkeys(stateful.USAGE, 1), "last": s in last} for s in seqs])

    m = stateful._Message(None)
    m.hold(parts(3, 1))
    assert m.advance() == "" and stateful._Message(m.kept()).held.keys() == {1, 3}
    m.hold(parts(0))
    assert m.advance() == "01"
    m = stateful._Message(m.kept())
    assert m.advance(over_gaps=True) == "3" and m.text == "013" and m.usage == [3, 3, 3] and not m.closed
    m.hold(parts(4, 5, last=(4,)))
    assert m.advance() == "4" and m.closed and not m.held
    m.hold(parts(6))
    assert not m.held
