"""WARC, URL filters, WebP, neighbours, tool calls, the pipeline: round trips, brute force and DuckDB."""

import json
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fernspark.llm import entries, lshforest, secrets, simhash, toolcalls, urlfilter, warc, webp

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_like_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entries.QUERIES[name](spark, sf)
    cur = con.execute(entries.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in df.select(names).collect()) == key(cur.fetchall())


def pages(spark):
    big, other = "é" * 60, "x" * 200
    rows = [(5, "http://a.net/", big), (2, "http://b.org/fr/x", big), (9, None, big), (2, "http://b.org/fr/x", big), (None, "u", big), (1, "q\r\nX: y", "short"), (3, "v", "short"), (4, "w", None), (6, "w", ""), (7, "z", other), (None, "y", other * 2), (None, "y", other * 2)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")


def test_warc(spark, tmp_path):
    stored = warc.archives(warc.with_revisits(pages(spark)), archive_bytes=500)
    got = warc.read(stored).collect()
    assert len(got) == 12
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([(5, "revisit", 2), (2, "response", None), (9, "revisit", 2), (2, "response", None), (-1, "revisit", 2), (1, "response", None), (3, "response", None), (4, "response", None), (6, "response", None), (7, "response", None), (-1, "response", None), (-1, "response", None)], key=lambda x: (x[0], x[1]))
    assert {r.payload_bytes for r in got if r.page_id == 5} == {120} and all(bytes(r.payload).decode() == "é" * 60 for r in got if r.page_id == 2)
    warc.save(stored, str(tmp_path))
    assert sum(len(list(warc.read_records((tmp_path / f).read_bytes()))) for f in os.listdir(tmp_path)) == 12
    assert warc.read(warc.archives(warc.with_revisits(pages(spark).limit(0)))).count() == 0


def test_warc_dictionary():
    rng = np.random.default_rng(0)
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nitem: " + bytes(rng.integers(97, 105, 300, dtype=np.uint8)) for _ in range(400)]
    data, size = warc.write_archive(records)
    assert size > 1000 and int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME and list(warc.read_records(data)) == records
    with pytest.raises(ValueError):
        list(warc.read_records(data[:-5]))


def test_warc_dictionary_of_uneven_records(spark):
    rng = np.random.default_rng(0)
    small = [b"WARC/1.1\r\nWARC-Type: response\r\n\r\n<html><body class='page'>" + bytes(rng.integers(97, 123, 200, dtype=np.uint8)) for _ in range(3000)]
    huge = bytes(rng.integers(0, 256, 12 << 20, dtype=np.uint8))
    some = warc.samples([huge, *small])
    assert sum(map(len, some)) <= warc.TRAIN_BYTES + warc.PART_BYTES and sum(len(x) for x in some if x.startswith(b"WARC")) > 0.5 * sum(map(len, small))
    data, size = warc.write_archive([huge, *small])
    assert b"<html><body class" in data[8 : 8 + size] and list(warc.read_records(data)) == [huge, *small]
    assert warc.write_archive([b"a"])[1] == 0
    long = spark.createDataFrame([(1, "u", "é" * 3_000_000), (2, "u", "é" * 3_000_000), (3, "u", "x")], "page_id long, url string, html string")
    stored = warc.archives(warc.with_revisits(long))
    assert stored.columns == ["name", "records", "dictionary_bytes", "archive"]
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.read(stored).collect()) == [(1, 6_000_000, "response"), (2, 6_000_000, "revisit"), (3, 1, "response")]


def test_warc_by_a_shuffle(spark, monkeypatch):
    want = sorted(map(str, warc.with_revisits(pages(spark)).collect()))
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    assert sorted(map(str, warc.with_revisits(pages(spark)).collect())) == want


def brute_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else default)


def test_url_filter(spark, monkeypatch):
    rules = [*entries.RULES, ("a.net", "", "allow"), ("co.uk", "/x", "block"), ("", "/", "block"), (None, "/", "block")]
    urls = [None, "", "no", "http://", "://x.net/", "http://A.NET", "http://b.a.net?q#f", "http://anet/", "https://m.example.net/en/1?x#y", "http://example.com/de", "http://Example.com/de/#", "ftp://q.co.uk/xyz/é", "http://u:p@k.org:80/fr/", "http://k.org/fr/a\nb", "http://a.net/a://b"] * 3
    frame = spark.createDataFrame([(i if i % 7 else None, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, hits string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = sorted(map(repr, [(i if i % 7 else None, *brute_verdict(u, [r for r in rules if r[0]])) for i, u in enumerate(urls)]))
    assert sorted(map(repr, map(tuple, urlfilter.judge(frame, listed).collect()))) == want
    monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, map(tuple, urlfilter.judge(frame, listed).collect()))) == want
    assert {r.verdict for r in urlfilter.judge(frame, listed.limit(0)).collect()} == {"allow"} and urlfilter.judge(frame.limit(0), listed).count() == 0


def test_url_filter_of_long_hosts(spark, monkeypatch):
    rules = [("x.org", "/", "block"), ("a.x.org", "", "allow"), ("y.net", "z", "block"), ("y.netz", "", "block")]
    many = "a." * 500_000 + "x.org"
    hosts = [many, "b" * 1_000_000 + ".x.org", "b" * 1_000_000, "." * 1_000_000, "x.org", ".x.org", "bx.org", "y.netz", "y.net", "q.y.net", "a.x.org"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/" + "p" * 100_000, "?z")]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = [brute_verdict(u, rules) for u in urls]
    for most in (urlfilter.BROADCAST_BYTES, 0):
        monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", most)
        got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(frame, listed).collect()}
        assert [got[i] for i in range(len(urls))] == want
    assert urlfilter.candidates(many, "/", [0, 1], 7) == ["a.x.org", "a.x.org/", "x.org", "x.org/", "org", "org/"] and not urlfilter.candidates("b" * 1_000_000, "/", [0, 1], 7)


def test_bloom_filter(spark):
    keys = [f"host{i}.org/" for i in range(5000)]
    f = urlfilter.bloom(spark.createDataFrame([(k,) for k in keys], "key string"), len(keys))
    assert f.has(urlfilter.hashes(keys)).all() and f.has(urlfilter.hashes([k + "x" for k in keys])).mean() < 0.02


def images():
    rng = np.random.default_rng(0)
    base = (np.arange(40)[:, None] * 3 + np.arange(50)[None] * 5) % 256
    x = (base.astype(np.uint32) << 8) | (rng.integers(0, 4, (40, 50)).astype(np.uint32) << 16) | (base.astype(np.uint32) // 2) | np.uint32(0xFF000000)
    elements = rng.integers(0, 1 << 32, (10, 13), dtype=np.uint64).astype(np.uint32)
    yield "literals", x, {"references": False}
    yield "back-references", np.tile(x, (3, 2)), {}
    yield "cache", np.tile(x[:, :10], (1, 5)), {"cache_bits": 6}
    yield "groups", x, {"group_bits": 2, "groups": rng.integers(0, 4, (10, 13))}
    for m in range(14):
        yield f"predictor {m}", x, {"transforms": [(webp.PREDICTOR, 3, np.full((5, 7), m))]}
    yield "cross-colour", x, {"transforms": [(webp.CROSS_COLOUR, 2, elements)]}
    for k in (1, 2, 3, 4, 5, 16, 17, 256):
        colours = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)
        yield f"palette {k}", colours[rng.integers(0, k, (21, 37))], {"transforms": [(webp.PALETTE,)]}
    yield "all", np.tile(x, (2, 2)), {"transforms": [(webp.PREDICTOR, 2, rng.integers(0, 14, (20, 25))), (webp.CROSS_COLOUR, 3, elements), (webp.SUBTRACT_GREEN,)], "cache_bits": 5, "group_bits": 3, "groups": rng.integers(0, 3, (10, 13))}
    yield "one pixel", np.array([[0x12345678]], np.uint32), {}
    yield "noise", rng.integers(0, 1 << 32, (33, 65), dtype=np.uint64).astype(np.uint32), {}


@pytest.mark.parametrize(("name", "x", "how"), list(images()), ids=lambda v: v if isinstance(v, str) else "")
def test_webp_round_trip(name, x, how):
    assert (webp.decode(webp.encode(x, **how)) == x).all()


def test_webp_parts():
    lengths = webp.code_lengths(np.array([2**i for i in range(30)]))
    assert lengths.max() <= 15 and sum(2.0**-n for n in lengths) == 1
    for v in range(1, 5000):
        p, n, e = webp.split_value(v)
        w = webp.Writer()
        w.put(e, n), w.put(0, 8)
        assert webp.read_value(webp.Bits(w.bytes()), p) == v
    assert len(set(webp.NEIGHBOURS)) == 120 and [webp.distance(c, 10) for c in (1, 2, 3, 121)] == [10, 1, 11, 1]
    with pytest.raises(ValueError):
        webp.decode(webp.encode(np.arange(4096, dtype=np.uint32).reshape(64, 64))[:200])
    with pytest.raises(ValueError):
        webp.decode(b"GIF89a" + bytes(40))


def test_webp_of_bytes(spark):
    rng = np.random.default_rng(1)
    for payload in (bytes(64), b"ab" * 96, bytes(rng.integers(0, 256, 6400, dtype=np.uint8)), (b"some text that comes again, " * 400)[:9600], bytes(64 * 16500), bytes(range(256)) * 4):
        assert b"".join(webp.channels(x)[..., 1].tobytes() for x in webp.images(webp.store(payload)))[: len(payload)] == payload
    texts = [(1, None, "clash"), (2, "", "c"), (3, "é" * 3000, "c"), (3, "é" * 3000, "c"), (None, "x", "c"), (4, "a" * 200_000, "c")]
    df = spark.createDataFrame(texts, "doc_id long, text string, media string")
    rows = webp.samples(webp.media(df)).collect()
    assert len(rows) == 6 and webp.samples(webp.media(df.limit(0))).count() == 0
    for r in rows:
        raw = next((t or "").encode() for i, t, _ in texts if i == r.doc_id)
        assert bytes(r.samples) == raw + bytes(-len(raw) % 64 if raw else 64) and r.n_bytes == len(raw) and r.payload_bytes == len(r.samples)
    p = webp.pixel_arrays(webp.media(df).where("doc_id = 1")).first()
    assert (p.width, p.height, len(p.pixels)) == (64, 1, 256)


def test_webp_of_far_repeats():
    line, rng = b"A line of boilerplate that comes again.\n", np.random.default_rng(2)
    payload = line + bytes(rng.integers(32, 127, 2_000_000, dtype=np.uint8)) + line
    payload += bytes(-len(payload) % 64)
    assert b"".join(webp.channels(x)[..., 1].tobytes() for x in webp.images(webp.store(payload)))[: len(payload)] == payload
    for d in (webp.FARTHEST, webp.FARTHEST + 1):  # the last distance that a symbol reaches, and the first beyond it
        x = rng.integers(0, 256, d + 16, dtype=np.uint8)
        x[d:] = x[:16]
        assert [m for m in webp.matches(x) if m[2] == d] == ([(d, 16, d)] if d == webp.FARTHEST else [])
    coloured = rng.integers(0, 1 << 32, (1100, 1024), dtype=np.uint64).astype(np.uint32)
    coloured[-1] = coloured[0]
    assert (webp.decode(webp.encode(coloured)) == coloured).all()


def test_neighbours(spark):
    e = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()}
    ids = np.array(sorted(e))
    m = np.stack([e[i] for i in ids])
    got: dict = {}
    for r in entries.op8_hash_prefix_forest(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in e if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((m - e[q]) ** 2).sum(axis=1))
        best = [i for _, i in sorted(zip(d.tolist(), ids.tolist(), strict=True)) if i != q][:10]
        hits += len(set(best) & {i for i, _ in found})
        assert len(found) == 10 and [i for i, _ in found] == [i for _, i in sorted((s, i) for i, s in found)]
        assert all(abs(s - np.sqrt(((e[i] - e[q]) ** 2).sum())) < 1e-12 for i, s in found)
    assert hits / (10 * len(got)) >= 0.9


def test_the_ascent_reaches_what_it_needs():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((6000, 48))
    f = lshforest.Forest(v, lshforest.planes(48), v.mean(axis=0))
    q = v[:25]
    best = [np.argsort(((v - x) ** 2).sum(axis=1))[1:11] for x in q]
    for i, need in enumerate(f.needed(q, best)):
        for row, share in zip(best[i].tolist(), need.tolist(), strict=True):
            at = round(share * len(v))
            assert row in next(f.candidates(q[i : i + 1], at + 1)) and (at == 0 or row not in next(f.candidates(q[i : i + 1], at)))
    x = np.array([0, 1, 1 << 63, (1 << 64) - 1, 1 << 40], np.uint64)
    assert lshforest.leading(x).tolist() == [64, 63, 0, 0, 23]


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 32)) * 4
    v = centres[rng.integers(0, 60, 12_000)] + rng.standard_normal((12_000, 32)) * 0.3
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 100 = 0")
    index = lshforest.Index(df, shard=1000)
    routed = index.routed(queries)
    probes, share = index.fit(routed)
    assert len(index.shards) >= 10 and probes <= 4  # of twelve ranges
    got: dict = {}
    for r in index.search(routed, probes, share, least=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[i] & {j for j in np.argsort(((v - v[i]) ** 2).sum(axis=1))[:11].tolist() if j != i}) for i in range(0, 12_000, 100))
    assert hits / 1200 >= 0.9
    f = lshforest.Forest(v, lshforest.planes(32), v.mean(axis=0))
    compared = [len(rows) for rows in f.candidates(v[:20], int(share * 1000) + 1)]
    assert np.mean(compared) < 0.02 * len(v)  # a query's own cluster


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i), 1.0]) for i in range(1, 6)] + [(100, [1.0, 1.0]), (200, [0.0, 0.0]), (300, [nan, 1.0]), (400, [inf, 1.0]), (500, None), (600, [None, 1.0]), (None, [1.0, 1.0]), (700, [1.0]), (800, [-0.0, 2.0]), (900, [0.0, 2.0])]
    rows += [(1000 + i, [9.0, 9.0]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got: dict = {}
    for r in lshforest.nearest(df, df.where("vec_id % 100 = 0"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {100, 800, 900, 1000}
    assert got[1000][:10] == [(k, 1000 + k, 0.0) for k in range(1, 11)]
    assert got[100][0] == (1, 1, 0.0) and got[900][0] == (1, 800, 0.0) and len(got[100]) == 10
    assert lshforest.nearest(df.limit(0), df).count() == 0 and lshforest.nearest(df, df.limit(0)).count() == 0


SCHEMA = {"type": "object", "required": ["q"], "additionalProperties": False, "properties": {"q": {"type": "string", "minLength": 1, "pattern": "^[a-z]"}, "n": {"type": ["integer", "null"], "minimum": 0, "maximum": 9}, "kind": {"enum": ["a", "b"]}, "list": {"type": "array", "maxItems": 2, "items": {"type": "number"}}, "in": {"type": "object", "required": ["x"], "properties": {"x": {"type": "boolean"}}}}}


def test_schema_checks(spark):
    good = ['{"q":"x"}', '{"q":"x","n":3,"kind":"a","list":[1,2.5],"in":{"x":true}}', '{"q":"x","n":null}']
    bad = ["", "no", "[]", '{"n":1}', '{"q":""}', '{"q":"X"}', '{"q":5}', '{"q":"x","n":10}', '{"q":"x","n":1.5}', '{"q":"x","kind":"c"}', '{"q":"x","list":[1,2,3]}', '{"q":"x","list":["1"]}', '{"q":"x","in":{}}', '{"q":"x","in":{"x":1}}', '{"q":"x","z":1}', None]
    calls = spark.createDataFrame([(1, i, 0, str(i), "t", a, []) for i, a in enumerate(good + bad)], toolcalls.CALL)
    rows = {int(r.call_id): r for r in toolcalls.link(calls, spark.createDataFrame([], toolcalls.RESULT), {"t": SCHEMA}).collect()}
    for i, a in enumerate(good + bad):
        assert rows[i].valid == (i < len(good)), (a, rows[i].errors)
    assert "q is missing" in rows[len(good) + 3].errors
    with pytest.raises(ValueError):
        toolcalls.violations({"format": "x"}, F.lit(None))


def test_tool_calls(spark):
    calls = [
        (1, 0, 0, "a", "t", '{"b":1,"a":{"d":"\\u00e9","c":[2, 1]}}', ["b"]), (1, 0, 1, "b", "t", "{}", []), (1, 2, 0, "c", "t", "{}", ["a", "b", "gone"]),
        (2, 0, 0, "x", "t", "{}", ["y"]), (2, 1, 0, "y", "t", "{}", ["x"]), (2, 2, 0, "z", "u", "{}", ["x"]), (3, 5, 0, "d", "t", "{}", []), (3, 6, 0, "d", "t", "{}", []), (3, 7, 0, None, "t", "{}", []),
    ]
    results = [(1, 1, "a", "ra"), (1, 4, "a", "later"), (1, 0, "b", "early"), (4, 1, "lost", "r"), (4, 2, None, "r")]
    got = toolcalls.link(spark.createDataFrame(calls, toolcalls.CALL), spark.createDataFrame(results, toolcalls.RESULT), {"t": {"type": "object"}}).collect()
    assert len(got) == 11
    by = {(r.call_id, r.turn): r for r in got}
    status = {k: r.status for k, r in by.items()}
    assert status[("a", 0)] == "linked" and status[("b", 0)] == "early" and status[("c", 2)] == "pending" and status[("d", 5)] == "pending" and status[("d", 6)] == "duplicate"
    assert status[("lost", None)] == "orphan" and status[(None, 7)] == "unnamed" and status[(None, None)] == "unnamed"
    order = lambda c: next(r.order_key for r in got if r.call_id == c)
    assert order("b") < order("a") < order("c") and order("x") is None and order("y") is None and order("z") is None
    assert by[("c", 2)].missing_after == 1 and not by[("z", 2)].valid and by[("a", 0)].result_turn == 1
    assert by[("a", 0)].json == '{"arguments":{"a":{"c":[2,1],"d":"é"},"b":1},"id":"a","name":"t","result":"ra"}'
    empty = toolcalls.link(spark.createDataFrame([], toolcalls.CALL), spark.createDataFrame([], toolcalls.RESULT), {})
    assert empty.count() == 0


def test_tool_calls_in_json(spark):
    said = json.dumps({"tool_calls": [{"id": "k1", "name": "t", "arguments": {"q": 1}, "after": []}]})
    rows = [(1, 0, "user", "hi", "c"), (1, 1, "assistant", said, "c"), (1, 2, "tool", json.dumps({"tool_call_id": "k1", "content": "done"}), "c"), (None, None, "user", None, "c"), (2, 0, "system", "x", "c")]
    calls, results = toolcalls.from_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, index string"))
    got = {r.call_id: r for r in toolcalls.link(calls, results, {"t": {}, "reply": entries.REPLY}).collect()}
    assert got["k1"].status == "linked" and json.loads(got["k1"].json)["result"] == "done" and got["c1-0"].status == "pending"
    assert got[None].status == "unnamed" and set(got) == {"k1", "c1-0", None}


def test_tool_calls_with_repeated_identifiers(spark):
    calls = [(c, 0, 0, "call_1", "t", "{}", []) for c in (1, 2, 3, None)] + [(2, 4, 0, "call_2", "t", "{}", ["call_1", "call_9"])]
    results = [(1, 1, "call_1", "r1"), (2, 1, "call_1", "r2"), (2, 2, "call_1", "again"), (2, 2, "call_1", "again"), (2, 1, "call_1", "r2"), (None, 3, "call_1", "r0"), (4, 1, "call_1", "lost"), (4, 2, "call_1", "lost too"), (5, 1, "call_1", "lost")]
    tables = spark.createDataFrame(calls, toolcalls.CALL), spark.createDataFrame(results, toolcalls.RESULT)
    got = sorted(((r.conv_id or 0, r.call_id, r.status, r.result_turn or 0, json.loads(r.json).get("result", ""), r.missing_after) for r in toolcalls.link(*tables, {"t": {}}, extras=True).collect()))
    assert got == sorted([
        (1, "call_1", "linked", 1, "r1", 0), (2, "call_1", "linked", 1, "r2", 0), (3, "call_1", "pending", 0, "", 0), (0, "call_1", "linked", 3, "r0", 0), (2, "call_2", "pending", 0, "", 1),
        (2, "call_1", "extra", 1, "r2", 0), (2, "call_1", "extra", 2, "again", 0), (2, "call_1", "extra", 2, "again", 0),
        (4, "call_1", "orphan", 1, "lost", 0), (4, "call_1", "orphan", 2, "lost too", 0), (5, "call_1", "orphan", 1, "lost", 0),
    ])
    assert sorted(r.status for r in toolcalls.link(*tables, {"t": {}}).collect()) == sorted(s for _, _, s, *_ in got if s != "extra")


def test_missing_calls_are_counted_by_call(spark):
    calls = [(1, 0, 0, "d", "t", "{}", ["gone", "lost", "gone"]), (1, 1, 0, "d", "t", "{}", []), (1, 2, 0, "d", "t", "{}", ["gone", "d"]), (2, 0, 0, "d", "t", "{}", None), (2, 0, 0, "d", "u", "{}", ["x"])]
    got = toolcalls.link(spark.createDataFrame(calls, toolcalls.CALL), spark.createDataFrame([], toolcalls.RESULT), {}).collect()
    assert sorted((r.conv_id, r.turn, r.name, r.missing_after) for r in got) == [(1, 0, "t", 2), (1, 1, "t", 0), (1, 2, "t", 1), (2, 0, "t", 0), (2, 0, "u", 1)]


def test_native_plan(spark, sf):
    plan = entries.op9_tool_calls(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_language_stage_without_labels(spark, sf):
    rows = [(1, "the first text", None), (2, None, None), (3, "", None), (4, "12 34 !", None), (5, "ein Text", None)]
    for labelled in ([], [(6, "12 !", "en")]):  # no label at all; a label on a text without a letter
        docs = spark.createDataFrame(rows + labelled, "doc_id long, text string, lang string")
        assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, sf).collect()) == [1, 5]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "12 34 !", "en", "s", 7)], docs.schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "packing"]
    first = corpus_pipeline.language_id(spark, docs.unionByName(odd), sf)
    assert {r.doc_id for r in first.collect()} == set(texts) and first.columns == docs.columns
    second = corpus_pipeline.near_duplicates(spark, docs, sf)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {r.doc_id for r in second.collect()} == set(groups.values()) and second.columns == docs.columns
    third = {r.doc_id: r for r in corpus_pipeline.secret_scan(spark, docs, sf).collect()}
    assert all(third[d].text == secrets.redact(t) and third[d].n_chars == len(third[d].text) for d, t in texts.items())
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == set(groups.values())
