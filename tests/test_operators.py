"""Pipelines, sinks, caches, retrieval, queries, agents, tasks and streams: the invariants of their steps."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from fernspark import schema
from fernspark.operators import agent, indexing, messages, models, nodes, querying, retrieval, sinks, stats
from fernspark.plans import tasks
from fernspark.sources import loaders
from fernspark.streaming import streams


def few(spark, *rows):
    return loaders.from_rows(spark, rows or [("a", "one"), ("b", "two"), ValueError("broken"), ("a", "one")])


def test_strict_run_stops_at_an_error(spark):
    p = indexing.IndexingPipeline(few(spark))
    with pytest.raises(indexing.PipelineError, match="broken"):
        p.run()
    s = p.filter_errors().run()
    assert (s.processed, s.failed, s.stored) == (3, 0, 0) and p.run(strict=False).failed == 1


def test_steps_leave_errors_alone(spark):
    p = indexing.IndexingPipeline(few(spark)).then(nodes.mapped(str.upper)).then_chunk(nodes.chunk_text(2)).then_in_batch(lambda b: b)
    got = sorted((r.path or "", r.chunk or "", r.error or "") for r in p.df.collect())
    assert got == sorted([("a", "ON", ""), ("a", "E", "")] * 2 + [("b", "TW", ""), ("b", "O", ""), ("", "", "broken")])


def test_a_failing_function_is_the_rows_error(spark):
    df = nodes.mapped(lambda t: str(1 // (t != "two")))(few(spark))
    assert sorted(r.error or "" for r in df.collect()) == ["", "", "ZeroDivisionError: integer division or modulo by zero", "broken"]


def test_split_merge_and_sinks(spark, tmp_path):
    memory, table = sinks.MemorySink(), sinks.ParquetSink(str(tmp_path / "t"))
    left, right = indexing.IndexingPipeline(few(spark)).filter_errors().split_by(F.col("path") == "a")
    assert (left.df.count(), right.df.count()) == (2, 1)
    p = left.then_store_with(memory).merge(right.then_store_with(table))
    assert p.run().stored == 3 and len(memory.get_all()) == 2 and table.read(spark).count() == 1
    assert p.run().stored == 2 and len(memory.rows) == 4 and memory.get(0)["chunk"] == "one"


def test_insert_and_upsert(spark, tmp_path):
    new = few(spark, ("a", "one"), ("a", "one"), ("b", "two"))
    for mode, counts in (("insert", (2, 0)), ("upsert", (2, 2)), ("append", (3, 3))):
        sink = sinks.ParquetSink(str(tmp_path / mode), mode)
        sink.setup(spark)
        assert (sink.store(new), sink.store(new)) == counts
    later = new.withColumn("metadata", F.create_map(F.lit("k"), F.lit("v"))).where("path = 'b'")
    sink = sinks.ParquetSink(str(tmp_path / "upsert"), "upsert")
    sink.store(later)
    assert {r.path: r.metadata for r in sink.read(spark).collect()} == {"a": {}, "b": {"k": "v"}}


def test_vector_columns(spark, tmp_path):
    df = nodes.embed(models.HashEmbedder(8))(few(spark, ("a", "one two"), ("b", "")))
    sink = sinks.ParquetSink(str(tmp_path / "v")).with_vector("Combined", 8).with_metadata("title")
    sink.setup(spark)
    assert sink.store(df) == 2 and {len(r.vector_combined) for r in sink.read(spark).collect()} == {8}
    with pytest.raises(Exception, match="hasn't 9 values"):
        sinks.ParquetSink(str(tmp_path / "w")).with_vector("Combined", 9).shaped(df).collect()
    with pytest.raises(Exception, match="title is missing"):
        sinks.ParquetSink(str(tmp_path / "x"), missing="error").with_metadata("title").shaped(df).collect()


def test_too_few_vectors_leave_none(spark):
    class Short:
        def embed(self, texts):
            return [[1.0]] * (len(texts) - 1)

    assert [r.vectors for r in nodes.embed(Short())(few(spark, ("a", "x"))).collect()] == [None]
    assert nodes.embed(models.HashEmbedder())(loaders.empty(spark)).count() == 0


def test_steps_before_a_sink_run_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def shout(text):
        calls.add(1)
        return text.upper()

    one, two = sinks.MemorySink(), sinks.MemorySink()
    p = indexing.IndexingPipeline(few(spark, ("a", "one"), ("b", "two"))).then(nodes.mapped(shout)).then_store_with(one).filter("path = 'a'").then_store_with(two)
    assert p.run().stored == 3 and calls.value == 2
    assert sorted(r["chunk"] for r in one.rows.values()) == ["ONE", "TWO"] and [r["chunk"] for r in two.rows.values()] == ["ONE"]


def test_embed_modes(spark):
    df = few(spark, ("a", "x")).withColumn("metadata", F.create_map(F.lit("m"), F.lit("y")))
    for mode, keys in ((schema.SINGLE, {"Combined"}), (schema.PER_FIELD, {"Chunk", "Metadata: m"}), (schema.BOTH, {"Combined", "Chunk", "Metadata: m"})):
        p = indexing.IndexingPipeline(df).with_embed_mode(mode).then(nodes.embed(models.HashEmbedder())).then(nodes.sparse_embed(models.HashSparseEmbedder()))
        r = p.df.first()
        assert set(r.vectors) == set(r.sparse_vectors) == keys


def test_cache(spark, tmp_path):
    cache = sinks.NodeCache(str(tmp_path / "c"), "p")
    first = indexing.IndexingPipeline(few(spark)).filter_cached(cache).df
    assert first.where("error is null").count() == 2 and first.count() == 3
    node = first.where("path = 'a'").first().id
    assert cache.get(spark, node) and not cache.get(spark, "x")
    assert indexing.IndexingPipeline(few(spark)).filter_cached(cache).df.where("error is null").count() == 0
    cache.clear(spark)
    assert not cache.get(spark, node)


def test_metadata_steps(spark):
    df = few(spark, ("f.py", "import os\ndef f():\n    return os.getcwd()\n"), ("g.py", "def ("))
    rows = {r.path: r for r in nodes.references_and_definitions(df).collect()}
    assert rows["f.py"].metadata == {"References (code)": "getcwd,os", "Definitions (code)": "f"} and "CodeError" in rows["g.py"].error
    o = nodes.outline_code()(df.where("path = 'f.py'"))
    said = nodes.compress_outline(models.CallablePrompt(lambda p: "Here:\n```\nshort\n```"))(o).first().metadata
    assert o.first().metadata["Outline"] == "import os\ndef f():\n" and said["Outline"] == "short\n"
    qa = nodes.metadata_from_prompt("Questions and Answers (code)", models.CallablePrompt(lambda p: f"{'outline' in p} {'Write 5' in p}"))(o).first().metadata
    assert qa["Questions and Answers (code)"] == "True True"
    with pytest.raises(ValueError, match="no model"):
        indexing.IndexingPipeline(df).then_with_client(lambda m: nodes.metadata_from_prompt("Title", m))


def test_code_offsets(spark):
    df = few(spark, ("f.py", "".join(f"x{i} = {i}\n" for i in range(40))))
    rows = sorted((r.offset, r.chunk) for r in nodes.chunk_code("python", 50)(df).collect())
    at = 0
    for offset, chunk in rows:
        assert offset == at
        at += len(chunk.encode())


def test_files(spark, tmp_path):
    for name, data in {"a.txt": b"\x80\x80\x80", "b.md": b"x", "sub/c.txt": "é".encode(), ".hidden.txt": b"h", "sub/skip.txt": b"s", "out/d.txt": b"d"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / ".gitignore").write_text("out/\nskip.*\n")
    got = {r.path.removeprefix(str(tmp_path) + "/"): (r.chunk, r.original_size) for r in loaders.files(spark, str(tmp_path), ("txt",)).collect()}
    assert got == {"a.txt": ("�" * 3, 9), "sub/c.txt": ("é", 2)}
    assert loaders.files(spark, str(tmp_path), ("TXT",)).count() == 0 and loaders.files(spark, str(tmp_path)).count() == 3
    assert loaders.files(spark, str(tmp_path), ("txt",), ignore_rules=False).count() == 4


def test_parquet_column(spark, tmp_path):
    spark.createDataFrame([("hello", 1), ("world", 2), (None, 3)], "chunk string, n int").write.parquet(str(tmp_path / "p"))
    assert sorted(r.chunk for r in loaders.parquet_column(spark, str(tmp_path / "p"), "chunk").collect()) == ["hello", "world"]
    assert "string" in loaders.parquet_column(spark, str(tmp_path / "p"), "n").first().error
    with pytest.raises(ValueError):
        loaders.parquet_column(spark, str(tmp_path / "p"), "z")


def test_queue_records(spark):
    df = spark.createDataFrame([("t", 0, 1, b"k", bytearray(b"ok")), ("t", 0, 2, None, bytearray(b"\x80")), ("t", 0, 3, None, None)], "topic string, partition int, offset long, key binary, value binary").withColumn("timestamp", F.timestamp_millis(F.lit(1500)))
    rows = loaders.queue_metadata(df).collect()
    assert [r.chunk for r in rows] == ["ok"] and rows[0].metadata == {"kafka_topic": "t", "kafka_partition": "0", "kafka_offset": "1", "kafka_timestamp": "1500", "kafka_key": "k"}


def test_retrieval_by_blocks_is_the_same(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = e.where("id < 20").select(F.col("id").alias("qid"), "embedding")
    for metric in retrieval.METRICS:
        how = retrieval.SimilaritySingleEmbedding(7, None, metric)
        few_way = [(r.qid, r.id, r["rank"]) for r in retrieval.similarity(e, asked, how, digits=9).orderBy("qid", "rank").collect()]
        monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 0)
        monkeypatch.setattr(retrieval, "SHARD", 100)
        monkeypatch.setattr(retrieval, "BLOCK", 6)
        assert [(r.qid, r.id, r["rank"]) for r in retrieval.similarity(e, asked, how, digits=9).orderBy("qid", "rank").collect()] == few_way
        monkeypatch.undo()


def test_filters(spark):
    df = spark.createDataFrame([("content1", "A", "1"), ("content2", "A", "2"), ("content3", "B", "1")], "c string, k string, p string").select("c", F.create_map(F.lit("category"), "k", F.lit("priority"), "p").alias("metadata"))
    get = lambda f: sorted(r.c for r in df.where(f).collect())
    assert get(retrieval.key_value_filter('category = "A"')) == ["content1", "content2"] and get(retrieval.key_value_filter("priority=1")) == ["content1", "content3"]
    assert get(retrieval.must_match({"category": "A", "priority": 2})) == ["content2"] and get(retrieval.key_value_filter("x=y")) == []
    assert get(retrieval.listed("c", ("content1", "content2"), ("content2",))) == ["content1"]
    with pytest.raises(ValueError):
        retrieval.key_value_filter("no sign")
    with pytest.raises(ValueError):
        retrieval.HybridSearch(0)
    with pytest.raises(ValueError):
        retrieval.CustomStrategy().run(df, df)


def test_close_vectors_rank_first(spark):
    v = lambda x: F.array_repeat(F.lit(x).cast("float"), 384)
    docs = spark.range(1).select(F.lit("base").alias("id"), v(1.0).alias("embedding")).union(spark.range(1).select(F.lit("similar"), v(1.1))).union(spark.range(1).select(F.lit("dissimilar"), v(-1.0)))
    asked = spark.range(1).select(F.col("id").alias("qid"), v(1.0).alias("embedding"))
    for metric in ("l2", "cosine", "cosine_distance", "dot"):
        assert {r.id for r in retrieval.similarity(docs, asked, retrieval.SimilaritySingleEmbedding(2, None, metric), digits=6).collect()} == {"base", "similar"}


def test_hybrid_keeps_rows_without_the_words(spark):
    docs = spark.createDataFrame([("n1", "hello", [1.0, 2.0, 3.0])], "id string, chunk string, embedding array<float>")
    asked = spark.createDataFrame([(0, "zzz", [1.0, 2.0, 3.0])], "qid long, current string, embedding array<float>")
    rows = retrieval.hybrid_convex(docs, asked).collect()
    assert len(rows) == 1 and rows[0].score is None


def test_query_states(spark):
    q = querying.queries(spark, ["a?", "b?"])
    assert [(r.qid, r.current, r.state) for r in q.orderBy("qid").collect()] == [(0, "a?", "Pending"), (1, "b?", "Pending")]
    p = querying.QueryPipeline()
    with pytest.raises(querying.StateError):
        p.then_answer(querying.answer_simple(models.EchoPrompt()))
    seen = []
    corpus = spark.createDataFrame([("1", "text", {"k": "v"}, [1.0, 0.0])], "id string, chunk string, metadata map<string,string>, embedding array<float>")
    step = lambda df: df.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))
    p = p.evaluate_with(lambda kind, df: seen.append(kind)).then_transform_query(step).then_transform_query(querying.generate_subquestions(models.EchoPrompt(2))).then_retrieve(querying.retrieve_from(corpus))
    p = p.then_transform_response(querying.summarise(models.EchoPrompt(1, "sum "))).then_answer(querying.answer_simple(models.EchoPrompt(3)))
    r = p.query(spark, "why?")
    assert [e.kind for e in r.history] == ["Transformed", "Retrieved", "Transformed"] and r.state == "Answered" and r.documents[0].metadata == {"k": "v", "id": "1"} and seen == ["retrieved", "answered"]
    assert [x.original for x in p.query_all(spark, ["x", "y"]).collect()] == ["x", "y"]
    with pytest.raises(querying.StateError):
        p.then_retrieve(querying.retrieve_from(corpus))


def test_answer_context(spark):
    docs = spark.createDataFrame([(0, 1, "first", {"t": "A"}), (0, 2, "second", {"t": "B"})], "qid long, rank int, content string, metadata map<string,string>")
    q = querying.retrieved(querying.queries(spark, ["q"]), docs)
    shown = lambda df, t=None: df.select(querying.context_documents(t).alias("c")).first().c
    assert shown(q) == "first\n---\nsecond" and shown(q, "{{ metadata.t }}: {{ content }}") == "A: first\n---\nB: second"
    assert shown(querying.transformed(q, F.lit("short"))) == "short"
    twice = querying.retrieved(q, docs).first()
    assert len(twice.documents) == 4 and len(twice.history[1].documents) == 2


def test_evaluation_json(spark):
    prepared = spark.createDataFrame([("q", "truth"), ("q", "truth"), ("p", None)], "question string, ground_truth string")
    rows = [json.loads(r.json) for r in querying.dataset_json(querying.evaluation_dataset(prepared)).collect()]
    assert rows == [{"answer": "", "contexts": [], "ground_truth": "", "question": "p"}, {"answer": "", "contexts": [], "ground_truth": "truth", "question": "q"}]


def test_usage(spark):
    u = spark.createDataFrame([("gpt-4", 100, 50, 150), ("gpt-3.5", 50, 25, 75)], "model string, prompt_tokens long, completion_tokens long, total_tokens long")
    t = stats.usage_totals(stats.usage_by_model(u)).first()
    assert (t.request_count, t.total_tokens) == (2, 225)


class Script:
    """A model that says what it is told to."""

    def __init__(self, *answers):
        self.answers, self.seen = list(answers), []

    def complete(self, messages, tools):
        self.seen.append([m["role"] for m in messages])
        return self.answers.pop(0) if self.answers else {"content": "end"}


def call(name, args="{}", i="1"):
    return {"content": None, "tool_calls": [{"id": i, "name": name, "args": args}]}


def test_agent():
    events = []
    a = agent.Agent(Script(call("add", '{"a":1,"b":2}'), {"content": "3"}), [agent.Tool("add", lambda a, b: a + b)], system="be brief").on("before_tool", lambda _, c: events.append(c["name"])).on("on_stop", lambda _, r: events.append(r))
    assert a.query("1+2?") == "done" and [m["role"] for m in a.history] == ["system", "user", "assistant", "tool", "assistant"] and a.history[3]["text"] == "3" and events == ["add", "done"]
    b = agent.Agent(Script(*[call("bad", i=str(i)) for i in range(9)]), [agent.Tool("bad", lambda: 1 / 0)])
    assert b.query("x") == ("tool failed too often", "bad") and sum(m["role"] == "tool" for m in b.history) == 4
    c = agent.Agent(Script(call("stop", '{"output": 7}')), [agent.stop_with_args()])
    assert c.query("x") == ("stop", 7)
    with pytest.raises(agent.AgentError):
        agent.Agent(Script(*[call("t", i=str(i)) for i in range(9)]), [agent.Tool("t", lambda: 1)], limit=3).query("x")
    said = [None]
    d = agent.Agent(Script(call("act"), {"content": "ok"}), [agent.needs_approval(agent.Tool("act", lambda: "done"), lambda _: said[0])])
    assert d.query("x") == "feedback" and len(d.open_calls()) == 1
    said[0] = True
    assert d.run() == "done" and d.history[-2]["text"] == "done"


def test_agent_context():
    a = agent.Agent(Script())
    a.history = [{"role": r} for r in ("system", "user", "summary", "assistant", "user")]
    assert [m["role"] for m in a.context()] == ["system", "summary", "assistant", "user"]


def test_executor(tmp_path):
    e = agent.LocalExecutor(str(tmp_path), env={"X": "1"})
    e.write("d/f", "text")
    assert e.read("d/f") == "text" and e.scoped("d").shell("echo $X; cat f; exit 3") == (3, "1\ntext")
    with pytest.raises(TimeoutError):
        e.shell("sleep 5", 0.2)


def test_retries():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise models.Transient
        return "ok"

    waits = []
    assert models.Backoff().run(flaky, waits.append) == "ok" and len(waits) == 2 and 0.5 <= waits[0] <= 1.5 and 1 <= waits[1] <= 3
    with pytest.raises(models.Permanent):
        models.Backoff().run(lambda: (_ for _ in ()).throw(models.Permanent()), waits.append)
    assert all(w <= 60 for w in models.Backoff(tries=20).waits(1))


def test_remote_model():
    asked = []

    def send(request, timeout):
        asked.append((request.full_url, json.loads(request.data)))
        return json.dumps({"data": [{"embedding": [1.0]}]} if "embeddings" in request.full_url else {"choices": [{"message": {"content": '{"a": 1}'}}]}).encode()

    m = models.RemoteModel("groq", "key", "p", "e", send=send)
    assert m.prompt("x") == '{"a": 1}' and m.embed(["x"]) == [[1.0]] and m.structured("x", {"type": "object", "properties": {"a": {"type": "integer"}}}) == {"a": 1}
    assert asked[0][0].startswith("https://api.groq.com") and asked[2][1]["response_format"]["json_schema"]["schema"]["required"] == ["a"]


def test_task_order():
    t = tasks.Task().register("s", lambda v: tasks.FanOut((("slow", v), ("fast", v)), "j").and_("fast", v + 1)).register("slow", lambda v: (time.sleep(0.05), tasks.Next("j", f"slow{v}"))[1])
    t.register("fast", lambda v: tasks.Next("j", f"fast{v}")).register("j", lambda got: tasks.Finish(got)).starts_with("s")
    for t.parallel in (False, True):
        assert t.run(1) == ["slow1", "fast1", "fast2"] and t.reset() == ["slow1", "fast1", "fast2"]


def test_task_runs_one_at_a_time():
    running, most, lock = [0], [0], threading.Lock()

    def work(v):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.02)
        with lock:
            running[0] -= 1
        return v

    t = tasks.Task().register("s", lambda v: tasks.FanOut(tuple(("w", i) for i in range(4)), "j")).register("w", work).transition("w", "j").register("j", sum).finishes("j").starts_with("s")
    assert t.run() == 6 and most[0] == 1
    t.parallel, most[0] = True, 0
    assert t.run() == 6 and most[0] > 1


def test_task_pause_and_errors():
    t = tasks.Task().register("a", lambda v: tasks.Pause("b", v + 1)).register("b", lambda v: v * 10).finishes("b").starts_with("a")
    assert t.run(1) is None and t.current == ["b"] and t.resume() == 20
    with pytest.raises(tasks.TaskError):
        t.resume()
    with pytest.raises(tasks.TaskError, match="no start"):
        tasks.Task().run()
    with pytest.raises(tasks.TaskError, match="x: boom"):
        tasks.Task().register("x", lambda v: (_ for _ in ()).throw(ValueError("boom"))).starts_with("x").run()
    nested = tasks.Task().register("s", lambda v: tasks.FanOut((("n", 1),), "j")).register("n", lambda v: tasks.FanOut((("n", 1),), "j")).register("j", lambda v: tasks.Finish(v)).starts_with("s")
    with pytest.raises(tasks.TaskError, match="inside a fan-out"):
        nested.run()


def test_branch_table(spark):
    df = spark.range(3).select(F.col("id").alias("task_id"))
    rows = tasks.fan_out(df, [lambda d: d.select("task_id", F.lit("x").alias("payload")), lambda d: d.where("task_id < 2").select("task_id", F.lit("a").alias("payload"))])
    assert {r.task_id: r.payloads for r in tasks.join_branches(rows, 2).collect()} == {0: ["x", "a"], 1: ["x", "a"]}


def test_message_windows(spark):
    rows = [(1, 0, "system"), (1, 1, "user"), (2, 0, "user"), (2, 1, "assistant"), (3, 0, "system"), (3, 1, "user"), (3, 2, "summary"), (3, 3, "user")]
    m = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id, r.turn) for r in messages.next_completion(m).collect()) == [(1, 0), (1, 1), (3, 0), (3, 2), (3, 3)]
    seen = spark.createDataFrame([(1, 1)], "conv_id long, turn long")
    assert {r.conv_id for r in messages.awaiting_completion(m, seen).collect()} == {3}
    assert {r.conv_id for r in messages.awaiting_completion(m, stop_on_assistant=False).collect()} == {1, 2, 3}


def test_stream_of_nodes(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    few(spark, ("a", "one"), ("a", "one"), ("b", "two")).coalesce(1).write.parquet(src)
    sink = sinks.ParquetSink(out)

    def run():
        s = streams.deduplicated(streams.files(spark, src, schema.NODE, files_per_batch=1), "id")
        streams.drained(streams.stored(s, lambda df, n: sink.store(df), str(tmp_path / "state")))

    run()
    few(spark, ("b", "two"), ("c", "three")).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r.path for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_record_stream(spark, tmp_path):
    spark.dataSource.register(loaders.RecordLog)
    s = spark.readStream.format("record_log").option("client", "tests_client:make").load()
    assert s.schema.simpleString() == "struct<key:string,value:string,offset:bigint>"
    assert loaders.record_nodes(spark.createDataFrame([(None, "v", 0)], "key string, value string, offset long")).first().metadata == {"fluvio_key": "null"}


def test_token_counters(spark):
    df = few(spark, ("a", "one two three"), ("b", "")).select("path", nodes.counted_tokens("chunk", lambda: lambda t: len(t.split())).alias("n"))
    assert {r.path: r.n for r in df.collect()} == {"a": 3, "b": 0}


def test_rank_file_counter(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    make = nodes.rank_file_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert few(spark, ("a", "hello world")).select(nodes.counted_tokens("chunk", make).alias("n")).first().n == 2


def test_lists_of_nodes(spark):
    df = few(spark)
    assert [n["chunk"] for n in loaders.list_nodes(df)] == ["one", "two", "one"] and len(list(loaders.iterate(df))) == 4
