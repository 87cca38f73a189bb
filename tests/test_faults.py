"""Cases that once went wrong: joins of branches, ways of searching, identifiers, sinks by folders, providers' messages, code inside code."""

import json
import os
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fernspark import session
from fernspark.functions import code, scalar
from fernspark.operators import agent, models, nearest, retrieval, sinks
from fernspark.operators import nodes as N
from fernspark.plans import q_indexing, tasks
from fernspark.tables import table


def test_a_missing_branch_isnt_made_up_by_another(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (2, 0, "a"), (2, 1, "b"), (3, 1, "x"), (3, 0, "y"), (3, 1, "x")], "task_id long, branch int, payload string")
    assert {r.task_id: r.payloads for r in tasks.join_branches(rows, 2).collect()} == {2: ["a", "b"], 3: ["y", "x"]}


def test_identifiers(spark):
    names = {"a": True, "_a$1": True, "1a": False, "$a": False, "a-b": False, "a" * 63: True, "a" * 64: False, "": False, "a\n": False, "é": False, "True": False, "index": False, "COLUMN": False, "alter": False, "Add": False, "order": True, None: False}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.ok for r in df.select("n", scalar.is_identifier("n").alias("ok")).collect()} == names


@pytest.mark.parametrize("metric", sorted(retrieval.METRICS))
@pytest.mark.parametrize("digits", [None, 1, 6])
def test_both_ways_of_searching_agree(spark, monkeypatch, metric, digits):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-2, 3, 5) / 3).tolist()) for i in range(80)] + [(100, [1.0, 2.0]), (101, [0.0] * 5), (102, [1.0, None, 2.0, 0.0, 1.0]), (103, None)]
    rows = [(i, v) for i, v in rows if i != 102]
    docs = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = docs.where("id % 7 = 0 or id >= 100").withColumnRenamed("id", "qid")
    monkeypatch.setattr(retrieval, "SHARD", 30)
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    how = retrieval.SimilaritySingleEmbedding(6, None, metric)
    found = [sorted((r.qid, r["rank"], r.id, r.score) for r in retrieval.similarity(docs, asked, how, digits=digits, broadcast_queries=n).collect()) for n in (1000, 0)]
    assert repr(found[0]) == repr(found[1]) and len(found[0]) == 6 * asked.where("embedding is not null").count()


def plain_bm25(docs, question, stop=()):
    split = lambda t: [w for w in re.split("[^a-z]+", (t or "").lower()) if w and w not in stop]
    words = {i: split(t) for i, t in docs}
    average = sum(map(len, words.values())) / len(words)
    out = {}
    for i, w in words.items():
        for term in set(split(question)) & set(w):
            df = sum(term in x for x in words.values())
            tf = w.count(term)
            out[i] = out.get(i, 0.0) + np.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
    return out


def test_text_index(spark, tmp_path, monkeypatch):
    docs = [(1, "the cat sat on the mat"), (2, "a dog, a cat and a mat"), (3, None), (4, ""), (5, "the the the bird")]
    df = spark.createDataFrame(docs, "id long, chunk string")
    asked = spark.createDataFrame([(1, "the cat the"), (2, "Mat bird"), (3, "nothing here"), (4, None)], "qid long, current string")
    for stop in ((), ("the", "a")):
        index = retrieval.TextIndex.of(df, stop=stop)
        want = {(q, i): round(s, 9) for q, t in ((1, "the cat the"), (2, "Mat bird")) for i, s in plain_bm25(docs, t, stop).items()}
        stored = index.save(str(tmp_path / f"index{len(stop)}"))
        for some in (index, stored, retrieval.TextIndex.load(spark, str(tmp_path / f"index{len(stop)}"), stop=stop)):
            for most in (200_000, 0):
                monkeypatch.setattr(retrieval, "BROADCAST_TERMS", most)
                assert {(r.qid, r.id): round(r.score, 9) for r in some.scores(asked).collect()} == want
    stems = retrieval.TextIndex.of(df, split=lambda t: F.transform(retrieval.words(t), lambda w: F.regexp_replace(w, "s$", "")))
    assert {r.id for r in stems.scores(spark.createDataFrame([(1, "cats")], "qid long, current string")).collect()} == {1, 2}
    plan = retrieval.TextIndex.of(df).scores(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_sink_rewrites_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = sinks.ParquetSink(path, "upsert", parts=8).with_metadata("k")
    rows = lambda ids, v: N.nodes(spark.createDataFrame([(f"p{i}", f"c{i}") for i in ids], "p string, c string"), path="p", chunk="c").withColumn("metadata", F.create_map(F.lit("k"), F.lit(v)))
    assert sink.store(rows(range(50), "old")) == 50
    files = lambda: {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    assert sink.store(rows([3, 3, 60], "new")) == 2
    got = {r.path: r.meta_k for r in sink.read(spark).collect()}
    assert len(got) == 51 and got["p3"] == "new" and got["p60"] == "new" and got["p4"] == "old"
    assert 1 <= len(set(before) - set(files())) <= 2 and not [f for f in os.listdir(tmp_path) if ".new-" in f]
    assert sink.store(rows([], "none")) == 0 and sinks.ParquetSink(path, "insert").store(rows(range(45, 55), "x")) == 5
    assert "_part" not in sink.read(spark).columns and sink.read(spark).count() == 56
    empty = sinks.ParquetSink(str(tmp_path / "e"), "insert")
    assert empty.store(rows([], "none")) == 0 and empty.store(rows([1], "x")) == 1 and empty.read(spark).count() == 1


def test_agent_with_a_provider():
    sent = []

    def send(request, timeout):
        body = json.loads(request.data)
        sent.append(body)
        if body["messages"][-1]["role"] == "tool":
            return json.dumps({"choices": [{"message": {"content": "It is 3."}}], "usage": {"total_tokens": 5}}).encode()
        call = {"id": "k", "type": "function", "function": {"name": "add", "arguments": '{"a": 1, "b": 2}'}}
        return json.dumps({"choices": [{"message": {"role": "assistant", "content": None, "tool_calls": [call]}}]}).encode()

    @agent.tool()
    def add(a: int, b: int) -> int:
        """Adds."""
        return a + b

    a = agent.Agent(models.RemoteModel("openai", "key", "model", send=send), [add], system="Be short.")
    a.history.append({"role": "summary", "text": "Before."})
    assert a.query("1 and 2?") == "done" and a.history[-1]["text"] == "It is 3."
    roles = [m["role"] for m in sent[1]["messages"]]
    assert roles == ["system", "system", "user", "assistant", "tool"] and all("content" in m and "text" not in m for m in sent[1]["messages"])
    asked, told = sent[1]["messages"][-2:]
    assert asked["tool_calls"][0] == {"id": "k", "type": "function", "function": {"name": "add", "arguments": '{"a": 1, "b": 2}'}} and told["tool_call_id"] == "k" and told["content"] == "3"
    assert sent[0]["tools"][0]["function"]["name"] == "add"
    assert models.RemoteModel("openai", "key", send=send).prompt("hi") is None


def test_code_inside_code():
    body = "".join(f"        x{i} = {i}\n" for i in range(15))
    python = "import a\n\n\nclass A:\n" + "".join(f"    @property\n    def f{i}(self):\n{body}        return {i}\n\n" for i in range(8)) + "y = 1\n"
    got = code.chunks(python, "python", 700)
    assert "".join(got) == python and all(len(c.encode()) <= 700 for c in got) and len(got) > 3
    assert all(c.startswith(("import a", "    @property\n    def", "y = 1")) for c in got)  # no method is cut
    rust = 'fn a() {\n    let s = "}}}"; // }\n    if x {\n        y();\n    }\n}\n\nimpl B {\n' + "".join(f"    fn f{i}(&self) {{\n        g('{{');\n    }}\n" for i in range(20)) + "}\n"
    got = code.chunks(rust, "rust", 300)
    assert "".join(got) == rust and got[0].startswith("fn a()")
    assert all(c.count("fn f") == c.count("g('{');\n    }\n") for c in got)  # no function is cut
    assert code.chunks("", "rust") == [] and code.chunks("", "python") == [] and code.chunks("x = (\n", "python") == ["x = (\n"]


def test_chunk_queries_keep_the_text(spark, sf):
    docs = {f"d{r.doc_id}.py": r for r in table(spark, sf, "documents").collect()}
    parts: dict = {}
    for r in q_indexing.chunk_code(spark, sf).collect():
        parts.setdefault(r.path, []).append((r.offset, r.chunk))
    assert set(parts) == set(docs)
    for path, found in parts.items():
        found.sort()
        whole = "".join(c for _, c in found)
        at = 0
        for offset, c in found:
            assert offset == at and len(c.encode()) <= 1500
            at += len(c.encode())
        shown = re.sub(r"(?m)^        # ", "", whole[: whole.rindex("\n        return " + str(docs[path].n_chars))])
        assert re.sub(r"\s", "", docs[path].text) in re.sub(r"\s", "", shown)
    squeezed = lambda t: re.sub(r"\s", "", t)
    nodes = N.nodes(table(spark, sf, "documents").withColumn("p", F.concat(F.lit("p"), "doc_id")), path="p", chunk="text")
    texts = {r.path: r.chunk for r in nodes.collect()}
    for split, most in ((N.chunk_text(200), 200), (N.chunk_markdown(300), 300)):
        got: dict = {}
        for r in split(nodes.withColumn("at", F.monotonically_increasing_id())).withColumn("k", F.monotonically_increasing_id()).orderBy("at", "k").collect():
            assert len(r.chunk) <= most and r.chunk == r.chunk.strip() and r.chunk in texts[r.path]
            got[r.path] = got.get(r.path, "") + squeezed(r.chunk)
        assert got == {p: squeezed(t) for p, t in texts.items() if squeezed(t)}


def test_scratch_needs_a_shared_folder():
    class Context:
        master = "yarn"

    class Fake:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        session.scratch_dir(Fake())
    Context.master = "local[4]"
    assert session.scratch_dir(Fake()).startswith("file:")


def test_sink_keeps_the_first_of_an_id(spark, tmp_path):
    import duckdb

    from fernspark.plans import registry

    rows = [(i, f"text {i % 40}", "abcdefg"[(i * 5 + i // 40) % 7], "s", 7) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").orderBy(F.desc("doc_id")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["sink_metadata_columns"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted((r.id, r.meta_lang) for r in got) == sorted(r[:2] for r in con.execute(registry.SQL["sink_metadata_columns"]).fetchall()) and len(got) == 40


@pytest.mark.parametrize("metric", sorted(retrieval.METRICS))
def test_all_ways_of_searching_give_the_expressions_scores(spark, monkeypatch, metric):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(1000 - i, [0.5] * 8) for i in range(60)] + [(2000, [1.0, 2.0]), (2001, [0.0] * 8), (2002, [1e-200] * 8), (2003, None), (2004, [])]
    docs = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = docs.where("id % 9 = 0 or id > 1995").withColumnRenamed("id", "qid")
    how = retrieval.SimilaritySingleEmbedding(5, None, metric)
    found = []
    for handful, few in ((1000, 1000), (0, 1000), (0, 0)):
        monkeypatch.setattr(retrieval, "HANDFUL", handful)
        df = retrieval.similarity(docs, asked, how, digits=6, broadcast_queries=few)
        found.append(sorted((r.qid, r["rank"], r.id, repr(r.score)) for r in df.collect()))
        # Many queries cost neither pairs in the plan nor a shuffle of each row for a thousand of them.
        assert handful or "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    assert found[0] == found[1] == found[2] and len(found[0]) == 5 * asked.where("embedding is not null").count()


def test_best_rows_by_text_are_cut_in_the_tasks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [a + b for a in "bcdfgh" for b in ("an", "el", "or")]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(200)] + [(900, None), (901, "")]
    docs += [(300 + i, docs[7][1]) for i in range(40)]
    df = spark.createDataFrame(docs, "id long, chunk string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(rng.choice(words, 5))) for q in range(15)] + [(15, docs[7][1]), (16, "nothing"), (17, None)], "qid long, current string")
    index, some = retrieval.TextIndex.of(df), df.where("id % 3 = 0").select("id")
    for among in (None, some):
        every = index.scores(asked) if among is None else index.scores(asked).join(some, "id", "left_semi")
        want = retrieval.ranked(every.withColumn("score", F.round("score", 6)), 6)
        found = index.best(asked, 6, digits=6, among=among)
        assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()  # pairs of queries and rows aren't grouped
        assert sorted((r.qid, r["rank"], r.id, r.score) for r in found.collect()) == sorted((r.qid, r["rank"], r.id, r.score) for r in want.collect())


def test_sparse_products_are_cut_in_the_tasks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vector = lambda: (lambda i: (i.tolist(), rng.integers(-3, 4, len(i)).astype(float).tolist()))(np.sort(rng.choice(1 << 30, 5) % 40 * (1 << 24)))
    rows = [(i, vector()) for i in range(300)]
    rows += [(1000 - i, rows[4][1]) for i in range(50)] + [(2000, None), (2001, ([], []))]
    docs = spark.createDataFrame(rows, "id long, sparse struct<indices:array<int>,values:array<float>>").repartition(3)
    asked = docs.where("id % 7 = 0 or id >= 1000").withColumnRenamed("id", "qid")
    found = retrieval.sparse_similarity(docs, asked, 6)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    few = sorted((r.qid, r["rank"], r.id, r.score) for r in found.collect())
    monkeypatch.setattr(retrieval, "QUERY_TERMS", 0)
    assert few == sorted((r.qid, r["rank"], r.id, r.score) for r in retrieval.sparse_similarity(docs, asked, 6).collect()) and few


def test_a_search_of_the_stored_index_groups_no_pairs(spark, tmp_path, monkeypatch):
    from fernspark.operators import textindex

    monkeypatch.setattr(textindex, "POSTINGS", 20)
    docs = [(i, f"cats {'sat ' * (i % 5)}on mats {i % 7 * 'running '}") for i in range(120)]
    df = spark.createDataFrame(docs, "id long, chunk string")
    index = textindex.StoredTextIndex.build(df, str(tmp_path))
    assert len([p for p in os.listdir(tmp_path / "blocks") if p.endswith(".parquet")]) > 8  # more postings, more tasks
    asked = spark.createDataFrame([(1, "cat mat"), (2, "runs sat"), (3, "cat run")], "qid long, current string")
    found = index.search(asked, 5, digits=6)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    few = sorted((r.qid, r["rank"], r.id, r.score) for r in found.collect())
    monkeypatch.setattr(textindex, "BROADCAST_TERMS", 0)
    assert few == sorted((r.qid, r["rank"], r.id, r.score) for r in index.search(asked, 5, digits=6).collect()) and few
    other = textindex.StoredTextIndex.build(df, str(tmp_path / "other"))
    assert sorted(map(tuple, other.terms.collect())) == sorted(map(tuple, index.terms.collect()))


def test_python_holds_few_rows_of_a_batch(spark):
    seen = []

    class Model:
        def embed(self, texts):
            return [[float(len(texts))] for _ in texts]

    df = N.nodes(spark.range(1000).coalesce(1).select(F.col("id").cast("string").alias("t")), path="t", chunk="t")
    made = N.embed(Model(), 100)(df).select(F.element_at("vectors", F.lit("Combined"))[0].alias("n")).collect()
    assert {r.n for r in made} == {100.0} and len(made) == 1000
    parts = list(N.parts_of(iter([__import__("pyarrow").array(range(150))])))
    assert [len(p) for p in parts] == [64, 64, 22] and not seen
    assert sorted(int(r.chunk) for r in N.mapped(lambda t: str(int(t) + 1))(df).collect()) == list(range(1, 1001))


def searched(m, q, k, metric, larger, slack):
    """What a task keeps, and its peak of memory in MB."""
    best, every = nearest.Best(k, slack, len(q)), np.arange
    tracemalloc.start()
    nearest.nearest({m.shape[1]: (every(len(m)), m)}, {q.shape[1]: (every(len(q)), q)}, pa.array(every(len(m))), k, metric, larger, best)
    found = best.table(pa.array(every(len(q))), pa.int64(), True)
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    return found, peak


def test_a_searchs_memory_is_the_same_in_any_order_of_rows():
    rng = np.random.default_rng(5)
    m = rng.normal(size=(32_768, 16)) * np.linspace(3, 0.1, 32_768)[:, None]  # nearer ones later
    q = rng.normal(size=(256, 16)) / 100
    found, peak = searched(m, q, 10, "l2", False, 0.0)
    assert peak < 80
    want = np.argsort(np.sqrt(((m[None] - q[:8, None]) ** 2).sum(2)), axis=1)[:, :10]
    got = found.to_pandas().sort_values(["qid", "score"])
    assert len(got) == 2560 and got[got.qid < 8].id.tolist() == want.ravel().tolist()


@pytest.mark.parametrize("metric", sorted(retrieval.METRICS))
def test_scores_that_rounding_makes_equal_arent_all_kept(spark, monkeypatch, metric):
    rng = np.random.default_rng(6)
    one = rng.normal(size=8)
    m = one + rng.normal(size=(3000, 8)) * 1e-9
    found, _ = searched(m, m[:200], 10, metric, metric in ("cosine", "dot"), 1e-6)
    assert 2000 <= found.num_rows <= 3 * 2000
    # Near copies with scores on both sides of where rounding changes, in all ways of searching.
    rows = [(int(i), (one + rng.normal(size=8) * 10.0 ** -rng.integers(1, 9)).tolist()) for i in rng.permutation(400)]
    docs = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(2)
    asked = docs.where("id % 16 = 0").withColumnRenamed("id", "qid")
    for digits in (2, 6):
        got = []
        for handful, few in ((1000, 1000), (0, 1000), (0, 0)):
            monkeypatch.setattr(retrieval, "HANDFUL", handful)
            df = retrieval.similarity(docs, asked, retrieval.SimilaritySingleEmbedding(5, None, metric), digits=digits, broadcast_queries=few)
            got.append(sorted((r.qid, r["rank"], r.id, repr(r.score)) for r in df.collect()))
        assert got[0] == got[1] == got[2] and len(got[0]) == 5 * 25
