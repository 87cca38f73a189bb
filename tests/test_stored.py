"""Stored indexes and the merged table: against plain searches and a plain dict."""

import math
import random
import re
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernspark.functions import stemming
from fernspark.operators import mergetable, models, nodes, retrieval, textindex, vectorindex
from fernspark.operators.indexing import IndexingPipeline

#: The published examples of the algorithm's steps, word and stem.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall
hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize
bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil say sai toy toi by by yes ye played plai crying cry controlling control""".split()  # fmt: skip


def test_stems(spark, tmp_path):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    df = spark.createDataFrame(pairs, "term string, want string")
    assert df.select(stemming.stemmed(F.array("term"))[0].alias("got"), "want").where("got <> want").collect() == []
    stemming.with_stems(df).write.parquet(f"{tmp_path}/stems")
    assert spark.read.parquet(f"{tmp_path}/stems").where("stem <> want").collect() == []
    assert "the" in stemming.STOP and len(set(stemming.STOP)) == len(stemming.STOP)


def corpus():
    rng = random.Random(7)
    vocabulary = [f"{a}{b}ing" for a in ("walk", "talk", "jump", "swim", "sail") for b in ("er", "s", "le", "on", "ick", "ump")]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60))) + " the and of") for i in range(400)]
    return docs + [(400, None), (401, ""), (402, "the of"), (403, docs[5][1]), (5, docs[5][1])], vocabulary


def brute_bm25(docs, asked, k):
    words = lambda t: re.findall("[a-z]+", (t or "").lower())
    bags = [(i, Counter(words(t))) for i, t in docs]
    average = sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for q, text in asked:
        score = {}
        for n, (_, b) in enumerate(bags):
            s = sum(math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / average)) for w in set(words(text)) if b[w])
            if s:
                score[n] = s
        best = sorted((-round(s, 6), bags[n][0]) for n, s in score.items())[:k]
        out += [(q, i, -s, r) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1, 5, 128])
def test_text_index_is_exact_and_skips(spark, tmp_path, block):
    docs, vocabulary = corpus()
    rng = random.Random(8)
    asked = [(q, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 4)))) for q in range(20)] + [(20, None), (21, "unheard"), (22, "The")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "id long, chunk string, term string").repartition(3)
    index = textindex.StoredTextIndex.build(df, str(tmp_path), split=retrieval.words, stems=False, block=block)
    queries = spark.createDataFrame(asked, "qid long, current string")
    got = sorted((r.qid, r.id, r.score, r["rank"]) for r in textindex.StoredTextIndex.load(spark, str(tmp_path), split=retrieval.words, stems=False).search(queries, 5, digits=6).collect())
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in brute_bm25(docs, asked, 5)]
    blocks, read = index.shares(queries, 5).agg(F.sum("blocks"), F.sum("read")).first()
    assert read <= blocks and (block > 5 or read < 0.9 * blocks)


def test_text_index_stems_and_stops(spark, tmp_path):
    df = spark.createDataFrame([(1, "The hopping of cats"), (2, "a hopped cat"), (3, "dogs"), (4, None)], "id long, chunk string")
    index = textindex.StoredTextIndex.build(df, str(tmp_path))
    found = index.search(spark.createDataFrame([(1, "hops and the CAT"), (2, "of the")], "qid long, current string"))
    assert sorted((r.qid, r.id) for r in found.collect()) == [(1, 1), (1, 2)]


def test_empty_text_index(spark, tmp_path):
    index = textindex.StoredTextIndex.build(spark.createDataFrame([], "id long, chunk string"), str(tmp_path))
    assert index.search(spark.createDataFrame([(1, "cat")], "qid long, current string")).collect() == []


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vector_index(spark, tmp_path, metric):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24)) * 4
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9000, None), (9001, []), (9002, [1.0] * 3), (9003, [float("nan")] * 24), (9004, [float("inf")] * 24), (None, rows[0][1]), (9005, rows[0][1])]
    df = spark.createDataFrame([(*r, "c") for r in rows[:2500] + odd], "id long, embedding array<double>, list string")
    built = vectorindex.VectorIndex.build(df, str(tmp_path), metric=metric)
    built.add(spark.createDataFrame(rows[2500:], "id long, embedding array<double>"))
    index = vectorindex.VectorIndex.load(spark, str(tmp_path))
    assert (index.probes, index.candidates) == (built.probes, built.candidates) and index.probes < len(index.codec.centres) // 2
    asked = spark.createDataFrame(rows[::100], "qid long, embedding array<double>")
    got = index.search(asked, 10).collect()
    good = df.where("id < 9000 or id = 9005").select("id", F.col("embedding").cast("array<float>").alias("embedding")).unionByName(spark.createDataFrame(rows[2500:], "id long, embedding array<double>"))
    want = retrieval.similarity(good, asked, retrieval.SimilaritySingleEmbedding(10, None, metric)).collect()
    assert len({(r.qid, r.id) for r in got} & {(r.qid, r.id) for r in want}) >= 0.9 * len(want)
    assert all(len([r for r in got if r.qid == q]) == 10 for q in {r.qid for r in want}) and {r.id for r in got if r.qid == 0 and r["rank"] <= 2} == {0, 9005}


def test_small_vector_index(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, embedding array<float>")
    found = vectorindex.VectorIndex.build(df, str(tmp_path)).search(df.where("id = 1").select(F.col("id").alias("qid"), "embedding"), 5)
    assert [r.id for r in found.orderBy("rank").collect()][0] == 1
    with pytest.raises(ValueError):
        vectorindex.VectorIndex.build(df.limit(0), f"{tmp_path}/none")


def contents(table):
    rows = table.read()
    return {} if rows is None else {r.id: r.v for r in rows.collect()}


def test_merge_table_is_a_dict(spark, tmp_path):
    rng = random.Random(1)
    table, want = mergetable.MergeTable(spark, str(tmp_path), most_folders=4), {}
    assert table.read() is None and table.version() == 0
    for commit in range(10):
        some = {rng.randrange(60): rng.randrange(1000) for _ in range(15)}
        if commit % 4 == 3:
            gone = spark.createDataFrame([(i,) for i in some], "id long")
            assert table.remove(gone.union(gone)) == len(some)
            want = {i: v for i, v in want.items() if i not in some}
        else:
            assert table.upsert(spark.createDataFrame(list(some.items()), "id long, v long")) == len(some)
            want |= some
        assert contents(table) == want
    new = spark.createDataFrame([(1, -1), (100, -2)], "id long, v long")
    had = 1 in want
    assert table.insert(new) == 2 - had and contents(table) == {1: -1, 100: -2} | want
    assert table.upsert(new.limit(0)) == 0
    with pytest.raises(Exception, match="without a key"):
        table.upsert(spark.createDataFrame([(None, 1)], "id long, v long"))
    before = contents(table)
    assert table.vacuum() > 0 and contents(table) == before


def test_merge_table_with_two_writers_and_a_killed_one(spark, tmp_path, monkeypatch):
    table = mergetable.MergeTable(spark, str(tmp_path))
    row = lambda i, v: spark.createDataFrame([(i, v)], "id long, v long")
    errors = []

    def writer(k):
        try:
            for j in range(3):
                table.upsert(row(k * 10 + j, j))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and table.version() == 6 and contents(table) == {k * 10 + j: j for k in range(2) for j in range(3)}
    # Another writer takes the version between this one's look and its rename.
    put = mergetable.MergeTable._put
    state = {"first": True}

    def raced(self, version, manifest):
        if state.pop("first", None):
            table.upsert(row(77, 7))
        return put(self, version, manifest)

    monkeypatch.setattr(mergetable.MergeTable, "_put", raced)
    table.upsert(row(88, 8))
    monkeypatch.undo()
    assert table.version() == 8 and contents(table)[77] == 7 and contents(table)[88] == 8

    def killed(self, version, manifest):
        raise KeyboardInterrupt

    monkeypatch.setattr(mergetable.MergeTable, "_put", killed)
    with pytest.raises(KeyboardInterrupt):
        table.upsert(row(99, 9))
    monkeypatch.undo()
    assert 99 not in contents(table) and table.read(6).count() == 6
    table.compact()
    assert len(table.manifest(table.version())["changes"]) == 0 and len(contents(table)) == 8


def test_merge_sink(spark, tmp_path):
    sink = mergetable.MergeSink(f"{tmp_path}/table", mode="upsert").with_vector("Combined", 8)
    df = nodes.nodes(spark.createDataFrame([("a", "one"), ("b", "two")], "path string, chunk string"), path="path", chunk="chunk")
    for _ in range(2):
        IndexingPipeline(df).then(nodes.embed(models.HashEmbedder(8))).then_store_with(sink).run()
    assert sink.read(spark).count() == 2 and mergetable.MergeTable(spark, sink.path).version() == 2
