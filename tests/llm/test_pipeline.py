"""The corpus pipeline's rows against a plain version, and its odd tables."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from fernspark.llm import langid, secrets, simhash


def plain(rows, learned):
    """(doc_id, piece, start, length, ids_crc32) of all pieces; rows: (doc_id, text)."""
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [r for r in rows if langid.predict(r[1], learned)[0] != "und"]
    prints = [simhash.fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    first: dict = {}
    for i, (d, _) in enumerate(rows):
        a = i
        while root[a] != a:
            a = root[a]
        if a not in first or d < rows[first[a]][0]:
            first[a] = i
    out = []
    for i in first.values():
        ids = np.array([*own.encode(secrets.redact(rows[i][1]), add_special_tokens=False).ids, 1], "<u4")
        out += [(rows[i][0], k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    return sorted(out)


def staged(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
    return docs


def test_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain(rows, langid.learn(docs))
    used: dict = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 4096


def test_odd_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert staged(spark, docs.limit(0)).collect() == []
    few = docs.limit(20).selectExpr("doc_id", "text", "lang", "1 AS fp", "2L AS component_id", "'t' AS _text", "3 AS sequence_id", "4 AS offset", "'a' AS _id", "'b' AS _row", "map('k', 'v') AS ids", "5 AS _a")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, few, sf)
        assert out.columns == few.columns
        few = out
    rows = staged(spark, few).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in few.collect()}
    # A repeated id with different texts, equal rows, nulls in any column, a very long text.
    long = " ".join(f"w{i}" for i in range(300_000))
    odd = spark.createDataFrame(
        [(1, "first text of the table here", None, None, None), (1, "another text with the same number", "en", "s", 1), (2, "twice in the table it is", "en", "s", 1), (2, "twice in the table it is", "en", "s", 1), (3, None, "en", None, None), (4, "", None, "s", 0), (5, long, "en", "s", len(long)), (None, "a text without a number", "en", "s", 1)],
        docs.schema,
    )
    got = staged(spark, odd).collect()
    assert sorted((r.doc_id or 0) for r in got if r.piece == 0) == [0, 1, 1, 2, 5] and max(r.piece for r in got if r.doc_id == 5) > 100
