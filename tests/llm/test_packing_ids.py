"""Token ids of packed documents against a tokenizer of the test's own."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fernspark.llm import entries, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
LETTERS = [chr(c) for c in range(0x250) if chr(c).isalpha()]


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def words():
    return packing.WordIds(open(WORDS, "rb").read())


def check(words, own, texts):
    for t, got in zip(texts, words.texts(texts), strict=True):
        assert np.frombuffer(got, np.uint32).tolist() == own.encode(t, add_special_tokens=False).ids, t


def test_every_latin_letter(words, own):
    for c in LETTERS:
        check(words, own, [f"{a}{c}{b}" for a in ("", "ab", "Ab", "Ж") for b in ("", ".", ",", "s", "s.", ".,")])
    check(words, own, [" ".join(f"x{c}{b}" for c in LETTERS) for b in ("", ",", ".")])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*LETTERS, " ", "\n", "'s", ",", ".", "1", "́", "̇", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "Σ", "日"]), max_size=30).map("".join))
def test_any_text(text):
    w = packing._loaded.get((1, False)) or packing._loaded.setdefault((1, False), packing.WordIds(open(WORDS, "rb").read()))
    check(w, _kept["own"], [text])


_kept = {"own": Tokenizer.from_file(WORDS)}


def test_special_tokens_as_text(own):
    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    check(packing.WordIds(open(WORDS, "rb").read(), special_as_text=True), plain, ["a <|endoftext|> b", "<|EndOfText|>"])
    assert plain.encode("a <|endoftext|>", add_special_tokens=False).ids != own.encode("a <|endoftext|>", add_special_tokens=False).ids


def test_a_full_memory_is_emptied(own, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_BYTES", 6000)
    w = packing.WordIds(open(WORDS, "rb").read())
    full = 0
    for k in range(30):
        check(w, own, [f"word{k} hot, hot cold. " + " ".join(f"w{chr(97 + i)}{chr(97 + k % 20)}, é{chr(97 + i)}." for i in range(20))])
        assert "" in w and w.held < 20_000 and len(w.older) < 100
        full += bool(w.older)
    assert full > 20


def test_query_against_the_library(spark, own):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {(r.doc_id, r.piece): r for r in entries.op10_packing(spark, sf).collect()}
    seen = 0
    for d, text in docs.items():
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for k, start in enumerate(range(0, len(ids), 4096)):
            r, part = rows[d, k], ids[start : start + 4096]
            assert (r.start, r.length, r.ids_crc32) == (start, len(part), zlib.crc32(part.tobytes()))
            seen += 1
    assert seen == len(rows)
    at: dict = {}
    for r in sorted(rows.values(), key=lambda r: r.offset):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096
