"""Byte-level BPE on long runs and with other patterns."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernspark.llm import bpe

DATA = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
#: As newer vocabularies have it: punctuation takes line feeds, so that a cut before a line feed would change the matches.
OTHER = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""


def test_the_pattern_is_the_public_one():
    assert bpe.KNOWN_PATTERN == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "'s", "1", ".", " ", "  ", "    ", "\n", "\n\n", "\t", "\x85", "\xa0", "　", " ", "\x1c", "​", " \n \n"]), max_size=80).map("".join), st.integers(1, 20), st.integers(1, 6))
def test_runs_encode_like_the_whole(text, size, run):
    enc = bpe.encoder(DATA, bpe.KNOWN_PATTERN)
    assert bpe.encode_text(enc, text, size, run) == enc.encode_ordinary(text)


@pytest.mark.parametrize("one", [" ", "\n", "\r\n", "a", "1", ".", "é "])
def test_millions_of_characters(one):
    enc = bpe.encoder(DATA, bpe.KNOWN_PATTERN)
    for text in (one * (5_000_000 // len(one)), "x" + one * (1_200_000 // len(one)) + "y z"):
        ids = bpe.encode_text(enc, text)
        assert enc.decode_bytes(ids) == text.encode()
    short = "x" + one * 100_000 + "y z"  # what the library still does whole
    assert bpe.encode_text(enc, short) == enc.encode_ordinary(short)


def test_another_pattern_encodes_whole_texts():
    enc = bpe.encoder(DATA, OTHER)
    text = ("word. \n\n, (x)\n y" * 50)[:700]
    assert bpe.encode_text(enc, text, 10, 2) == enc.encode_ordinary(text)


def test_rank_files_are_limited(tmp_path, monkeypatch, spark):
    (tmp_path / "ranks").write_bytes(DATA)
    monkeypatch.setattr(bpe, "MAX_RANK_BYTES", 1000)
    rows = spark.createDataFrame([(1, "a", [1])], "doc_id long, text string, token_ids array<int>")
    with pytest.raises(ValueError):
        bpe.encode(rows, str(tmp_path / "ranks"), bpe.KNOWN_PATTERN)
    with pytest.raises(ValueError):
        bpe.decode(rows, str(tmp_path / "ranks"), bpe.KNOWN_PATTERN)
