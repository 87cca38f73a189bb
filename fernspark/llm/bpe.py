"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame

from fernspark.llm.common import slices

#: Texts of more characters are split before they are encoded.
LONG = 1 << 16
#: Rank files are sent to the executors once; a larger one is refused.
MAX_RANK_BYTES = 64 << 20
#: Fixed value: the pre-splitting pattern whose matches are known well enough to cut texts. With any other, texts are encoded whole.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A white-space character after one that is none always starts a match of this pattern.
#: Space and line feed are white space to every regex engine; what Python alone takes for white space doesn't count.
_SAFE = re.compile(r"(?<=\S)[ \n]")
#: The library's regex engine goes back step by step over white space and overflows its stack on long runs; runs from this length on are told apart here.
LONG_RUN = 1 << 15
#: White space to the library (Unicode's property).
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_encoders: dict[tuple, tiktoken.Encoding] = {}


def encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The library's encoding for a rank file's bytes, one per Python worker."""
    key = (hash(ranks), pattern)
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        _encoders[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def safe_pieces(text: str, size: int = LONG) -> Iterator[str]:
    """Cuts ``text`` after about ``size`` characters each, only where a match starts in any case.

    Such a place is a space or line feed after a character that isn't white space: no alternative of the pattern reaches
    over it from the left, and none looks back. Where no such place follows, the rest stays whole.
    """
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str, size: int = LONG, run: int = LONG_RUN) -> list[int]:
    """Token ids of ``text``, special tokens being ordinary text, as ``encode_ordinary`` of the whole text gives them.

    A run of white space before a character that is none is two matches to the pattern, all but its last character and what begins with
    that; a run at the end is one. So long runs go to the library's encoder of single matches.
    """
    if enc._pat_str != KNOWN_PATTERN or len(text) <= min(size, run):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for m in re.finditer(f"[{_WHITE}]{{{run},}}", text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        for piece in safe_pieces(text[at : m.start()], size):
            ids += enc.encode_ordinary(piece)
        if end > m.start():
            ids += enc._core_bpe.encode_single_piece(text[m.start() : end].encode())
        at = end
    for piece in safe_pieces(text[at:], size):
        ids += enc.encode_ordinary(piece)
    return ids


def rank_file(path: str) -> bytes:
    """A rank file's bytes; too large a file is an error."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has over {MAX_RANK_BYTES} bytes")
    return data


def encode(docs: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes its ids again.

    Returns ``<id_col>, token_ids array<int>, decoded binary`` for each input row, repeated rows included. Null or empty
    text: no ids, empty bytes. A null id stays null. Other columns of the input aren't read, so their names can't clash.
    An empty table gives an empty table. Very long texts are encoded in parts that match as the whole does, if ``pattern`` is :data:`KNOWN_PATTERN`;
    with another pattern each text goes whole to the library. The rank file is read on the driver and broadcast (at most 64 MB).
    """
    spark = docs.sparkSession
    sent: Broadcast = spark.sparkContext.broadcast(rank_file(rank_path))
    src = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("_text"))
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for batch in batches:
            enc = enc or encoder(sent.value, pattern)
            for part in slices(batch, "_text"):
                ids = [encode_text(enc, t) if t else [] for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode_bytes(x) for x in ids], pa.binary())],
                    [id_col, "token_ids", "decoded"],
                )

    return src.mapInArrow(run, f"`{id_col}` {kind}, token_ids array<int>, decoded binary")


def decode(rows: DataFrame, rank_path: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """Raw bytes of id lists: ``<id_col>, decoded binary`` per row; null or empty lists give empty bytes, unknown ids an error. The rank file has at most 64 MB."""
    sent = rows.sparkSession.sparkContext.broadcast(rank_file(rank_path))
    src = rows.select(rows[id_col].alias(id_col), rows[ids_col].cast("array<int>").alias("_ids"))
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enc = encoder(sent.value, pattern)
            out = [enc.decode_bytes(x or []) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
