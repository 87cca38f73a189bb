"""Packing tokenised documents into sequences: cut to pieces, then sum-of-squares bin packing of the pieces."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fernspark.llm.common import slices, written

#: Pieces that one task packs. A group ends with about one sequence that isn't full, so larger groups waste less.
GROUP_PIECES = 32768
#: Bytes of words and ids that a Python worker keeps, and what a word takes besides.
KEPT_BYTES, WORD_BYTES = 288 << 20, 200
MAX_TOKENIZER_BYTES = 64 << 20

_loaded: dict[tuple[int, bool], WordIds] = {}


class WordIds(dict):
    """Ids (little-endian uint32 bytes) by word, for tokenizers that drop white space and handle each word by itself.

    Words are what lies between spaces and line feeds. New words go through the whole tokenizer together, joined by
    spaces. If the tokenizer folds case, Latin-1 texts are folded before; if it takes a full stop or comma apart from letters,
    a Latin word whose lower-case form is letters throughout takes the ids of both when it ends with one. What a tokenizer does is tried at the start.

    When half of ``KEPT_BYTES`` is held, the words become the older ones, in place of those before; an older word that comes again is among the new ones again.
    """

    def __init__(self, data: bytes, *, special_as_text: bool = False):
        super().__init__({"": b""})
        self.held, self.older = 0, {}
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(c in t for t in self.special for c in " \n"):
            raise ValueError("a special token with a blank")
        ids = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        if ids("ab cd\nab") != ids("ab") + ids("cd") + ids("ab") or ids(" ") or ids("\n"):
            raise ValueError("this tokenizer doesn't handle words by themselves")
        upper = "".join(chr(c) for c in range(0x100) if chr(c).isupper())
        self.folds = all(ids(c + "x") == ids(c.lower() + "x") for c in upper)
        self.marks = {c: np.array(ids(c), np.uint32).tobytes() for c in ".,"} if all(ids(f"{w}{c}") == ids(w) + ids(c) for w in ("ab", "é") for c in ".,") else {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def keep(self, words: list[str], ids: list[bytes]) -> None:
        self.update(zip(words, ids, strict=True))
        self.held += sum(map(len, words)) + sum(map(len, ids)) + WORD_BYTES * len(words)

    def encode(self, words: list[str]) -> None:
        """Learns words that are letters throughout, so one unit each to the tokenizer; any others if that turns out not to hold."""
        e = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0]
        ids = np.array(e.ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or len(ids) and ends[-1] != len(ids):
            self.encode_any(words)
            return
        data, cut = ids.tobytes(), [0, *(4 * ends).tolist()]
        self.keep(words, [data[a:b] for a, b in pairwise(cut)])

    def encode_any(self, words: list[str]) -> None:
        """Learns any words; offsets tell which ids are whose."""
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        data = np.array(e.ids, np.uint32).tobytes()
        edges = (4 * np.searchsorted(np.array([o[0] for o in e.offsets], np.int64), starts)).tolist()
        self.keep(words, [data[a:b] for a, b in pairwise(edges)])

    def learn(self, words: set[str]) -> None:
        def latin(w: str) -> bool:
            return w.isalpha() if w.isascii() else w.isalpha() and max(w) < "ɐ" and w.lower().isalpha()

        if self.older:
            again = [w for w in words if w in self.older]
            self.keep(again, [self.older[w] for w in again])
            words = words.difference(again)
        plain, other, marked = [], [], []
        for w in words:
            if w.isalpha() and (w.isascii() or latin(w)):
                plain.append(w)
            elif w[-1] in self.marks and latin(w[:-1]):
                marked.append(w)
            else:
                other.append(w)
        plain += {b for w in marked if (b := w[:-1]) not in self and b not in words}
        for learned, some in ((self.encode, plain), (self.encode_any, other)):
            for k in range(0, len(some), 2000):
                learned(some[k : k + 2000])
        self.keep(marked, [self[w[:-1]] + self.marks[w[-1]] for w in marked])

    def texts(self, texts: list[str]) -> list[bytes]:
        if self.held > KEPT_BYTES // 2:
            self.older = dict(self)
            self.clear()
            self[""], self.held = b"", 0
        words = []
        for t in texts:
            if self.folds:
                try:
                    t.encode("latin-1")
                    folded = t.lower()
                    if not any(s in folded for s in self.special):  # which folding could make
                        t = folded
                except UnicodeEncodeError:
                    pass
            words.append(t.replace("\n", " ").split(" "))
        found = [list(map(self.get, w)) for w in words]
        unknown = []  # text and place of each
        for k, ids in enumerate(found):
            if None not in ids:
                continue
            at = 0
            for _ in range(ids.count(None)):
                at = ids.index(None, at)
                unknown.append((k, at))
                at += 1
        if unknown:
            self.learn({words[k][i] for k, i in unknown})
            for k, i in unknown:
                found[k][i] = self[words[k][i]]
        return [b"".join(ids) for ids in found]


def cut(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Tokenises every whole text, adds ``end_id`` and cuts what is longer than ``capacity`` into full pieces and a rest.

    Returns a row per piece: ``<id_col>, piece int`` from 0, ``start long`` (the document's ids before it), ``length long``,
    ``ids binary`` (little-endian unsigned 32-bit ids). Null or empty text: one piece of ``end_id`` alone. Null ids and repeated rows
    stay; columns other than the two named aren't read. Very long texts are tokenised whole, in one task's memory. Strings of special tokens in a text
    become these tokens, as the library has it, or ordinary text with ``special_as_text``. The tokenizer must handle words by themselves (see
    :class:`WordIds`); its file, at most 64 MB, is read on the driver and broadcast.
    """
    with open(tokenizer_path, "rb") as f:
        data = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_path} has over {MAX_TOKENIZER_BYTES} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(data)
    src = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("_text"))
    kind = src.schema[id_col].dataType.simpleString()
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = zlib.crc32(sent.value), special_as_text
            words = _loaded.get(key) or _loaded.setdefault(key, WordIds(sent.value, special_as_text=special_as_text))
            for part in slices(batch, "_text", 1 << 20):
                row, piece, start, length, ids = [], [], [], [], []
                for i, x in enumerate(words.texts([t or "" for t in part.column("_text").to_pylist()])):
                    x += end
                    for k, a in enumerate(range(0, len(x), 4 * capacity)):
                        p = x[a : a + 4 * capacity]
                        row.append(i), piece.append(k), start.append(a // 4), length.append(len(p) // 4), ids.append(p)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    [id_col, "piece", "start", "length", "ids"],
                )

    return src.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each size, in the order given.

    A size goes into the open bin after which the sum, over all gaps, of the squared number of open bins with that gap is
    smallest (ties: the smallest gap). A bin is opened only where no open bin has room; a full bin isn't open. Sizes must
    be 1 to ``capacity``.
    """
    if len(sizes) and (sizes.min() < 1 or sizes.max() > capacity):
        raise ValueError("sizes must be 1 to capacity")
    count = np.zeros(capacity, np.int64)  # open bins by gap
    bins: list[list[int]] = [[] for _ in range(capacity)]
    out, at, used, far = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0, 1 << 60
    for i, s in enumerate(sizes.tolist()):
        have = count[s:]
        best = far
        if len(have):
            change = 2 * (count[: capacity - s] - have) + 2  # squares lost at the old gap, won at the new one
            change[0] = 1 - 2 * have[0]  # the bin is full then
            change[have == 0] = far
            k = int(change.argmin())
            best = change[k]
        if best < far:
            b, gap = bins[s + k].pop(), s + k
            count[gap] -= 1
        else:
            b, gap = used, capacity
            used += 1
        out[i], at[i] = b, capacity - gap
        if gap > s:
            count[gap - s] += 1
            bins[gap - s].append(b)
    return out, at


def pack(pieces: DataFrame, *, capacity: int = 4096, length_col: str = "length", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Packs rows with a length into sequences of at most ``capacity``.

    Returns the rows with ``sequence_id long`` and ``offset long`` (columns of these names are replaced). Offsets of a
    sequence are gapless from 0. Rows are dealt evenly, by their place and not by any value, to groups of about
    ``group_pieces``; each is packed by itself in order of falling length, so memory is bounded and no key can be hot.
    Equal lengths go by all other columns in their order, and rows equal in all are interchangeable; repeated rows are packed each. An empty table gives an empty table; null lengths or lengths outside 1 to ``capacity`` are an error.
    """
    pieces = written(pieces.drop("sequence_id", "offset"))
    groups = max(1, -(-pieces.count() // group_pieces))
    kept = pieces.columns
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py()
        sizes = table.column(length_col).to_numpy()
        keys = [(length_col, "descending")] + [(c, "ascending") for c in kept if c != length_col]
        table = table.take(pc.sort_indices(table, sort_keys=keys))
        sizes = table.column(length_col).to_numpy()
        b, at = sum_of_squares(sizes, capacity)
        return table.select(kept).append_column("sequence_id", pa.array(b + (group << 32), pa.int64())).append_column("offset", pa.array(at, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("_group").applyInArrow(run, f"{schema}, sequence_id long, offset long")
