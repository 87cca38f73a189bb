"""What text filters do to each other: every order of application, counted from one pass over the texts.

A document's outcome is a mask, a bit for each filter that it fails; what any order keeps, removes or repeats follows from how many
documents have each mask. The duplicate filter is table-wide: texts are routed by their XXH64 in an RDD, where the texts of one hash are a chain of full texts with their
least ids. Count vectors by mask are then merged by ``combineByKey``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby, permutations
from math import factorial
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernspark.llm.common import written

#: Characters of distinct texts that a task holds before it hands them on.
HELD = 16 << 20
#: Bytes of text in a partition of the shuffle, about.
ROUTED_BYTES = 128 << 20
#: Texts longer than this many bytes are read word by word, not split at once.
SPLIT_AT_ONCE = 8 << 20
_UPPER, _SIGNS, _WORD = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", re.compile(rb"[#$%&*|]"), re.compile(rb"[^\x20\x09-\x0d]+")


class Text:
    """A text's figures, each computed when first asked for."""

    def __init__(self, text: str):
        self.text, self.raw = text, text.encode("utf-8", "surrogatepass")
        self._words: tuple[int, int] | None = None

    @property
    def words(self) -> tuple[int, int]:
        """Words between ASCII white space, and distinct ones."""
        if self._words is None:
            if len(self.raw) <= SPLIT_AT_ONCE:
                all_words = self.raw.split()
                self._words = len(all_words), len(set(all_words))
            else:
                n, seen = 0, set()
                for m in _WORD.finditer(self.raw):
                    n += 1
                    seen.add(m[0])
                self._words = n, len(seen)
        return self._words

    def few_words(self) -> bool:
        return self.words[0] < 100

    def repeats_words(self) -> bool:
        return 100 * self.words[1] < 80 * self.words[0]

    def shouts(self) -> bool:
        return 100 * (len(self.raw) - len(self.raw.translate(None, _UPPER))) > 10 * len(self.text)

    def has_signs(self) -> bool:
        return _SIGNS.search(self.raw) is not None


Tests = dict[str, Callable[[Text], bool]]
#: Filters by letter; the last letter of an audit is the duplicate filter.
TESTS: Tests = {"A": Text.few_words, "B": Text.repeats_words, "C": Text.shouts, "D": Text.has_signs}


def _collapsed(rows: Iterable[tuple], tests: Sequence[Callable[[Text], bool]], held: int) -> Iterator[tuple]:
    """From rows ``hash, text, id, part``: ``hash, (text, mask, least id, rows by part)`` for each text, and ``any, (None, mask, id, rows by part)`` for what is decided.

    A row whose text has a smaller id in the same task is a duplicate whatever else the table has, so only a text's least id goes on; a task's
    copies of a common text are one row of the shuffle.
    """
    twin = 1 << len(tests)
    chains: dict[int, list] = {}
    size = 0
    for h, text, row_id, part in rows:
        chain = chains.setdefault(h, [])
        entry = next((e for e in chain if e[0] == text), None)
        if entry is None:
            figures = Text(text)
            entry = [text, sum(1 << i for i, test in enumerate(tests) if test(figures)), None, {}]
            chain.append(entry)
            size += len(text) + 200
        _, mask, least, parts = entry
        if row_id is None:
            yield h ^ hash(part), (None, mask, None, {part: 1})
        elif least is None or row_id < least:
            if least is not None:
                yield least, (None, mask | twin, least, parts)
            entry[2:] = row_id, {part: 1}
        elif row_id == least:
            parts[part] = parts.get(part, 0) + 1
        else:
            yield row_id, (None, mask | twin, row_id, {part: 1})
        if size > held:
            yield from ((h, tuple(e)) for h, chain in chains.items() for e in chain if e[2] is not None)
            chains, size = {}, 0
    yield from ((h, tuple(e)) for h, chain in chains.items() for e in chain if e[2] is not None)


def _decided(rows: Iterable[tuple], twin: int) -> Iterator[tuple]:
    """``id, part, mask, n`` from the rows of a partition in the order of their hashes."""
    for _, group in groupby(rows, key=itemgetter(0)):
        chain: list[list] = []
        for _, (text, mask, row_id, parts) in group:
            if text is None:
                yield from ((row_id, part, mask, n) for part, n in parts.items())
                continue
            entry = next((e for e in chain if e[0] == text), None)
            if entry is None:
                chain.append([text, mask, row_id, parts])
            elif row_id == entry[2]:
                for part, n in parts.items():
                    entry[3][part] = entry[3].get(part, 0) + n
            else:
                lost = (entry[2], entry[3]) if row_id < entry[2] else (row_id, parts)
                if row_id < entry[2]:
                    entry[2:] = row_id, parts
                yield from ((lost[0], part, mask | twin, n) for part, n in lost[1].items())
        yield from ((row_id, part, mask, n) for _, mask, row_id, parts in chain for part, n in parts.items())


def outcomes(docs: DataFrame, *, tests: Tests = TESTS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", held: int = HELD) -> DataFrame:
    """``id long, part string, mask int, n long``: rows of ``docs`` by the filters that they fail, bit i for the i-th of ``tests`` and the next bit for the duplicate filter.

    A row is a duplicate if a smaller id has the same whole text anywhere in the table; rows that repeat an id and text aren't duplicates of each other and are
    counted in ``n``. A row with a null id is no duplicate and makes none. A null text is the empty text, a null part the empty string. An empty table
    gives an empty table; other columns aren't read.

    A first pass adds up the texts' bytes, for the number of partitions. Texts are shuffled once, as they are, and sorted by hash, so a task holds the chain of one hash at a time. A text has at most one row for each
    task that read it, whatever its share of the table is; equal hashes of different texts are told apart by the texts.
    """
    text, part = F.coalesce(docs[text_col].cast("string"), F.lit("")), F.coalesce(docs[part_col].cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text), text, docs[id_col].cast("long"), part).rdd
    checks, twin = list(tests.values()), 1 << len(tests)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // ROUTED_BYTES)
    routed = rows.mapPartitions(lambda it: _collapsed(it, checks, held)).repartitionAndSortWithinPartitions(parts, lambda h: h % parts)
    return docs.sparkSession.createDataFrame(routed.mapPartitions(lambda it: _decided(it, twin)), "id long, part string, mask int, n long", verifySchema=False)


def duplicates(masks: DataFrame, tests: Tests = TESTS) -> DataFrame:
    """The ids, once each, that are not the least of their text, from :func:`outcomes`."""
    return masks.where(F.col("mask").bitwiseAND(1 << len(tests)) != 0).select("id").distinct()


def report(counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """A row for every order of the letters and step; ``counts`` has documents, good and toxic ones by mask."""
    masks = np.arange(counts.shape[1])
    bits = {x: 1 << i for i, x in enumerate(letters)}
    docs, good, toxic = counts.tolist()
    orders = factorial(len(letters))
    failed = [m.bit_count() for m in masks.tolist()]
    shapley = {x: sum(docs[m] * orders // failed[m] for m in masks.tolist() if m & b) for x, b in bits.items()}  # a filter is first of f in 1 / f of the orders
    unique = {x: docs[b] for x, b in bits.items()}
    for order in map("".join, permutations(letters)):
        before = 0
        for step, x in enumerate(order, 1):
            here = masks[(masks & bits[x] != 0) & (masks & before == 0)].tolist()
            again = masks[(masks & bits[x] != 0) & (masks & before != 0)].tolist()
            before |= bits[x]
            kept = sum(docs[m] for m in masks[masks & before == 0].tolist())
            yield order, step, kept, *(sum(c[m] for m in ms) for c, ms in ((docs, here), (docs, again))), unique[x], *(sum(c[m] for m in here) for c in (good, toxic)), shapley[x]


def audit(masks: DataFrame, labels: DataFrame, *, letters: str = "ABCDE", id_col: str = "doc_id") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` from :func:`outcomes`.

    One row, zeros included, for each part, order of the filters and step. ``labels``: ``<id_col>, quality, toxic``, any number of rows for an id; an id is
    good or toxic if one of them has 1. Ids without a label, and null ids, are neither. Without documents there are no parts and no rows.

    Ids and masks are joined with the labels, texts aren't; vectors of counts are merged in each task before the shuffle, and a part's vector has
    2^filters * 3 numbers.
    """
    one = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    named = masks.where("id is not null").join(known, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    rows = named.unionAll(masks.where("id is null").select("part", "mask", "n", F.lit(0), F.lit(0)))
    size = 1 << len(letters)

    def added(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[:, mask] += (n, n * good, n * toxic)
        return counts

    merged = rows.rdd.map(lambda r: (r[0], tuple(r)[1:])).combineByKey(lambda row: added(np.zeros((3, size), np.int64), row), added, lambda a, b: a + b)
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return rows.sparkSession.createDataFrame(merged.flatMap(lambda kv: ((kv[0], *row) for row in report(kv[1], letters))), schema, verifySchema=False)


def interactions(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """:func:`audit` of the standard filters over whole texts. One written table stays for the result to read."""
    return audit(written(outcomes(docs, **columns)), labels)
