"""Language identification by rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernspark.llm.common import sliced, slices

#: N-grams in a language's profile and in a document's.
PROFILE, DOC_PROFILE = 400, 300
#: Labelled documents a language is learned from, at about.
SAMPLE = 2000
#: Distinct labels; more are an error, as the profiles are kept on the driver.
MOST_LABELS = 1000
#: Positions whose n-grams are sorted at a time.
CHUNK = 1 << 20
UNKNOWN = "und"


_letters: list[np.ndarray] = []

Profile = tuple[np.ndarray, np.ndarray]


def letters() -> np.ndarray:
    """Which code points are letters; made once per Python worker."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of one to three characters of the whole text, as ascending numbers, and how often each occurs.

    Letters are folded to lower case; what isn't a letter parts words, and a word is padded by a blank on each side. Numbers
    rise with the n-gram's length, then by code points.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([[32], np.where(letters()[c], c, 32), [32]]).astype(np.int64)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found, often = [], []
    for i in range(0, len(c), CHUNK):
        a = c[i : i + CHUNK + 2]
        one = a[:CHUNK]
        two = (a[:-1][:CHUNK] + 1) << 21 | a[1:][:CHUNK]
        three = ((a[:-2] + 1) << 21 | a[1:-1]) << 21 | a[2:]
        g, n = np.unique(np.concatenate([one[one != 32], two, three[a[1:-1] != 32]]), return_counts=True)
        found.append(g), often.append(n)
    if len(found) == 1:
        return found[0], often[0]
    return add(np.concatenate(found), np.concatenate(often))


def add(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums the counts of equal n-grams."""
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(n, first)


def ranked(grams: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by number."""
    return grams[np.argsort(-n, kind="stable")[:most]]


def profile(ranking: np.ndarray) -> Profile:
    """A ranking as ascending n-grams and the rank of each."""
    order = np.argsort(ranking)
    return ranking[order], order


def predict(text: str | None, profiles: dict[str, Profile]) -> tuple[str, float]:
    """The nearest language and a score from 0 to 1: one less the distance's share of the largest distance possible."""
    grams, n = counts(text) if text else ((), ())
    if not len(grams) or not profiles:
        return UNKNOWN, 0.0
    doc = ranked(grams, n, DOC_PROFILE)
    at = np.arange(len(doc))
    best, far = UNKNOWN, None
    for lang in sorted(profiles):
        known, rank = profiles[lang]
        i = np.minimum(np.searchsorted(known, doc), len(known) - 1)
        d = int(np.where(known[i] == doc, np.abs(rank[i] - at), PROFILE).sum())
        if far is None or d < far:
            best, far = lang, d
    return best, 1.0 - far / (PROFILE * len(doc))


def learn(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict[str, Profile]:
    """Each label's ``PROFILE`` most frequent n-grams with their ranks.

    It learns from whole texts of about ``sample`` rows per label, those whose hashed id and text falls below that share of the label's
    rows (a bounded, reproducible sample whatever the size of the table). N-grams are counted on the executors, summed by key
    and cut to the profile there; what reaches the driver is ``PROFILE`` rows per label, at most ``MOST_LABELS`` labels.
    Rows with a null label or text are left out; an empty table gives no profile.
    """
    rows = labelled.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang")).where("_text is not null and _lang is not null")
    sizes = rows.groupBy("_lang").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} labels")
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["_lang"], min(1.0, sample / r["n"]))])
    drawn = rows.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 30)) < share[F.col("_lang")] * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in slices(batch, "_text"):
                more: dict[str, list] = {}
                for text, lang in zip(part.column("_text").to_pylist(), part.column("_lang").to_pylist(), strict=True):
                    more.setdefault(lang, [total[lang]] if lang in total else []).append(counts(text))
                total |= {lang: add(np.concatenate([g for g, _ in x]), np.concatenate([n for _, n in x])) for lang, x in more.items() if any(len(g) for g, _ in x)}
        for lang, (grams, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    summed = drawn.select("_text", "_lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = summed.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE)
    found: dict[str, list[tuple[int, int]]] = {}
    for x in best.select("lang", "r", "gram").collect():
        found.setdefault(x["lang"], []).append((x["r"], x["gram"]))
    return {lang: profile(np.array([g for _, g in sorted(x)], np.int64)) for lang, x in found.items()}


def identify(docs: DataFrame, profiles: dict[str, Profile], *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Predicts the language of every whole text: ``<id_col>, <carry...>, lang_pred string, score double`` per row.

    ``und`` with score 0 where the text is null, empty or without a letter, or where no profile was learned; equal distances go
    to the label that sorts first. Null ids and repeated rows stay; only the columns named are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    src = docs.select(docs[id_col].alias(id_col), *[docs[c] for c in carry], docs[text_col].cast("string").alias("_text"))
    kept = [id_col, *carry]
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found = [predict(t, sent.value) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], [*kept, "lang_pred", "score"]
                )

    return src.mapInArrow(run, f"{schema}, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: dict[str, Profile], *, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text has a predicted language; null, empty and letterless texts go.

    Where no profile was learned (no label, or no letter in a labelled text), every text with a letter stays.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def has_language(text: str | None) -> bool:
        return predict(text, sent.value)[0] != UNKNOWN if sent.value else bool(text) and len(counts(text)[0]) > 0

    @F.arrow_udf("boolean")
    def known(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            yield sliced(some, lambda part: pa.array(list(map(has_language, part)), pa.bool_()))

    return docs.where(known(F.col(text_col)))
