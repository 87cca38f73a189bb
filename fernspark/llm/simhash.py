"""SimHash near-duplicates by anchor points of covering codes.

The 64 bits of a fingerprint are parted into A and B of 23 bits and C of 18. Anchors of A and B are the 4096 words of the perfect
binary Golay code, with covering radius 3; those of C the words of the perfect Hamming code of 15 bits, with covering radius 1, and three
bits kept as they are. Every fingerprint has one home anchor in a part, its nearest. If two fingerprints differ in e bits of a part, then one lies within
covering radius plus e of the other's home; so it visits all anchors that near, and only fingerprints that meet where one is at home and the
other visits are compared, on all 64 bits.

Two ways of sharing out the threshold of 4 bits keep that exact. Single parts: two fingerprints differ in at most one bit of A, or one of
B, or none of C (else 2 + 2 + 1 bits differ): 8192 + 2^14 anchors and about 12 visits each. Products: of A with B, A with C and B with C one pair of parts holds at most two of
the differing bits (else they were at least 3 * 3 / 2), and C never needs both: 2^24 + 2 * 2^26 anchors and about 200 visits each. Comparisons by fingerprint grow with the
table's size over the number of anchors, so large tables take products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernspark.llm.common import components, discard, slices, temporary_tables, written

BITS, MOST_BITS = 64, 4
#: Fingerprints at home, and visiting, in one comparison task at most, about.
CELL = 8192
#: From so many distinct fingerprints on, products of parts cost less than single parts.
PRODUCTS_FROM = 1 << 26
#: Rows of a table that is broadcast at most: crowded anchors, dropped rows.
BROADCAST_ROWS = 500_000
#: A key with at least this share of the rows is hot; there are at most as many as its inverse, so they are broadcast.
HOT_SHARE = 0.001
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 18
#: The generator polynomial of the [23, 12, 7] Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (a fixed value).
GOLAY = 0b110001110101
#: First bit and bits of A, B and C.
PARTS = ((0, 23), (23, 23), (46, 18))
HAMMING = 15
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_tables: dict[str, np.ndarray] = {}


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of the whole text's shingles, repeats counted; 0 without words."""
    parts = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []  # bytes.split: space and \\t \\n \\v \\f \\r
    if not parts:
        return 0
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    end = np.cumsum(size)
    n = max(1, len(parts) - words + 1)
    starts = (end - size)[:n].tolist()
    ends = (end[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, CHUNK):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(ones * 2 > n).tolist())


def fingerprints(docs: DataFrame, *, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """``<id_col>, fp long`` (the fingerprint's 64 bits, signed) and the columns ``carry`` per row; null or wordless texts have 0."""
    more = carry or {}
    src = docs.select(docs[id_col].alias(id_col), *[c.alias(name) for name, c in more.items()], docs[text_col].cast("string").alias("_text"))
    kept = [id_col, *more]
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                fp = np.array([fingerprint(t, words, seed) for t in part.column("_text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(fp.view(np.int64), pa.int64())], [*kept, "fp"])

    return src.mapInArrow(run, f"{schema}, fp long")


def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest error pattern of each of the 2^11 syndromes, and the code words of weight 7 and 8."""
    if "errors" not in _tables:
        message = np.arange(4096, dtype=np.int64)
        code = np.zeros(4096, np.int64)
        for i in range(12):
            code ^= np.where(message >> i & 1, GOLAY << i, 0)
        bits = np.arange(23)
        errors = [0, *(1 << bits)]
        errors += [1 << a | 1 << b for a in range(23) for b in range(a)]
        errors += [1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b)]
        errors = np.array(errors, np.int64)
        by_syndrome = np.zeros(2048, np.int64)
        by_syndrome[syndrome(errors)] = errors
        _tables["errors"] = by_syndrome
        _tables["sevens"], _tables["eights"] = code[np.bitwise_count(code) == 7], code[np.bitwise_count(code) == 8]
    return _tables["errors"], _tables["sevens"], _tables["eights"]


def syndrome(word: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words modulo the generator."""
    word = word.copy()
    for i in range(22, 10, -1):
        word ^= np.where(word >> i & 1, GOLAY << (i - 11), 0)
    return word


#: Rows and anchors by the number of bits beyond the covering radius: 0 (the home), 1, 2.
Near = list[tuple[np.ndarray, np.ndarray]]


def near_golay(word: np.ndarray) -> Near:
    """Anchors within 3, at 4 and at 5 bits of 23-bit words.

    A word is its home with an error of at most 3 bits, and any other code word differs from the home by one of weight 7, 8 or over 10; so those at 4 or
    5 bits are the home with a word of weight 7 or 8 that has all bits of the error: 3 + 7 - 6, 2 + 7 - 4 and 3 + 8 - 6 bits.
    """
    errors, sevens, eights = golay()
    error = errors[syndrome(word)]
    home, weight = word ^ error, np.bitwise_count(error)

    def others(of: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(weight == of)
        row, anchor = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(0, len(some), 1 << 12):
            k = some[i : i + (1 << 12)]
            a, b = np.nonzero((words[None, :] & error[k][:, None]) == error[k][:, None])
            row.append(k[a]), anchor.append(home[k][a] ^ words[b])
        return np.concatenate(row), np.concatenate(anchor)

    two, three = others(2, sevens), others(3, eights)
    return [(np.arange(len(word)), home), others(3, sevens), (np.concatenate([two[0], three[0]]), np.concatenate([two[1], three[1]]))]


def near_hamming(word: np.ndarray) -> Near:
    """The anchor within covering radius of 18-bit words and those a bit further: code words two bits from the first 15 bits, or the home with another bit flipped of the last three."""
    low, rest = word & ((1 << HAMMING) - 1), word >> HAMMING << HAMMING
    wrong = np.zeros(len(word), np.int64)  # the exclusive or of the places, from 1, of set bits: the place of the error
    for i in range(HAMMING):
        wrong ^= np.where(low >> i & 1, i + 1, 0)
    flip = lambda place: np.where(place > 0, 1 << np.maximum(place - 1, 0), 0)
    home = low ^ flip(wrong) | rest
    row, anchor = [], []
    every = np.arange(len(word))
    for a in range(1, HAMMING + 1):  # two places whose exclusive or is the error's
        b = a ^ wrong
        k = np.flatnonzero((wrong > 0) & (b > a))
        row.append(k), anchor.append(low[k] ^ (1 << (a - 1)) ^ flip(b[k]) | rest[k])
    for i in range(HAMMING, PARTS[2][1]):
        row.append(every), anchor.append(home ^ (1 << i))
    return [(every, home), (np.concatenate(row), np.concatenate(anchor))]


def _product(n: int, one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a row's anchors in two parts."""
    order = np.argsort(two[0], kind="stable")
    count = np.bincount(two[0], minlength=n)
    start = np.cumsum(count) - count
    times = count[one[0]]
    at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[one[0]], times)
    return np.repeat(one[0], times), np.repeat(one[1], times) << width | two[1][order][at]


def anchors(fp: np.ndarray, *, products: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For uint64 fingerprints: which row, which anchor (its kind in the high bits) and whether it is the row's home there."""
    word = [(fp >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64) for shift, width in PARTS]
    near = [near_golay(word[0]), near_golay(word[1]), near_hamming(word[2])]
    row, anchor, home = [], [], []

    def put(kind: int, rows: np.ndarray, which: np.ndarray, is_home: bool) -> None:
        row.append(rows), anchor.append(which | kind << 60), home.append(np.full(len(rows), is_home))

    if not products:
        for k, most in enumerate((1, 1, 0)):
            for e in range(most + 1):
                put(k, *near[k][e], e == 0)
    else:
        for kind, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            for e, one in enumerate(near[a]):
                for f, two in enumerate(near[b]):
                    if e + f <= MOST_BITS // 2:
                        put(3 + kind, *_product(len(fp), one, two, PARTS[b][1]), e + f == 0)
    return np.concatenate(row), np.concatenate(anchor), np.concatenate(home)


def link(homes: np.ndarray, visitors: np.ndarray, most: int = MOST_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the groups of fingerprints within ``most`` bits of each other, between two sets of one anchor.

    A group of n gets up to n - 1 links to its root, never all its pairs.
    """
    both = np.unique(np.concatenate([homes, visitors]))
    label = np.arange(len(both))
    at_v = np.searchsorted(both, visitors)
    at_h = np.searchsorted(both, homes)
    step = max(1, (1 << 21) // max(1, len(visitors)))
    for i in range(0, len(homes), step):
        near = np.bitwise_count(homes[i : i + step, None] ^ visitors[None, :]) <= most
        near &= at_h[i : i + step, None] != at_v[None, :]
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            roots = np.unique(np.append(label[at_v[near[k]]], label[at_h[i + k]]))
            if len(roots) > 1:
                label[np.isin(label, roots[1:])] = roots[0]
    moved = np.flatnonzero(label != np.arange(len(both)))
    if len(moved):
        yield both[moved], both[label[moved]]


def links(fps: DataFrame, cell: int = CELL, products: bool | None = None) -> DataFrame:
    """``u, v`` long: links between different fingerprints that span every group within 4 bits.

    ``fps`` has distinct longs ``fp``. ``products``: anchors are products of two parts, by default from ``PRODUCTS_FROM`` fingerprints on; both ways find the same groups. Rows of an
    anchor are dealt to a grid of cells of about ``cell`` at home by ``cell`` visiting, by a hash of the fingerprint, so that a crowded anchor is many
    bounded tasks. The list of crowded anchors is broadcast up to ``BROADCAST_ROWS`` of them and joined by a shuffle beyond.
    """
    if products is None:
        products = fps.count() >= PRODUCTS_FROM

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 1 << 13):
                part = fp[i : i + (1 << 13)]
                row, anchor, home = anchors(part.view(np.uint64), products=products)
                yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(anchor), pa.array(home)], ["fp", "anchor", "home"])

    seen = written(fps.select("fp").mapInArrow(visits, "fp long, anchor long, home boolean"))
    sizes = seen.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).withColumn("k", F.ceil(F.col("n") / cell).cast("int"))
    crowded = written(sizes.where("k > 1").select("anchor", "k", F.expr("(n + homes) * (k - 1)").alias("more")))
    extra = crowded.agg(F.count("*").alias("anchors"), F.coalesce(F.sum("more"), F.lit(0)).alias("rows")).first()
    grid = seen.join(F.broadcast(crowded) if extra["anchors"] <= BROADCAST_ROWS else crowded, "anchor", "left")
    k = F.coalesce("k", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), k).cast("int")
    dealt = grid.select("fp", "anchor", "home", k.alias("k"), mine.alias("mine"))
    at_home = dealt.where("home").select("fp", "anchor", F.lit(True).alias("home"), F.col("mine").alias("r"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c"))
    visiting = dealt.select("fp", "anchor", F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("r"), F.col("mine").alias("c"))

    # Cells are too many for a task each: a task takes a bucket of cells, sorted, and works cell by cell.
    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("anchor", "ascending"), ("r", "ascending"), ("c", "ascending")])
        cols = [table.column(c).to_numpy() for c in ("anchor", "r", "c")]
        fp, home = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in cols])) + 1
        u, v = [], []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)], strict=True):
            if b - a == 1 or b - a == 2 and (fp[a] == fp[b - 1] or home[a] == home[b - 1]):  # a fingerprint alone, or none at home or visiting
                continue
            h = home[a:b]
            for x, y in link(fp[a:b][h], fp[a:b][~h]):
                u.append(x), v.append(y)
        join = lambda x: pa.array(np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64), pa.int64())
        return pa.table({"u": join(u), "v": join(v)})

    total = seen.count() + seen.where("home").count() + extra["rows"]  # as dealt
    buckets = max(1, min(1 << 24, -(-total // (4 * cell))))
    both = at_home.unionByName(visiting).withColumn("_b", F.pmod(F.xxhash64("anchor", "r", "c"), F.lit(buckets)))
    return both.groupBy("_b").applyInArrow(compare, "u long, v long")


def join_hot(rows: DataFrame, named: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``named``, which has each key once, ``n`` telling how many rows have it.

    Keys with at least ``HOT_SHARE`` of ``total`` rows, which can't be over 1 / ``HOT_SHARE``, are joined by broadcast, so no task gets a hot key; the rest by a shuffle.
    """
    hot = F.broadcast(named.where(F.col("n") >= F.lit(max(2.0, HOT_SHARE * total))))
    return rows.join(hot.select(key), key, "left_anti").join(named, key).unionByName(rows.join(hot, key))


def grouped(prints: DataFrame, order: Column) -> DataFrame:
    """``fp, n, first``: of each fingerprint the number of rows in ``prints``, and the least ``order`` of all rows in its group."""
    unique = written(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(order).alias("first")))
    found = written(components(links(unique)))
    group = written(unique.join(found, F.col("fp") == F.col("node"), "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root")))
    least = written(group.groupBy("root").agg(F.count("*").alias("n"), F.min("first").alias("least")))
    return written(join_hot(group.select("fp", F.col("n").alias("rows"), "root"), least, "root", unique.count()).select("fp", F.col("rows").alias("n"), F.col("least").alias("first")))


def near_duplicates(docs: DataFrame, *, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose fingerprints are joined by chains of links of at most 4 differing bits.

    Returns ``<id_col>, fp long, component_id`` (the smallest id of the group, the row's own included) per row. Equal
    fingerprints are reduced to one before any comparison, so copies cost nothing beyond an aggregation. Null or wordless
    texts have fingerprint 0 and are linked like any other. Very long texts are read whole, a part at a time. Rows with a null id stay and are grouped, but a group's id is its smallest
    non-null id (null if it has none). Repeated rows stay. Other columns aren't read; an empty table gives an empty table.
    Two written tables stay for the result to read; see :func:`~fernspark.llm.common.temporary_tables`.
    """
    prints = written(fingerprints(docs, words=words, seed=seed, id_col=id_col, text_col=text_col))
    with temporary_tables() as made:
        names = grouped(prints, F.col(id_col))
        made.remove(names)
    return join_hot(prints, names, "fp", prints.count()).select(id_col, "fp", F.col("first").alias("component_id"))


def keep_first(docs: DataFrame, *, words: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all columns as they are, of each group of near-duplicates: that with the smallest id; of rows with this id the one with the smallest
    hash of all columns, and one of rows that are equal throughout.

    So every text that is in no group with another stays, whatever ids repeat. Rows with a null id can't be named by their group; they stay. Null or wordless texts are
    a group. An empty table gives an empty table, and columns of any name go through.

    Only ids, fingerprints and hashes are shuffled; the rows that go are taken out by a broadcast of up to ``BROADCAST_ROWS`` of their
    keys, by a shuffle of the table beyond.
    """
    whole = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if any(x in f.dataType.simpleString() for x in ("map<", "variant")) else F.col(f"`{f.name}`") for f in docs.schema]
    key = {"_a": F.xxhash64(*whole), "_b": F.xxhash64(F.lit(1), *whole)}
    named = docs.where(F.col(id_col).isNotNull())
    prints = written(fingerprints(named, words=words, seed=seed, id_col=id_col, text_col=text_col, carry=key).withColumnRenamed(id_col, "_id"))
    with temporary_tables() as made:
        first = grouped(prints, F.struct("_id", "_a", "_b")).select("first.*").distinct().withColumn("_first", F.lit(True))
        rows = prints.groupBy("_id", "_a", "_b").agg(F.count("*").alias("n")).join(first, ["_id", "_a", "_b"], "left")
        gone = written(rows.where("_first is null or n > 1").select("_id", "_a", "_b", F.col("_first").isNotNull().alias("again")))
        made.remove(gone)
    discard(prints)
    n, again = gone.count(), gone.where("again").count()
    taken = lambda df: F.broadcast(df) if n <= BROADCAST_ROWS else df
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), docs[id_col].alias("_id"), *[c.alias(name) for name, c in key.items()])
    kept = keyed.join(taken(gone), ["_id", "_a", "_b"], "left_anti") if n else keyed
    if again:  # one of rows that are equal throughout
        kept = kept.unionByName(keyed.join(taken(gone.where("again").drop("again")), ["_id", "_a", "_b"], "left_semi").dropDuplicates(["_id", "_a", "_b"]))
    return kept.select("_row.*")
