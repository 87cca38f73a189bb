"""MinHash near-duplicates by tensored banding.

A document has two small collections of ``HALVES`` half keys, each of ``WIDTH`` minhashes; the keys of its ``HALVES``^2 tables are the pairs of a half key from
either collection. So 2 * 10 * 2 = 40 minhashes make 100 tables of 4, which plain banding would need 400 for. Two documents of Jaccard similarity s
meet in no table with a probability of at most 2 * (1 - s^WIDTH)^HALVES: 5.4e-6 at 0.85, 1.2e-7 at 0.9. A document that shares no half key of one
collection with another document is in no crowded table, so only pairs of shared half keys become table keys.

Candidates are confirmed on the full sets of shingles, in two steps. First each document is compared with one centre, the one of its table mates that has
most company itself; that joins groups of copies, however large, by one comparison each. Then, in tables whose documents aren't all joined yet, those outside the
main group are compared with all by their minhashes; groups that may touch are compared on full sets, again those outside the main group with all. Documents
that are joined already are never compared again, so groups of copies cost in proportion to their size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernspark.llm.common import components, discard, slices, temporary_tables, written
from fernspark.llm.simhash import HOT_SHARE, join_hot

#: Half keys in a collection and minhashes in a half key.
HALVES, WIDTH = 10, 2
HASHES = 2 * HALVES * WIDTH
#: Of the minhashes of two documents at 0.85, fewer than this agree once in 10^6 pairs.
LEAST_AGREE = 21
#: Shingles on each side of one comparison on full sets, rows on each side of one by minhashes, about.
CELL, ROWS = 1 << 20, 4096
#: Rows of a table that is broadcast at most.
BROADCAST_ROWS = 500_000
#: Shingles whose minhashes are computed at a time.
CHUNK = 1 << 14
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Fixed odd multipliers and offsets, from a stated seed.
_RNG = np.random.default_rng(42)
_FACTOR = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSET = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct XXH64s of a whole text's word shingles; with fewer words that of all of them; empty without words."""
    parts = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []  # bytes.split: space and \\t \\n \\v \\f \\r
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    end = np.cumsum(size)
    n = max(1, len(parts) - words + 1)
    starts, ends = (end - size)[:n].tolist(), (end[-n:] - 1).tolist()
    del parts
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, n))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The minhashes of a set, 32 bits each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        mixed = hashes[None, i : i + CHUNK] * _FACTOR[:, None] + _OFFSET[:, None]
        least = np.minimum(least, mixed.min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def half_keys(sketches: np.ndarray) -> np.ndarray:
    """Of sketches (a row each) the half keys: those of the first collection, then those of the second."""
    grouped = sketches.reshape(len(sketches), 2 * HALVES, WIDTH).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, 2 * HALVES + 1, dtype=np.uint64), grouped.shape[:2])
    for w in range(WIDTH):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, w])
    return key


def table_keys(halves: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of the tables made of two shared half keys; bit i of ``shared`` tells that half key i is."""
    one = (shared[:, None] >> np.arange(2 * HALVES) & 1).astype(bool)
    both = one[:, :HALVES, None] & one[:, None, HALVES:]
    row, i, j = np.nonzero(both)
    return row, _mix(halves[row, i] * np.uint64(0xD1342543DE82EF95) + halves[row, HALVES + j])


def alike(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches (last axis) and sizes leave the similarity possible."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    return ((a == b).sum(axis=-1) >= LEAST_AGREE) & (100 * small >= percent * large)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


def sets(docs: DataFrame, *, words: int, id_col: str, text_col: str) -> DataFrame:
    """``id, size, set_a, set_b, text_hash, sketch`` per row: the size of its set of shingles, 128 bits that name the set, and its minhashes (null for an empty set)."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("_text"), F.xxhash64(docs[text_col].cast("string")).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                size, name, minima = [], [], []
                for text in part.column("_text").to_pylist():
                    h = shingles(text, words)
                    size.append(len(h))
                    name.append(xxhash.xxh3_128_digest(h.tobytes(), 7))
                    minima.append(sketch(h).tobytes() if len(h) else None)
                both = np.frombuffer(b"".join(name), np.int64).reshape(-1, 2)
                columns = [part.column("id"), pa.array(size, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), part.column("text_hash"), pa.array(minima, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "size", "set_a", "set_b", "text_hash", "sketch"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, size long, set_a long, set_b long, text_hash long, sketch binary")


def _joined(rows: DataFrame, named: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """:func:`~fernspark.llm.simhash.join_hot`, and a plain join where no key of ``named``, a written table, is hot."""
    if named.where(F.col("n") >= max(2.0, HOT_SHARE * total)).isEmpty():
        return rows.join(named, key)
    return join_hot(rows, named, key, total)


def _shared(rows: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` whose key isn't theirs alone, with ``n``, the number of rows of the key. A hot key's rows aren't brought together."""
    counted = written(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"))
    return _joined(rows, counted, key, total)


def tables(nodes: DataFrame) -> DataFrame:
    """``key, node, n``: the tables' keys that at least two of ``nodes`` (``node, sketch``) have, and how many have them."""
    total = nodes.count()

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = half_keys(_sketches(batch.column("sketch")))
            node = np.repeat(batch.column("node").to_numpy(), 2 * HALVES)
            slot = np.tile(np.arange(2 * HALVES, dtype=np.int32), len(key))
            yield pa.RecordBatch.from_arrays([_ints(key.ravel()), pa.array(node), pa.array(slot)], ["key", "node", "slot"])

    half = nodes.select("node", "sketch").mapInArrow(halves, "key long, node long, slot int")
    slots = _shared(half, "key", 2 * HALVES * total).groupBy("node").agg(F.bit_or(F.expr("shiftleft(1, slot)")).alias("shared"))
    low = (1 << HALVES) - 1
    crowded = slots.where((F.col("shared").bitwiseAND(low) != 0) & (F.col("shared") > low))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "sketch", most_rows=4096):
                row, key = table_keys(half_keys(_sketches(part.column("sketch"))), part.column("shared").to_numpy())
                yield pa.RecordBatch.from_arrays([_ints(key), pa.array(part.column("node").to_numpy()[row])], ["key", "node"])

    full = written(nodes.select("node", "sketch").join(crowded, "node")).select("node", "sketch", "shared").mapInArrow(keys, "key long, node long")
    return _shared(full, "key", HALVES * HALVES * total)


def intersections(hashes: list[np.ndarray], one: np.ndarray) -> np.ndarray:
    """How many of ``one`` each of the sorted sets has."""
    flat = np.concatenate(hashes)
    at = np.searchsorted(one, flat)
    hit = one[np.minimum(at, len(one) - 1)] == flat
    size = np.fromiter(map(len, hashes), np.int64, len(hashes))
    return np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)


def confirm(homes: list[int], visitors: list[int], hashes: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links, by place, that span all groups of linked documents between homes and visitors; those with one label are known to be one group.

    Empty sets have no links.
    """
    label = label.copy()
    size = np.fromiter(map(len, hashes), np.int64, len(hashes))
    visitors = np.array(visitors, np.int64)
    visitors = visitors[size[visitors] > 0]
    out = []
    for h in homes:
        small, large = np.minimum(size[h], size[visitors]), np.maximum(size[h], size[visitors])
        apart = visitors[(label[visitors] != label[h]) & (100 * small >= percent * large)] if size[h] else visitors[:0]
        for i in range(0, len(apart), 1024):
            some = apart[i : i + 1024]
            some = some[label[some] != label[h]]
            if not len(some):
                continue
            common = intersections([hashes[v] for v in some.tolist()], hashes[h])
            for v in some[100 * common >= percent * (size[h] + size[some] - common)].tolist():
                if label[v] != label[h]:
                    out.append((h, v))
                    label[label == label[v]] = label[h]
    return out


def _dealt(sides: DataFrame, task: Callable[[pa.Table], pa.Table], total: int, most: int) -> DataFrame:
    """``u, v`` from ``task`` on buckets of about ``most`` of ``total``, each of whole cells ``g, r, c``."""
    least = int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, min(1 << 24, total // most))
    return sides.withColumn("_b", F.pmod(F.xxhash64("g", "r", "c"), F.lit(buckets))).groupBy("_b").applyInArrow(task, "u long, v long")


def _cells(table: pa.Table) -> Iterator[pa.Table]:
    """The cells of a bucket, those with both sides."""
    table = table.sort_by([("g", "ascending"), ("r", "ascending"), ("c", "ascending"), ("home", "descending"), ("node", "ascending")]).combine_chunks()
    g, r, c = (table.column(x).to_numpy() for x in ("g", "r", "c"))
    cut = np.flatnonzero((g[1:] != g[:-1]) | (r[1:] != r[:-1]) | (c[1:] != c[:-1])) + 1
    home = table.column("home").to_numpy(zero_copy_only=False)
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(g)], strict=True):
        if home[a] and not home[b - 1]:
            yield table.slice(a, b - a)


def _linked(sides: DataFrame, texts: DataFrame, words: int, percent: int, cell: int) -> DataFrame:
    """``u, v``: confirmed links between the homes and visitors of each cell; ``sides`` has ``g, r, c, home, node, root, size``."""

    def task(table: pa.Table) -> pa.Table:
        u, v = [], []
        for part in _cells(table):
            hashes = [shingles(t, words) for t in part.column("text").to_pylist()]
            home = part.column("home").to_numpy(zero_copy_only=False)
            node = part.column("node").to_numpy()
            for a, b in confirm(np.flatnonzero(home).tolist(), np.flatnonzero(~home).tolist(), hashes, part.column("root").to_numpy(), percent):
                u.append(node[a]), v.append(node[b])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return _dealt(sides.join(texts, "node"), task, sides.agg(F.sum("size")).first()[0] or 0, 2 * cell)


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, text`` of the nodes of ``wanted`` (``node, id, text_hash``): a broadcast of up to ``BROADCAST_ROWS`` of them, a shuffle of the texts beyond."""
    n = wanted.count()
    named = wanted.select("node", F.col("id").alias("_id"), F.col("text_hash").alias("_hash"))
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("text is not null")
    found = src.join(F.broadcast(named) if n <= BROADCAST_ROWS else named, F.expr("id <=> _id and xxhash64(text) = _hash"))
    return written(found.groupBy("node").agg(F.any_value("text").alias("text")))  # repeated rows once


def _grid(weight: str, mine: str, most: int) -> Column:
    return F.ceil(F.expr(f"sum({weight})") / most).cast("int").alias(mine)


def _crossed(members: DataFrame, key: str, weight: str, most: int, total: int, *more: str) -> DataFrame:
    """Cells ``g, r, c, home`` of the members of a group: those that are ``other`` than its main part against all.

    A group's homes are dealt to rows and its visitors to columns of a grid, by a hash of the node, so that a side of a cell has about ``most`` of ``weight``.
    """
    shape = members.groupBy(key).agg(F.count("*").alias("n"), _grid(f"if(other, {weight}, 0)", "kr", most), _grid(weight, "kc", most))
    shape = written(shape.where("kr > 0"))
    dealt = _joined(members, shape, key, total)
    mine = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    homes = dealt.where("other").select(F.col(key).alias("g"), "node", "root", *more, F.lit(True).alias("home"), mine("kr").alias("r"), every("kc").alias("c"))
    visitors = dealt.select(F.col(key).alias("g"), "node", "root", *more, F.lit(False).alias("home"), mine("kc").alias("c"), every("kr").alias("r"))
    return homes.unionByName(visitors)


def _centres(rows: DataFrame, nodes: DataFrame, percent: int, total: int) -> DataFrame:
    """``node, centre, size``: for each node the one of its table mates that has most company over all its tables, if their minhashes leave a link possible."""
    best = written(rows.groupBy("key").agg(F.max(F.struct("company", "node")).alias("best"), F.count("*").alias("n")))
    named = _joined(rows.drop("n"), best, "key", total).groupBy("node").agg(F.max("best").alias("best")).select("node", F.col("best.node").alias("centre")).where("node <> centre")
    pairs = written(named.join(nodes.select("node", "sketch", "size"), "node"))
    hot = pairs.groupBy("centre").agg(F.count("*").alias("n"))
    known = written(hot.join(nodes.select(F.col("node").alias("centre"), F.col("sketch").alias("centre_sketch"), F.col("size").alias("centre_size")), "centre"))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _sketches(batch.column("sketch")), _sketches(batch.column("centre_sketch"))
                ok = alike(a, b, batch.column("size").to_numpy(), batch.column("centre_size").to_numpy(), percent)
                yield batch.select(["node", "centre", "size"]).filter(pa.array(ok))

    return _joined(pairs, known, "centre", pairs.count()).select("node", "centre", "size", "sketch", "centre_sketch", "centre_size").mapInArrow(possible, "node long, centre long, size long")


def _stars(pairs: DataFrame, nodes: DataFrame, cell: int) -> DataFrame:
    """Cells in which a centre is at home and the documents that have it visit, in blocks."""
    shape = written(pairs.groupBy("centre").agg(F.count("*").alias("n"), _grid("size", "k", cell)))
    members = _joined(pairs, shape, "centre", pairs.count())
    visit = members.select(F.col("centre").alias("g"), "node", F.col("node").alias("root"), "size", F.lit(False).alias("home"), F.lit(0).alias("r"), F.pmod(F.xxhash64("node"), "k").cast("int").alias("c"))
    sized = shape.join(nodes.select(F.col("node").alias("centre"), "size"), "centre")
    home = sized.select(F.col("centre").alias("g"), F.col("centre").alias("node"), F.col("centre").alias("root"), "size", F.lit(True).alias("home"), F.lit(0).alias("r"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c"))
    return visit.unionByName(home)


def _touching(rows: DataFrame, roots: DataFrame, nodes: DataFrame, percent: int, total: int, most: int) -> DataFrame:
    """``u, v``: roots of groups that may touch, spanning, by the minhashes of documents that share a table."""
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max_by("root", F.struct("company", "node")).alias("main"), F.count("*").alias("n"))
    mixed = written(mixed.where("low < high").select("key", "main", "n"))
    members = _joined(rooted.drop("n"), mixed, "key", total).select("key", "node", "root", (F.col("root") != F.col("main")).alias("other"))
    members = written(members).withColumn("one", F.lit(1))
    crossed = _crossed(members, "key", "one", most, total)
    dealt = crossed.count()

    def task(table: pa.Table) -> pa.Table:
        u, v = [], []
        for part in _cells(table):
            home = part.column("home").to_numpy(zero_copy_only=False)
            root, size = part.column("root").to_numpy(), part.column("size").to_numpy()
            minima = _sketches(part.column("sketch"))
            label = root.copy()
            at = np.flatnonzero(~home)
            for h in np.flatnonzero(home).tolist():
                some = at[label[at] != label[h]]
                for i in some[alike(minima[some], minima[h], size[some], size[h], percent)].tolist():
                    if label[i] != label[h]:
                        u.append(root[h]), v.append(root[i])
                        label[label == label[i]] = label[h]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return _dealt(crossed.join(nodes.select("node", "sketch", "size"), "node"), task, dealt, 2 * most)


def groups(docs: DataFrame, nodes: DataFrame, *, words: int, percent: int, id_col: str, text_col: str, cell: int = CELL, rows: int = ROWS) -> DataFrame:
    """``node, root`` of every node that is linked with another."""
    where = nodes.select("node", "id", "text_hash")
    made = written(tables(nodes).withColumn("company", F.sum("n").over(Window.partitionBy("node"))))
    total = made.count()
    pairs = written(_centres(made, nodes, percent, total))
    ends = pairs.select("node").unionByName(pairs.select(F.col("centre").alias("node"))).distinct()
    texts = _texts(docs, written(where.join(ends, "node")), id_col, text_col)
    links = written(_linked(_stars(pairs, nodes, cell), texts, words, percent, cell))
    discard(texts)
    roots = written(components(links))
    touching = written(_touching(made, roots, nodes, percent, total, rows))
    if not touching.isEmpty():
        near = written(components(touching).select(F.col("node").alias("root"), F.col("root").alias("g")))
        members = nodes.select("node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sized = written(members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("size")).join(near, "root"))
        main = written(sized.groupBy("g").agg(F.max(F.struct("size", "root")).alias("main"), F.sum("n").alias("n")).select("g", "n", F.col("main.root").alias("main")))
        named = written(sized.select("root", "g", F.col("n").alias("rows")).join(main.drop("n"), "g").select("root", "g", F.col("rows").alias("n"), (F.col("root") != F.col("main")).alias("other")))
        inside = written(_joined(members, named, "root", nodes.count()).select("g", "node", "root", "size", "other"))
        texts = _texts(docs, where.join(inside.select("node"), "node"), id_col, text_col)
        more = written(_linked(_crossed(inside, "g", "size", cell, inside.count(), "size"), texts, words, percent, cell))
        discard(texts)
        if not more.isEmpty():
            links = written(links.unionByName(more))
            roots = written(components(links))
    return roots


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL, rows: int = ROWS) -> DataFrame:
    """``<id_col>, n_shingles long, component_id, kept boolean`` per row: the size of its set of word shingles, and the smallest id of its group of near-duplicates.

    Documents are linked if ``percent`` of their sets' union is common to both (100 * intersection >= percent * union), which full sets confirm. A set is that of the distinct
    XXH64s of shingles of ``words`` lower-cased words (A-Z); of fewer words the whole sequence is one shingle. Null, empty and wordless texts have an empty set and are
    linked with nothing. Equal sets are reduced to one document first, so copies cost no more than an aggregation. Whole texts are read. ``kept`` tells whether
    the row has the group's id. Rows with a null id belong to groups but don't name them; a group without any other id has a null one, and its rows are
    kept. Repeated rows stay, other columns aren't read, and an empty table gives an empty table.

    Texts are shuffled only where a link is possible. No task gets a group whole: rows of a frequent key are broadcast to or dealt to cells of about ``cell`` shingles or ``rows`` rows a side. One written
    table of sets and one of groups stay for the result to read.
    """
    prints = written(sets(docs, words=words, id_col=id_col, text_col=text_col))
    with temporary_tables() as made:
        place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash")
        unique = prints.where("size > 0").groupBy("set_a", "set_b").agg(F.count("*").alias("n"), F.min(place).alias("place"), F.max("size").alias("size"), F.max("sketch").alias("sketch"))
        nodes = written(unique.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", "n", "place.id", "place.text_hash", "size", "sketch"))
        roots = groups(docs, nodes, words=words, percent=percent, id_col=id_col, text_col=text_col, cell=cell, rows=rows)
        rooted = nodes.select("node", "set_a", "set_b", "n", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = written(rooted.groupBy("root").agg(F.count("*").alias("n"), F.min("id").alias("component_id")))
        names = _joined(rooted.withColumnRenamed("n", "rows"), least, "root", nodes.count()).select("set_a", "set_b", F.col("rows").alias("n"), "component_id")
        names = written(names)
        made.remove(names)
    alone = prints.where("size = 0").select("id", "size", F.col("id").alias("component_id"))
    found = _joined(prints.where("size > 0").select("id", "size", "set_a", "set_b"), names, ["set_a", "set_b"], prints.count()).select("id", "size", "component_id")
    return found.unionByName(alone).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

