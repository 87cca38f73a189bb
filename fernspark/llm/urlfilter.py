"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernspark.llm.common import slices

#: Bits of the filter per entry, and its largest size. Beyond that it lets more false hits through, which the join removes.
BITS_PER_ENTRY, MOST_BYTES = 16, 8 << 20
#: A list whose texts have at most this many bytes is joined by broadcast; a longer one by a salted shuffle.
BROADCAST_BYTES, SALTS = 8 << 20, 32
#: The eight odd multipliers of the split-block Bloom filter in the Parquet format.
MULTIPLIERS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: then up to ``?``, ``#`` or the end.
    Both are empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


class BlockedBloom:
    """Blocks of eight 32-bit words; a key sets one bit in each word of its block."""

    def __init__(self, words: np.ndarray):
        self.words = words  # (blocks, 8) uint32

    @staticmethod
    def blocks_for(entries: int) -> int:
        return max(1, min(MOST_BYTES // 32, -(-entries * BITS_PER_ENTRY // 256)))

    @staticmethod
    def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Block number and the eight words' bit masks of 64-bit hashes."""
        block = (hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
        low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        bit = (low[:, None] * np.array(MULTIPLIERS, np.uint32)) >> np.uint32(27)
        return block.astype(np.int64), np.uint32(1) << bit

    def has(self, hashes: np.ndarray) -> np.ndarray:
        block, masks = self.places(hashes, len(self.words))
        return ((self.words[block] & masks) == masks).all(axis=1)


def hashes(keys: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), 42) for k in keys], np.uint64)


def bloom(keys: DataFrame, entries: int) -> BlockedBloom:
    """The filter of a column ``key``: each task ORs its keys' bits, words are ORed by key, and the filter alone is collected."""
    blocks = BlockedBloom.blocks_for(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, masks = BlockedBloom.places(hashes(batch.column("key").to_pylist()), blocks)
            yield pa.RecordBatch.from_arrays([pa.array((block[:, None] * 8 + np.arange(8)).ravel(), pa.int64()), pa.array(masks.ravel().astype(np.int64), pa.int64())], ["word", "mask"])

    words = np.zeros((blocks, 8), np.uint32)
    for r in keys.select("key").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        words[r["word"] // 8, r["word"] % 8] = r["mask"]
    return BlockedBloom(words)


def candidates(host: str, path: str, lengths: list[int], longest: int) -> list[str]:
    """The listed URLs that could fit: every parent domain of at most ``longest`` characters with every listed length of the path's beginning."""
    out: list[str] = []
    known = [n for n in lengths if n <= len(path)]
    at = 0
    if len(host) > longest:  # the first parent domain that is short enough
        at = host.find(".", len(host) - longest - 1) + 1
        if not at:
            return out
    while True:
        suffix = host[at:]
        out += [suffix + path[:n] for n in known]
        dot = host.find(".", at)
        if dot < 0:
            return out
        at = dot + 1


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The longest listed URL that fits each row's url, and its verdict.

    ``rules``: ``host, path, verdict`` (a canonical URL without scheme; A-Z of the host are lower-cased here). An entry fits its host and all subdomains, if the url's
    path starts with the entry's. The longest entry (host and path) wins, of equally long ones that with the longer host, of one listed with several verdicts the
    greatest ('block' over 'allow'). Returns ``<id_col>, host, path, rule, verdict`` per row, ``rule`` being host and path of the entry or null; without an entry the
    verdict is ``default``. Null urls and urls without ``://`` have an empty host and path, which no entry with a host fits. Null ids and repeated rows
    stay, other columns aren't read, an empty list gives ``default`` throughout and an empty table an empty table. Entries with a
    null or empty host are left out.

    All of a url's possible entries are looked up in a blocked Bloom filter (at most 8 MB, broadcast); those it passes go to an exact join with
    the list, which removes false hits. Parent domains longer than any listed host can't fit, so a url of any length has no more candidates than
    the longest listed host has characters, times the lengths of listed paths. Lists of over ``BROADCAST_BYTES`` bytes are joined by a shuffle with ``SALTS`` copies of each
    entry, so that a host with very many pages is spread over as many tasks.
    """
    spark = pages.sparkSession
    listed = (
        rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .where("rule_host is not null and rule_host <> ''")
        .groupBy(F.concat("rule_host", "rule_path").alias("key"), "rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
    )
    sizes = (
        listed.groupBy(F.char_length("rule_path").alias("n"))
        .agg(F.count("*").alias("entries"), F.max(F.char_length("rule_host")).alias("longest"), F.sum(F.octet_length("key") + F.octet_length("rule_host") + F.octet_length("rule_path") + F.coalesce(F.octet_length("rule_verdict"), F.lit(0))).alias("bytes"))
        .collect()
    )  # as many rows as paths have lengths
    entries, lengths, longest, listed_bytes = sum(r["entries"] for r in sizes), sorted(r["n"] for r in sizes), max([r["longest"] for r in sizes], default=0), sum(r["bytes"] for r in sizes)
    sent = spark.sparkContext.broadcast((bloom(listed.select("key"), entries), lengths))
    host, path = host_and_path(F.col(url_col).cast("string"))
    src = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id())
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom_filter, known = sent.value
        for batch in batches:
            for part in slices(batch, "path"):
                keys = [candidates(h, p, known, longest) if h else [] for h, p in zip(part.column("host").to_pylist(), part.column("path").to_pylist(), strict=True)]
                flat = [k for x in keys for k in x]
                passed = iter(bloom_filter.has(hashes(flat)).tolist() if flat else ())
                hits = [[k for k in x if next(passed)] for x in keys]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, pa.list_(pa.string()))], [*part.schema.names, "hits"])

    tested = src.mapInArrow(run, f"_id {kind}, host string, path string, _row long, hits array<string>")
    possible = tested.select("_id", "host", "path", "_row", F.explode_outer("hits").alias("key"))
    # Host and path are one text in a key, so the same text parted elsewhere is no fit.
    fits = (F.col("host") == F.col("rule_host")) | F.col("host").endswith(F.concat(F.lit("."), F.col("rule_host")))
    fits = fits & F.col("path").startswith(F.col("rule_path"))
    if listed_bytes <= BROADCAST_BYTES:
        matched = possible.join(F.broadcast(listed.withColumnRenamed("key", "rule")), (F.col("key") == F.col("rule")) & fits, "left")
    else:
        salted = listed.withColumnRenamed("key", "rule").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = possible.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
        matched = dealt.join(salted, (F.col("key") == F.col("rule")) & (F.col("_salt") == F.col("_copy")) & fits, "left")
    best = F.max(F.when(F.col("rule_verdict").isNotNull(), F.struct(F.char_length("key").alias("n"), F.char_length("rule_host").alias("h"), F.col("key"), F.col("rule_verdict"))))
    out = matched.groupBy("_row").agg(F.first("_id").alias("_id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
