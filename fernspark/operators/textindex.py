"""A stored full-text index: stems without stop words, postings in blocks of falling impact, and a top-k search that skips blocks.

The impact of a posting is its share of BM25 without the word's weight. A word's postings lie in blocks of falling impact, so the head of a block bounds all
that follow. A search first scores the heads of a query's words, which gives the score that the k-th best row has at least; a block is then read only if its
head, with the best impacts of the query's other words, reaches that score. A row whose posting lies in a block that is skipped can't be among the best, so the
result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernspark.functions import stemming
from fernspark.operators import nearest
from fernspark.operators.retrieval import BROADCAST_TERMS, DEFAULT_TOP_K, K1, B, ranked, words

#: Postings of a block.
BLOCK = 128
#: Postings of each word that the first look reads, or eight times as many as rows are wanted.
FIRST_LOOK = 128
#: Scores are sums in any order: what is within this of the bound is read.
ROUNDING = 1e-9

#: Postings that a task sorts.
POSTINGS = 1 << 20

COUNTED = "row long, id long, dl int, term string, tf long"
BLOCKS = "term string, block int, top double, ids array<long>, rows array<long>, impacts array<double>"


def content_words(text: str | Column) -> Column:
    """A text's words but for stop words."""
    return F.filter(words(text), lambda w: ~w.isin(*stemming.STOP))


def _parts(spark: SparkSession, postings: int) -> int:
    """Partitions of so many postings: with more of them there are more tasks, not larger ones."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-postings // POSTINGS))


def _counted(batches: Iterator[pa.RecordBatch], stems: pa.Table | None) -> Iterator[pa.RecordBatch]:
    """Rows ``id, w, row`` as ``COUNTED``: each row's words, or their stems, with their counts."""
    stem = None if stems is None else dict(zip(stems.column("term").to_pylist(), stems.column("stem").to_pylist(), strict=True))
    for b in nearest.slices(batches, 512):
        size = pc.list_value_length(b.column("w")).to_numpy(zero_copy_only=False)
        words_of = b.column("w").flatten().dictionary_encode()
        names, code = words_of.dictionary, words_of.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if stem is not None:
            again = pa.array([stem[t] for t in names.to_pylist()], pa.string()).dictionary_encode()
            names, code = again.dictionary, again.indices.to_numpy(zero_copy_only=False)[code].astype(np.int64)
        if not len(code):
            continue
        pairs, tf = np.unique(np.repeat(np.arange(len(size)), size) * len(names) + code, return_counts=True)
        row, term = pairs // len(names), pairs % len(names)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([b.column("row").take(at), b.column("id").take(at), pa.array(size[row], pa.int32()), names.take(pa.array(term)), pa.array(tf, pa.int64())], ["row", "id", "dl", "term", "tf"])


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows ``term, id, row, impact`` in the order of terms and falling impact, as blocks. A block ends where the term or the partition does."""
    rest: pa.Table | None = None
    at: dict = {"term": None, "block": 0}

    def put(part: pa.Table) -> pa.RecordBatch:
        term = part.column("term").to_pylist()
        cut = [0]
        for i in range(1, len(term) + 1):
            if i == len(term) or term[i] != term[i - 1] or i - cut[-1] == size:
                cut.append(i)
        number = []
        for a in cut[:-1]:
            at.update(block=at["block"] + 1 if at["term"] == term[a] else 0, term=term[a])
            number.append(at["block"])
        ids, rows, impacts = (part.column(c).combine_chunks() for c in ("id", "row", "impact"))
        offsets = pa.array(cut, pa.int32())
        take = lambda column: column.take(pa.array(cut[:-1], pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array([term[a] for a in cut[:-1]], pa.string()), pa.array(number, pa.int32()), take(impacts), *[pa.ListArray.from_arrays(offsets, x) for x in (ids, rows, impacts)]],
            ["term", "block", "top", "ids", "rows", "impacts"],
        )

    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not rest.num_rows:
            continue
        term = rest.column("term").to_pylist()
        last = term[-1]
        begin = len(term) - 1
        while begin and term[begin - 1] == last:
            begin -= 1
        whole = begin + (len(term) - begin) // size * size  # what can't grow any more
        if whole:
            yield put(rest.slice(0, whole))
            rest = rest.slice(whole)
    if rest is not None and rest.num_rows:
        yield put(rest)


@dataclass(frozen=True)
class StoredTextIndex:
    """An index in a folder: ``blocks`` (``BLOCKS``, sorted by term), ``terms`` (``term, df, top``) and the corpus's size.

    ``split`` and ``stems`` must be what the index was built with: a text's words as a Column, and whether they are reduced to English stems.
    """

    blocks: DataFrame
    terms: DataFrame
    count: int
    split: Callable[[str | Column], Column] = content_words
    stems: bool = True
    block: int = BLOCK

    @staticmethod
    def build(corpus: DataFrame, path: str, *, key: str = "id", text: str = "chunk", split: Callable[[str | Column], Column] = content_words, stems: bool = True, block: int = BLOCK) -> StoredTextIndex:
        """Writes the index of ``corpus`` (a long ``key`` and a text) to ``path``. A null text has no words; rows that repeat a key are found each by itself.

        Only distinct words are stemmed; words are counted by row into a table, without a shuffle while the stems fit a task. The blocks are cut from postings sorted by range of term,
        impact and key, ``POSTINGS`` to a task, so a frequent word is many partitions and tasks.
        """
        spark = corpus.sparkSession
        split_once = corpus.select(F.col(key).cast("long").alias("id"), split(F.coalesce(F.col(text), F.lit(""))).alias("w"), F.monotonically_increasing_id().alias("row"))
        known, few = None, True
        if stems:
            stemming.with_stems(split_once.select(F.explode("w").alias("term")).distinct()).write.parquet(f"{path}/stems")
            known = spark.read.parquet(f"{path}/stems").select("term", "stem")
            few = known.count() <= BROADCAST_TERMS
        if few:  # a row's words are counted where the row is
            table = known.toArrow() if stems else None
            counted = split_once.mapInArrow(lambda it: _counted(it, table), COUNTED)
        else:
            counted = split_once.select("row", "id", F.size("w").alias("dl"), F.explode("w").alias("term")).join(known, "term").groupBy("row", "id", "dl", F.col("stem").alias("term")).agg(F.count("*").alias("tf"))
        counted.write.parquet(f"{path}/counted")
        rows = spark.read.parquet(f"{path}/counted")
        total, size = rows.agg(F.sum("tf"), F.count("*")).first()
        n, total = corpus.count(), total or 0
        average = total / n if n and total else 1.0
        impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(average)))
        postings = rows.select("term", "id", "row", impact.cast("double").alias("impact"))
        ordered = postings.repartitionByRange(_parts(spark, size), "term", F.desc("impact"), "row").sortWithinPartitions("term", F.desc("impact"), "row")
        ordered.mapInArrow(lambda it: _blocks(it, block), BLOCKS).write.parquet(f"{path}/blocks")
        stored = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
        stored.groupBy("term").agg(F.sum(F.size("ids")).alias("df"), F.max("top").alias("top")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        spark.createDataFrame([(n, block)], "count long, block int").coalesce(1).write.parquet(f"{path}/size")
        return StoredTextIndex.load(spark, path, split=split, stems=stems)

    @staticmethod
    def load(spark: SparkSession, path: str, *, split: Callable[[str | Column], Column] = content_words, stems: bool = True) -> StoredTextIndex:
        terms = spark.read.schema("term string, df long, top double").parquet(f"{path}/terms")
        count, block = spark.read.schema("count long, block int").parquet(f"{path}/size").first()
        return StoredTextIndex(spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), terms, count, split, stems, block)

    def _asked(self, queries: DataFrame, text: str) -> DataFrame:
        """``qid, term, weight, others``: a query's distinct words that the index has, and what its other words can add at most."""
        split = self.split(text)
        asked = queries.select("qid", F.explode(F.array_distinct(stemming.stemmed(split) if self.stems else split)).alias("term"))
        weight = F.log(F.lit(1.0) + (F.lit(float(self.count)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        known = asked.join(self.terms, "term").withColumn("weight", weight)
        best = F.col("weight") * F.col("top")
        return known.select("qid", "term", "weight", (F.sum(best).over(Window.partitionBy("qid")) - best).alias("others"))

    def _scored(self, blocks: DataFrame) -> DataFrame:
        """``qid, id, row, score``: what the postings of ``blocks`` (with ``qid`` and ``weight``) add up to."""
        each = blocks.select("qid", "weight", F.explode(F.arrays_zip("ids", "rows", "impacts")).alias("p"))
        return each.groupBy("qid", F.col("p.ids").alias("id"), F.col("p.rows").alias("row")).agg(F.sum(F.col("weight") * F.col("p.impacts")).alias("score"))

    def _by_row(self, asked: DataFrame, k: int, slack: float) -> DataFrame:
        """``qid, id, score``: candidates for the best ``k`` of few queries. A posting that one of them needs is dealt once, by its row, and a task scores whole rows against all queries."""
        spark = asked.sparkSession
        first = self._scored(self.blocks.join(F.broadcast(asked), "term").where(F.col("block") < -(-max(FIRST_LOOK, 8 * k) // self.block)))
        least = first.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("r") == k).select("qid", F.col("score").alias("least"))
        floor = F.min(F.coalesce("least", F.lit(float("-inf"))) - F.col("others"))  # a block whose head is below it is below every query's bound
        floors = spark.createDataFrame(asked.join(least, "qid", "left").groupBy("term").agg(F.first("weight").alias("weight"), floor.alias("floor")).toArrow())
        read = self.blocks.join(F.broadcast(floors), "term").where(F.col("weight") * F.col("top") + slack + ROUNDING >= F.col("floor"))
        size = self.terms.join(F.broadcast(floors), "term", "left_semi").agg(F.sum("df")).first()[0] or 0
        each = read.select("term", F.explode(F.arrays_zip("ids", "rows", "impacts")).alias("p")).select(F.col("p.rows").alias("row"), F.col("p.ids").alias("id"), "term", F.col("p.impacts").alias("impact"))
        table = asked.select("qid", "term", "weight").toArrow()
        qids, of = np.unique(table.column("qid").to_numpy(), return_inverse=True)
        terms = pc.unique(table.column("term"))
        terms = terms.take(pc.sort_indices(terms))
        lists = nearest.Postings(of, pc.index_in(nearest.joined(table.column("term")), value_set=terms).to_numpy(), table.column("weight").to_numpy(), len(qids), len(terms))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, rest = nearest.Best(k, slack, len(qids)), None

            def put(t: pa.Table) -> None:
                row, place = t.column("row").to_numpy(), pc.index_in(nearest.joined(t.column("term")), value_set=terms).to_numpy()
                at = np.lexsort((place, row))
                lists.add(np.searchsorted(row, row)[at], place[at], t.column("impact").to_numpy()[at], nearest.joined(t.column("id")), best)

            for b in batches:
                t = pa.Table.from_batches([b])
                rest = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
                if not rest.num_rows:
                    continue
                row = rest.column("row").to_numpy()
                whole = int(np.searchsorted(row, row[-1]))  # the last row may go on
                if whole:
                    put(rest.slice(0, whole))
                    rest = rest.slice(whole)
            if rest is not None and rest.num_rows:
                put(rest)
            yield best.table(pa.array(qids, pa.int64()), pa.int64(), False)

        return each.repartition(_parts(spark, size), "row").sortWithinPartitions("row").mapInArrow(run, "qid bigint, id bigint, score double")

    def _matched(self, queries: DataFrame, text: str) -> DataFrame:
        """Blocks of the queries' words, each with ``qid, weight, others``. Words are broadcast after a count, up to ``BROADCAST_TERMS``."""
        asked = self._asked(queries, text).persist()
        return self.blocks.join(F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked, "term")

    def needed(self, queries: DataFrame, k: int = DEFAULT_TOP_K, *, text: str = "current", slack: float = 0.0) -> DataFrame:
        """The blocks of each query's words with ``read``, whether a search for the best ``k`` reads them beyond its first look."""
        matched = self._matched(queries, text)
        heads = -(-max(FIRST_LOOK, 8 * k) // self.block)
        first = self._scored(matched.where(F.col("block") < heads))
        least = first.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("r") == k).select("qid", F.col("score").alias("least"))
        bound = F.col("weight") * F.col("top") + F.col("others") + slack + ROUNDING
        small = least.count() <= BROADCAST_TERMS
        return matched.join(F.broadcast(least) if small else least, "qid", "left").withColumn("read", F.col("least").isNull() | (bound >= F.col("least")))

    def search(self, queries: DataFrame, k: int = DEFAULT_TOP_K, *, text: str = "current", digits: int | None = None, key: str = "id") -> DataFrame:
        """``qid, <key>, score, rank``: the best ``k`` rows that have one of a query's words, by BM25; ties by key. With ``digits`` scores are rounded before they are ranked.

        A query without any word of the index has no rows. Queries with a null or an empty text have no words.
        """
        slack = 10.0**-digits if digits is not None else 0.0
        asked = self._asked(queries, text).withColumn("qid", F.col("qid").cast("bigint")).persist()
        few = asked.count() <= BROADCAST_TERMS
        found = self._by_row(asked, k, slack) if few else self._scored(self.needed(queries, k, text=text, slack=slack).where("read"))
        if digits is not None:
            found = found.withColumn("score", F.round("score", digits))
        return ranked(found, k).select("qid", F.col("id").alias(key), "score", "rank")

    def shares(self, queries: DataFrame, k: int = DEFAULT_TOP_K, *, text: str = "current") -> DataFrame:
        """``qid, blocks, read``: how many blocks each query's words have, and how many a search reads."""
        return self.needed(queries, k, text=text).groupBy("qid").agg(F.count("*").alias("blocks"), F.count_if("read").alias("read"))
