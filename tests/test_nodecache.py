"""The bucketed cache: equal to an anti-join, its tables are never shuffled, sketches rule out new ids."""

import re

import pytest
from pyspark.sql import functions as F

from fernspark import schema
from fernspark.operators import indexing, nodecache, sinks
from fernspark.sources import loaders


def cache_of(tmp_path, **more):
    return nodecache.BucketedCache(str(tmp_path / "c"), buckets=4, expected=6000, **more)


def keyed(spark, ids):
    return spark.createDataFrame([(i, "p") for i in ids], "id string, path string")


def test_stands_in_for_the_plain_cache(spark, tmp_path):
    cache = cache_of(tmp_path, prefix="p")
    df = loaders.from_rows(spark, [("a", "one"), ("b", "two"), ValueError("broken"), ("a", "one")])
    first = indexing.IndexingPipeline(df).filter_cached(cache).df
    assert first.where("error is null").count() == 2 and first.count() == 3
    node = first.where("path = 'a'").first().id
    assert cache.get(spark, node) and not cache.get(spark, "x")
    again = nodecache.BucketedCache(cache.path, prefix="p", buckets=9)  # keeps the buckets of the first marking
    assert indexing.IndexingPipeline(df).filter_cached(again).df.where("error is null").count() == 0
    other = nodecache.BucketedCache(cache.path, prefix="q")
    assert other.absent(first.where("error is null")).count() == 2
    cache.clear(spark)
    assert not cache.get(spark, node) and cache.ids(spark) is None


def test_equals_an_anti_join_over_appends_and_a_rebuild(spark, tmp_path):
    cache, seen = cache_of(tmp_path), set()
    for a, b in ((0, 500), (300, 900), (900, 901)):
        cache.set(keyed(spark, [str(i) for i in range(a, b)] * 2))
        seen |= {str(i) for i in range(a, b)}
        assert sorted(r.key for r in cache.ids(spark).collect()) == sorted(seen)
    rows = keyed(spark, [str(i) for i in range(0, 2000, 7)] + [None, ""])
    found = sorted(str(r.id) for r in cache.absent(rows).collect())
    assert found == sorted(str(r.id) for r in rows.collect() if r.id not in seen)
    cache.rebuild(spark, expected=30_000, buckets=2)
    assert cache._about(spark)[1:] == (2, 10) and sorted(str(r.id) for r in cache.absent(rows).collect()) == found
    assert sorted(r.key for r in cache.ids(spark).collect()) == sorted(seen)


def test_only_what_is_looked_up_is_shuffled(spark, tmp_path):
    cache = cache_of(tmp_path)
    cache.set(keyed(spark, [str(i) for i in range(400)]))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        looked = cache.absent(keyed(spark, ["1", "x"]))
        plan = looked._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.id for r in looked.collect()) == ["x"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    lines = plan.split("\n")
    assert len([x for x in lines if "FileScan parquet spark_catalog.default.fernspark_cache" in x]) >= 2
    for n, line in enumerate(lines):
        if "fernspark_cache" in line and "FileScan" in line:
            above, at = [], line.index("FileScan")
            for up in reversed(lines[:n]):  # the chain of parents up to the join
                start = len(re.match(r"[\s:|+*-]*", up).group())
                if start < at:
                    at = start
                    above.append(up)
                    if "Join" in up:
                        break
            assert above and not [u for u in above if "Exchange" in u], plan


def test_sketches_rule_out_new_ids_and_no_old_one(spark, tmp_path):
    cache = cache_of(tmp_path)
    cache.set(keyed(spark, [f"old{i}" for i in range(6000)]))
    about = cache._about(spark)
    rows = keyed(spark, [f"old{i}" for i in range(6000)] + [f"new{i}" for i in range(6000)]).withColumn("_key", F.col("id"))
    n = {r.old: (r.maybe, r.n) for r in cache._looked_up(rows, about).groupBy(F.col("id").startswith("old").alias("old")).agg(F.count_if("_maybe").alias("maybe"), F.count("*").alias("n")).collect()}
    assert n[True] == (6000, 6000) and n[False][1] == 6000 and n[False][0] < 6000 / 30


def test_bits_without_ids_change_nothing(spark, tmp_path):
    """What a run leaves that was killed between its two writes."""
    cache = cache_of(tmp_path)
    cache.set(keyed(spark, ["a"]))
    about = cache._about(spark)
    bits = keyed(spark, ["b"]).select(cache._block("id", about[2]).alias("block"), F.explode(cache._bits("id")).alias("at")).groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))
    bits.write.insertInto(cache._table(spark, about, "sketches"))
    assert [r.id for r in cache.absent(keyed(spark, ["a", "b"])).collect()] == ["b"]


def test_empty_tables(spark, tmp_path):
    cache = cache_of(tmp_path)
    none = spark.createDataFrame([], schema.NODE)
    assert cache.filter(none).count() == 0 and cache.filter(none).count() == 0 and cache.ids(spark).count() == 0
    assert sinks.exists(spark, cache.path)
    cache.rebuild(spark)
    with pytest.raises(ValueError, match="at least"):
        nodecache.BucketedCache(cache.path, expected=0)
