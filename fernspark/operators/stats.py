"""Counters of runs and token usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage_by_model(usage: DataFrame) -> DataFrame:
    """Requests and tokens per model: ``model, prompt_tokens, completion_tokens, total_tokens, request_count``."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return usage.groupBy("model").agg(s("prompt_tokens"), s("completion_tokens"), s("total_tokens"), F.count("*").alias("request_count"))


def usage_totals(by_model: DataFrame) -> DataFrame:
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return by_model.agg(s("prompt_tokens"), s("completion_tokens"), s("total_tokens"), s("request_count"))


def normalised_usage(usage: DataFrame) -> DataFrame:
    """Input, output and total tokens from what a provider reports; a missing total is their sum."""
    first = lambda *names: F.coalesce(*[F.col(n).cast("bigint") for n in names if n in usage.columns], F.lit(0))
    i, o = first("input_tokens", "prompt_tokens"), first("output_tokens", "completion_tokens")
    total = F.coalesce(F.col("total_tokens").cast("bigint"), i + o) if "total_tokens" in usage.columns else i + o
    return usage.withColumn("input", i).withColumn("output", o).withColumn("total", total)


def running_usage(deltas: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Usage so far at each streamed part."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for c in ("prompt_tokens", "completion_tokens", "total_tokens"):
        deltas = deltas.withColumn(c, F.sum(F.coalesce(c, F.lit(0))).over(w))
    return deltas


def rate(count: str | Column, seconds: str | Column) -> Column:
    """Rows a second; null where either is zero."""
    c, s = (F.col(x) if isinstance(x, str) else x for x in (count, seconds))
    return F.when(c != 0, F.try_divide(c.cast("double"), s.cast("double")))


def pipeline_counts(nodes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``processed, failed, stored`` of a table of nodes."""
    out = nodes.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return out.crossJoin(stored.agg(F.count("*").alias("stored"))) if stored is not None else out.withColumn("stored", F.lit(0).cast("bigint"))
