"""Queries of message tables, usage statistics and task joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernspark.operators import messages, stats
from fernspark.plans import tasks
from fernspark.plans.registry import query
from fernspark.tables import table


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations; every turn 2 is taken for a summary."""
    return table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("turn") == 2, "summary").otherwise(F.col("role")))


_TALK = "m AS (SELECT conv_id, turn, CASE WHEN turn = 2 THEN 'summary' ELSE role END AS role, text FROM conversations)"


@query(f"WITH {_TALK}, s AS (SELECT conv_id, max(turn) AS last FROM m WHERE role = 'summary' GROUP BY conv_id) SELECT m.conv_id, turn, role FROM m LEFT JOIN s USING (conv_id) WHERE last IS NULL OR turn >= last OR role = 'system'")
def conv_since_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.since_summary(_talk(spark, sf_dir)).select("conv_id", "turn", "role")


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING arg_max(role, turn) <> 'assistant'")
def conv_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose last turn isn't the assistant's."""
    return messages.awaiting_completion(table(spark, sf_dir, "conversations"))


@query(
    f"WITH {_TALK}, s AS (SELECT conv_id, max(turn) FILTER (role = 'summary') AS last, arg_max(role, turn) AS r FROM m GROUP BY conv_id) SELECT m.conv_id, turn FROM m JOIN s USING (conv_id) WHERE r <> 'assistant' AND (last IS NULL OR turn >= last OR role = 'system')"
)
def conv_next_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.next_completion(_talk(spark, sf_dir)).select("conv_id", "turn")


def _pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("conv_id % 2 = 0").select("conv_id", F.lit(2).cast("bigint").alias("turn")).distinct()


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 2 = 1 OR turn >= 2")
def conv_new_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.new_messages(table(spark, sf_dir, "conversations"), _pointers(spark, sf_dir)).select("conv_id", "turn")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 2 = 1 OR turn < 2")
def conv_redrive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.redrive(table(spark, sf_dir, "conversations"), _pointers(spark, sf_dir)).select("conv_id", "turn")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT DISTINCT conv_id, 0, 'system' FROM conversations WHERE conv_id % 3 = 0")
def conv_replace_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    new = c.where("conv_id % 3 = 0").select("conv_id").distinct().select("conv_id", F.lit(0).cast("bigint").alias("turn"), F.lit("system").alias("role"), F.lit("").alias("text"))
    return messages.replace_history(c, new).select("conv_id", "turn", "role")


@query("SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id")
def conv_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.last_rows(table(spark, sf_dir, "conversations")).select("conv_id", "role", "turn")


@query(
    """WITH a AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS call, max(turn) FILTER (role = 'user' AND turn % 4 = 0) AS output FROM conversations GROUP BY conv_id)
SELECT conv_id, call AS turn, 'call-' || conv_id || '-' || call AS id, 'search' AS name FROM a WHERE call IS NOT NULL AND (output IS NULL OR output < call)"""
)
def conv_open_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as calls, every fourth turn of a user as a tool's output."""
    c = table(spark, sf_dir, "conversations")
    call = F.struct(F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), F.lit("search").alias("name"), F.lit("{}").alias("args"))
    m = c.withColumn("tool_calls", F.when(F.col("role") == "assistant", F.array(call)))
    m = m.withColumn("role", F.when((F.col("role") == "user") & (F.col("turn") % 4 == 0), "tool").otherwise(F.col("role")))
    return messages.open_tool_calls(m).select("conv_id", "turn", "id", "name")


@query("SELECT user_id AS conv_id, event_id AS turn, n AS failure, n > 3 AS stop FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)::INT AS n FROM events WHERE event_type = 'error')")
def tool_retry_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a user as failures of one call."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("call"))
    return messages.over_retry_limit(e).select("conv_id", "turn", "failure", "stop")


@query("SELECT conv_id, (sum(length(text)) // 4 + 4 * count(*) + 3)::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def token_estimate_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.conversation_tokens(table(spark, sf_dir, "conversations"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"k":' || (props->>'k') || '}' ELSE event_type END AS args FROM events""")
def canonical_tool_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", messages.canonical_arguments(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.col("props"))).otherwise(F.col("event_type"))).alias("args"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def stream_delta_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.joined_deltas(table(spark, sf_dir, "conversations"), order="turn", text="text")


@query(
    "SELECT conv_id, (turn % 2)::INT AS index, arg_min('id' || turn, turn) AS id, arg_min(role, turn) AS name, string_agg(text, '' ORDER BY turn) AS args FROM conversations GROUP BY conv_id, turn % 2"
)
def tool_call_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    d = c.select("conv_id", (F.col("turn") % 2).cast("int").alias("index"), F.col("turn").alias("seq"), F.concat(F.lit("id"), F.col("turn")).alias("id"), F.col("role").alias("name"), F.col("text").alias("args"))
    return messages.joined_tool_calls(d)


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage reports: the type is the model, the user's number the prompt's tokens."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("model"), F.col("user_id").alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"), (F.col("user_id") + F.col("event_id") % 7).alias("total_tokens"))


_USAGE = "u AS (SELECT event_id, event_type AS model, user_id AS prompt_tokens, event_id % 7 AS completion_tokens, user_id + event_id % 7 AS total_tokens FROM events)"


@query(f"WITH {_USAGE} SELECT model, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS request_count FROM u GROUP BY model")
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.usage_by_model(_usage(spark, sf_dir))


@query(f"WITH {_USAGE} SELECT sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens, count(*) AS request_count FROM u")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.usage_totals(stats.usage_by_model(_usage(spark, sf_dir)))


@query(f"WITH {_USAGE} SELECT event_id, prompt_tokens AS input, completion_tokens AS output, total_tokens AS total FROM u")
def usage_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _usage(spark, sf_dir).withColumn("total_tokens", F.when(F.col("event_id") % 2 == 0, F.col("total_tokens")))
    return stats.normalised_usage(u).select("event_id", "input", "output", "total")


@query(f"WITH {_USAGE} SELECT event_id, model, sum(total_tokens) OVER (PARTITION BY model, prompt_tokens ORDER BY event_id)::BIGINT AS total_tokens FROM u")
def usage_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _usage(spark, sf_dir).withColumn("request", F.col("prompt_tokens"))
    return stats.running_usage(u, ("model", "request"), "event_id").select("event_id", "model", "total_tokens")


@query("SELECT source, count(*) FILTER (toxic IS DISTINCT FROM 1) AS processed, count(*) FILTER (toxic = 1) AS failed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed and failed documents by source."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    failed = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return d.groupBy("source").agg(F.count_if(~failed).alias("processed"), F.count_if(failed).alias("failed"))


@query("SELECT event_type, CASE WHEN count(*) <> 0 AND sum(value) <> 0 THEN round(count(*) / sum(value), 6) END AS per_second FROM events GROUP BY event_type")
def nodes_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return g.select("event_type", F.round(stats.rate("n", "s"), 6).alias("per_second"))


@query("SELECT o_orderkey AS task_id, o_orderstatus || '|' || o_orderpriority || '|' || coalesce(n::VARCHAR, '0') AS payloads FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def task_fanout_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three branches per order, joined in the order of the branches."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    branches = [
        lambda df: df.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("payload")),
        lambda df: df.select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("payload")),
        lambda df: df.join(lines, "o_orderkey", "left").select(F.col("o_orderkey").alias("task_id"), F.coalesce(F.col("n"), F.lit(0)).cast("string").alias("payload")),
    ]
    joined = tasks.join_branches(tasks.fan_out(table(spark, sf_dir, "orders"), branches), len(branches))
    return joined.select("task_id", F.array_join("payloads", "|").alias("payloads"))
