"""Operators over message tables: what an agent's context does, as relations over conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens that each message, and the reply after a list of messages, takes beside its text.
MESSAGE_OVERHEAD, REPLY_OVERHEAD = 4, 3


def since_summary(messages: DataFrame, role: str | Column = "role") -> DataFrame:
    """From each conversation's last summary on, and all system messages before it."""
    r = F.col(role) if isinstance(role, str) else role
    last = messages.where(r == "summary").groupBy("conv_id").agg(F.max("turn").alias("_last"))
    kept = messages.join(last, "conv_id", "left").where(F.col("_last").isNull() | (F.col("turn") >= F.col("_last")) | (r == "system"))
    return kept.drop("_last").select(messages.columns)


def last_rows(messages: DataFrame) -> DataFrame:
    """Each conversation's last message, by partial aggregation rather than a sort of whole conversations."""
    rest = [c for c in messages.columns if c != "conv_id"]
    best = F.max_by(F.struct(*rest), F.struct("turn", *[c for c in rest if c != "turn" and messages.schema[c].dataType.typeName() not in ("map", "variant")]))
    return messages.groupBy("conv_id").agg(best.alias("m")).select("conv_id", "m.*")


def awaiting_completion(messages: DataFrame, pointers: DataFrame | None = None, *, stop_on_assistant: bool = True) -> DataFrame:
    """Conversations that get a completion next: not empty, with a message past the pointer, and not ended by the assistant (if that stops)."""
    last = last_rows(messages)
    if pointers is not None:
        last = last.join(pointers.select("conv_id", F.col("turn").alias("_seen")), "conv_id", "left").where(F.col("_seen").isNull() | (F.col("turn") > F.col("_seen"))).drop("_seen")
    return (last.where("role <> 'assistant'") if stop_on_assistant else last).select("conv_id")


def next_completion(messages: DataFrame, pointers: DataFrame | None = None, *, stop_on_assistant: bool = True) -> DataFrame:
    """The messages that those conversations send, since their last summary."""
    return since_summary(messages.join(awaiting_completion(messages, pointers, stop_on_assistant=stop_on_assistant), "conv_id", "left_semi"))


def new_messages(messages: DataFrame, pointers: DataFrame) -> DataFrame:
    """Messages from each conversation's pointer (``conv_id, turn``) on, all where there is none."""
    seen = pointers.select("conv_id", F.col("turn").alias("_from"))
    return messages.join(seen, "conv_id", "left").where(F.col("turn") >= F.coalesce("_from", F.lit(-(1 << 62)))).select(messages.columns)


def redrive(messages: DataFrame, pointers: DataFrame) -> DataFrame:
    """History cut at each pointer, so that the completion after it is made again."""
    seen = pointers.select("conv_id", F.col("turn").alias("_to"))
    return messages.join(seen, "conv_id", "left").where(F.col("_to").isNull() | (F.col("turn") < F.col("_to"))).select(messages.columns)


def replace_history(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Conversations of ``new`` in place of what they were."""
    return messages.join(new.select("conv_id").distinct(), "conv_id", "left_anti").unionByName(new)


def open_tool_calls(messages: DataFrame) -> DataFrame:
    """Tool calls of each conversation's last assistant message with calls, unless a tool's output came after it."""
    calls = messages.where("role = 'assistant' and size(tool_calls) > 0")
    lasts = messages.groupBy("conv_id").agg(
        F.max(F.when((F.col("role") == "assistant") & (F.size("tool_calls") > 0), F.col("turn"))).alias("call"), F.max(F.when(F.col("role") == "tool", F.col("turn"))).alias("output")
    )
    due = lasts.where("call is not null and (output is null or output < call)").select("conv_id", F.col("call").alias("turn"))
    return calls.join(due, ["conv_id", "turn"]).select("conv_id", "turn", F.explode("tool_calls").alias("c")).select("conv_id", "turn", "c.*")


def over_retry_limit(failures: DataFrame, limit: int = 3) -> DataFrame:
    """Failures (``conv_id, turn, call``) with their number among equal calls of the conversation, and whether it is over the limit: the one after ``limit``."""
    w = Window.partitionBy("conv_id", "call").orderBy("turn")
    n = F.row_number().over(w)
    return failures.withColumn("failure", n).withColumn("stop", n > limit)


def conversation_tokens(messages: DataFrame, text: str = "text") -> DataFrame:
    """A quarter of a conversation's characters, rounded down after the sum, with the overhead of its messages and the reply. An assistant's null text counts as ``None``."""
    said = F.coalesce(F.col(text), F.when(F.col("role") == "assistant", "None").otherwise(""))
    n = F.floor(F.sum(F.char_length(said)) / 4) + MESSAGE_OVERHEAD * F.count("*") + REPLY_OVERHEAD
    return messages.groupBy("conv_id").agg(n.cast("bigint").alias("tokens"))


def canonical_arguments(args: str | Column) -> Column:
    """Arguments that are a JSON object, written again; others as they are."""
    c = F.col(args) if isinstance(args, str) else args
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v)).otherwise(c)


def joined_deltas(deltas: DataFrame, keys: tuple[str, ...] = ("conv_id",), order: str = "seq", text: str = "delta") -> DataFrame:
    """Streamed parts of a message, put together in order. A message is bounded by what a model writes."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"])
    return deltas.groupBy(*keys).agg(F.array_join(parts, "").alias("text"))


def joined_tool_calls(deltas: DataFrame, keys: tuple[str, ...] = ("conv_id",), order: str = "seq") -> DataFrame:
    """Streamed parts of tool calls by ``index``: the first id and name count, arguments are put together in order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("args", F.lit("")).alias("t")))), lambda x: x["t"])
    return deltas.groupBy(*keys, "index").agg(first("id"), first("name"), F.array_join(parts, "").alias("args"))
