"""Operators with state by key: deduplication with an exact expiry, and messages put together from streamed parts.

State lies in the stream's checkpoint; ``with_state_on_disk`` keeps the working copy on executors' disks instead of their memory. State expires by the rows' own times:
times up to the start of 1970 are before any watermark. With times of the clock a run over what is there now would never end, as Spark then always has another batch to look for expired state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

#: Columns of a streamed part of a message. ``index``, ``id``, ``name`` and ``args`` are a part of a tool call, ``last`` marks the last part.
PART = "conv_id bigint, seq bigint, delta string, index int, id string, name string, args string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, last boolean"
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")
#: What is known of a message after a micro-batch.
MESSAGE = "conv_id bigint, seq bigint, delta string, text string, tool_calls array<struct<index:int,id:string,name:string,args:string>>, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, status string"


def with_state_on_disk(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def once_within(df: DataFrame, key: str, time: str, seconds: float, late: str = "10 minutes") -> DataFrame:
    """A key's row, and again the first one more than ``seconds`` of event time after the row of that key let through last.

    Rows of a micro-batch count in the order of their times, then of all their columns. The rows let through are those of a pass over all rows in the order of their times, if no row of a
    key comes in a later micro-batch than one with a greater time. Where it does, it is let through unless it is within ``seconds`` of a row let through, before or after,
    that is still remembered. A key is forgotten when the watermark (the greatest time seen, less ``late``) is over ``seconds`` past its row, so state grows with the keys of that span. Rows before the
    watermark are dropped, rows without a time too; a null key is a key. A key's rows of one micro-batch are in one task's memory, so the source should bound a micro-batch.
    """
    span = int(seconds * 1_000_000)
    columns = df.columns
    shape = df.schema
    at = "_at"
    while at in columns:
        at = f"_{at}"

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True)
        rows = rows[rows[at] >= mark * 1000]  # a mark of 0: no watermark yet
        order = rows[columns].astype(str).agg("\x00".join, axis=1)
        rows = rows.assign(_order=order).sort_values([at, "_order"], kind="stable")
        last = state.get[0] if state.exists else None
        kept = []
        for i, t in enumerate(rows[at]):
            if last is None or abs(t - last) > span:
                kept.append(i)
                last = max(t, last) if last is not None else t
        if kept:
            state.update((int(last),))
        if state.exists:
            state.setTimeoutTimestamp(max((state.get[0] + span) // 1000 + 1, mark + 1))
        yield rows.iloc[kept][columns]

    timed = df.where(F.col(time).isNotNull()).withColumn(at, F.unix_micros(F.col(time).cast("timestamp"))).withWatermark(time, late)
    return timed.groupBy(key).applyInPandasWithState(step, shape, StructType([StructField("last", LongType())]), "append", GroupStateTimeout.EventTimeTimeout)


class _Message:
    """What is known of one message: the parts up to the first gap are taken in, later ones are held."""

    def __init__(self, kept: str | None):
        s: dict[str, Any] = json.loads(kept) if kept else {"next": 0, "held": {}, "text": "", "calls": {}, "usage": [0, 0, 0], "closed": False, "newest": 0}
        self.next, self.held, self.text, self.calls, self.usage = s["next"], {int(k): v for k, v in s["held"].items()}, s["text"], s["calls"], s["usage"]
        self.closed, self.newest = s["closed"], s["newest"]

    def kept(self) -> str:
        return json.dumps({"next": self.next, "held": self.held, "text": self.text, "calls": self.calls, "usage": self.usage, "closed": self.closed, "newest": self.newest})

    def hold(self, parts: pd.DataFrame) -> None:
        """Parts by their numbers; one that is held or taken in already is a repeat."""
        if self.closed:
            return
        for r in json.loads(parts.to_json(orient="records")):
            if r["seq"] is not None and int(r["seq"]) >= self.next:
                self.held.setdefault(int(r["seq"]), r)

    def _take(self, seq: int) -> str:
        p = self.held.pop(seq)
        self.next = seq + 1
        if p["index"] is not None:
            call = self.calls.setdefault(str(int(p["index"])), {"index": int(p["index"]), "id": None, "name": None, "args": ""})
            call["id"], call["name"] = call["id"] if call["id"] is not None else p["id"], call["name"] if call["name"] is not None else p["name"]
            call["args"] += p["args"] or ""
        self.usage = [a + int(p[u] or 0) for a, u in zip(self.usage, USAGE, strict=True)]
        self.closed = self.closed or bool(p["last"])
        self.text += p["delta"] or ""
        return p["delta"] or ""

    def advance(self, over_gaps: bool = False) -> str:
        """Takes in what is due; gives the new text."""
        new = ""
        while self.held and not self.closed:
            if self.next in self.held:
                new += self._take(self.next)
            elif over_gaps:
                new += self._take(min(self.held))
            else:
                break
        if self.closed:
            self.held = {}
        return new

    def row(self, key: tuple, delta: str, status: str) -> pd.DataFrame:
        calls = [self.calls[k] for k in sorted(self.calls, key=int)]
        one = {"conv_id": key[0], "seq": self.next - 1, "delta": delta, "text": self.text, "tool_calls": calls, **dict(zip(USAGE, self.usage, strict=True)), "status": status}
        return pd.DataFrame([one])


def messages(parts: DataFrame, time: str = "time", wait: float = 600, late: str = "1 minute") -> DataFrame:
    """Messages (``MESSAGE``) as their parts (``PART`` and their ``time``) come in: the new text, and text, tool calls and usage so far, at each micro-batch that a message gets further in.

    Parts are numbered from 0 and may come in any order and more than once; of several with one number the first counts, within a micro-batch the least by its values. Parts after a gap are held. With its last part
    a message is ``closed``; parts numbered beyond that are dropped. When the watermark (the greatest time seen, less ``late``) is more than ``wait`` seconds past a message's newest part, held parts are put together
    over the gaps and the message ends as ``timed_out``, also if the last part was among them; a closed one is forgotten, so state grows with the messages of that span. Parts before the watermark and those without a number, a conversation
    or a time are dropped. Times are the parts' own, so a stream that is run again gives the same. One message is bounded by what a model writes.
    """
    span = max(1, int(wait * 1000))
    columns = [f.strip().split(" ")[0] for f in PART.split(",")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        message = _Message(state.get[0] if state.exists else None)
        if state.hasTimedOut:
            state.remove()
            if not message.closed:
                yield message.row(key, message.advance(over_gaps=True), "timed_out")
            return
        before, mark = message.next, state.getCurrentWatermarkMs()
        rows = pd.concat(list(batches), ignore_index=True)
        rows = rows[rows["_at"] >= mark]
        if rows.empty:
            if state.exists:
                state.setTimeoutTimestamp(max(message.newest + span, mark + 1))  # a call without it would end the waiting
            return
        message.newest = max(message.newest, int(rows["_at"].max()))
        order = rows[columns].astype(str).agg("\x00".join, axis=1)
        message.hold(rows.assign(_order=order).sort_values("_order", kind="stable")[columns])
        was = message.closed
        new = message.advance()
        state.update((message.kept(),))
        state.setTimeoutTimestamp(max(message.newest + span, mark + 1))
        if message.next > before and not was:
            yield message.row(key, new, "closed" if message.closed else "open")

    numbered = parts.where("conv_id is not null and seq is not null").where(F.col(time).isNotNull())
    timed = numbered.select(*columns, F.col(time).cast("timestamp").alias("_time")).withColumn("_at", F.unix_millis("_time")).withWatermark("_time", late)
    return timed.groupBy("conv_id").applyInPandasWithState(step, MESSAGE, "message string", "append", GroupStateTimeout.EventTimeTimeout)
