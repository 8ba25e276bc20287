"""Streaming forms: windowed rates, first sightings, the turn protocol as state per conversation, and calls met with their settlements.

Each gives what its batch form gives over the same rows, for rows that arrive
within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.numbers import money
from ..operators.rules import Rule, first_reason


def source(spark: SparkSession, folder: str, schema: str, kind: str = "parquet", files: int = 16) -> DataFrame:
    """New files of a folder as a stream, `files` of them at most in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(folder)


def windowed_rates(events: DataFrame, by: str, flag: Column, time: str, width: str, delay: str) -> DataFrame:
    """start, by, n, rate: the share of true flags in each window of event time; windows close `delay` after the latest event."""
    timed = events.withWatermark(time, delay)
    counts = timed.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.avg(flag.cast("int")).alias("rate"))
    return counts.select(F.col("w.start").alias("start"), by, "n", F.coalesce("rate", F.lit(1.0)).alias("rate"))


def first_seen(rows: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The rows whose key no earlier row within the watermark has: copies that arrive later are dropped, state does not grow for ever."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and its latest value so far; for update and complete output."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def settlements(calls: DataFrame, settled: DataFrame, same: list[str], within: str, delay: str) -> DataFrame:
    """id, at, settled_at, problem: each call with each settlement of its id that follows within a span of event time.

    Both have id, at, cost (as text) and the columns `same`, which must agree.
    A call that nothing settles in time and a settlement of no call appear
    once, when no row can come any more that would match them: `within` and
    `delay` after the latest time of both sides, so that state holds no more
    than that span. Sound pairs have no problem; two settlements of a call are
    two rows. A null id matches nothing; null is equal to null in `same`; rows
    without a time take no part. Over tables that are no streams the result is
    the same, of all rows.
    """
    c = calls.where("at IS NOT NULL").select("id", "at", "cost", *same).withWatermark("at", delay)
    s = settled.where("at IS NOT NULL").select(*[F.col(x).alias(f"s_{x}") for x in ("id", "at", "cost", *same)]).withWatermark("s_at", delay)
    known = F.col("id").isNotNull()  # a stream's join takes null keys for equal
    meet = known & (F.col("id") == F.col("s_id")) & (F.col("s_at") >= F.col("at")) & (F.col("s_at") <= F.col("at") + F.expr(f"INTERVAL {within}"))
    rules = [
        Rule("settled without a call", F.col("at").isNotNull()),
        Rule("not settled in time", F.col("s_at").isNotNull()),
        *[Rule(f"{x} differs", F.col(x).eqNullSafe(F.col(f"s_{x}"))) for x in same],
        Rule("invalid cost", money(F.col("cost")).isNotNull() & money(F.col("s_cost")).isNotNull()),
        Rule("cost does not reconcile", money(F.col("cost")) == money(F.col("s_cost"))),
    ]
    met = c.join(s, meet, "full_outer")
    return met.select(F.coalesce("id", "s_id").alias("id"), "at", F.col("s_at").alias("settled_at"), first_reason(rules).alias("problem"))


FINDING = "conv_id long, turn long, finding string"
STATE = "turn long, role string, waiting string"


def protocol(turns: DataFrame, idle: str | None = None) -> DataFrame:
    """conv_id, turn, finding: places where roles break the protocol, as turns arrive.

    State per conversation: the last turn judged and the turns that came ahead
    of their predecessor, which wait for it. Turns count from 0. With `idle`
    (milliseconds, processing time) a conversation silent for that long is
    judged over its gaps and forgotten.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, role, waiting = state.get if state.exists else (-1, None, "")
        ahead = {int(t): r for t, r in (x.split(":", 1) for x in waiting.split(",") if x)}
        for b in batches:
            ahead |= {int(t): r for t, r in zip(b["turn"], b["role"], strict=True) if t > last}
        found = []
        while ahead and (last + 1 in ahead or state.hasTimedOut):
            at = min(ahead)
            now = ahead.pop(at)
            if now == "system" and role is not None:
                found.append((at, "late_system"))
            elif now == role:
                found.append((at, "repeated_role"))
            elif now == "assistant" and role in (None, "system"):
                found.append((at, "assistant_first"))
            last, role = at, now
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((last, role, ",".join(f"{t}:{r}" for t, r in sorted(ahead.items()))))
            if idle:
                state.setTimeoutDuration(int(idle))
        yield pd.DataFrame({"conv_id": [key[0]] * len(found), "turn": [t for t, _ in found], "finding": [f for _, f in found]}).astype({"conv_id": "int64", "turn": "int64"})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return turns.select("conv_id", "turn", "role").groupBy("conv_id").applyInPandasWithState(judge, FINDING, STATE, "append", timeout)


def drain(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over what has arrived, into Parquet at a path, and end; a later run goes on where this one ended."""
    q = rows.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
