"""Order-dependent checks over the turns of conversations and over call logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjacency(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """conv, turn, finding: places where the roles break the protocol.

    A system turn stands first or not at all; user and assistant alternate; an
    assistant does not begin. One window by conversation, ordered by turn.
    """
    w = Window.partitionBy(conv).orderBy(turn)
    before = F.lag(role).over(w)
    finding = (
        F.when((F.col(role) == "system") & before.isNotNull(), "late_system")
        .when(F.col(role) == before, "repeated_role")
        .when((F.col(role) == "assistant") & (before.isNull() | (before == "system")), "assistant_first")
    )
    return turns.select(conv, turn, finding.alias("finding")).where("finding IS NOT NULL")


def shape(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """conv, n_turns, first_role, last_role."""
    return turns.groupBy(conv).agg(F.count("*").alias("n_turns"), F.min_by(role, turn).alias("first_role"), F.max_by(role, turn).alias("last_role"))


def gaps(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", start: int = 0) -> DataFrame:
    """conv, turn, expected: turns that are not the next number from `start`."""
    w = Window.partitionBy(conv).orderBy(turn)
    return turns.select(conv, turn, (F.row_number().over(w) - 1 + start).cast("bigint").alias("expected")).where(F.col(turn) != F.col("expected"))


def last_of_role(turns: DataFrame, value: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, text of the last turn of a role, for conversations that have one."""
    mine = turns.where(F.col(role) == value)
    return mine.groupBy(conv).agg(F.max(turn).alias(turn), F.max_by(text, turn).alias(text))


def constant(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, constant: whether all values of the group are equal (nulls count as a value)."""
    distinct = F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))
    return df.groupBy(group).agg(F.count("*").alias("n"), (distinct == 1).alias("constant"))


def call_results(calls: DataFrame, results: DataFrame, conv: str, call: str, position: str) -> DataFrame:
    """conv, call, state: each call id's outcome.

    paired (one result, after the call), early (its result stands before),
    unresolved, orphan (a result without call), repeated (an id used twice).
    """
    mine = calls.groupBy(conv, call).agg(F.count("*").alias("n_calls"), F.min(position).alias("called"))
    theirs = results.groupBy(conv, call).agg(F.count("*").alias("n_results"), F.min(position).alias("answered"))
    both = mine.join(theirs, [conv, call], "full_outer")
    state = (
        F.when(F.col("n_calls").isNull(), "orphan")
        .when((F.col("n_calls") > 1) | (F.col("n_results") > 1), "repeated")
        .when(F.col("n_results").isNull(), "unresolved")
        .when(F.col("answered") < F.col("called"), "early")
        .otherwise("paired")
    )
    return both.select(conv, call, state.alias("state"))


def next_turn_pairs(turns: DataFrame, ask: str = "user", answer: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """conv, turn, resolved: each `ask` turn and whether an `answer` follows it."""
    asks = turns.where(F.col(role) == ask).select(conv, turn)
    answers = turns.where(F.col(role) == answer).select(conv, (F.col(turn) - 1).alias(turn), F.lit(True).alias("resolved"))
    return asks.join(answers, [conv, turn], "left").select(conv, turn, F.coalesce("resolved", F.lit(False)).alias("resolved"))


def ungrounded(picks: DataFrame, surfaced: DataFrame, keys: list[str]) -> DataFrame:
    """The picks that nothing surfaced."""
    return picks.join(surfaced.select(*keys).distinct(), keys, "left_anti")


def misnamed(picks: DataFrame, surfaced: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """Grounded picks whose name is not the one that surfaced last."""
    last = surfaced.groupBy(*keys).agg(F.max_by(name, order).alias("_surfaced_name"))
    return picks.join(last, keys).where(~F.col(name).eqNullSafe(F.col("_surfaced_name"))).drop("_surfaced_name")


def protocol_state(messages: Column) -> Column:
    """A fold over one conversation's messages (role, calls: array<string>, result: string).

    Gives struct(problem, pending, answered): the first problem or null, the
    call ids without result, and how many results came.
    """
    start = F.struct(F.lit(None).cast("string").alias("problem"), F.array().cast("array<string>").alias("pending"), F.lit(0).alias("answered"))

    def step(s: Column, m: Column) -> Column:
        calls = F.coalesce(m["calls"], F.array().cast("array<string>"))
        problem = (
            F.when(F.arrays_overlap(calls, s["pending"]), "a call id is pending already")
            .when(m["result"].isNotNull() & ~F.array_contains(s["pending"], F.coalesce(m["result"], F.lit(""))), "a result answers no pending call")
            .when((m["role"] == "user") & (F.size(s["pending"]) > 0), "a user turn comes before the results")
        )
        pending = F.filter(F.concat(s["pending"], calls), lambda x: m["result"].isNull() | (x != m["result"]))
        return F.struct(F.coalesce(s["problem"], problem).alias("problem"), pending.alias("pending"), (s["answered"] + m["result"].isNotNull().cast("int")).alias("answered"))

    return F.aggregate(messages, start, step)
