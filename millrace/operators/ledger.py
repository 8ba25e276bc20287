"""Exact spend: component sums, caps, durations, ledger transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import MONEY, TERM, ceil_hour, seconds, within
from ..sources.tables import RANGE, before, ranged


def reconcile(buckets: DataFrame, by: str, components: list[str], total: str, tolerance: str) -> DataFrame:
    """by, n, a sum for each component, their total, balanced: whether components and total agree within the tolerance."""
    sums = buckets.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in components], F.sum(total).alias(total))
    parts = None
    for c in components:
        parts = F.col(c).cast(TERM) if parts is None else (parts + F.col(c).cast(TERM)).cast(TERM)
    return sums.withColumn("balanced", within(parts, F.col(total), tolerance))


def running_cap(spend: DataFrame, order: str, amount: str, cap: str) -> DataFrame:
    """order, running: the first row at which the running sum exceeds the cap; no row if it never does.

    Sums of ranges of the order find the range in which the cap is passed; only
    its rows are then added up one by one. So no task sorts the whole table.
    """
    limit = F.lit(cap).cast(MONEY)
    rows = ranged(spend.select(order, amount), order)
    passed = before(rows, F.col(amount)).where((F.col("start") + F.col("s")).cast(MONEY) > limit).agg(F.min(F.struct(RANGE, "start")).alias("x")).select(f"x.{RANGE}", "x.start")
    within = rows.join(F.broadcast(passed), RANGE)  # one row
    running = F.col("start") + F.sum(amount).over(Window.partitionBy(RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    first = within.select(order, running.cast(MONEY).alias("running")).where(F.col("running") > limit).agg(F.min(F.struct(order, "running")).alias("x"))
    return first.select(F.col(f"x.{order}").alias(order), F.col("x.running").alias("running")).where(F.col(order).isNotNull())


def duration_cost(start: Column, end: Column, rate: str) -> Column:
    """Seconds at an hourly rate, exact to ten digits."""
    return (seconds(start, end) * F.lit(rate).cast("decimal(10,6)") / F.lit(3600).cast("decimal(4,0)")).cast("decimal(30,10)")


def billed_hour(t: Column) -> Column:
    return ceil_hour(t)


def ledger_problem(posted: Column, outstanding: Column, committed: Column, authorized: Column, cost: Column, reserved: Column) -> Column:
    """What forbids a settlement: the first of the ledger's identities that fails; null if none."""
    posted, outstanding, committed, authorized, cost, reserved = (c.cast(TERM) for c in (posted, outstanding, committed, authorized, cost, reserved))
    return (
        F.when(posted + outstanding != committed, "posted and outstanding are not what is committed")
        .when(cost > reserved, "the cost exceeds its reservation")
        .when(committed - reserved + cost > authorized, "the ledger would exceed its authorization")
    )


def settle(ledger: DataFrame, cost: str, reserved: str) -> DataFrame:
    """The ledger (posted, outstanding, committed, authorized) after a reservation is settled at its cost; raises if an identity fails."""
    c, r = F.lit(cost).cast(TERM), F.lit(reserved).cast(TERM)
    problem = ledger_problem(F.col("posted"), F.col("outstanding"), F.col("committed"), F.col("authorized"), c, r)
    checked = ledger.withColumn("posted", F.when(problem.isNull(), (F.col("posted").cast(TERM) + c).cast(MONEY)).otherwise(F.raise_error(problem)))
    checked = checked.withColumn("outstanding", (F.col("outstanding").cast(TERM) - r).cast(MONEY))
    return checked.withColumn("committed", (F.col("posted").cast(TERM) + F.col("outstanding").cast(TERM)).cast(MONEY))


def append_bucket(buckets: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """buckets with those rows of `new` whose key is not there yet: appending again changes nothing."""
    return buckets.unionByName(new.join(buckets.select(key).distinct(), key, "left_anti"))
