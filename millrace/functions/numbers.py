"""Column expressions over decimals, ranks and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,22)"
#: Amounts to be added: a sum of two of 38 digits would lose the last one of its scale.
TERM = "decimal(36,22)"


def money(c: Column) -> Column:
    """An exact amount from its text; null unless it is a finite, non-negative decimal."""
    return F.when(F.regexp_like(c, F.lit(r"\A[0-9]+(?:\.[0-9]+)?\z")), c.try_cast(MONEY))


def within(a: Column, b: Column, tolerance: str) -> Column:
    return F.abs(a.cast(TERM) - b.cast(TERM)) <= F.lit(tolerance).cast(MONEY)


def nearest_rank(name: str, q: float) -> Column:
    """The value of a column at rank ceil(q * n), an aggregate: always one of the values, as a long."""
    return F.expr(f"CAST(percentile_disc({q}) WITHIN GROUP (ORDER BY `{name}`) AS BIGINT)")


def floored_median(name: str) -> Column:
    return F.floor(F.median(name)).cast("bigint")


def ceil_hour(t: Column) -> Column:
    t = t.cast("timestamp")
    hour = F.date_trunc("HOUR", t)
    return F.when(t == hour, t).otherwise(hour + F.expr("INTERVAL 1 HOUR"))


def seconds(a: Column, b: Column) -> Column:
    """Exact seconds from a to b."""
    return ((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(24,6)")


def utc(c: Column) -> Column:
    """A timestamp from RFC 3339 text in UTC; null for any other form or a date that is none."""
    return F.when(F.regexp_like(c, F.lit(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?Z\z")), F.try_to_timestamp(c))
