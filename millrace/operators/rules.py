"""Integrity rules: predicates over a row that give readable reasons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`holds` is what must be true; null counts as false."""

    reason: str
    holds: Column


class RuleError(ValueError):
    """A table that breaks a rule, in strict use."""


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f looks at it."""
    return F.transform(F.array(value), f)[0]


def broken(rule: Rule) -> Column:
    return ~F.coalesce(rule.holds, F.lit(False))


def first_reason(rules: list[Rule]) -> Column:
    """The reason of the first rule that a row breaks; null if it keeps all. Later rules are not evaluated."""
    if not rules:
        return F.lit(None).cast("string")
    # One CASE of many branches, not one within the other: Spark compiles each branch for itself.
    out = F.when(broken(rules[0]), F.lit(rules[0].reason))
    for r in rules[1:]:
        out = out.when(broken(r), F.lit(r.reason))
    return out


def all_reasons(rules: list[Rule]) -> Column:
    """The reasons of all rules that a row breaks, in the order of the rules."""
    found = F.array(*[F.when(broken(r), F.lit(r.reason)) for r in rules])
    return F.filter(found, lambda x: x.isNotNull())


def violations(df: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """key and reason of every row that breaks a rule."""
    return df.select(key, first_reason(rules).alias("reason")).where("reason IS NOT NULL")


def strict(df: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """df as it is; RuleError with the least key's reason if any row breaks a rule."""
    bad = violations(df, rules, key).agg(F.min(F.struct(key, "reason")).alias("r")).first()["r"]
    if bad is not None:
        raise RuleError(f"{bad[key]}: {bad['reason']}")
    return df


def histogram(reasons: DataFrame, column: str = "reasons") -> DataFrame:
    """reason and n; rows without a reason count under 'none'."""
    return reasons.select(F.explode_outer(column).alias("reason")).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


def quota(df: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """by, n, expected, met: the groups' counts against a table (by, expected), groups of either side."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    both = counts.join(expected, by, "full_outer")
    n, want = F.coalesce("n", F.lit(0)).cast("bigint"), F.coalesce("expected", F.lit(0)).cast("bigint")
    return both.select(by, n.alias("n"), want.alias("expected"), (n == want).alias("met"))
