"""From case results to rates, summaries, gates and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import floored_median, nearest_rank
from ..sources.tables import RANGE, before, ranged

EPSILON = 1e-12
REGRESSION = 0.02


def rate(flag: Column) -> Column:
    """The share of true among rows where the flag is given; 1.0 without such rows."""
    return F.coalesce(F.avg(flag.cast("int")), F.lit(1.0))


def summary(results: DataFrame, by: str, flags: list[str], counters: list[str], latency: str, only: dict[str, str] | None = None) -> DataFrame:
    """One row a candidate: n, a rate for each flag, a sum for each counter, p50 and p95 of the latency.

    only[flag] names a boolean that says which rows a flag's rate is taken over.
    """
    only = only or {}
    over = lambda f: F.when(F.col(only[f]), F.col(f)) if f in only else F.col(f)
    return results.groupBy(by).agg(
        F.count("*").alias("n"), *[rate(over(f)).alias(f"{f}_rate") for f in flags], *[F.sum(c).cast("bigint").alias(c) for c in counters], floored_median(latency).alias("p50"), nearest_rank(latency, 0.95).alias("p95")
    )


def weighted(weights: dict[str, float]) -> Column:
    """The weighted sum of rate columns, its terms added in the order given."""
    total = None
    for name, w in weights.items():
        term = F.col(name) * F.lit(w)
        total = term if total is None else total + term
    return total


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and the value of its last row."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def unpivot(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    return df.unpivot(key, metrics, "metric", "value")


def threshold_gate(metrics: DataFrame, checks: list[tuple[str, float | None, float | None]], key: str, never: tuple[str, ...] = ()) -> DataFrame:
    """key, failing, decision from (key, metric, value) and checks (metric, least or None, most or None): the metrics outside, in the order of the checks, comma-joined.

    Bounds are exact and part of what passes; a metric without value fails. A
    metric in `never`, e.g. a count of hard failures, fails above 0, after the
    others.
    """
    listed = [*checks, *[(m, None, 0.0) for m in never]]
    # Metrics and checks are a handful: each key's metrics meet in one map.
    values = metrics.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("metric").isin([m for m, *_ in listed]), F.struct("metric", "value")))).alias("m"))
    value = lambda m: F.try_element_at("m", F.lit(m))

    def outside(m: str, least: float | None, most: float | None) -> Column:
        holds = F.lit(True) if least is None else value(m) >= F.lit(float(least))
        holds = holds if most is None else holds & (value(m) <= F.lit(float(most)))
        return F.when(~F.coalesce(holds & value(m).isNotNull(), F.lit(False)), F.lit(m))

    failing = F.array_join(F.filter(F.array(*[outside(*c) for c in listed]), lambda x: x.isNotNull()), ",")
    return values.select(key, failing.alias("failing")).select(key, "failing", F.when(F.col("failing") == "", "passes").otherwise("fails").alias("decision"))


def compare(stock: DataFrame, adapter: DataFrame, key: str, metrics: list[str], margin: float, may_fall: tuple[str, ...] = ()) -> DataFrame:
    """key, a delta for each metric, quality_delta (their mean), failing, decision.

    A metric may fall by REGRESSION at most unless it is in may_fall; the mean
    must rise by the margin.
    """
    a = stock.select(key, *[F.col(m).alias(f"{m}_a") for m in metrics])
    b = adapter.select(key, *[F.col(m).alias(f"{m}_b") for m in metrics])
    both = a.join(b, key).select(key, *[(F.col(f"{m}_b") - F.col(f"{m}_a")).alias(f"{m}_delta") for m in metrics])
    mean = None
    for m in metrics:
        mean = F.col(f"{m}_delta") if mean is None else mean + F.col(f"{m}_delta")
    both = both.withColumn("quality_delta", mean / len(metrics))
    reasons = [F.when(F.col("quality_delta") + EPSILON < margin, "margin")]
    reasons += [F.when(F.col(f"{m}_delta") < -REGRESSION - EPSILON, m) for m in metrics if m not in may_fall]
    failing = F.array_join(F.filter(F.array(*reasons), lambda x: x.isNotNull()), ",")
    return both.withColumn("failing", failing).withColumn("decision", F.when(F.col("failing") == "", "advances").otherwise("rejected"))


def trial_stability(df: DataFrame, group: str, trial: str, passed: str) -> DataFrame:
    """group, trials, least, most, mean (two decimals, half to even), spread: passed cases a trial."""
    per = df.groupBy(group, trial).agg(F.count_if(F.col(passed)).alias("k"))
    return per.groupBy(group).agg(F.count("*").alias("trials"), F.min("k").alias("least"), F.max("k").alias("most"), F.bround(F.avg("k"), 2).alias("mean"), (F.max("k") - F.min("k")).alias("spread"))


def ordered_digest(df: DataFrame, text: Column, order: str) -> DataFrame:
    """n, digest: SHA-256 of all texts in order. One value is built of the whole table: for manifests, not for corpora."""
    rows = df.select(F.col(order).alias("o"), text.alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "")
    return rows.agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("digest"))


def corpus_digest(df: DataFrame, text: Column, order: str, block: int = 10_000) -> DataFrame:
    """n, digest: an ordered digest for tables of any size, over the digests of blocks of consecutive numbers of `order` (a long)."""
    rows = df.select(F.floor(F.col(order) / block).alias("b"), F.col(order).alias("o"), F.sha2(text, 256).alias("t"))
    blocks = rows.groupBy("b").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), ""), 256).alias("t"))
    return blocks.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "t"))), lambda x: x["t"]), ""), 256).alias("digest"))


def consumed(cases: DataFrame, log: DataFrame, order: str, calls: str, position: str) -> DataFrame:
    """The log's rows with the case each belongs to: case k owns the next `calls` rows after those of the cases before.

    Positions of the log run from 1. The cases' calls are added up by ranges of
    their order.
    """
    rows = ranged(cases, order)
    starts = F.broadcast(before(rows, F.col(calls)).select(RANGE, "start"))  # one row a range
    w = Window.partitionBy(RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    owned = rows.withColumn("_own", F.coalesce(F.sum(calls).over(w), F.lit(0))).join(starts, RANGE).withColumn("_start", F.col("start") + F.col("_own"))
    each = owned.select("*", F.explode(F.sequence(F.lit(1), F.col(calls).cast("int"))).alias("call_number")).where(F.col(calls) > 0)
    return each.withColumn(position, (F.col("_start") + F.col("call_number")).cast("bigint")).join(log, position, "left").drop("_start", "_own", "start", RANGE)
