"""Exact quantiles of groups of any size, with bounded state for each group.

A group of few values is sorted as it is. Of a larger one only counts and a
sketch are taken, whose size does not grow: the sketch's grid gives a bracket
of values that holds the wanted rank, the next pass counts what lies before and
in it and sketches its inside, and so on, until the rank falls on an end of the
bracket or what is inside is few. A pass narrows the bracket some seventyfold,
so that a group of a trillion values takes four; rows are never shuffled, only
the groups' partial counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpoint

#: Values of a group that are sorted in one place.
BUFFER = 10_000
#: Steps of a sketch's grid; the sketch is wrong by one in ACCURACY of its ranks at most, far less than a step.
GRID, ACCURACY = 200, 10_000
#: Rows of wanted ranks that may be broadcast; beyond them the same join shuffles.
BROADCAST_ROWS = 100_000

Rank = Callable[[Column], Column]


def nearest(q: str) -> Rank:
    """The rank ceil(q * n), q a decimal as text."""
    return lambda n: F.greatest(F.ceil(n.cast("decimal(20,0)") * F.lit(q).cast("decimal(10,8)")), F.lit(1))


def lower_middle(n: Column) -> Column:
    return F.floor((n + 1) / 2)


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2) + 1


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _nth(values: Column, n: Column) -> Column:
    return F.try_element_at(F.array_sort(F.collect_list(values)), n.cast("int"))


def at_ranks(df: DataFrame, by: str, value: str, ranks: dict[str, Rank], buffer: int = BUFFER) -> DataFrame:
    """by, n, and the value at each of the ranks, for each group: one of its values, of its type.

    n counts the values that are not null; a group without any has no row. A
    null group is a group; NaN comes after all numbers. Values are of a type
    that percentile_approx takes: numbers, dates, times.
    """
    names = [*ranks]
    rows = df.select(F.col(by).alias("g"), F.col(value).alias("v")).where("v IS NOT NULL")
    sizes = checkpoint(rows.groupBy("g").agg(F.count("*").alias("n")))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), f(F.col("n")).cast("long").alias("rank")) for i, f in enumerate(ranks.values())])).alias("x")
    targets = sizes.select("g", "n", wanted).select("g", "n", "x.t", "x.rank")
    large = sizes.where(F.col("n") > buffer).select(F.col("g").alias("h"))
    few = rows.join(_small(large), F.col("g").eqNullSafe(F.col("h")), "left_anti").groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    near = few.select(F.col("g").alias("h"), "vs")
    answers = [targets.where(F.col("n") <= buffer).join(near, F.col("g").eqNullSafe(F.col("h"))).select("g", "t", F.try_element_at("vs", F.col("rank").cast("int")).alias("v"))]

    kind = rows.schema["v"].dataType
    none = F.lit(None).cast(kind)
    state = targets.where(F.col("n") > buffer).select(F.col("g").alias("h"), "t", "rank", none.alias("a"), none.alias("b"))
    steps = [k / GRID for k in range(GRID + 1)]
    inside = (F.col("a").isNull() | (F.col("v") > F.col("a"))) & (F.col("b").isNull() | (F.col("v") < F.col("b")))
    while not state.isEmpty():
        held = rows.join(_small(state), F.col("g").eqNullSafe(F.col("h")))
        count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
        stats = held.groupBy("h", "t").agg(
            *[F.first(c).alias(c) for c in ("rank", "a", "b")], count(F.col("v") < F.col("a")).alias("under"), count(F.col("v") <= F.col("a")).alias("until"), count(inside).alias("m"),
            count(F.col("v") == F.col("b")).alias("on"), F.percentile_approx(F.when(inside, F.col("v")), steps, ACCURACY).alias("grid"),
        )
        end = F.col("until") + F.col("m")
        rank = F.col("rank")
        stats = checkpoint(stats.withColumn("base", F.col("until")).withColumn("found", F.when((rank > F.col("under")) & (rank <= F.col("until")), F.col("a")).when((rank > end) & (rank <= end + F.col("on")), F.col("b"))))
        answers.append(stats.where("found IS NOT NULL").select(F.col("h").alias("g"), "t", F.col("found").alias("v")))
        left = stats.where("found IS NULL")
        inner = (rank > F.col("until")) & (rank <= end)
        last = left.where(inner & (F.col("m") <= buffer))
        if not last.isEmpty():
            values = rows.join(_small(last), F.col("g").eqNullSafe(F.col("h"))).where(inside)
            answers.append(values.groupBy("h", "t").agg(_nth(F.col("v"), F.first(rank) - F.first("base")).alias("v")).select(F.col("h").alias("g"), "t", "v"))
        # Two steps to either side of where the rank stands; an end that has no such step stays.
        at = (rank - F.col("until")) / F.col("m") * GRID
        step = lambda i: F.when((i >= 1) & (i <= GRID + 1), F.get("grid", (i - 1).cast("int")))
        a, b = F.coalesce(step(F.floor(at) - 1), F.col("a")), F.coalesce(step(F.ceil(at) + 3), F.col("b"))
        # Should the sketch have missed, the side it missed on opens again.
        a = F.when(inner, a).when(rank > end, F.col("a"))
        b = F.when(inner, b).when(rank <= end, F.col("b"))
        state = checkpoint(left.where(~(inner & (F.col("m") <= buffer))).select("h", "t", "rank", a.alias("a"), b.alias("b")))

    found = answers[0]
    for more in answers[1:]:
        found = found.union(more)
    found = found.groupBy("g").agg(*[F.max(F.when(F.col("t") == i, F.col("v"))).alias(f"_{i}") for i in range(len(names))]).withColumnRenamed("g", "h")
    return sizes.join(found, F.col("g").eqNullSafe(F.col("h"))).select(F.col("g").alias(by), "n", *[F.col(f"_{i}").alias(name) for i, name in enumerate(names)])
