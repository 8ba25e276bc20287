"""Two-reviewer evidence: plans, consensus, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import numbered

SETTLED = ("approved", "rejected")


def request_plan(items: DataFrame, reviewers: DataFrame, order: str, text: str, size: int, price: str) -> DataFrame:
    """role, batch, n_items, n_bytes, cost: items in batches of `size` in their order, for each reviewer (role, factor).

    reviewers is a handful of rows. Costs are exact decimals.
    """
    rows = numbered(items.select(F.col(order), F.octet_length(text).alias("bytes")), "nth", order)
    batches = rows.groupBy(F.floor((F.col("nth") - 1) / size).cast("bigint").alias("batch")).agg(F.count("*").alias("n_items"), F.sum("bytes").cast("bigint").alias("n_bytes"))
    cost = (F.col("n_bytes").cast("decimal(18,0)") * F.col("factor").cast("decimal(4,2)") * F.lit(price).cast("decimal(10,8)")).cast("decimal(30,10)")
    return batches.join(F.broadcast(reviewers)).select("role", "batch", "n_items", "n_bytes", cost.alias("cost"))


def consensus(primary: Column, secondary: Column, required: Column) -> Column:
    """approved, rejected or pending from two verdicts; without a required second, the first decides."""
    alone = F.when(primary.isin(*SETTLED), primary).otherwise("pending")
    agreed = F.when((primary == secondary) & primary.isin(*SETTLED), primary).otherwise("pending")
    return F.when(required, agreed).otherwise(alone)


def pivoted(observations: DataFrame, invalid: DataFrame, item: str = "item", role: str = "role", verdict: str = "verdict") -> DataFrame:
    """item, primary, secondary from rows (item, role, verdict); an invalid observation (item) of either role blanks both."""
    slot = lambda r: F.max(F.when(F.col(role) == r, F.col(verdict))).alias(r)
    both = observations.groupBy(item).agg(slot("primary"), slot("secondary"))
    bad = invalid.select(item).distinct().withColumn("_bad", F.lit(True))
    blank = lambda r: F.when(F.col("_bad").isNull(), F.col(r)).alias(r)
    return both.join(bad, item, "left").select(item, blank("primary"), blank("secondary"))


def derived(decisions: DataFrame, item: str = "item") -> DataFrame:
    """Decisions with status and problem: reviewers differ, the second follows the first, evidence only where a verdict is.

    Columns primary, secondary, primary_reviewer, secondary_reviewer,
    primary_at, secondary_at, required.
    """
    second = F.col("required") & F.col("secondary").isin(*SETTLED)
    problem = (
        F.when(second & (F.col("primary_reviewer") == F.col("secondary_reviewer")), "both reviews are by one person")
        .when(second & ~F.coalesce(F.col("secondary_at") > F.col("primary_at"), F.lit(False)), "the second review is not after the first")
        .when(~F.col("required") & (F.coalesce("secondary_reviewer", F.lit("")) != ""), "a secondary review that is not required has evidence")
    )
    return decisions.withColumn("problem", problem).withColumn("status", F.when(problem.isNull(), consensus(F.col("primary"), F.col("secondary"), F.col("required"))))


def coverage(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """missing, surplus: rows of one table that the other lacks, counted with their repetitions."""
    missing, surplus = expected.exceptAll(actual), actual.exceptAll(expected)
    both = missing.select(F.lit(1).alias("m"), F.lit(0).alias("s")).union(surplus.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("missing"), F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("surplus"))


def zipped(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Two tables side by side in their orders; `position` from 1, and nulls where one is longer."""
    a, b = numbered(left, "position", *left_order), numbered(right, "position", *right_order)
    return a.join(b, "position", "full_outer")


#: The keys of a decision and of one reviewer's part of it.
DECISION = ["schemaVersion", "traceId", "primary", "secondary"]
PERSON = ["verdict", "reviewer", "reviewedAt", "notes"]


def decision_reason(decision: Column, required: Column) -> Column:
    """Why a decision (JSON text) is refused; `required` says whether it needs a second reviewer.

    A settled verdict has a reviewer and a UTC time, a pending one has no
    evidence; a second review differs in person and comes after the first.
    """
    from ..functions import jsonx
    from ..functions.numbers import utc
    from .rules import let

    def parts(v: Column) -> Column:
        """Either reviewer's values, taken out once; `of` has the keys, which only an object has."""
        person = lambda who: F.struct(
            jsonx.object_keys(v, f"$.{who}").alias("of"), *[F.coalesce(jsonx.string(v, f"$.{who}.{k}"), F.lit("")).alias(k) for k in PERSON], utc(jsonx.string(v, f"$.{who}.reviewedAt")).alias("at"),
        ).alias(who)
        return F.struct(v.alias("v"), person("primary"), person("secondary"))

    return let(let(jsonx.variant(decision), parts), lambda x: _decision_reason(decision, required, x))


def _decision_reason(decision: Column, required: Column, x: Column) -> Column:
    from ..functions import jsonx
    from .rules import Rule, first_reason

    v = x["v"]
    text = lambda who, k: x[who][k]
    settled = lambda who: text(who, "verdict").isin(*SETTLED)
    at = lambda who: x[who]["at"]
    only = lambda who, names: F.coalesce(x[who]["of"] == F.lit(sorted(names)), F.lit(False))
    evidence = lambda who: (text(who, "reviewer") != "") | (text(who, "reviewedAt") != "") | (text(who, "notes") != "")
    sound = lambda who: ~settled(who) | ((text(who, "reviewer") != "") & at(who).isNotNull())
    second = required & settled("secondary")
    return first_reason([
        Rule("the decision has other fields", jsonx.closed(decision, DECISION) & (jsonx.integer(v, "$.schemaVersion") == 1)),
        Rule("the first review has other fields", only("primary", PERSON)),
        Rule("the second review has other fields", only("secondary", [*PERSON, "required"])),
        Rule("a second review is wanted where it is not required, or the other way round", F.coalesce(jsonx.boolean(v, "$.secondary.required") == required, F.lit(False))),
        Rule("unknown verdict", text("primary", "verdict").isin("pending", *SETTLED) & F.when(required, text("secondary", "verdict").isin("pending", *SETTLED)).otherwise(text("secondary", "verdict") == "not-required")),
        Rule("a settled verdict needs a reviewer and a UTC time", sound("primary") & sound("secondary")),
        Rule("a pending verdict carries evidence", (settled("primary") | ~evidence("primary")) & (settled("secondary") | ~evidence("secondary"))),
        Rule("both reviews are by one person", ~second | (text("primary", "reviewer") != text("secondary", "reviewer"))),
        Rule("the second review is not after the first", ~second | (at("secondary") > at("primary"))),
    ])


def pending(drafts: DataFrame, criteria: list[str], key: str = "trace_id", text: str = "trace") -> DataFrame:
    """One undecided row for each draft, bound to its digest: key, trace_sha256, reviewer, verdict, criteria (by name, null), notes."""
    return drafts.select(key, F.sha2(text, 256).alias("trace_sha256"), F.lit("").alias("reviewer"), F.lit("pending").alias("verdict"), F.create_map(*[x for c in criteria for x in (F.lit(c), F.lit(None).cast("boolean"))]).alias("criteria"), F.lit("").alias("notes"))


def trace_review(status: Column, primary: Column, secondary: Column, reviewed_at: Column, notes: Column) -> Column:
    """The review that a trace carries: reviewers joined by + only where it is approved."""
    both = F.concat_ws("+", F.nullif(primary, F.lit("")), F.nullif(secondary, F.lit("")))
    approved = status == "approved"
    return F.struct(status.alias("status"), F.when(approved, both).otherwise("").alias("reviewer"), F.when(approved, reviewed_at).alias("reviewedAt"), F.coalesce(notes, F.lit("")).alias("notes"))


def verdict_counts(decisions: DataFrame, by: str, verdict: str = "verdict", reviewer: str = "reviewer") -> DataFrame:
    """by, approved, rejected, pending, reviewers (the distinct names, sorted: a handful)."""
    count = lambda v: F.count_if(F.col(verdict) == v).alias(v)
    return decisions.groupBy(by).agg(*[count(v) for v in (*SETTLED, "pending")], F.array_sort(F.collect_set(F.nullif(F.col(reviewer), F.lit("")))).alias("reviewers"))


def escalated(attestations: DataFrame, item: str = "item", role: str = "role", verdict: str = "verdict") -> DataFrame:
    """item, status, for items with attestations of two roles: approved if both approve, else escalated; one missing role escalates too."""
    per = attestations.groupBy(item).agg(F.count_distinct(role).alias("roles"), F.bool_and(F.col(verdict) == "approved").alias("all"))
    return per.select(item, F.when((F.col("roles") == 2) & F.col("all"), "approved").otherwise("escalated").alias("status"))
