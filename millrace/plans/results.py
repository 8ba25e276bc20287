"""Queries over results, reviews and spend, for which the star-schema tables stand in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import ceil_hour, floored_median, nearest_rank
from ..operators import intervals, ledger, review, scoring, turns
from ..sources.tables import read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH o AS (SELECT DISTINCT o_orderkey % 1000 AS k, o_custkey AS c FROM orders), l AS (SELECT DISTINCT l_orderkey % 1000 AS k, l_suppkey AS c FROM lineitem)
SELECT k, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM l WHERE l.k = o.k AND l.c = o.c)) AS ungrounded FROM o GROUP BY 1""")
def grounded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys picked by a group that nothing surfaced in it."""
    picks = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("k"), F.col("o_custkey").alias("c")).distinct()
    surfaced = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("k"), F.col("l_suppkey").alias("c"))
    missing = turns.ungrounded(picks, surfaced, ["k", "c"]).groupBy("k").agg(F.count("*").alias("ungrounded"))
    return picks.groupBy("k").agg(F.count("*").alias("n")).join(missing, "k", "left").select("k", "n", F.coalesce("ungrounded", F.lit(0)).cast("bigint").alias("ungrounded"))


@query("""SELECT d.source, count(l.doc_id) AS n, round(coalesce(avg(CAST(quality AS DOUBLE)), 1.0), 6) AS quality_rate, round(coalesce(avg(CAST(toxic AS DOUBLE)), 1.0), 6) AS toxic_rate FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def boolean_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    r = lambda c: F.round(scoring.rate(F.col(c) == 1), 6).alias(f"{c}_rate")
    return both.groupBy("source").agg(F.count("quality").alias("n"), r("quality"), r("toxic"))


@query("""SELECT event_type, CAST(quantile_disc(CAST(floor(value * 100) AS BIGINT), 0.95) AS BIGINT) AS p95, CAST(floor(median(CAST(floor(value * 100) AS BIGINT))) AS BIGINT) AS p50 FROM events GROUP BY 1""")
def nearest_rank_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 100).cast("bigint").alias("v"))
    return e.groupBy("event_type").agg(nearest_rank("v", 0.95).alias("p95"), floored_median("v").alias("p50"))


@query("""WITH e AS (SELECT event_type, value > 10 AS done, user_id % 2 = 0 AS recovery, value > 20 AS recovered, CAST(event_id % 3 AS BIGINT) AS failures, CAST(floor(value * 100) AS BIGINT) AS latency FROM events)
SELECT event_type, count(*) AS n, round(avg(CAST(done AS INT)), 6) AS done_rate, round(coalesce(avg(CAST(recovered AS INT)) FILTER (recovery), 1.0), 6) AS recovered_rate, CAST(sum(failures) AS BIGINT) AS failures,
  CAST(floor(median(latency)) AS BIGINT) AS p50, CAST(quantile_disc(latency, 0.95) AS BIGINT) AS p95 FROM e GROUP BY 1""")
def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(
        "event_type", (F.col("value") > 10).alias("done"), (F.col("user_id") % 2 == 0).alias("recovery"), (F.col("value") > 20).alias("recovered"), (F.col("event_id") % 3).alias("failures"), F.floor(F.col("value") * 100).cast("bigint").alias("latency")
    )
    s = scoring.summary(e, "event_type", ["done", "recovered"], ["failures"], "latency", {"recovered": "recovery"})
    return s.withColumns({c: F.round(c, 6) for c in ("done_rate", "recovered_rate")})


@query("""SELECT source, round(coalesce(avg(CAST(quality AS DOUBLE)), 1.0) * 0.7 + (1 - coalesce(avg(CAST(toxic AS DOUBLE)), 1.0)) * 0.3, 6) AS score FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def weighted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    rates = both.groupBy("source").agg(scoring.rate(F.col("quality") == 1).alias("good"), (1 - scoring.rate(F.col("toxic") == 1)).alias("clean"))
    return rates.select("source", F.round(scoring.weighted({"good": 0.7, "clean": 0.3}), 6).alias("score"))


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def last_wins_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.last_wins(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("""WITH m AS (SELECT source, coalesce(avg(CAST(quality AS DOUBLE)), 1.0) AS quality, coalesce(avg(CAST(toxic AS DOUBLE)), 1.0) AS toxic, count(l.doc_id) / count(*) AS labelled, count(*) FILTER (quality = 1 AND toxic = 1) AS odd FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1),
f AS (SELECT source, [x for x in [CASE WHEN NOT quality >= 0.85 THEN 'quality' END, CASE WHEN NOT toxic <= 0.1 THEN 'toxic' END, CASE WHEN NOT (labelled >= 0.1 AND labelled <= 0.4) THEN 'labelled' END, CASE WHEN odd > 0 THEN 'odd' END] if x IS NOT NULL] AS l FROM m)
SELECT source, array_to_string(l, ',') AS failing, CASE WHEN len(l) = 0 THEN 'passes' ELSE 'fails' END AS decision FROM f""")
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    odd = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).cast("double")
    m = both.groupBy("source").agg(scoring.rate(F.col("quality") == 1).alias("quality"), scoring.rate(F.col("toxic") == 1).alias("toxic"), (F.count("quality") / F.count("*")).alias("labelled"), odd.alias("odd"))
    return scoring.threshold_gate(scoring.unpivot(m, "source", ["quality", "toxic", "labelled", "odd"]), [("quality", 0.85, None), ("toxic", None, 0.1), ("labelled", 0.1, 0.4)], "source", ("odd",))


@query("""WITH s AS (SELECT event_type, avg(CAST(value > 10 AS INT)) FILTER (event_id % 2 = 0) AS a, avg(CAST(value > 10 AS INT)) FILTER (event_id % 2 = 1) AS b, avg(CAST(value > 30 AS INT)) FILTER (event_id % 2 = 0) AS c, avg(CAST(value > 30 AS INT)) FILTER (event_id % 2 = 1) AS d FROM events GROUP BY 1),
x AS (SELECT event_type, b - a AS fast, d - c AS slow, ((b - a) + (d - c)) / 2 AS q FROM s),
f AS (SELECT *, array_to_string([y for y in [CASE WHEN q + 1e-12 < 0.001 THEN 'margin' END, CASE WHEN fast < -0.02 - 1e-12 THEN 'fast' END] if y IS NOT NULL], ',') AS failing FROM x)
SELECT event_type, round(fast, 6) AS fast_delta, round(slow, 6) AS slow_delta, round(q, 6) AS quality_delta, failing, CASE WHEN failing = '' THEN 'advances' ELSE 'rejected' END AS decision FROM f""")
def candidate_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "event_type", (F.col("value") > 10).alias("fast"), (F.col("value") > 30).alias("slow"))
    half = lambda p: e.where(F.col("event_id") % 2 == p).groupBy("event_type").agg(scoring.rate(F.col("fast")).alias("fast"), scoring.rate(F.col("slow")).alias("slow"))
    out = scoring.compare(half(0), half(1), "event_type", ["fast", "slow"], 0.001, may_fall=("slow",))
    return out.withColumns({c: F.round(c, 6) for c in ("fast_delta", "slow_delta", "quality_delta")})


@query("""WITH t AS (SELECT event_type, user_id % 10 AS trial, count(*) FILTER (value > 10) AS k FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS trials, min(k) AS least, max(k) AS most, round_even(avg(k), 2) AS mean, max(k) - min(k) AS spread FROM t GROUP BY 1""")
def trial_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("trial"), (F.col("value") > 10).alias("passed"))
    return scoring.trial_stability(e, "event_type", "trial", "passed")


@query("""WITH b AS (SELECT (row_number() OVER (ORDER BY item_id) - 1) // 8 AS batch, strlen(text) AS n FROM benchmark), g AS (SELECT batch, count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_bytes FROM b GROUP BY 1)
SELECT role, CAST(batch AS BIGINT) AS batch, n_items, n_bytes, CAST(CAST(n_bytes AS DECIMAL(18,0)) * CAST(f AS DECIMAL(4,2)) * CAST('0.00001250' AS DECIMAL(10,8)) AS DECIMAL(30,10)) AS cost FROM g, (VALUES ('primary', 1.0), ('secondary', 1.5)) r(role, f)""")
def review_request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewers = spark.createDataFrame([("primary", 1.0), ("secondary", 1.5)], "role string, factor double")
    return review.request_plan(read(spark, sf_dir, "benchmark"), reviewers, "item_id", "text", 8, "0.0000125")


@query("""WITH d AS (SELECT doc_id, CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' END AS p, CASE toxic WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' END AS s FROM labels)
SELECT doc_id, p AS "primary", s AS secondary, CASE WHEN doc_id % 5 <> 0 THEN coalesce(p, 'pending') WHEN p = s THEN p ELSE 'pending' END AS status FROM d""")
def review_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = lambda c: F.when(c, "approved").otherwise("rejected")
    l = read(spark, sf_dir, "labels")  # noqa: E741
    seen = l.select(F.col("doc_id").alias("item"), F.lit("primary").alias("role"), verdict(F.col("quality") == 1).alias("verdict")).union(l.select("doc_id", F.lit("secondary"), verdict(F.col("toxic") == 0)))
    d = review.pivoted(seen, spark.createDataFrame([], "item long"))
    return d.select(F.col("item").alias("doc_id"), "primary", "secondary", review.consensus(F.col("primary"), F.col("secondary"), F.col("item") % 5 == 0).alias("status"))


@query("""SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)) AS surplus""")
def observation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.coverage(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id"))


@query("""WITH a AS (SELECT item_id AS "left", row_number() OVER (ORDER BY item_id) AS position FROM benchmark), b AS (SELECT item_id AS "right", row_number() OVER (ORDER BY length(text), item_id) AS position FROM benchmark)
SELECT CAST(position AS INTEGER) AS position, "left", "right", "left" = "right" AS agrees FROM a FULL JOIN b USING (position)""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    both = review.zipped(b.select(F.col("item_id").alias("left")), b.select(F.col("item_id").alias("right"), F.length("text").alias("n")), [F.col("left")], [F.col("n"), F.col("right")])
    return both.select("position", "left", "right", (F.col("left") == F.col("right")).alias("agrees"))


@query("""WITH b AS (SELECT l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS tax FROM lineitem), t AS (SELECT *, price + tax AS total FROM b)
SELECT l_returnflag, count(*) AS n, CAST(sum(price) AS DECIMAL(28,4)) AS price, CAST(sum(tax) AS DECIMAL(28,4)) AS tax, CAST(sum(total) AS DECIMAL(28,4)) AS total, abs(sum(price) + sum(tax) - sum(total)) <= 0.0000000000000001 AS balanced FROM t GROUP BY 1""")
def ledger_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    b = read(spark, sf_dir, "lineitem").select("l_returnflag", price.alias("price"), (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,4)").alias("tax"))
    out = ledger.reconcile(b.withColumn("total", F.col("price") + F.col("tax")), "l_returnflag", ["price", "tax"], "total", "0.0000000000000001")
    return out.withColumns({c: F.col(c).cast("decimal(28,4)") for c in ("price", "tax", "total")})


@query("""WITH s AS (SELECT o_orderkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderkey) AS running FROM orders) SELECT o_orderkey, CAST(running AS DECIMAL(28,2)) AS running FROM s WHERE running > 30000000 ORDER BY o_orderkey LIMIT 1""")
def running_spend_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    return ledger.running_cap(spend, "o_orderkey", "amount", "30000000").select("o_orderkey", F.col("running").cast("decimal(28,2)").alias("running"))


@query("""WITH e AS (SELECT event_id, event_type, ts, CASE WHEN ts = date_trunc('hour', ts) THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS billed FROM events)
SELECT event_type, count(*) AS n, CAST(sum(CAST(date_diff('microsecond', ts, billed) AS DECIMAL(20,0)) / 1000000) AS DECIMAL(28,6)) AS waited, count(*) FILTER (ts = billed) AS on_the_hour FROM e GROUP BY 1""")
def duration_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to the end of the billed hour."""
    from ..functions.numbers import seconds

    e = read(spark, sf_dir, "events").select("event_type", "ts", ceil_hour(F.col("ts")).alias("billed"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(seconds(F.col("ts"), F.col("billed"))).cast("decimal(28,6)").alias("waited"), F.count_if(F.col("ts").cast("timestamp") == F.col("billed")).alias("on_the_hour"))


@query("""WITH blocks AS (SELECT doc_id // 1000 AS b, count(*) AS n, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY doc_id, sha256(coalesce(text, '')))) AS digest FROM documents GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(digest, '' ORDER BY b)) AS digest FROM blocks""")
def ordered_corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the order of their ids, by digests of blocks."""
    return scoring.corpus_digest(read(spark, sf_dir, "documents"), F.coalesce("text", F.lit("")), "doc_id", 1000)


@query("""WITH s AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + CAST(floor(value * 60) AS BIGINT) AS e FROM events WHERE user_id IS NOT NULL)
SELECT a.user_id, count(*) AS n FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e GROUP BY 1""")
def overlap_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint")
    spans = read(spark, sf_dir, "events").select("user_id", "event_id", start.alias("s"), (start + F.floor(F.col("value") * 60).cast("bigint")).alias("e")).toDF("user_id", "event_id", "begins", "ends")
    return intervals.overlaps(spans, "user_id", "event_id", "begins", "ends").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT floor(CAST(props->>'k' AS BIGINT) / 25.0)::BIGINT AS tier, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import jsonx

    k = jsonx.integer(jsonx.variant(F.col("props")), "$.k")
    return read(spark, sf_dir, "events").groupBy(F.floor(k / 25).cast("bigint").alias("tier"), "event_type").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT item_id, 1 + item_id % 3 AS calls FROM benchmark), s AS (SELECT item_id, calls, coalesce(sum(calls) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM c),
l AS (SELECT event_id + 1 AS position, value FROM events) SELECT item_id, count(*) AS n, CAST(min(position) AS BIGINT) AS first_position, round(sum(value), 6) AS spent FROM s JOIN l ON position > st AND position <= st + calls GROUP BY 1""")
def consumed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shared call log dealt to cases, each owning as many rows as it made calls."""
    cases = read(spark, sf_dir, "benchmark").select("item_id", (1 + F.col("item_id") % 3).alias("calls"))
    log = read(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("position"), "value")
    dealt = scoring.consumed(cases, log, "item_id", "calls", "position")
    return dealt.groupBy("item_id").agg(F.count("value").alias("n"), F.min("position").alias("first_position"), F.round(F.sum("value"), 6).alias("spent"))
