"""Queries whose operators keep bounded state where one key may hold everything: quantiles, spans of any length, hash trees, nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, merkle, quantiles, walk
from ..sources.tables import read

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH e AS (SELECT CASE WHEN l_orderkey % 10 < 7 THEN 'most' ELSE l_returnflag END AS part, l_extendedprice AS v, l_quantity FROM lineitem)
SELECT part, count(v) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.999) AS p999, min(v) AS least, max(v) AS most FROM e GROUP BY 1""")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of prices, one group with seven rows in ten."""
    part = F.when(F.col("l_orderkey") % 10 < 7, "most").otherwise(F.col("l_returnflag"))
    rows = read(spark, sf_dir, "lineitem").select(part.alias("part"), "l_extendedprice")
    ranks = {"p50": quantiles.nearest("0.5"), "p95": quantiles.nearest("0.95"), "p999": quantiles.nearest("0.999"), "least": lambda n: F.lit(1), "most": lambda n: n}
    return quantiles.at_ranks(rows, "part", "l_extendedprice", ranks)


@query("""SELECT 'all' AS part, count(v) AS n, CAST(floor(median(v)) AS BIGINT) AS p50, CAST(quantile_disc(v, 0.95) AS BIGINT) AS p95 FROM (SELECT CAST(floor(value * 100) AS BIGINT) AS v FROM events)""")
def exact_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floored median and the 95th percentile of all latencies, in one group with many ties."""
    rows = read(spark, sf_dir, "events").select(F.lit("all").alias("part"), F.floor(F.col("value") * 100).cast("bigint").alias("v"))
    found = quantiles.at_ranks(rows, "part", "v", {"low": quantiles.lower_middle, "high": quantiles.upper_middle, "p95": quantiles.nearest("0.95")})
    return found.select("part", "n", F.floor((F.col("low") + F.col("high")) / 2).cast("bigint").alias("p50"), "p95")


@query("""WITH s AS (SELECT user_id % 10 AS lane, event_id, epoch_us(ts) // 1000000 AS s,
    CASE WHEN event_id % 500 = 0 THEN 315360000 WHEN event_id % 50 = 0 THEN 86400 ELSE 1 + CAST(floor(value) AS BIGINT) END AS span FROM events WHERE user_id IS NOT NULL)
SELECT a.lane, count(*) AS n, CAST(sum(a.event_id) AS BIGINT) AS left_sum, CAST(sum(b.event_id) AS BIGINT) AS right_sum
FROM s a JOIN s b ON a.lane = b.lane AND a.event_id < b.event_id AND a.s < b.s + b.span AND b.s < a.s + a.span GROUP BY 1""")
def overlap_any_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of spans from a second to ten years, joined without a width."""
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint")
    span = F.when(F.col("event_id") % 500 == 0, 315_360_000).when(F.col("event_id") % 50 == 0, 86_400).otherwise(1 + F.floor("value"))
    spans = read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("lane"), "event_id", start.alias("s"), (start + span).cast("bigint").alias("e"))
    pairs = intervals.overlaps(spans, "lane", "event_id", "s", "e")
    return pairs.groupBy("lane").agg(F.count("*").alias("n"), F.sum("left").alias("left_sum"), F.sum("right").alias("right_sum"))


def _level(k: int) -> str:
    return f"l{k} AS (SELECT i // 16 AS i, sha256('b' || string_agg(digest, '' ORDER BY i)) AS digest FROM l{k - 1} WHERE (SELECT count(*) FROM l{k - 1}) > 1 GROUP BY 1)"


@query(f"""WITH l0 AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, digest) - 1 AS i, digest FROM (SELECT doc_id, sha256(CASE WHEN text IS NULL THEN 'n' ELSE 'l' || text END) AS digest FROM documents)),
{", ".join(map(_level, range(1, 9)))},
whole AS ({" UNION ALL ".join(f"SELECT {k} AS level, i, digest FROM l{k}" for k in range(9))})
SELECT CAST(level AS INTEGER) AS level, CAST(i AS BIGINT) AS i, digest FROM whole""")
def merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the documents' hash tree, in the order of their ids."""
    return merkle.tree(read(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS t, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT CAST(i AS BIGINT) AS i, sha256('l' || t) AS old, sha256('l' || 'void|' || split_part(t, '|', 2)) AS new FROM o WHERE o_orderkey % 977 = 0""")
def merkle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two states of the orders differ, found from the roots of their trees downwards."""
    orders = read(spark, sf_dir, "orders")
    text = lambda status: F.concat(status, F.lit("|"), F.col("o_orderpriority"))
    old = merkle.tree(orders, text(F.col("o_orderstatus")), "o_orderkey")
    new = merkle.tree(orders, text(F.when(F.col("o_orderkey") % 977 == 0, "void").otherwise(F.col("o_orderstatus"))), "o_orderkey")
    return merkle.differing(old, new)


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS t, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT CAST(i AS BIGINT) AS place, i % 200 = 0 AS holds FROM o WHERE i % 100 = 0""")
def merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every hundredth order, every other one held against a text that it does not have."""
    orders = read(spark, sf_dir, "orders")
    nodes = merkle.tree(orders, F.concat("o_orderstatus", F.lit("|"), "o_orderpriority"), "o_orderkey")
    leaves = nodes.where("level = 0 AND i % 100 = 0").select(F.col("i").alias("place"), F.when(F.col("i") % 200 == 0, F.col("digest")).otherwise(merkle.leaf(F.lit("another"))).alias("digest"))
    top = merkle.root(nodes).first()
    told = merkle.proved(leaves, merkle.proofs(nodes, leaves), top["level"] if top else 0)
    return told.select("place", (F.col("digest") == F.lit(top["digest"] if top else "")).alias("holds"))


@query("""WITH e AS (SELECT event_id, event_type, CAST(props->>'k' AS VARCHAR) AS k FROM events),
said AS (
  SELECT '$.kind' AS path, 'kind' AS key, event_type AS value, false AS protected FROM e
  UNION ALL SELECT '$.private.kind', 'kind', event_type, true FROM e
  UNION ALL SELECT '$.list[1]', 'list', event_type || k, false FROM e
  UNION ALL SELECT '$.told', 'told', '{"inner":["' || event_type || '"],"private":"' || k || '"}', false FROM e
  UNION ALL SELECT '$.told~.inner[0]', 'inner', event_type, false FROM e
  UNION ALL SELECT '$.told~.private', 'private', k, true FROM e)
SELECT path, key, protected, count(*) AS n, count(DISTINCT value) AS texts, min(value) AS least, max(value) AS most FROM said GROUP BY 1, 2, 3""")
def nested_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strings of nested records made of events, one of which is a record itself, with the path, name and protection of each."""
    k = F.get_json_object("props", "$.k")
    told = F.concat(F.lit('{"inner":["'), "event_type", F.lit('"],"private":"'), k, F.lit('"}'))
    record = F.to_json(F.struct(F.col("event_type").alias("kind"), F.struct(F.col("event_type").alias("kind"), F.lit(5).alias("n")).alias("private"), F.array(F.lit(None).cast("string"), F.concat("event_type", k)).alias("list"), told.alias("told")))
    rows = read(spark, sf_dir, "events").select("event_id", record.alias("record"))
    found = walk.leaves(rows, "event_id", "record", ["private"])
    return found.groupBy("path", "key", "protected").agg(F.count("*").alias("n"), F.countDistinct("value").alias("texts"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("""SELECT event_type, CAST(sum(CASE WHEN props->>'k' IS NULL THEN 0 WHEN event_id % 2 = 0 THEN 3 ELSE 1 END) AS BIGINT) AS n FROM events GROUP BY 1 HAVING n > 0""")
def nested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a name stands in records, whose depth varies."""
    record = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"k": [{"deep": ['), "props", F.lit(', 1]}], "other": {"k": null}}'))).otherwise(F.col("props"))
    events = read(spark, sf_dir, "events").withColumn("record", record)
    counts = walk.name_counts(events, "event_id", "record", ["k"])
    return events.join(counts, F.col("event_id") == F.col("id")).groupBy("event_type").agg(F.sum("n").alias("n"))
