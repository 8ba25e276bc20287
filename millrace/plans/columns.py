"""Rules over records that are made of the tables' own columns: a row breaks a rule by its own values.

The SQL evaluates the rules over the columns, without the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arguments as A
from ..sources.tables import read

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH a AS (SELECT l_orderkey, l_tax = 0 AS q, CASE WHEN l_discount = 0.1 THEN 'book' WHEN l_returnflag = 'A' THEN 'movie' WHEN l_returnflag = 'R' THEN 'series' END AS media,
  CASE WHEN l_tax > 0.04 THEN l_partkey END AS lo, CASE WHEN l_discount BETWEEN 0.045 AND 0.095 THEN l_suppkey * 10 END AS hi, CASE WHEN l_linenumber > 4 THEN l_quantity / 4 END AS vote,
  l_tax = 0.02 OR (l_tax = 0.03 AND l_linestatus = 'F') AS net, CASE WHEN l_tax = 0.03 THEN l_linenumber END AS people FROM lineitem),
r AS (SELECT *, lo IS NOT NULL OR hi IS NOT NULL OR vote IS NOT NULL OR net OR people IS NOT NULL AS filters FROM a)
SELECT CASE WHEN NOT q AND NOT filters AND media IS NULL THEN 'not the arguments of a search' WHEN q AND filters THEN 'title query mixed with filters' WHEN NOT q AND NOT filters THEN 'nothing to search by'
  WHEN media = 'book' THEN 'media_type is not of its kind' WHEN lo NOT BETWEEN 1 AND 1440 THEN 'runtime_min is not of its kind' WHEN hi NOT BETWEEN 1 AND 1440 THEN 'runtime_max is not of its kind' WHEN lo > hi THEN 'the least runtime is above the greatest'
  WHEN vote <= 0 OR vote > 10 THEN 'vote_average_min is not of its kind' WHEN people > 4 THEN 'cast is not of its kind' WHEN people = 4 THEN 'cast names someone twice' WHEN net AND people IS NOT NULL THEN 'network and person constraints at once'
  WHEN net AND media IS DISTINCT FROM 'series' THEN 'a network is asked for without series' WHEN people IS NOT NULL AND media IS DISTINCT FROM 'movie' THEN 'people of other media than movies' END AS reason, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orders FROM r GROUP BY 1""")
def line_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as searches: their parts, suppliers, quantities and flags are the arguments, and what is refused is so for their values."""
    arguments = """to_json(named_struct(
        'query', CASE WHEN l_tax = 0 THEN concat('part ', l_partkey) END,
        'media_type', CASE WHEN l_discount = 0.1 THEN 'book' WHEN l_returnflag = 'A' THEN 'movie' WHEN l_returnflag = 'R' THEN 'series' END,
        'runtime_min', CASE WHEN l_tax > 0.04 THEN l_partkey END,
        'runtime_max', CASE WHEN l_discount BETWEEN 0.045 AND 0.095 THEN l_suppkey * 10 END,
        'vote_average_min', CASE WHEN l_linenumber > 4 THEN l_quantity / 4 END,
        'network', CASE WHEN l_tax = 0.02 OR (l_tax = 0.03 AND l_linestatus = 'F') THEN concat('network ', l_suppkey) END,
        'cast', CASE WHEN l_tax = 0.03 THEN transform(sequence(1, l_linenumber), i -> concat('Actor ', i % 3)) END))"""
    rows = A.search_reasons(read(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(arguments).alias("asked")), "asked")
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("orders"))


@query("""WITH y AS (SELECT o_orderstatus AS status, o_orderpriority AS p, o_custkey BETWEEN 1900 AND 2099 OR o_custkey BETWEEN 0 AND 99 AS a, o_orderkey BETWEEN 1900 AND 2099 OR o_orderkey BETWEEN 0 AND 99 AS b FROM orders)
SELECT status, CASE status WHEN 'F' THEN a WHEN 'P' THEN a AND b ELSE false END AS valid, count(*) AS n FROM y GROUP BY 1, 2""")
def order_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as eras: a customer's number as a decade, two numbers as a span, a priority as what is none."""
    era = F.expr("CASE o_orderstatus WHEN 'F' THEN concat(' ', o_custkey, 'S ') WHEN 'P' THEN concat(o_custkey, IF(o_custkey % 2 = 0, ' to ', ' – '), o_orderkey) ELSE o_orderpriority END")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), A.valid_era(era).alias("valid"))
    return rows.groupBy("status", "valid").agg(F.count("*").alias("n"))
