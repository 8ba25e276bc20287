"""Queries over generated cases and traces, and evidence checks for which the driver's tables stand in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprints, jsonx, messages
from ..operators import cases as case_rules
from ..operators import evidence, replay, scoring, traces
from ..sources import generate
from ..sources.tables import read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH t AS (SELECT conv_id, turn, CAST(sum((length(coalesce(text, '')) + 3) // 4) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS tokens FROM conversations),
f AS (SELECT conv_id, turn FROM t WHERE 300 - tokens < 20 ORDER BY conv_id, turn LIMIT 1)
SELECT count(DISTINCT conv_id) AS cases, count(*) AS stages, max(tokens) AS most, 300 - max(tokens) AS least_left, (SELECT conv_id FROM f) AS failing_case, (SELECT turn FROM f) AS failing_stage FROM t""")
def capacity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that grow turn by turn, at four characters a token, against a context of 300."""
    from pyspark.sql import Window

    tokens = F.floor((F.length(F.coalesce("text", F.lit(""))) + 3) / 4)
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(tokens).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)).cast("bigint").alias("tokens"))
    return evidence.capacity(t, "conv_id", "turn", "tokens", 300, 20).withColumn("least_left", F.col("least_left").cast("bigint"))


@query("""SELECT event_type, CAST(sum(CAST(coalesce(json_exists(props, '$.k'), false) AS INT)) AS BIGINT) AS found FROM events GROUP BY 1""")
def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a key occurs, at any depth."""
    e = read(spark, sf_dir, "events").select("event_type", jsonx.count_keys(F.col("props"), ["k"]).alias("n"))
    return e.groupBy("event_type").agg(F.sum("n").alias("found"))


@query("""SELECT o_orderkey % 5 AS kind, sha256('{"a":[{"k":"#","n":"' || o_orderstatus || '"}],"b":"' || o_orderpriority || '","k":"#"}') AS digest, count(*) AS n FROM orders GROUP BY 1, 2""")
def masked_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of records whose ids are masked, at two depths: copies under other ids collide, others do not."""
    o = read(spark, sf_dir, "orders")
    record = F.format_string('{"k": %d, "b": "%s", "a": [{"n": "%s", "k": [%d]}]}', "o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey")
    return o.select((F.col("o_orderkey") % 5).alias("kind"), F.sha2(jsonx.masked(record, ["k"], "#"), 256).alias("digest")).groupBy("kind", "digest").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN l_orderkey % 7 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(18,2)) AS cost FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT coalesce(CASE WHEN l_orderkey IS NULL THEN 'not settled' WHEN cost <> CAST(o_totalprice AS DECIMAL(18,2)) THEN 'cost does not reconcile' END, 'none') AS problem, count(*) AS n FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1""")
def settlement_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls, their line items as settlements of which some are off by a cent."""
    same = lambda df, key, cost: df.select(key.cast("string").alias("id"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("stop").alias("finish"), cost.cast("string").alias("cost"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    settled = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().join(orders, "o_orderkey")
    off = F.when(F.col("o_orderkey") % 7 == 0, F.lit("0.01")).otherwise(F.lit("0")).cast("decimal(3,2)")
    calls = same(orders, F.col("o_orderkey"), F.col("p"))
    bad = evidence.settlement_problems(calls, same(settled, F.col("o_orderkey"), F.col("p") + off))
    return calls.select("id").join(bad, "id", "left").groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN quality = 0 AND toxic = 1 THEN 'bad and toxic' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'bad' ELSE 'other' END AS class, count(*) AS n FROM labels GROUP BY 1""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition of rows by the first class that fits."""
    q, t = F.col("quality") == 0, F.col("toxic") == 1
    return evidence.first_divergence(read(spark, sf_dir, "labels"), {"bad and toxic": q & t, "toxic": t, "bad": q}, "doc_id").groupBy("class").agg(F.count("*").alias("n"))


@query("""SELECT field, count(*) AS n FROM (SELECT unnest([CASE WHEN lang IS DISTINCT FROM 'en' THEN 'lang' END, CASE WHEN source IS DISTINCT FROM 'src0' THEN 'source' END]) AS field FROM documents) WHERE field IS NOT NULL GROUP BY 1""")
def contract_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of records that are not as a contract has them."""
    return evidence.identity_problems(read(spark, sf_dir, "documents"), {"lang": "en", "source": "src0"}, "doc_id").groupBy("field").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN '{"k":"' || conv_id || '"}' END AS arguments FROM conversations""")
def wire_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as an endpoint's messages and read back; each turn of an assistant is sent as a call, too."""
    rows = read(spark, sf_dir, "conversations")
    plain = F.try_parse_json(F.to_json(F.struct("role", F.col("text").alias("content")), {"ignoreNullFields": "false"}))
    called = F.try_parse_json(F.format_string('{"role":"assistant","toolCalls":[{"id":"c%d","name":"catalog_search","arguments":{"k":"%s"}}]}', "turn", F.col("conv_id").cast("string")))
    sent = rows.select("conv_id", "turn", messages.wire(plain, True).alias("m"), messages.wire(called, True).alias("c"), "role")
    back = messages.endpoint_turn(F.col("c"), F.lit(1))
    return sent.select(
        "conv_id", "turn", F.get_json_object("m", "$.role").alias("role"), F.get_json_object(messages.endpoint_turn(F.col("m"), F.lit(1)), "$.content").alias("text"),
        F.when(F.col("role") == "assistant", F.get_json_object(back, "$.toolCalls[0].arguments")).alias("arguments"),
    )


@query("""WITH t AS (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS flow FROM conversations GROUP BY 1) SELECT length(flow) // 1000 AS thousands, count(*) AS n FROM t GROUP BY 1""")
def conversation_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one text each, by thousands of characters."""
    t = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), "text").alias("s")))).alias("x"))  # the turns of one conversation
    flow = F.array_join(F.transform("x", lambda r: r["s"]), "\n")
    return t.groupBy(F.floor(F.length(flow) / 1000).cast("bigint").alias("thousands")).agg(F.count("*").alias("n"))


def _variants(spark: SparkSession, sf_dir: str) -> int:
    """Cases an axis: one for each fiftieth customer, so that they grow with the tables."""
    return max(5, read(spark, sf_dir, "customer").count() // 50)


_AXES = ", ".join(f"({i}, '{axis}')" for i, axis in enumerate(generate.AXES))
_MADE = f"""made AS (SELECT a.i * n.variants + v.v AS id, axis, v.v, 'case-' || axis || '-' || lpad(CAST(v.v AS VARCHAR), CAST(greatest(2, length(CAST(v.v AS VARCHAR))) AS INTEGER), '0') AS case_id
  FROM (VALUES {_AXES}) a(i, axis), (SELECT greatest(5, count(*) // 50) AS variants FROM customer) n, LATERAL (SELECT unnest(range(n.variants)) AS v) v)"""
_RECOVERY = ", ".join(f"'{x}'" for x in replay.RECOVERY)


@query(f"""WITH {_MADE},
played AS (SELECT *, CASE WHEN axis IN ({_RECOVERY}) AND axis <> 'malformed-final-repair' THEN 3 ELSE 2 END AS turns FROM made)
SELECT axis, count(*) AS n, 1.0::DOUBLE AS grounded_rate, 1.0::DOUBLE AS correct_operation_rate, 1.0::DOUBLE AS arguments_valid_rate, 1.0::DOUBLE AS schema_valid_rate, 1.0::DOUBLE AS policy_accuracy_rate, 1.0::DOUBLE AS proposal_quality_rate, 1.0::DOUBLE AS recovery_successful_rate,
  CAST(0 AS BIGINT) AS failures, CAST(0 AS BIGINT) AS unsupported, CAST(0 AS BIGINT) AS authority, CAST(max(turns * (turns + 1) // 2 * 1000000) AS BIGINT) AS p50, CAST(max(turns * (turns + 1) // 2 * 1000000) AS BIGINT) AS p95
FROM played GROUP BY axis""")
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perfect model's turns, played against the generated cases, scored and summed by axis: it has every rate and no failure."""
    made = generate.cases(spark, _variants(spark, sf_dir))
    scored = replay.score(made, generate.perfect_log(made)).withColumn("failures", F.size("hard_failures"))
    flags = ["grounded", "correct_operation", "arguments_valid", "schema_valid", "policy_accuracy", "proposal_quality", "recovery_successful"]
    return scoring.summary(scored, "axis", flags, ["failures", "unsupported", "authority"], "latency", {"recovery_successful": "recovery_expected"})


@query(f"""WITH {_MADE} SELECT CASE WHEN case_id LIKE '%1' AND axis <> 'abstention' THEN 'unsupported selected id' ELSE 'none' END AS reason, count(*) AS n FROM made GROUP BY 1""")
def trace_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated traces, of which each whose number ends in 1 picks an id that nothing surfaced, by their first problem."""
    made = generate.traces(generate.cases(spark, _variants(spark, sf_dir))).withColumn("trace", F.when(F.col("trace_id").endswith("1"), F.regexp_replace("trace", r'\\"tmdbId\\":[0-9]+', r'\\"tmdbId\\":999999')).otherwise(F.col("trace")))
    return traces.first_problems(made, generate.PROMPT).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {_MADE} SELECT axis, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN axis = 'abstention' THEN 0 ELSE 4 END) AS BIGINT) AS candidates,
  CAST(count(DISTINCT v) AS BIGINT) AS intents, CAST(0 AS BIGINT) AS household FROM made GROUP BY axis""")
def case_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What generated traces surface and ask, by axis: relabelled copies have one digest, other requests have others."""
    made = generate.cases(spark, _variants(spark, sf_dir))
    copies = made.withColumn("case_id", F.concat(F.col("case_id"), F.lit("-copy")))
    both = generate.traces(made).withColumn("copy", F.lit(0)).union(generate.traces(copies).withColumn("copy", F.lit(1)))
    told = both.select("copy", F.regexp_extract("trace_id", "^planner-case-(.+)-[0-9]+(?:-copy)?$", 1).alias("axis"), fingerprints.semantic_digest(F.col("trace"), False).alias("digest"), F.size(fingerprints.identities(F.col("trace"))).alias("n"), case_rules.synthetic_reason(F.col("trace")).alias("reason"))
    same = told.groupBy("axis", "digest").agg(F.count_if(F.col("copy") == 0).alias("own"), F.count_if(F.col("copy") == 1).alias("copied"))
    asked = same.where("own = copied").groupBy("axis").agg(F.count("*").alias("intents"))
    counts = told.where("copy = 0").groupBy("axis").agg(F.count("*").alias("n"), F.sum("n").cast("bigint").alias("candidates"), F.count("reason").alias("household"))
    return counts.join(asked, "axis").select("axis", "n", "candidates", "intents", "household")
