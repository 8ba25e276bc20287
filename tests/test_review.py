"""Review, ledger and rules on hand-made rows."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import jsonx
from millrace.operators import evidence, ledger, leakage, review, rules, turns
from millrace.operators.rules import Rule, RuleError

PERSON = {"verdict": "approved", "reviewer": "a", "reviewedAt": "2024-01-01T00:00:00Z", "notes": ""}
DECISION = {"schemaVersion": 1, "traceId": "t", "primary": PERSON, "secondary": {**PERSON, "reviewer": "b", "reviewedAt": "2024-01-02T00:00:00Z", "required": True}}


@pytest.mark.parametrize(
    "change, reason",
    [
        (lambda d: None, None), (lambda d: d.update(more=1), "the decision has other fields"), (lambda d: d["primary"].update(more=1), "the first review"), (lambda d: d["secondary"].pop("required"), "the second review has"), (lambda d: d["secondary"].update(required=False), "not required, or the other way"),
        (lambda d: d["primary"].update(verdict="maybe"), "unknown verdict"), (lambda d: d["primary"].update(reviewedAt="2024-02-30T00:00:00Z"), "UTC time"), (lambda d: d["primary"].update(reviewedAt="2024-01-01 00:00:00"), "UTC time"), (lambda d: d["primary"].update(verdict="pending"), "carries evidence"),
        (lambda d: d["secondary"].update(reviewer="a"), "by one person"), (lambda d: d["secondary"].update(reviewedAt="2024-01-01T00:00:00Z"), "not after the first"),
    ],
)
def test_decisions(spark, change, reason):
    d = json.loads(json.dumps(DECISION))
    change(d)
    got = spark.createDataFrame([(json.dumps(d),)], "d string").select(review.decision_reason(F.col("d"), F.lit(True)).alias("r")).first().r
    assert (got is None) if reason is None else (got and reason in got), got


def test_consensus_and_counts(spark):
    rows = [("x", "primary", "approved", "a"), ("x", "secondary", "approved", "b"), ("y", "primary", "approved", "a"), ("y", "secondary", "rejected", "b"), ("z", "primary", "approved", "a")]
    df = spark.createDataFrame(rows, "item string, role string, verdict string, reviewer string")
    assert {tuple(r) for r in review.escalated(df).collect()} == {("x", "approved"), ("y", "escalated"), ("z", "escalated")}
    blank = review.pivoted(df, spark.createDataFrame([("x",)], "item string"))
    got = {r.item: r.s for r in blank.select("item", review.consensus(F.col("primary"), F.col("secondary"), F.lit(True)).alias("s")).collect()}
    assert got == {"x": "pending", "y": "pending", "z": "pending"}
    c = {r.role: (r.approved, r.rejected, r.pending, r.reviewers) for r in review.verdict_counts(df, "role").collect()}
    assert c == {"primary": (3, 0, 0, ["a"]), "secondary": (1, 1, 0, ["b"])}
    p = review.pending(spark.createDataFrame([("t", "x")], "trace_id string, trace string"), ["c1"]).first()
    assert p.verdict == "pending" and p.criteria == {"c1": None} and len(p.trace_sha256) == 64
    s = spark.range(1).select(review.trace_review(F.lit("approved"), F.lit("a"), F.lit("b"), F.lit("t"), F.lit(None).cast("string")).alias("r"), review.trace_review(F.lit("pending"), F.lit("a"), F.lit("b"), F.lit("t"), F.lit("n")).alias("q")).first()
    assert s.r.reviewer == "a+b" and s.r.notes == "" and s.q.reviewer == "" and s.q.reviewedAt is None


def test_ledger(spark):
    row = [(Decimal("10"), Decimal("5"), Decimal("15"), Decimal("40"))]
    df = spark.createDataFrame(row, "posted decimal(38,22), outstanding decimal(38,22), committed decimal(38,22), authorized decimal(38,22)")
    got = ledger.settle(df, "4.2127440000000000000001", "5").first()
    assert (got.posted, got.outstanding, got.committed) == (Decimal("14.2127440000000000000001"), 0, Decimal("14.2127440000000000000001"))
    with pytest.raises(Exception, match="exceeds its reservation"):
        ledger.settle(df, "5.1", "5").collect()
    with pytest.raises(Exception, match="not what is committed"):
        ledger.settle(df.withColumn("committed", F.lit(14).cast("decimal(38,22)")), "1", "5").collect()
    b = spark.createDataFrame([("a", 1)], "k string, v int")
    assert ledger.append_bucket(ledger.append_bucket(b, b, "k"), b.withColumn("k", F.lit("b")), "k").count() == 2
    spend = spark.createDataFrame([(i, Decimal("0.10")) for i in range(1000)], "o long, amount decimal(18,2)")
    assert ledger.running_cap(spend, "o", "amount", "50").first().o == 500 and ledger.running_cap(spend, "o", "amount", "1000").count() == 0
    t = evidence.plan_totals(spark.createDataFrame([(1, 2, "0.1"), (3, 4, "0.2")], "bytes int, tokens int, worst_cost string"), "0.3").first()
    assert t.within and t.worst == Decimal("0.3")


def test_endpoints_requests_and_replays(spark):
    listing = {"name": "Lab | Model x | Provider (fp8)", "provider_name": "Provider", "pricing": {"prompt": "0.0000012", "completion": "bad"}, "supported_parameters": ["seed", "tools", "top_k"]}
    e = spark.createDataFrame([(json.dumps(listing),)], "l string").select(evidence.endpoint(F.col("l"), ["tools", "seed", "x"]).alias("e")).first().e
    assert e.name == "Provider (fp8)" and e.prompt_price == Decimal("0.0000012") and e.completion_price is None and e.parameters == ["seed", "tools"]
    d = spark.range(1).select(evidence.request_document(F.lit("m"), F.lit('say "x"'), F.lit("p\n"), 10, "low").alias("d")).first().d
    assert json.loads(d)["messages"][0] == {"role": "system", "content": 'say "x"'} and json.dumps(json.loads(d), sort_keys=True, separators=(",", ":")) == d
    a = spark.createDataFrame([("m", 1, 0.5), ("n", 1, 0.5)], "k string, n int, r double")
    got = evidence.replay_differences(a, a.withColumn("n", F.when(F.col("k") == "m", 2).otherwise(1)), "k").collect()
    assert [tuple(r) for r in got] == [("m", "n", "1", "2")]


def test_rules_and_leakage(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "k int, v int")
    rs = [Rule("null", F.col("v").isNotNull()), Rule("negative", F.col("v") >= 0)]
    assert {tuple(r) for r in rules.violations(df, rs, "k").collect()} == {(2, "null"), (3, "negative")}
    with pytest.raises(RuleError, match="2: null"):
        rules.strict(df, rs, "k")
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "c d"), (3, None), (4, "x")], "d int, text string")
    deny = spark.createDataFrame([(1, "b c d e f"), (2, "d"), (3, None), (4, "q r s t u v")], "i int, text string")
    assert {tuple(r) for r in leakage.containing(docs, deny, "d", "i").collect()} == {(1, 1), (1, 2), (2, 2)}
    leaves = spark.createDataFrame([(1, "Some Long  Text", True), (2, "exact value here", True), (3, "exact value here", False), (4, "no", True)], "row int, value string, protected boolean")
    exact = leaves.where("row = 2").select(F.sha2("value", 256).alias("digest"))
    norm = spark.range(1).select(F.sha2(F.lit("some long text"), 256).alias("digest"))
    assert {(r.row, r.how) for r in leakage.denied_leaves(leaves, exact, norm, 5).collect()} == {(1, "normalized"), (2, "exact")}


def test_calls_meet_results(spark):
    calls = spark.createDataFrame([("t", "a", 1), ("t", "b", 3), ("t", "c", 5), ("t", "c", 7)], "conv string, call string, position int")
    results = spark.createDataFrame([("t", "a", 2), ("t", "b", 2), ("t", "d", 4)], "conv string, call string, position int")
    got = {r.call: r.state for r in turns.call_results(calls, results, "conv", "call", "position").collect()}
    assert got == {"a": "paired", "b": "early", "c": "repeated", "d": "orphan"}


def test_json_types(spark):
    df = spark.createDataFrame([('{"a":true}',), ('{"a":"5"}',), ('{"a":5}',), ('{"a":5.5}',), ('{"a":1,"a":2}',), (None,)], "j string")
    got = df.select(jsonx.integer(jsonx.variant(F.col("j")), "$.a").alias("i"), jsonx.closed(F.col("j"), ["a"]).alias("c")).collect()
    assert [r.i for r in got] == [None, None, 5, None, None, None]
    assert [r.c for r in got][:4] == [True] * 4 and got[5].c is False
    assert df.limit(3).select(jsonx.canonical_bytes(F.col("j")).alias("x")).first().x == '{"a":true}'
