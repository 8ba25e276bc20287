"""Evidence, cases, fingerprints and promotion against rows that break one rule each."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import fingerprints
from millrace.operators import cases, evidence
from millrace.operators.rules import RuleError
from millrace.sources import generate

REPLY = {"id": "g1", "model": "m", "choices": [{"finish_reason": "stop", "message": {"content": json.dumps({"reviews": [{"traceId": "a"}, {"traceId": "b"}]})}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2, "total_tokens": 7, "cost": 0.25}}


def changed(base, f):
    x = json.loads(json.dumps(base))
    f(x)
    return json.dumps(x)


def test_completions(spark):
    rows = [
        (changed(REPLY, lambda x: None), "ok", None), (changed(REPLY, lambda x: x.update(model="n")), "aborted", "another model than asked for"), (changed(REPLY, lambda x: x.pop("id")), "aborted", "no generation id"), (changed(REPLY, lambda x: x.update(choices=[])), "aborted", "not exactly one choice"),
        (changed(REPLY, lambda x: x["usage"].update(total_tokens=6)), "aborted", "the usage does not add up to its total"), (changed(REPLY, lambda x: x["usage"].update(cost="1")), "aborted", "invalid cost"), (changed(REPLY, lambda x: x["choices"][0].update(finish_reason="length")), "quarantined", "did not stop by itself"),
        (changed(REPLY, lambda x: x["choices"][0]["message"].update(content="{")), "quarantined", "content is not JSON"), (changed(REPLY, lambda x: x["choices"][0]["message"].update(content='{"reviews":[{"traceId":"b"},{"traceId":"a"}]}')), "quarantined", "reviews are not those asked for"),
    ]
    df = spark.createDataFrame([(i, r, "m", "p", ["a", "b"]) for i, (r, _, _) in enumerate(rows)], "i int, response string, model string, provider string, ids array<string>")
    got = evidence.completions(df, "response", "model", "provider", "ids").orderBy("i").collect()
    assert [(r.state, r.reason) for r in got] == [(s, w) for _, s, w in rows]


def test_settlements_and_bills(spark):
    s = "id string, provider string, model string, finish string, cost string"
    calls = spark.createDataFrame([("a", "p", "m", "stop", "0.10"), ("b", "p", "m", "stop", "0.1"), ("c", "p", "m", "stop", "1"), ("d", "p", "m", "stop", "1")], s)
    done = spark.createDataFrame([("a", "p", "m", "stop", "0.1"), ("b", "p", "m", "stop", "0.1000000000000000000001"), ("c", "q", "m", "stop", "1")], s)
    assert {(r.id, r.problem) for r in evidence.settlement_problems(calls, done).collect()} == {("b", "cost does not reconcile"), ("c", "provider differs"), ("d", "not settled")}
    rows = [(1, "01:00", "02:00", "0.49", "0.01", "0.50"), (2, "02:00", "01:00", "0.49", "0.01", "0.50"), (3, "01:00", "02:00", "0.60", "0.01", "0.61"), (4, "01:00", "02:00", "0.49", "0.02", "0.50"), (5, "01:00", "02:00", "0.49", "9", "9.49")]
    df = spark.createDataFrame(rows, "i int, c string, d string, gpu string, disk string, total string")
    t = lambda c: F.concat(F.lit("2024-01-01 "), c, F.lit(":00")).cast("timestamp")
    m = lambda c: F.col(c).cast("decimal(20,10)")
    why = evidence.billing_reason(t(F.lit("00:00")), t(F.col("c")), t(F.col("d")), t(F.lit("03:00")), t(F.lit("04:00")), [m("gpu"), m("disk")], m("total"), m("gpu"), "0.49", F.lit("1").cast("decimal(4,2)"), "0.0000000000000001", 7200)
    assert [r.w for r in df.select("i", why.alias("w")).orderBy("i").collect()] == [None, "times are out of order", "GPU charge is not rate times hours", "components do not add up to the total", "total exceeds its reservation"]


def test_capacity_redaction_divergence(spark):
    df = spark.createDataFrame([("a", 1, 50), ("a", 2, 95), ("b", 1, 99)], "case_id string, stage int, tokens int")
    assert tuple(evidence.capacity(df, "case_id", "stage", "tokens", 100, 6).first()) == (2, 3, 99, 1, "a", 2)
    assert tuple(evidence.capacity(df, "case_id", "stage", "tokens", 100, 1).first())[4:] == (None, None)
    results = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("d", 0)], "case_id string, model_calls int")
    made = spark.createDataFrame([("a", None, "0" * 64), ("b", None, "0" * 64), ("c", "text", "0" * 64)], "case_id string, raw string, raw_sha256 string")
    assert {(r.case_id, r.problem) for r in evidence.redaction_problems(results, made).collect()} == {("b", "generations are not the model calls"), ("c", "raw text is still there")}
    got = evidence.first_divergence(df, {"high": F.col("tokens") > 90, "any": F.col("tokens") > 60}, "tokens").collect()
    assert {(r.tokens, r["class"]) for r in got} == {(50, "other"), (95, "high"), (99, "high")}


def test_contracts(spark):
    tools = [{"Name": "catalog_search", "Description": "d", "Parameters": {"b": 1, "a": {"z": 1, "y": 2}}}]
    text = '[{"Name":"catalog_search","Description":"d","Parameters":{"a":{"y":2,"z":1},"b":1}}]'
    bundle = {"systemPrompt": "p", "systemPromptSha256": hashlib.sha256(b"p").hexdigest(), "tools": tools, "toolSchemaSha256": hashlib.sha256(text.encode()).hexdigest()}
    rows = [changed(bundle, lambda x: None), changed(bundle, lambda x: x.update(more=1)), changed(bundle, lambda x: x.update(systemPrompt="q")), changed(bundle, lambda x: x["tools"][0].update(Description="e"))]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, b string")
    got = [r.w for r in df.select("i", evidence.contract_reason(F.col("b"), list(bundle)).alias("w")).orderBy("i").collect()]
    assert got == [None, "the contract has other fields", "system prompt digest differs", "tool schema digest differs"]
    a = spark.createDataFrame([(1, "x", None), (2, "y", "v")], "k int, p string, q string")
    assert {tuple(r) for r in evidence.identity_problems(a, {"p": "x", "q": "v"}, "k").collect()} == {(1, "q"), (2, "p")}


def test_relabelled_copies_collide(spark):
    trace = generate.traces(generate.cases(spark, 1)).where("trace_id LIKE '%genre-discovery%'").first().trace
    moved = trace.replace("1001", "6001")
    other = trace.replace("western", "noir")
    df = spark.createDataFrame([(1, trace), (2, moved), (3, other), (4, None), (5, "{")], "i int, t string")
    rows = df.select("i", fingerprints.semantic_digest(F.col("t")).alias("d"), fingerprints.semantic_digest(F.col("t"), False).alias("a"), fingerprints.identities(F.col("t")).alias("x")).orderBy("i").collect()
    assert rows[0].d != rows[1].d  # titles within results still tell them apart
    assert rows[0].a == rows[1].a != rows[2].a
    assert len(rows[0].x) == 4 and not set(rows[0].x) & set(rows[1].x)


CASE = {
    "schemaVersion": 1, "caseId": "case-01", "split": "development-eval", "axis": "a", "contract": {}, "intent": "A synthetic intent", "repairPrompt": None, "provenance": {},
    "script": [{"arguments": {"genres": ["x"]}, "result": {"candidates": [{"mediaType": "movie", "tmdbId": 1, "name": "n"}, {"mediaType": "movie", "tmdbId": 2, "name": "m"}]}}],
    "expectation": {"selectedIds": [{"mediaType": "movie", "tmdbId": 1}], "forbiddenIds": [{"mediaType": "movie", "tmdbId": 2}], "expectedPolicy": {}, "abstain": False, "maxToolCalls": 1},
}


@pytest.mark.parametrize(
    "change, reason",
    [
        (lambda c: None, None), (lambda c: c.update(extra=1), "the case has other fields"), (lambda c: c.update(caseId="X"), "the case's id is not of its form"), (lambda c: c.update(axis="z"), "another split"), (lambda c: c.update(intent=" "), "a blank intent"), (lambda c: c.update(script=[]), "1 to 2 steps"),
        (lambda c: c["script"][0]["arguments"].update(query="x"), "a step's search is refused"), (lambda c: c["script"][0]["arguments"].update(keywords=["x"]), "several selectors"), (lambda c: c["script"][0]["result"].update(more=1), "a step's result has other fields"),
        (lambda c: c["script"][0]["result"]["candidates"][0].update(tmdbId=2), "a candidate is scripted twice"), (lambda c: c["script"][0]["result"]["candidates"][0].update(tmdbId=-1), "a step's candidate has no identity"), (lambda c: c["expectation"].pop("abstain"), "the expectation has other fields"),
        (lambda c: c["expectation"].update(forbiddenIds=c["expectation"]["selectedIds"]), "wanted and forbidden"), (lambda c: c["expectation"]["selectedIds"][0].update(tmdbId=9), "no step returns"), (lambda c: c["expectation"].update(abstain=True), "abstention"), (lambda c: c["expectation"].update(maxToolCalls=2), "calls allowed"),
    ],
)
def test_cases(spark, change, reason):
    got = spark.createDataFrame([(changed(CASE, change),)], "c string").select(cases.case_reason(F.col("c"), ["a"]).alias("r")).first().r
    assert (got is None) if reason is None else (got and reason in got), got


def test_synthetic_payload_accept(spark):
    one = lambda f, *values: spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x
    assert one(cases.synthetic_reason, json.dumps(CASE)) is None
    assert "household" in one(cases.synthetic_reason, changed(CASE, lambda c: c.update(intent="synthetic me@x")))
    assert "synthetic" in one(cases.synthetic_reason, changed(CASE, lambda c: c.update(intent="mine")))
    key = '[{"mediaType":"movie","key":"movie:tmdb:1","name":"n"}]'
    assert one(cases.payload_state, key).keys == ["movie:tmdb:1"]
    assert one(cases.payload_state, key.replace(":tmdb:", "-"))["problem"] == "a candidate without key, name or kind"
    fault = one(cases.payload_state, '{"error":"x","fault":{"injected":true,"observed":true}}')
    assert fault.injected and fault.observed and fault["problem"] is None
    rule = json.dumps({"fields": {"genres": {"match": "containsAll", "value": ["Noir"], "required": True}, "keywords": {"match": "tokens", "value": "space opera", "required": False}}, "allowed": ["media_type"], "requireAny": []})
    for args, holds in [({"genres": ["noir", "x"]}, True), ({"genres": ["x"]}, False), ({"genres": ["noir"], "keywords": ["space operas"]}, True), ({"genres": ["noir"], "keywords": ["opera"]}, False), ({"genres": ["noir"], "era": "80s"}, False), ({"genres": ["noir"], "media_type": "movie"}, True), ({"keywords": ["space opera"]}, False)]:
        assert one(cases.step_accepts, rule, json.dumps(args)) is holds, args


def test_promotion(spark):
    drafts = spark.createDataFrame([("a", "x"), ("b", "y")], "trace_id string, trace string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s = "trace_id string, trace_sha256 string, draft_author string, reviewer string, verdict string, criteria array<boolean>"
    good = [("a", sha("x"), "w", "r", "approved", [True]), ("b", sha("y"), "w", "r", "approved", [True])]
    assert cases.promotable(drafts, spark.createDataFrame(good, s)).count() == 2
    for bad, why in [(good[:1], "no decision"), ([good[0], (*good[1][:2], "r", *good[1][3:])], "wrote the draft"), ([good[0], ("b", sha("z"), *good[1][2:])], "digest differs"), ([good[0], (*good[1][:5], [False])], "criterion"), ([*good, ("c", *good[0][1:])], "no draft")]:
        with pytest.raises(RuleError, match=why):
            cases.promotable(drafts, spark.createDataFrame(bad, s))
