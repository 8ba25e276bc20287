"""Cases and traces that the generators make: the perfect model scores 1.0, each saboteur trips what it should."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import replay, scoring, traces
from millrace.sources import generate


@pytest.fixture(scope="module")
def cases(spark):
    return generate.cases(spark, 2).cache()


def summed(scored):
    flags = ["grounded", "correct_operation", "arguments_valid", "schema_valid", "policy_accuracy", "proposal_quality", "recovery_successful"]
    rows = scored.withColumn("failures", F.size("hard_failures")).withColumn("model", F.lit("m"))
    return scoring.summary(rows, "model", flags, ["failures", "unsupported", "authority"], "latency", {"recovery_successful": "recovery_expected"}).first().asDict()


def test_perfect(cases):
    s = summed(replay.score(cases, generate.perfect_log(cases)))
    assert s["n"] == 20 and s["failures"] == 0
    assert all(v == 1.0 for k, v in s.items() if k.endswith("_rate"))


def sabotaged(log, change):
    """The log with each case's final proposal changed."""
    rows = []
    for r in log.collect():
        turn = json.loads(r.turn)
        if "content" in turn:
            final = json.loads(turn["content"])
            change(final)
            turn["content"] = json.dumps(final)
        rows.append((r.case_id, r.call_number, json.dumps(turn), r.latency))
    return log.sparkSession.createDataFrame(rows, replay.LOG)


@pytest.mark.parametrize(
    "change, failure",
    [
        (lambda f: f.pop("rationale"), "schema_invalid"),
        (lambda f: [p.update(tmdbId=999999) for p in f["picks"][:1]], "unsupported_id"),
        (lambda f: f["policy"].update(approved=True), "authority_violation"),
        (lambda f: [p.update(confidence=True) for p in f["picks"]], "schema_invalid"),
    ],
)
def test_saboteurs(cases, change, failure):
    with_picks = cases.where("NOT abstain")
    scored = replay.score(with_picks, sabotaged(generate.perfect_log(with_picks), change)).collect()
    assert all(failure in r.hard_failures for r in scored)


def test_wrong_search_and_missing_turns(cases):
    one = cases.where("case_id = 'case-title-lookup-00'")
    wrong = generate.perfect_log(one).withColumn("turn", F.regexp_replace("turn", "Title 0", "Title 7"))
    r = replay.score(one, wrong).first()
    assert not r.correct_operation and r.arguments_valid and "unsupported_id" in r.hard_failures and "grounding_bypass" in r.hard_failures
    r = replay.score(one, wrong.where("false")).first()
    assert r.model_calls == 0 and r.hard_failures == ["schema_invalid"]
    bad = generate.perfect_log(one).withColumn("turn", F.replace("turn", F.lit('{"query"'), F.lit('{"tmdb":1,"query"')))
    assert not replay.score(one, bad).first().arguments_valid
    equal = generate.perfect_log(cases.where("axis = 'runtime-bounds'")).withColumn("turn", F.regexp_replace("turn", r'"runtime_max":(\d+)', '"runtime_max":$1.0'))
    assert replay.played(cases.where("axis = 'runtime-bounds'"), equal, valid=lambda a: F.lit(True)).first().step == 1  # 90.0 is 90


MUTATIONS = [
    (lambda t: t["messages"].pop(), "the end is no JSON of the assistant"),
    (lambda t: t["messages"].pop(0), "first message differs"),
    (lambda t: t["messages"][1].update(role="assistant", content=""), "no intent in second place"),
    (lambda t: t["messages"].pop(3), "left unanswered"),
    (lambda t: t["messages"].insert(3, t["messages"][2]), "a call's id is taken"),
    (lambda t: t["messages"].insert(2, t["messages"][3]), "answers no open call"),
    (lambda t: t["messages"][2]["toolCalls"][0]["arguments"].update(genres=["x"]), "title query mixed"),
    (lambda t: t["messages"][2]["toolCalls"][0].update(arguments={}), "not the arguments of a search"),
    (lambda t: t["messages"][2].update(extra=1), "a turn of calls with other fields"),
    (lambda t: t["messages"][3].update(content={"other": 1}), "a result of no known form"),
    (lambda t: t["messages"][3]["content"]["candidates"][0].update(tmdbId="5"), "a candidate without identity"),
    (lambda t: t["messages"][-1].update(content="words"), "the end is no JSON of the assistant"),
    (lambda t: t["messages"][-1].update(content=t["messages"][-1]["content"].replace('"picks":[', '"other":[')), "lacks picks"),
    (lambda t: t["messages"][-1].update(content=t["messages"][-1]["content"].replace("10000", "999999")), "unsupported selected id"),
    (lambda t: t["messages"][-1].update(content=t["messages"][-1]["content"].replace("Title 10000", "Title X")), "goes by another name"),
    (lambda t: t["messages"][-1].update(content=t["messages"][-1]["content"].replace("0.5", "1.5")), "a confidence outside 0 to 1"),
]


def test_traces_and_mutations(spark, cases):
    every = generate.traces(cases)
    assert [r for r in traces.first_problems(every, generate.PROMPT).collect() if r.reason] == []
    base = every.where("trace_id = 'planner-case-title-lookup-00'").first().trace
    rows = [("sound", base), ("none", None), ("broken", "{")]
    for i, (change, _) in enumerate(MUTATIONS):
        t = json.loads(base)
        change(t)
        rows.append((f"m{i}", json.dumps(t)))
    found = {r.trace_id: r.reason for r in traces.first_problems(spark.createDataFrame(rows, "trace_id string, trace string"), generate.PROMPT).collect()}
    assert found["sound"] is None and found["none"] == found["broken"] == "fewer than three messages"
    for i, (_, reason) in enumerate(MUTATIONS):
        assert found[f"m{i}"] and reason in found[f"m{i}"], (i, reason, found[f"m{i}"])


def test_records(spark, cases):
    base = generate.traces(cases).first().trace
    changed = [("ok", base), ("key", base.replace('"split"', '"extra":1,"split"')), ("split", base.replace('"train"', '"holdout"')), ("secret", base.replace("A synthetic", "/home/me/ A synthetic")), ("review", base.replace('"pending"', '"approved"'))]
    df = spark.createDataFrame(changed, "k string, trace string").select("k", traces.record_reason(F.col("trace"), ["train"]).alias("reason"))
    found = {r.k: r.reason for r in df.collect()}
    assert found == {"ok": None, "key": "the record has other fields", "split": "the split is not open to records", "secret": "possible secret or private path", "review": "the review's evidence is not that of its status"}


NONE = {"kind": "none", "anchors": [], "axes": []}


def dated(spark, axis="plain", fault=False, change=lambda f: None, meaning=NONE):
    """One case of the later contract with the turns for it."""
    found = json.dumps([{"mediaType": "movie", "key": "movie:tmdb:1", "name": "n"}, {"mediaType": "movie", "key": "movie:tmdb:2", "name": "m"}])
    first = json.dumps({"error": "out", "fault": {"injected": True, "observed": True}})
    args = [{"dateMeaning": NONE, "genres": ["a"]}, {"dateMeaning": NONE, "genres": ["b"]}]
    script = [(json.dumps(a), r) for a, r in (zip(args, [first, found], strict=True) if fault else [(args[0], found)])]
    case = spark.createDataFrame([("c", axis, script, ["movie:tmdb:1"], ["movie:tmdb:2"], "{}", json.dumps(NONE), False)], replay.DATED_CASE)
    final = {"channelName": "A", "rationale": "r", "dateMeaning": NONE, "picks": [{"mediaType": "movie", "key": "movie:tmdb:1"}], "policy": {}}
    change(final)
    asked = [a if i == 0 else {**a, "dateMeaning": meaning} for i, a in enumerate(args[: len(script)])]
    said = [{"role": "assistant", "toolCalls": [{"id": f"k{i}", "name": "catalog_search", "arguments": a}]} for i, a in enumerate(asked)] + [{"role": "assistant", "content": json.dumps(final)}]
    return case, spark.createDataFrame([("c", i, json.dumps(t), 1) for i, t in enumerate(said, 1)], replay.LOG)


def test_dated_cases(spark):
    assert replay.score_dated(*dated(spark)).first().hard_failures == []
    r = replay.score_dated(*dated(spark, replay.FAULT, True)).first()
    assert r.hard_failures == [] and r.injected and r.observed and r.recovery_successful
    assert replay.score_dated(*dated(spark, replay.FAULT)).first().hard_failures == ["recovery_without_observed_fault"]
    assert replay.score_dated(*dated(spark, change=lambda f: f.pop("policy"))).first().hard_failures == ["schema_invalid", "date_meaning_mismatch"]
    assert "unsupported_key" in replay.score_dated(*dated(spark, change=lambda f: f["picks"][0].update(key="movie:tmdb:9"))).first().hard_failures
    assert "authority_violation" in replay.score_dated(*dated(spark, change=lambda f: f["policy"].update(rules=[], approved=1))).first().hard_failures
    other = {"kind": "ambiguous", "anchors": [{"field": "era", "start": 0, "end": 2}], "axes": []}
    r = replay.score_dated(*dated(spark, replay.FAULT, True, meaning=other)).first()
    assert "incorrect_tool_operation" in r.hard_failures


def test_cases_of_many_variants(spark):
    """However many cases an axis has, their searches are such as the rules take."""
    from millrace.operators.arguments import search_reason

    steps = generate.cases(spark, 3000).select(F.explode("script.arguments").alias("a"))
    assert steps.where(search_reason(F.col("a")).isNotNull()).count() == 0
