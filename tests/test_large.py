"""What keeps queries over many rows within their time: records parsed once, rows dealt over all cores, pieces told together."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import jsonx
from millrace.operators import arguments, behaviors, cases, review
from millrace.plans import planted
from millrace.sources import archives

T = ["axis"]
RULES = {
    "behaviour_traces": lambda t: behaviors.trace_reason(behaviors.trace_parts(t)),
    "entity_routes": lambda t: behaviors.entity_trace_reason(behaviors.trace_parts(t)),
    "behaviour_cases": behaviors.case_reason,
    "current_traces": lambda t: behaviors.current_trace_reason(t, T, "p"),
    "approved_traces": lambda t: behaviors.approved_trace_reason(t, T, "p"),
    "current_cases": lambda t: behaviors.current_case_reason(t, T),
    "proposals": lambda t: arguments.proposal_valid(jsonx.variant(t)),
    "dated_proposals": lambda t: arguments.dated_proposal_valid(jsonx.variant(t)),
    "review_decisions": lambda t: review.decision_reason(t, F.lit(True)),
    "search_rules": arguments.search_reason,
    "dated_searches": arguments.dated_search_reason,
    "tool_payloads": lambda t: cases.payload_state(t)["problem"],
}


@pytest.mark.parametrize("name", RULES)
def test_records_are_parsed_once(spark, name):
    assert str(RULES[name](F.col("record_text"))).count("try_parse_json(record_text)") == 1


def test_rows_are_dealt_over_cores(spark, tmp_path):
    spark.range(50).toDF("c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    rows = planted.QUERIES["proposals"](spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString()
    assert sum(r.n for r in rows.collect()) == 50


def test_reasons_of_many_searches(spark):
    """Compiled or within a lambda, the rules say the same; a key twice and no JSON too."""
    texts = ['{"query":"a"}', '{"query":"a","query":"b"}', "{", None, "[]", "{}", '{"genres":["a"],"era":"80s"}', '{"genres":{"a":1}}', '{"network":"n","cast":["a"]}', '{"cast":["a","A "],"media_type":"movie"}', '{"runtime_min":"5"}', '{"query":null}', '{"keywords":null}']
    rows = spark.createDataFrame([(t,) for t in texts], "asked string")
    got = arguments.search_reasons(rows, "asked").withColumn("other", arguments.search_reason(F.col("asked"))).collect()
    assert [r.reason for r in got] == [r.other for r in got]
    assert got[1].reason == "the title is blank" and got[7].reason == "genres is not of its kind" and got[12].reason == "keywords is not of its kind"


def test_small_pieces_come_together():
    frames = list(archives._frames(("a", i, "m", 0, b"x") for i in range(2500)))
    assert [len(f) for f in frames] == [1000, 1000, 500] and [n for f in frames for n in f["nth"]] == list(range(2500))
    large = list(archives._frames(("a", i, "m", 0, bytes(archives.PIECE)) for i in range(3)))
    assert [len(f) for f in large] == [1, 1, 1]
