"""Numbering, running sums, containment, folding and deep JSON: against plain Python."""

import hashlib
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions import fingerprints, jsonx
from millrace.functions import text as T
from millrace.operators import leakage, ledger, scoring
from millrace.sources.tables import numbered


def test_rows_are_numbered_in_their_order(spark):
    rnd = random.Random(1)
    values = [rnd.choice([None, 1, 2, 2, 2, rnd.randrange(1000)]) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").repartition(7)
    got = [r.v for r in numbered(df, "n", "v", "i").orderBy("n").collect()]
    assert got == sorted(values, key=lambda v: (v is not None, v or 0))
    assert sorted(r.n for r in numbered(df, "n", "v", "i").collect()) == list(range(1, 501))
    assert [r.i for r in numbered(df, "n", F.col("i").desc()).orderBy("n").collect()] == list(range(499, -1, -1))
    assert numbered(df.where("false"), "n", "v").count() == 0


def test_a_cap_is_passed_at_one_row(spark):
    rows = [(i, f"{(i * 37) % 11}.01") for i in range(300)]
    df = spark.createDataFrame(rows, "i long, a string").withColumn("a", F.col("a").cast("decimal(18,2)")).repartition(5)
    for cap in ("0", "99.5", "800.37", "1e9"):
        total, want = 0, []
        for i, a in rows:
            total += round(float(a) * 100)
            if total > float(cap) * 100:
                want = [(i, total)]
                break
        assert [(r.i, round(float(r.running) * 100)) for r in ledger.running_cap(df, "i", "a", f"{float(cap):.2f}").collect()] == want


def test_the_log_of_a_case(spark):
    cases = spark.createDataFrame([(i, i % 4) for i in range(40)], "c long, calls int").repartition(6)
    log = spark.createDataFrame([(p, f"r{p}") for p in range(1, 55)], "position long, said string")
    want, at = [], 0
    for i in range(40):
        for k in range(1, i % 4 + 1):
            at += 1
            want.append((i, k, at, f"r{at}" if at < 55 else None))
    got = scoring.consumed(cases, log, "c", "calls", "position").select("c", "call_number", "position", "said").collect()
    assert sorted(map(tuple, got), key=lambda x: x[2]) == want


@pytest.mark.parametrize("automaton", [leakage.AUTOMATON_BYTES, 0])
def test_containment_of_long_and_short_items(spark, automaton):
    rnd = random.Random(3)
    words = ["ab", "abc", "é", "日本", "x", "", "cat", "concatenate", "\U0001f600"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(40)))) for i in range(60)] + [(60, None), (61, "")]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 9)))) for i in range(60)] + [(70, "cat"), (71, "t c"), (72, "a"), (73, None), (74, ""), (75, "concatenate x"), (76, "\U0001f600"), (77, docs[3][1]), (78, docs[4][1][1:-1])]
    items += [(i + 100, x) for i, x in items[:3]]  # the same text twice
    want = {(i, j) for i, t in docs for j, x in items if t is not None and x and x in t}
    found = leakage.containing(spark.createDataFrame(docs + docs[:2], "d int, text string"), spark.createDataFrame(items, "i int, text string"), "d", "i", automaton=automaton)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert leakage.containing(spark.createDataFrame(docs, "d int, text string"), spark.createDataFrame([], "i int, text string"), "d", "i").count() == 0


def test_case_is_folded(spark):
    letters = [chr(c) for c in range(1, 0x2FFFF) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(x,) for x in letters], "x string").select("x", T.casefold(F.col("x")).alias("y"), T.fold(F.col("x")).alias("z"))
    rows = df.collect()
    assert all(r.y == r.x.casefold() for r in rows)
    cherokee = {chr(c) for c in (*range(0x13A0, 0x13FE), *range(0xAB70, 0xABC0))}
    assert all(r.x == "\u0131" or r.x in cherokee or unicodedata.category(r.x) == "Cn" for r in rows if r.z != r.x.casefold())
    leaves = spark.createDataFrame([("r", "  STRASSE  nach Rom", True)], "row string, value string, protected boolean")
    digest = spark.createDataFrame([(hashlib.sha256("straße nach rom".casefold().encode()).hexdigest(),)], "digest string")
    assert [r.how for r in leakage.denied_leaves(leaves, digest.where("false"), digest, 4).collect()] == ["normalized"]


def test_tool_digests_keep_numbers(spark):
    tools = [{"Name": "n", "Description": "ü", "Parameters": {"b": 1.0, "a": {"z": 1e3, "y": 6}}}]
    text = '[{"Name":"n","Description":"ü","Parameters":{"a":{"y":6,"z":1000.0},"b":1.0}}]'
    df = spark.createDataFrame([(json.dumps(tools),), ("{",), ("[1]",), (None,)], "t string")
    assert [r.d for r in df.select(fingerprints.tool_schema_digest(F.col("t")).alias("d")).collect()] == [hashlib.sha256(text.encode()).hexdigest(), None, None, None]


def test_json_nested_too_deep(spark):
    df = spark.createDataFrame([("[" * 100_000 + "]" * 100_000,), ('{"k":1}',), ("{",), (None,)], "j string")
    got = df.select(jsonx.canonical_bytes(F.col("j")).alias("c"), F.size(jsonx.json_leaves(F.col("j"), ["k"])).alias("l"), jsonx.masked(F.col("j"), ["k"], "#").alias("m"), jsonx.count_keys(F.col("j"), ["k"]).alias("n")).collect()
    assert [tuple(r) for r in got] == [(None, 0, None, 0), ('{"k":1}', 0, '{"k":"#"}', 1), (None, 0, None, 0), (None, 0, None, 0)]
