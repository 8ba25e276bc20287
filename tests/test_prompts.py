import json

from pyspark.sql import functions as F

from millrace.functions import prompts
from millrace.sources import generate


def test_prompts(spark):
    intents = [{"description": " old  films ", "mustInclude": ["a", "b"]}, {}, {"description": 1, "era": "80s"}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(intents)], "i int, x string")
    got = df.select("i", prompts.user_prompt(F.col("x")).alias("p"), prompts.coordinates(F.col("x")).alias("c")).orderBy("i").collect()
    assert [r.p for r in got] == ["Build a channel: old  films\nMust include: a, b", "", "Era: 80s"]
    assert [tuple(s) for s in got[0].c] == [("old", 1, 4), ("films", 6, 11)] and got[1].c == []


def test_templates_and_counts(spark):
    df = spark.createDataFrame([(1, json.dumps([{"role": "user", "content": "hé"}])), (2, "{}"), (3, None)], "i int, x string")
    got = {r.i: (r.t, r.n) for r in df.select("i", prompts.rendered(F.col("x"), lambda m: "".join(f"<{y['role']}>{y['content']}" for y in m)).alias("t")).select("*", prompts.token_count(F.col("t"), lambda ts: [len(t) // 4 for t in ts]).alias("n")).collect()}
    assert got == {1: ("<user>hé", 2), 2: (None, 0), 3: (None, 0)}


def test_protected_payloads(spark):
    t = generate.traces(generate.cases(spark, 1)).limit(1)
    p = json.loads(t.select(prompts.protected_payload(F.col("trace")).alias("p")).first().p)
    assert set(p) == {"messages", "traceId"} and all(m["role"] != "system" for m in p["messages"])
    c = spark.createDataFrame([('{"caseId":"c","intent":"x","axis":"a"}',), ("{}",)], "x string").select(prompts.protected_payload(F.col("x")).alias("p")).collect()
    assert json.loads(c[0].p) == {"caseId": "c", "expectation": None, "intent": "x", "script": None} and c[1].p is None
