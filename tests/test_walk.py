"""The walk of JSON values against plain Python, deep records and records within strings among them."""

import json
import random

from pyspark.sql import functions as F

from millrace.functions import jsonx
from millrace.operators import walk


def value(rnd, depth):
    pick = rnd.random()
    if depth == 0 or pick < 0.3:
        return rnd.choice(["x", "", 5, 1.5, True, None, "[1", "ü", json.dumps({"k": ["in", {"safe": "s"}]}), json.dumps(["a", json.dumps({"k": "deeper"})])])
    if pick < 0.6:
        return [value(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    return {rnd.choice(["k", "safe", "name", "z"]): value(rnd, depth - 1) for _ in range(3)}


def test_leaves_and_counts(spark):
    rnd = random.Random(3)
    deep = "end"
    for i in range(50):
        deep = {"k": deep} if i % 2 else [deep]
    values = [value(rnd, 5) for _ in range(120)] + [deep, {}, [], "text", {"a": {"safe": {"b": ["c", '["d"]']}}}]
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)] + [(900, None), (901, "no json"), (902, '{"k": 1, "k": 2}'), (None, '{"k": "v"}'), (7, '{"k": ["again"]}')]
    df = spark.createDataFrame(rows, "i int, r string").withColumn("v", F.lit(1)).withColumn("path", F.lit("p")).repartition(3)
    want = []
    for i, r in rows:
        if r and i not in (901, 902):
            want += [(i, *x) for x in jsonx.leaves(json.loads(r), frozenset(["safe"])) if x[0] != "$" and not x[0].startswith("$~")]
    got = [tuple(r) for r in walk.leaves(df, "i", "r", ["safe"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    counts = {r["r"]: r["n"] for r in df.where("i < 900 AND r IS NOT NULL AND i <> 7").select("r", jsonx.count_keys(F.col("r"), ["k", "z"]).alias("n")).collect() if r["n"]}
    told = walk.name_counts(df.where("i < 900 AND i <> 7"), "i", "r", ["k", "z"]).join(df.select(F.col("i").alias("id"), "r"), "id")
    assert {r["r"]: r["n"] for r in told.dropDuplicates(["r"]).collect()} == counts
    assert walk.nodes(df.where("false"), "i", "r").count() == 0 == walk.nodes(df.where("i = 901"), "i", "r").count()
