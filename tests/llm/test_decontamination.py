import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination as d

from millrace.llm.common import bounded_bytes
from tests import parity

from .fixtures import documents, frame, prose


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def sets(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items, threshold=0.8):
    out = []
    for i, t in docs:
        for j, q in items:
            n = min(5, len(words(q)))
            if n and (want := sets(q, n)) and len(want & sets(t, n)) >= threshold * len(want) - 1e-9:
                out.append((str(i), str(j), len(want), len(want & sets(t, n))))
    return sorted(out)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


passage = prose(30, 77)
ITEMS = [(1, passage), (2, prose(12, 5)), (3, "one two"), (4, None), (5, ""), (6, "?!"), (7, passage), (7, passage), (8, "zebra"), (None, prose(9, 3)), (9, "A b, c"), (10, "a b c d"), (11, prose(9000, 9))]
edited = passage.split()
edited[3] = "changed"
half = passage.split()[:18]
DOCS = [
    *[(i, t) for i, t, *_ in documents()], (20, f"{prose(500, 8)} {passage.upper()}! {prose(4000, 9)}"), (21, prose(50, 6) + " " + " ".join(edited)), (22, " ".join(half) + " " + prose(90, 6)), (23, "One, two."), (20, passage), (24, passage.replace(" ", "\n")),
    (26, "x a b c y"), (27, "b a b c d"), (28, prose(8000, 9)), (29, "w " + prose(7000, 9)),
    (25, " ".join(passage.split()[:20]) + " split " + " ".join(passage.split()[20:])),
]


@pytest.mark.parametrize("rows", [10**6, 0])
def test_contract(spark, monkeypatch, rows):
    monkeypatch.setattr(d, "bounded", lambda df: F.broadcast(df) if rows else df)  # either way to join
    monkeypatch.setattr(d, "bounded_bytes", lambda df, size: F.broadcast(df) if rows else df)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("_row", F.lit("x"))
    got = d.contained(docs, items(spark, ITEMS))
    assert sorted((str(r["doc_id"]), str(r["item_id"]), r["n_shingles"], r["n_shared"]) for r in got.collect()) == brute(DOCS, ITEMS)


def test_sql_finds_short_items(spark, tmp_path):
    short = lambda rows: [(i, t) for i, t in rows if i is not None and len(t or "") < 20_000]
    spark.createDataFrame(short(DOCS), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items(spark, short(ITEMS)).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert parity.compare(d.op4_decontamination(spark, str(tmp_path)), parity.views(str(tmp_path)), d.ORACLE) > 5


def test_items_are_broadcast_by_their_bytes(spark):
    df = spark.createDataFrame([("a" * 100,)] * 5, "x string")
    of = lambda most: "ResolvedHint" in bounded_bytes(df, F.octet_length("x"), most)._jdf.queryExecution().analyzed().toString()
    assert of(500) and not of(499) and bounded_bytes(df.where("false"), F.octet_length("x"), 0).count() == 0


def test_clean(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("row", F.lit(1))
    rows = d.clean(docs, items(spark, ITEMS))
    assert rows.columns == docs.columns
    dirty = {(a, t) for a, t in DOCS if brute([(a, t)], ITEMS)}
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in rows.collect()))) == sorted(str(x) for x in DOCS if x not in dirty)


def test_empty_tables(spark):
    assert d.contained(frame(spark), items(spark, [])).count() == 0
    assert d.contained(frame(spark), items(spark, [(1, ""), (2, None)])).count() == 0
    assert d.contained(frame(spark, []), items(spark, ITEMS)).count() == 0
    assert d.clean(frame(spark), items(spark, [])).count() == len(documents())


def test_sketch_sizes(spark):
    for r in d.sketches(items(spark, ITEMS)).collect():
        assert len(r["sketch"]) == r["size"] - r["needed"] + 1 and 2 ** r["class"] <= r["size"] < 2 ** (r["class"] + 1)
