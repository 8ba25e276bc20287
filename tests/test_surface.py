"""What is called from SQL gives what the library's columns give."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import jsonx, numbers, surface
from millrace.functions import text as T
from millrace.sources import artifacts

TEXTS = [None, "", " ", "Cats  and\u00a0dogs\n", "sk_abcdefghijklmnop", "AKIA" + "A" * 16, "/home/me/x", "C:\\Users\\me\\x", "a/.env", "bus us gas 12s", "é ß\tx  y", "../x", "/x", "a\\..\\b", "x/y.txt", "2024-02-30T00:00:00Z",
         "2024-02-29T23:59:59.5Z", "2024-02-29T23:59:59+00:00", "1.50", "-1", "1e5", "9" * 40, '{"k":1}', '{"k":1,"k":2}', '{"k":1,"b":2}', "[1]", "op://v", "x" * 100_000]


@pytest.fixture(scope="module")
def rows(spark):
    surface.register(spark)
    df = spark.createDataFrame([(t,) for t in TEXTS + TEXTS[:4]], "t string")
    df.createOrReplaceTempView("surface_texts")
    return df


@pytest.mark.parametrize(
    "name,column",
    [
        ("normalized_text", T.normalize),
        ("text_fingerprint", T.fingerprint),
        ("text_tokens", T.tokens),
        ("has_secret", lambda c: F.coalesce(F.greatest(*T.flags(c, T.SECRETS)), F.lit(False))),
        ("has_private_path", lambda c: F.coalesce(F.greatest(*T.flags(c, T.PRIVATE_PATHS)), F.lit(False))),
        ("utc_time", numbers.utc),
        ("exact_amount", numbers.money),
        ("safe_path", artifacts.safe_name),
    ],
)
def test_functions_of_one_text(spark, rows, name, column):
    mine = rows.select(F.expr(f"{name}(t)").alias("a"), column(F.col("t")).alias("b"))
    assert mine.count() == len(TEXTS) + 4 and mine.where("NOT (a <=> b)").count() == 0


def test_objects_hours_and_spans(spark, rows):
    got = rows.select(F.expr("closed_object(t, array('k'))").alias("a"), jsonx.closed(F.col("t"), ["k"]).alias("b")).collect()
    assert [r.a for r in got] == [bool(r.b) for r in got] and sum(r.a for r in got) == 1
    hours = spark.sql("SELECT hour_up(TIMESTAMP'2024-01-01 10:00:00') a, hour_up(TIMESTAMP'2024-01-01 10:00:01') b, hour_up(NULL) c").first()
    assert (hours.a.hour, hours.b.hour, hours.c) == (10, 11, None)
    mine = spark.sql("SELECT t, s.piece, s.start, s.stop FROM surface_texts, LATERAL text_spans(t) s")
    theirs = rows.select("t", F.explode(T.spans(F.col("t"))).alias("s")).select("t", "s.*")
    assert mine.exceptAll(theirs).count() == 0 and theirs.exceptAll(mine).count() == 0 and mine.count() > 20


def test_the_protocol_as_a_table_function(spark):
    surface.register(spark)
    data = [
        ("a", 0, "user", ["1", "2"], None), ("a", 1, "tool", None, "1"), ("a", 2, "user", ["2"], None), ("a", 3, "tool", [], "9"),
        ("b", 0, "user", ["1"], None), ("b", 1, "tool", None, "1"), (None, 0, "tool", None, "1"), ("c", 0, "user", ["5"], "5"), (None, 1, "user", ["7"], None),
    ]
    spark.createDataFrame(data, "conv string, turn bigint, role string, calls array<string>, result string").createOrReplaceTempView("surface_turns")
    ask = "SELECT * FROM turn_protocol(TABLE(SELECT * FROM surface_turns{}) PARTITION BY conv ORDER BY turn)"
    got = {tuple(r) for r in spark.sql(ask.format("")).collect()}
    assert got == {
        ("a", 2, "a call id is pending already", 0), ("a", 2, "a user turn comes before the results", 0), ("a", 3, "a result answers no pending call", 0), ("a", None, "calls without results", 1),
        (None, 0, "a result answers no pending call", 0), (None, None, "calls without results", 1),
    }
    assert spark.sql(ask.format(" WHERE turn > 99")).count() == 0


def test_a_long_conversation_goes_through_in_batches(spark):
    surface.register(spark)
    turns = "SELECT 'x' AS conv, id AS turn, IF(id % 2 = 0, 'user', 'tool') AS role, IF(id % 2 = 0, array(string(id)), NULL) AS calls, IF(id % 2 = 1, string(id - 1), NULL) AS result FROM range(100001)"
    got = spark.sql(f"SELECT * FROM turn_protocol(TABLE({turns}) PARTITION BY conv ORDER BY turn)").collect()
    assert [tuple(r) for r in got] == [("x", None, "calls without results", 1)]
