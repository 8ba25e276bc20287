"""Streams give what the batch forms give over the same rows."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import turns
from millrace.streaming import flows

SCHEMA = "conv_id long, turn long, role string"


@pytest.fixture
def arriving(spark, tmp_path):
    said = {1: "system user assistant assistant user", 2: "assistant user system", 3: "user assistant user user assistant", 4: "user"}
    rows = [(c, t, r) for c, roles in said.items() for t, r in enumerate(roles.split())]
    parts = [rows[1::3], rows[::3], rows[2::3]]  # out of order
    for i, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    return rows, [str(tmp_path / "in" / f"p{i}") for i in range(3)], tmp_path


def test_protocol(spark, arriving):
    rows, parts, tmp = arriving
    inbox = tmp / "inbox"
    out, point = str(tmp / "out"), str(tmp / "point")
    for i, p in enumerate(parts):  # each arrival is a run of its own; state goes on from run to run
        spark.read.parquet(p).coalesce(1).write.mode("append").parquet(str(inbox))
        flows.drain(flows.protocol(flows.source(spark, str(inbox), SCHEMA, files=1)), out, point)
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    want = {tuple(r) for r in turns.adjacency(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and len(got) == 4


def test_windows_and_first_seen(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", k, v) for m, k, v in [(0, "a", 1), (5, "a", 0), (5, "b", 1), (20, "a", 1), (59, "z", 1)]]
    df = spark.createDataFrame(rows, "t string, k string, v int").select(F.col("t").cast("timestamp").alias("t"), "k", "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = flows.source(spark, str(tmp_path / "in"), "t timestamp, k string, v int")
    flows.drain(flows.windowed_rates(stream, "k", F.col("v") == 1, "t", "10 minutes", "1 minute"), str(tmp_path / "o"), str(tmp_path / "c"))
    got = {(r.start.minute, r.k, r.n, r.rate) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {(0, "a", 2, 0.5), (0, "b", 1, 1.0), (20, "a", 1, 1.0)}  # the last window is still open
    flows.drain(flows.first_seen(stream, "k", "t", "2 hours"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "o2")).collect()) == ["a", "b", "z"]


COLUMNS = "id long, at timestamp, cost string, status string"
WANT = {
    (1, "sound"), (1, "cost does not reconcile"),  # settled twice
    (2, "status differs"), (3, "invalid cost"), (4, "not settled in time"), (4, "settled without a call"),  # settled too late
    (5, "not settled in time"), (6, "settled without a call"), (7, "settled without a call"), (7, "not settled in time"),  # settled before the call
    (8, "sound"), (None, "not settled in time"), (None, "settled without a call"),
}
CALLS = [(1, 0, "1.50", "a"), (2, 1, "2", "a"), (3, 1, "1e3", None), (4, 2, "1", "a"), (5, 3, "1", "a"), (7, 9, "1", "a"), (8, 4, "0.10", None), (None, 2, "1", "a"), (9, None, "1", "a")]
SETTLED = [(1, 1, "1.5", "a"), (1, 3, "1.6", "a"), (2, 1, "2", "b"), (3, 2, "1000", None), (4, 13, "1", "a"), (6, 5, "1", "a"), (7, 8, "1", "a"), (8, 14, "0.1", None), (None, 2, "1", "a"), (9, None, "1", "a")]
END = (None, 600, None, None)


def _sides(spark, rows):
    """Rows whose time is minutes after a day's begin."""
    timed = spark.createDataFrame(rows, "id long, m int, cost string, status string")
    return timed.select("id", (F.timestamp_seconds(F.lit(1_700_000_000)) + F.make_dt_interval(mins=F.col("m"))).alias("at"), "cost", "status")


def _found(rows):
    return sorted(((r.id, r.problem or "sound") for r in rows.where("coalesce(at, settled_at) < timestamp_seconds(1700000000 + 3600)").collect()), key=repr)


def test_settlements_of_tables(spark):
    got = _found(flows.settlements(_sides(spark, CALLS), _sides(spark, SETTLED), ["status"], "10 minutes", "20 minutes"))
    assert got == sorted(WANT, key=repr)
    empty = _sides(spark, CALLS).where("false")
    assert flows.settlements(empty, empty, [], "1 minute", "1 minute").count() == 0
    assert {p for _, p in _found(flows.settlements(_sides(spark, CALLS), empty, [], "1 minute", "1 minute"))} == {"not settled in time"}


@pytest.mark.parametrize("turned", [False, True])
def test_settlements_of_streams(spark, tmp_path, turned):
    """In whatever order rows arrive within the delay, with a stop in between, each problem comes once."""
    step = -1 if turned else 1
    for rows, name in ((CALLS[::step], "calls"), (SETTLED[::-step], "settled")):
        for k, part in enumerate([rows[::2], rows[1::2] + [END]]):
            _sides(spark, part).coalesce(1).write.parquet(str(tmp_path / "staged" / name / str(k)))
    seen = []
    for k in range(2):
        for name in ("calls", "settled"):
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / "staged" / name / str(k)).rename(tmp_path / name / str(k))
        calls, settled = (flows.source(spark, str(tmp_path / name / "*"), COLUMNS) for name in ("calls", "settled"))
        flows.drain(flows.settlements(calls, settled, ["status"], "10 minutes", "20 minutes"), str(tmp_path / "out"), str(tmp_path / "point"))
        seen.append(_found(spark.read.parquet(str(tmp_path / "out"))))
    assert len(seen[0]) < len(seen[1]) and seen[1] == sorted(WANT, key=repr)


@pytest.mark.parametrize("days", [6, 0])
def test_streamed_settlements_first_day(spark, tmp_path, days):
    """Rows of the first day that come late are no later than the delay, though the days fall on the slices' borders; nor are those of one day only."""
    from datetime import datetime, timedelta

    from millrace.plans.stored import ORACLES, streamed_settlements

    from . import parity

    day = lambda k: datetime(1995, 1, 1) + timedelta(days=k)
    orders = [(k, day(k % (days + 1)), k, "F") for k in range(1, 29)]
    lines = [(k, day(min(k % (days + 1) + k % 2, days)), 1 + k % 5, float(k), "F" if k % 3 else "O") for k in range(1, 25)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_shipdate timestamp, l_linenumber int, l_quantity double, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert parity.compare(streamed_settlements(spark, str(tmp_path)), parity.views(str(tmp_path)), ORACLES["streamed_settlements"]) > 2
