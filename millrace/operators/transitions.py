"""A ledger as an append-only log of its transitions, for writers that do not know of each other.

A version is a file of its own, which exactly one writer can create: whoever
comes second reads what is there, judges again and tries the next one. Each
version holds the transition and the balance after it, so that the last one is
the snapshot, and a table of all of them can be checked row by row with the row
before: no fold over the whole log.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import MONEY, TERM
from ..sources import files
from . import ledger

BALANCE = ["posted", "outstanding", "committed", "authorized"]
#: Amounts are text, exact as written.
ENTRY = "version long, kind string, key string, cost string, reserved string, " + ", ".join(f"{c} string" for c in BALANCE)
#: How often a writer that came second tries again.
TRIES = 100


class Contended(RuntimeError):
    """Others were quicker every time."""


def _name(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/{version:020d}.json"


def version(spark: SparkSession, path: str) -> int:
    """The last version; -1 of a log that is not begun."""
    return max((int(n.removesuffix(".json")) for n in files.names(spark, path)), default=-1)


def entry(spark: SparkSession, path: str, at: int) -> dict:
    return json.loads(files.text_of(spark, _name(path, at)))


def append(spark: SparkSession, path: str, at: int, told: dict) -> bool:
    """Write version `at`; False if another writer has."""
    return files.create(spark, _name(path, at), json.dumps({"version": at, **told}, sort_keys=True))


def begin(spark: SparkSession, path: str, authorized: str) -> bool:
    """Version 0: nothing is posted or reserved. False if the log has begun."""
    return append(spark, path, 0, {"kind": "begin", "key": None, "cost": "0", "reserved": "0", "posted": "0", "outstanding": "0", "committed": "0", "authorized": authorized})


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All versions as a table; its folder grows only, so what is read of it stays true."""
    return spark.read.schema(ENTRY).json(path)


def _change(spark: SparkSession, path: str, kind: str, key: str, judge) -> int:
    """Append what `judge` makes of the last balance; the version that the transition has, an earlier one if it is there."""
    for _ in range(TRIES):
        now = version(spark, path)
        if now < 0:
            raise ValueError(f"{path} is not begun")
        known = entries(spark, path).where((F.col("version") <= now) & (F.col("kind") == kind) & (F.col("key") == key)).agg(F.min("version")).first()[0]
        if known is not None:
            return known
        if append(spark, path, now + 1, {"kind": kind, "key": key, **judge(entry(spark, path, now), now)}):
            return now + 1
    raise Contended(path)


def _balance(spark: SparkSession, last: dict) -> DataFrame:
    return spark.createDataFrame([tuple(last[c] for c in BALANCE)], ", ".join(f"{c} string" for c in BALANCE)).select(*[F.col(c).cast(MONEY).alias(c) for c in BALANCE])


def _plain(row) -> dict:
    return {c: format(row[c], "f") for c in BALANCE}


def reserve(spark: SparkSession, path: str, key: str, amount: str) -> int:
    """Set an amount aside; raises where the authorization does not reach. Reserving again changes nothing."""

    def judge(last: dict, _: int) -> dict:
        more = F.lit(amount).cast(TERM)
        held = _balance(spark, last)
        fits = F.col("committed").cast(TERM) + more <= F.col("authorized")
        for c in ("outstanding", "committed"):
            held = held.withColumn(c, F.when(fits, (F.col(c).cast(TERM) + more).cast(MONEY)).otherwise(F.raise_error(F.lit("the ledger would exceed its authorization"))) if c == "outstanding" else (F.col(c).cast(TERM) + more).cast(MONEY))
        return {"cost": "0", "reserved": amount, **_plain(held.first())}

    return _change(spark, path, "reserve", key, judge)


def settle(spark: SparkSession, path: str, key: str, cost: str) -> int:
    """Post the cost of what was reserved under the key; raises where an identity of the ledger fails or nothing was reserved. Settling again changes nothing."""

    def judge(last: dict, now: int) -> dict:
        held = entries(spark, path).where((F.col("version") <= now) & (F.col("kind") == "reserve") & (F.col("key") == key)).first()
        if held is None:
            raise ValueError(f"nothing is reserved for {key}")
        return {"cost": cost, "reserved": held["reserved"], **_plain(ledger.settle(_balance(spark, last), cost, held["reserved"]).first())}

    return _change(spark, path, "settle", key, judge)


def problems(log: DataFrame) -> DataFrame:
    """version, problem: versions at which an identity fails, held against the version before; no row of a sound log."""
    amount = lambda c: F.col(c).cast(TERM)
    rows = log.select("version", "kind", *[amount(c).alias(c) for c in ("cost", "reserved", *BALANCE)])
    before = rows.select((F.col("version") + 1).alias("version"), *[F.col(c).alias(f"{c}_before") for c in BALANCE])
    both = rows.join(before, "version", "left")
    moved = lambda c: F.col(c) - F.col(f"{c}_before")
    reserved, cost = F.col("reserved"), F.col("cost")
    known = F.col("posted_before").isNotNull()
    reason = (
        F.when(F.col("posted") + F.col("outstanding") != F.col("committed"), "posted and outstanding are not what is committed")
        .when(F.col("committed") > F.col("authorized"), "more is committed than authorized")
        .when((F.col("version") > 0) & ~known, "the version before is missing")
        .when(known & (moved("authorized") != 0), "the authorization changed")
        .when((F.col("kind") == "reserve") & ((moved("posted") != 0) | (moved("outstanding") != reserved)), "a reservation moved something else")
        .when((F.col("kind") == "settle") & ((moved("posted") != cost) | (moved("outstanding") != -reserved)), "a settlement moved something else")
    )
    return both.select("version", reason.alias("problem")).where("problem IS NOT NULL")
