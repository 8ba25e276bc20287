import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import sharding
from millrace.llm.common import key_text

from .fixtures import documents, frame


def placed(spark, tree, n=4000):
    return {r[0]: r[1] for r in spark.range(n).select("id", sharding.place(key_text("id"), tree)).collect()}


def test_contract(spark):
    rows = [r.asDict() for r in sharding.assign(frame(spark), shards=5).collect()]
    assert len(rows) == len(documents())
    want = Counter((i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in documents())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 5) and r["law"] == "key" for r in rows)
    assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({r["doc_id"] for r in rows})


def exponential(*parts):
    return -math.log((int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52)


def descend(key, region):
    rack = min((2 * region, 2 * region + 1), key=lambda r: exponential(key, "rack", r))
    return min(range(4 * rack, 4 * rack + 4), key=lambda s: exponential(key, "shard", s))


def shard_of(key, n):
    """Where a key goes among n shards in racks of four and regions of eight, step by step."""
    limit, region = min(((exponential(key, "region", r) / 8, r) for r in range(n // 8)), default=(math.inf, None))
    drawn = 0.0
    for nth in range(1, sharding.DRAWS + 1) if n % 8 else ():
        again = key if nth == 1 else f"{key}|{nth}"
        drawn += exponential(again, "region", n // 8) / 8
        if drawn >= limit:
            break
        if (shard := descend(again, n // 8)) < n:
            return shard
    return descend(key, region) if region is not None else 0


def test_one_more_shard_takes_rows_only_into_itself(spark):
    keys = [str(i) for i in range(400)]
    at = {n: {k: shard_of(k, n) for k in keys} for n in range(1, 102)}
    for n in range(1, 101):
        moved = [k for k in keys if at[n][k] != at[n + 1][k]]
        assert {at[n + 1][k] for k in moved} <= {n} and abs(len(moved) / len(keys) - 1 / (n + 1)) < 0.1
    for n in (1, 5, 8, 13, 40, 41, 100):
        assert placed(spark, sharding.layout(n), 400) == {int(k): s for k, s in at[n].items()}
    for n in (39, 40):  # what a growth foretells comes true
        a, b = (sharding.assign(frame(spark), shards=m) for m in (n, n + 1))
        assert Counter(map(tuple, a.select("doc_id", "size", "text_crc32", "grown_shard").collect())) == Counter(map(tuple, b.select("doc_id", "size", "text_crc32", "shard").collect()))


def test_shards_have_equal_shares(spark):
    for n in (1, 3, 8, 13, 41):
        share = Counter(placed(spark, sharding.layout(n), 5_000).values())
        assert set(share) == set(range(n))
        assert all(abs(share[s] - 5_000 / n) < 5 * (5_000 / n) ** 0.5 for s in range(n))


def test_very_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 7)
    got = sharding.assign(frame(spark, [(1, "a", "en", "x", 1)] * 100 + [(1, f"b{i}", "en", "x", 1) for i in range(50)]), shards=3).collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(150))


def test_weights_decide_shares_and_only_changed_subtrees_move(spark):
    tree = [sharding.Leaf(0, 0, 0, 1.0), sharding.Leaf(0, 0, 1, 3.0), sharding.Leaf(0, 1, 2, 4.0), sharding.Leaf(1, 2, 3, 8.0)]
    a = placed(spark, tree)
    share = Counter(a.values())
    assert all(abs(share[x.shard] / len(a) - x.weight / 16) < 0.03 for x in tree)
    # Weight goes from one shard of a rack to its neighbour: nothing else moves.
    b = placed(spark, [sharding.Leaf(0, 0, 0, 2.0), sharding.Leaf(0, 0, 1, 2.0), *tree[2:]])
    assert {(a[k], b[k]) for k in a if a[k] != b[k]} <= {(1, 0), (0, 1)}
    # A region grows: rows move into it, none between the others or out of it.
    c = placed(spark, [*tree[:3], sharding.Leaf(1, 2, 3, 12.0)])
    assert {c[k] for k in a if a[k] != c[k]} == {3}


def test_no_weight_and_no_rows(spark):
    with pytest.raises(ValueError):
        sharding.place(F.lit("k"), [sharding.Leaf(0, 0, 0, 0.0)])
    with pytest.raises(ValueError):
        sharding.place(F.lit("k"), [sharding.Leaf(0, 0, 0, 1.0, vacant=True)])
    assert sharding.assign(frame(spark, [])).count() == 0


def test_clashing_columns(spark):
    docs = frame(spark).withColumn("shard", F.lit("x")).withColumn("bucket", F.lit(1)).withColumn("count", F.lit(2))
    assert sharding.assign(docs, 3).count() == len(documents())
