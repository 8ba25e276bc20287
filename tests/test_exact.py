"""Quantiles, overlaps and hash trees against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from millrace.operators import intervals, merkle, quantiles


def test_quantiles_of_groups_of_any_shape(spark):
    rnd = random.Random(4)
    groups = {
        "ties": [7.0] * 900 + [rnd.random() for _ in range(60)] + [8.0] * 900, "heavy": [rnd.paretovariate(0.3) for _ in range(2000)], "few": [3.0, 1.0, 2.0], "one": [5.0], "same": [1.5] * 1000,
        None: [float(i % 37) for i in range(1500)], "nan": [float("nan")] * 300 + [float(i) for i in range(300)], "steps": [float(2 ** (i % 60)) for i in range(900)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("void", None), ("one", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit(1)).repartition(6)
    ranks = {"first": lambda n: F.lit(1), "p05": quantiles.nearest("0.05"), "low": quantiles.lower_middle, "high": quantiles.upper_middle, "p95": quantiles.nearest("0.95"), "last": lambda n: n}
    at = [lambda n: 1, lambda n: max(1, -(-5 * n // 100)), lambda n: (n + 1) // 2, lambda n: n // 2 + 1, lambda n: -(-95 * n // 100), lambda n: n]
    want = {}
    for g, vs in groups.items():
        vs = sorted(vs, key=lambda v: (v != v, v))
        want[g] = [len(vs), *[vs[f(len(vs)) - 1] for f in at]]
    for buffer in (50, 10_000):
        got = {r[0]: list(r)[1:] for r in quantiles.at_ranks(df, "g", "v", ranks, buffer).collect()}
        assert {g: list(map(str, x)) for g, x in got.items()} == {g: list(map(str, x)) for g, x in want.items()}
    assert quantiles.at_ranks(df.where("false"), "g", "v", ranks).count() == 0


def test_quantiles_of_one_large_group(spark):
    df = spark.range(200_000).select(F.lit(1).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("v"))
    want = sorted(r.v for r in df.select("v").collect())
    got = quantiles.at_ranks(df, "g", "v", {"a": quantiles.nearest("0.123"), "b": lambda n: n - 1}, 100).first()
    assert (got.n, got.a, got.b) == (200_000, want[24_600 - 1], want[200_000 - 2])


def test_spans_of_any_length(spark):
    rnd = random.Random(9)
    spans = [(rnd.choice(["a", "b", None]), i, s := rnd.randrange(-(10**9), 10**9), s + rnd.choice([-5, 0, 1, 2, 3, 4, 5, 900, 10**5, 10**8, 10**9])) for i in range(300)]
    spans += [("a", 1000 + i, 5, 6) for i in range(20)] + [("c", 2000, -(1 << 62), 1 << 61), ("c", 2001, 0, 1), (None, 2002, None, 4), ("c", 2003, 0, None)]
    df = spark.createDataFrame(spans, "g string, k long, s long, e long").withColumn("level", F.lit(1)).withColumn("cell", F.lit(1))
    got = sorted(tuple(r) for r in intervals.overlaps(df, "g", "k", "s", "e").collect())
    real = [x for x in spans if x[0] is not None and None not in x[2:] and x[2] < x[3]]
    assert got == sorted((g, *sorted((k, m))) for i, (g, k, s, e) in enumerate(real) for h, m, t, f in real[:i] if g == h and s < f and t < e)
    assert intervals.overlaps(df.where("false"), "g", "k", "s", "e").count() == 0


def test_trees_proofs_and_differences(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(i * i * 10**14, None if i % 50 == 3 else f"text {i % 40}") for i in range(300)] + [(None, "x"), (0, "text 0"), (0, "")]
    df = spark.createDataFrame(rows, "o long, t string").withColumn("i", F.lit(1)).withColumn("digest", F.lit("d")).repartition(5)
    leaf = lambda t: sha("n" if t is None else "l" + t)
    level = [d for _, _, d in sorted((o is not None, o or 0, leaf(t)) for o, t in rows)]
    want, k = {}, 0
    while True:
        want |= {(k, i): d for i, d in enumerate(level)}
        if len(level) == 1:
            break
        level, k = [sha("b" + "".join(level[i : i + 4])) for i in range(0, len(level), 4)], k + 1
    nodes = merkle.tree(df, F.col("t"), "o", fan=4)
    assert {(r.level, r.i): r.digest for r in nodes.collect()} == want and nodes.count() == len(want)
    leaves = nodes.where("level = 0").select(F.col("i").alias("place"), "digest")
    given = merkle.proofs(nodes, leaves, 4)
    assert given.groupBy("place").count().agg(F.max("count")).first()[0] <= 3 * k
    assert {r.digest for r in merkle.proved(leaves, given, k, 4).collect()} == {want[k, 0]} == {merkle.root(nodes).first().digest}
    false = leaves.withColumn("digest", F.sha2("digest", 256))
    assert want[k, 0] not in {r.digest for r in merkle.proved(false, given, k, 4).collect()}
    other = merkle.tree(df.withColumn("t", F.when(F.col("o") == 100 * 10**14, "new").otherwise(F.col("t"))), F.col("t"), "o", fan=4)
    (one,) = merkle.differing(nodes, other, 4).collect()
    assert (one.old, one.new) == (leaf("text 10"), leaf("new")) and want[0, one.i] == one.old
    longer = merkle.tree(df.select("o", "t").union(spark.createDataFrame([((1 << 63) - 1, "z")], "o long, t string")), F.col("t"), "o", fan=4)
    assert [tuple(r) for r in merkle.differing(nodes, longer, 4).collect()] == [(len(rows), None, leaf("z"))]
    none = merkle.tree(df.where("false"), F.col("t"), "o")
    assert none.count() == 0 and merkle.differing(none, none).count() == 0 and merkle.differing(none, nodes, 4).count() == len(rows)
    alone = merkle.tree(df.limit(1), F.col("t"), "o")
    assert alone.count() == 1 and merkle.proofs(alone, leaves).count() == 0
