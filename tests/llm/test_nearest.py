import numpy as np
from pyspark.sql import functions as F

from millrace.llm import nearest as s

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_force(rows, asks, k):
    """Every pair, in plain Python; rows are distinct by id and vector."""
    rows = list(dict.fromkeys((i, tuple(x + 0.0 for x in v)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)))
    out = []
    for i, v in rows:
        if i is None or not asks(i):
            continue
        found = []
        for j, w in rows:
            if (i, v) != (j, w) and len(v) == len(w):
                score = 0.0
                for x, y in zip(v, w, strict=True):
                    score += x * y
                found.append((-score, j is None, j or 0, j))
        out += [(i, n + 1, j, -x) for n, (x, _, _, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def said(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def test_by_force(spark, monkeypatch):
    monkeypatch.setattr(s, "CANDIDATES_A_TILE", 16)
    monkeypatch.setattr(s, "QUERIES_A_TILE", 8)
    monkeypatch.setattr(s, "STRIP", 5)
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(150)]
    hot = rows[7][1]
    rows += [(i, hot) for i in range(200, 260)] + [(7, hot)] * 40  # copies of a vector, and of a row
    rows += [(20, [1.0] * 6), (20, [2.0] * 6), (None, [3.0] * 6), (None, hot)]
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [None] + [1.0] * 5), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (306, [0.0, -0.0, 0, 0, 0, 1e-310])]
    rows += [(i, draw.normal(size=3).tolist()) for i in range(310, 330)] + [(340, [1e150, -1e150, 1e-150])]
    df = vectors(spark, rows).withColumn("query", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("rank", F.lit(2))
    got = said(s.nearest(df, F.col("vec_id") % 5 == 0, k=4))
    assert got == by_force(rows, lambda i: i % 5 == 0, 4)


def test_bounds_hold():
    draw = np.random.default_rng(5)
    for d in (1, 64, 3000):
        a, b = draw.normal(size=(20, d)) * 10.0 ** draw.integers(-3, 4, (20, 1)), draw.standard_cauchy(size=(30, d))
        ac, s_a, na, xa, n_a = s.rounded(a)
        bc, s_b, _, xb, n_b = s.rounded(b)
        exact = ac.astype(np.int64) @ bc.astype(np.int64).T
        assert (s.int8_products(ac, bc) == exact).all()
        assert (np.abs(a @ b.T - exact * s_a[:, None] * s_b) <= na[:, None] * xb + xa[:, None] * n_b + 1e-12 * n_a[:, None] * n_b).all()


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.5])]
    assert said(s.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0)) == [(0, 1, 1, 2.0)]
    assert said(s.nearest(vectors(spark, []), F.lit(True))) == []
    assert said(s.nearest(vectors(spark, rows[:1]), F.lit(True))) == []
