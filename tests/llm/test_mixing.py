import re
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import mixing

from .fixtures import documents, frame, prose


def shares(sizes: dict) -> dict:
    """Shares by weight, the excess over three times a source's size shared again until none is above."""
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    target, left, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while open_ and left > 1e-9:
        total, spare = sum(weight[s] for s in open_), 0.0
        for s in open_:
            target[s] += left * weight[s] / total
        for s in list(open_):
            if target[s] > 3 * sizes[s]:
                spare += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
        left = spare
    return target


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(spark, rows):
    got = [r.asDict() for r in mixing.mix(frame(spark, rows)).collect()]
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += n_words(t)
    want = shares(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1
    return got, want


def test_targets_and_copies(spark):
    check(spark, documents())


def test_taken_words_come_near_the_target(spark):
    rows = [(i, prose(20 + i % 50, i), "en", f"s{i % 4 if i % 3 else 0}", 0) for i in range(1500)]
    got, want = check(spark, rows)
    for s, t in want.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - t) < 0.1 * t
    assert sorted(map(str, got)) == sorted(map(str, (r.asDict() for r in mixing.mix(frame(spark, rows)).collect())))


def test_sources_without_words_and_caps(spark):
    got, _ = check(spark, [(1, "", "en", "a", 0), (2, None, "en", "b", 0), (3, "w " * 5, "en", "c", 0), (4, "w " * 500, "en", "d", 0)])
    assert {r["target"] for r in got if r["source"] in ("a", "b")} == {0.0}
    check(spark, [(1, "", "en", "a", 0)])
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mixed_rows_are_the_copies(spark):
    docs = frame(spark).withColumn("of", F.lit(1)).withColumn("rate", F.lit("x"))
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    want = {(r["doc_id"], r["source"]): 0 for r in docs.collect()}
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    got = dict.fromkeys(want, 0)
    for r in rows.collect():
        got[r["doc_id"], r["source"]] += 1
    assert got == want
