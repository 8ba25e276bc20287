"""Operators 5 and 10: statistics against plain Python, models by held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import functions as F

from millrace.llm import compression_quality as cq
from millrace.llm import gbdt
from millrace.llm import quality_rules as qr

from .fixtures import documents, frame, prose

WORD = r"[^\x20\x09-\x0D]+"


def statistics(t):
    t = t or ""
    w = re.findall(WORD, t)
    often = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if often[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def bad(i):
    return (" ".join(f"{w}$$$ #{w}" for w in prose(40, i).split()), prose(60, i).upper().replace(" ", "!! "), "again and again " * 60, "\n".join([prose(8, i)] * 12))[i % 4]


def corpus(n=600):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        rows.append((i, prose(60 + i % 90, i) + ".\n" + prose(20, i + 1) if good else bad(i // 4), "en", "a", 0))
        labels.append((i, int(good), 0))
    return rows, labels


def labels_of(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_statistics(spark):
    texts = [t for _, t, *_ in documents()] + ["a b a b a b", "a b c a b", "x\nx\n\n\n x\nx ", "#*$%&|<>", "a b \x1c \x85 c", "a b c d a b c e a b c"]
    for t in texts:
        assert qr.statistics_of(t)[:5] == statistics(t), t
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    trees = gbdt.train(np.zeros((0, len(qr.FEATURES))), np.zeros(0), np.array(list(qr.FEATURES.values())))
    docs = frame(spark, rows).withColumn("stats", F.lit(1))
    for r in qr.judge(docs, trees, "doc_id").collect():
        n, chars, symbols, lines, repeated = statistics(texts[r["doc_id"]])
        failed = n < 50 or 100 * repeated > 50 * n
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, lines, repeated, failed)
        assert not (failed and r["kept"])
    assert qr.kept_rows(docs, trees).count() == qr.judge(docs, trees, "doc_id").where("kept").count()
    assert qr.judge(frame(spark, []), trees, "doc_id").count() == 0


def test_rules_on_held_out_documents(spark):
    rows, labels = corpus()
    noise = [(0, 1, 0), (None, 0, 0), (5, None, 0), (10**6, 0, 0)]
    trees = qr.fit(frame(spark, rows), labels_of(spark, [x for x in labels if x[0] % 2] + [x for x in labels if x[0] % 8 == 0] + noise))
    got = {r["doc_id"]: r for r in qr.judge(frame(spark, rows), trees, "doc_id").collect()}
    test = [(i, q) for i, q, _ in labels if i % 2 == 0 and i % 8 != 0]
    assert all(got[i]["kept"] for i, q in test if q)
    assert not any(got[i]["kept"] for i, q in test if not q)


def test_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.3 * rng.random(3000) - 0.5 * x[:, 1]) > 0.5).astype(float)
    trees = gbdt.train(x, y, np.array([1, -1, 0]))
    grid = np.linspace(0, 1, 60)
    for a, b in rng.random((30, 2)):
        p = trees.probability(np.stack([grid, np.full(60, a), np.full(60, b)], axis=1))
        q = trees.probability(np.stack([np.full(60, a), grid, np.full(60, b)], axis=1))
        assert (np.diff(p) >= -1e-12).all() and (np.diff(q) <= 1e-12).all()
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.85


def walked(trees, x):
    """The probability of one row, by going down each tree from its root."""
    def below(at):
        if trees.feature[at] < 0:
            return trees.value[at]
        return below(trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at])

    return 1 / (1 + math.exp(-(trees.base + sum(below(r) for r in trees.roots))))


def test_node_arrays_say_what_the_trees_say(spark):
    rows, labels = corpus(300)
    trees = qr.fit(frame(spark, rows), labels_of(spark, labels))
    assert len(trees.roots) == 60 and (trees.feature >= 0).any()
    got = {r["doc_id"]: r["bad"] for r in qr.judge(frame(spark, rows), trees, "doc_id").collect()}
    for i, t, *_ in rows:
        x = qr.features(pd.DataFrame([qr.statistics_of(t)], columns=[*qr.BASE, *qr.MORE]))[0]
        assert abs(got[i] - walked(trees, x)) < 1e-9


def test_repeated_ids_are_one_row_of_the_sample(spark):
    rows, labels = corpus(60)
    again = [(4, f"{t} again", lang, source, n) for _, t, lang, source, n in rows[4:5]] * 50
    for fit in (qr.fit, cq.fit):
        a, b = (fit(frame(spark, x), labels_of(spark, labels)) for x in (rows + again[:1], again + rows + rows))
        assert repr(a) == repr(b)


def test_ids_may_be_texts(spark):
    rows, labels = corpus(120)
    docs = frame(spark, rows).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    named = labels_of(spark, labels).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert cq.score(docs, cq.fit(docs, named)).count() == qr.judge(docs, qr.fit(docs, named), "doc_id").count() == len(rows)


def test_compression_by_force(spark):
    """Sample, dictionaries, block sizes, curve and score, each found anew."""
    rows, labels = corpus(400)
    rows[8] = (8, "".join(prose(400, k) for k in range(30)), "en", "a", 0)  # more than one block, and than is left
    budget = 20_000
    model = cq.fit(frame(spark, rows), labels_of(spark, labels), dictionary_texts=40, dictionary_bytes=budget, curve_texts=50)
    text, order = {i: t for i, t, *_ in rows}, lambda i: np.uint64(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)).astype(np.int64)
    of = lambda q, third: sorted((i for i, x, _ in labels if x == q and zlib.crc32(str(i).encode()) % 3 == third), key=order)
    for q, have in ((1, model.good), (0, model.bad)):
        left, kept = budget, []
        for i in of(q, 0)[:40]:
            if len(text[i]) <= left:
                left -= len(text[i])
                kept.append(text[i])
        assert cq.dictionary(kept) == have

    def size(t, raw):
        blocks = [t[i : i + cq.BLOCK] for i in range(0, len(t), cq.BLOCK)]
        d = zstandard.ZstdCompressionDict(raw)
        return sum(len(zstandard.ZstdCompressor(level=cq.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress(x)) for x in blocks)

    x = {i: (size(t.encode(), model.bad) - size(t.encode(), model.good)) / (len(t) + 64) for i, t in text.items()}
    for r in cq.score(frame(spark, rows), model).collect():
        assert abs(r["score"] - 1 / (1 + math.exp(-(model.slope * x[r["doc_id"]] + model.offset)))) < 1e-9
    points = [(x[i], q) for q in (0, 1) for i in of(q, 2)[:50]]
    share = len(of(1, 2)) / (len(of(1, 2)) + len(of(0, 2)))
    n = [sum(q == k for _, q in points) for k in (0, 1)]
    scale = np.std([v for v, _ in points])

    def loss(slope, offset):
        p = lambda v: 1 / (1 + math.exp(-(slope * v + offset)))
        every = sum((share / n[1] if q else (1 - share) / n[0]) * len(points) * -math.log(p(v) if q else 1 - p(v)) for v, q in points)
        return every + 0.5e-2 * ((slope * scale) ** 2 + offset**2)

    least = loss(model.slope, model.offset)
    assert all(loss(model.slope + a, model.offset + b) >= least - 1e-9 for a in (-0.1, 0, 0.1) for b in (-0.01, 0, 0.01))


def test_compression_on_held_out_documents(spark):
    rows, labels = corpus()
    docs = frame(spark, rows + [(None, "a b", "en", "a", 0), (9000, None, "en", "a", 0), (9001, "", "en", "a", 0), (9002, prose(9, 1), "en", "a", 0), (9002, prose(9, 1), "en", "a", 0)])
    model = cq.fit(docs, labels_of(spark, [*labels, (0, 1, 0), (None, 1, 0), (7, None, 0)]))
    got = cq.score(docs.withColumn("score", F.lit(1)), model).collect()
    assert len(got) == len(rows) + 5
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    quality = {i: q for i, q, _ in labels}
    held = [(r["predicted"], quality[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in quality]
    assert sum(a == b for a, b in held) > 0.95 * len(held)


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(200)
    model = cq.fit(frame(spark, rows), labels_of(spark, labels))
    turned = [(i, 1 - q if cq.held_out(i) else q, t) for i, q, t in labels]
    assert cq.fit(frame(spark, rows), labels_of(spark, turned)) == model


def test_compression_without_labels(spark):
    model = cq.fit(frame(spark), labels_of(spark, []))
    assert {r["score"] for r in cq.score(frame(spark), model).collect()} == {0.5}
    assert cq.score(frame(spark, []), model).count() == 0
