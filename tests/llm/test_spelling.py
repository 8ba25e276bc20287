import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import spelling as s

from .fixtures import documents, frame


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def by_force(n, ratio=s.RATIO):
    near = {w: [v for v in n if w and v and one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        if vs and n[best := min(vs, key=lambda v: (-n[v], v))] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def said(df):
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def table(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


def test_random_words_of_any_length(spark):
    draw = random.Random(7)
    letters = "abàÿ"
    words = {"".join(draw.choice(letters) for _ in range(draw.choice([1, 2, 3, 5, 7, 8, 9, 20, 40]))) for _ in range(150)}
    for w in sorted(words):
        for _ in range(2):
            i = draw.randrange(len(w) + 1)
            words.add(draw.choice([w[:i] + draw.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + draw.choice(letters) + w[i + 1 :]]))
    n = {w: draw.choice([1, 2, 30, 400, 5000]) for w in sorted(words)}
    assert said(s.variants(table(spark, n))) == by_force(n)


def test_long_words_ties_and_chains(spark):
    long = "ab" * 150
    n = {long: 500, long[:200] + "x" + long[200:]: 5, long[:-1]: 50, long[1:]: 50, "z" + long: 1, "": 3, "a": 90, "b": 90, "c": 9, "abcdefg": 10_000, "abcdefgh": 1000, "abcdefghi": 100, "abcdefghij": 10, "abcdefghijk": 1}
    got = said(s.variants(table(spark, n)))
    assert got == by_force(n)
    assert ("c", "a", "a", 9, 3 - 1, 90) in got
    assert ("abcdefghijk", "abcdefghij", "abcdefg", 1, 1, 10) in got


def test_words_about_as_long_as_short_ones_may_be(spark):
    draw = random.Random(11)
    words = {"".join(draw.choice("abà") for _ in range(size)) for size in (s.SHORT - 1, s.SHORT, s.SHORT + 1, s.SHORT + 2, 2 * s.SHORT, 4 * s.SHORT + 3) for _ in range(6)}
    for w in sorted(words):
        for i in (0, len(w) // 2 - 1, len(w) // 2, len(w) // 2 + 1, len(w) - 1):
            words |= {w[:i] + "x" + w[i:], w[:i] + w[i + 1 :], w[:i] + "x" + w[i + 1 :]}
        words.add(w + "x")
    n = {w: draw.choice([1, 2, 30, 400]) for w in sorted(words)}
    assert said(s.variants(table(spark, n))) == by_force(n)


def test_a_code_point_of_zero_is_a_letter(spark):
    n = {"abcdefg": 50, "abcdefg\0": 2, "\0abcdefg": 3, "abc\0efg": 4, "abcefg": 1, "\0": 5, "a": 7}
    assert said(s.variants(table(spark, n))) == by_force(n)


def shuffled(spark):
    """Bytes that this session's tasks have written to shuffles."""
    every = spark._jsc.sc().statusStore().executorList(False)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def test_bytes_shuffled_for_a_word(spark):
    draw = random.Random(3)
    stems = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(40)]
    words = {draw.choice(stems) + "".join(draw.choice("etaoinsr") for _ in range(draw.choice([3, 4, 5, 6]))) for _ in range(6000)}
    rows = s.checkpoint(table(spark, {w: 2 for w in sorted(words)}))
    before = shuffled(spark)
    s.neighbours(rows).write.format("noop").mode("overwrite").save()
    assert 0 < shuffled(spark) - before < 500 * len(words)


def test_words_of_texts(spark):
    rows = [*documents(), (20, "Straßenbahn ÉCLAIRÉS éclairés naïveté×÷ab abcdefg ABCDEFG x1abcdefgh", "fr", "a", 0)]
    rows += [(i, "wonderful beautiful " * 3, "en", "a", 0) for i in range(100, 160)] + [(100, "wonderful", "en", "a", 0)] * 2
    counts = {}
    for i, t, *_ in rows:
        run = ""
        for c in (t or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
                continue
            if run:
                h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
                if h % 31 == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                if len(run) >= 7:
                    counts[run] = counts.get(run, 0) + 1
            run = ""
    docs = frame(spark, rows).withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("key", F.lit(1))
    assert {tuple(r) for r in s.words_of(docs).collect()} == {(w, n) for w, n in counts.items() if n > 1}


def test_nothing(spark):
    assert s.variants(s.words_of(frame(spark, []))).count() == 0
    assert said(s.variants(table(spark, {"alone": 2}))) == {("alone", None, "alone", 2, 0, None)}
    assert said(s.variants(spark.createDataFrame([(None, 2)], "word string, n long"))) == {(None, None, None, 2, 0, None)}
    with pytest.raises(ValueError):
        s.variants(table(spark, {"a": 1}), ratio=1)
