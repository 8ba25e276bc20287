import math
import random
import re

from pyspark.sql import functions as F

from millrace.llm import licenses as lic

from .fixtures import documents, frame, prose

GPL = lic.template_words(lic.TEMPLATES[1][1])
MIT = lic.template_words(lic.TEMPLATES[9][1])
LONG = lic.template_words(lic.TEMPLATES[11][1])
TEXTS = [
    None, "", "MIT License", "the mit license and the Apache License, under CC-BY; gnu general\npublic  license", "commit license", "cc bye", "CC BY CC BY cc by", "gnu general public licenses", "GNU general public license gnu general public license",
    "ccé by", "cc éby", "cc—by", "mit license", *[f"{prose(60, 1)} {t} {prose(300, 2)}" for _, t in lic.TEMPLATES], *[f"{prose(n, 1)} {' '.join(GPL)} {prose(9, 2)}" for n in (0, 1, 26, 27, 28, 55, 56, 83)],
    " ".join(w for i, w in enumerate(MIT) if i not in (3, 9)), " ".join(MIT[:9]), "  Apache License  ", "apache license apache license x",
    " ".join(w for i, w in enumerate(LONG) if i % 17), " ".join(w for i, w in enumerate(LONG) if i % 7), " ".join(w + " filler" for w in LONG),
]
SCATTERED = "Released by us last week, under a tree the MIT student saw a license plate"


def scanned(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    at = [(i, label) for p, label in lic.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    more, most = set(), 0.0
    for label, said in lic.TEMPLATES:
        said = re.findall("[a-z0-9]+", said.lower())
        s, step = set(said), max(1, len(said) // 4)
        for i in range(0, max(1, len(w)), step):
            block = set(w[i : i + len(said) + step])
            if len(s & block) >= math.ceil(lic.THRESHOLD * len(s) - 1e-9):
                more.add(label)
                most = max(most, len(s & block) / len(s))
    base = {x for _, x in at}
    places = [i for i, _ in at]
    return (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if at else round(most, 6))


def test_contract(spark):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(TEXTS)]
    got = lic.scan(frame(spark, rows)).withColumn("score", F.round("score", 6)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: scanned(t) for i, t, *_ in rows}
    labels = {r["labels"] for r in got}
    assert all(any(label in x.split(",") for x in labels) for label, _ in lic.TEMPLATES)


def test_scattered_words_get_no_label(spark):
    rng = random.Random(2)
    rows = [(0, SCATTERED, "en", "a", 0)]
    for i, (_, t) in enumerate(lic.TEMPLATES, 1):
        words = [w for x in lic.template_words(t) for w in (x, *rng.choices(lic.template_words(prose(90, i)), k=3))]
        rows.append((i, " ".join(words), "en", "a", 0))
    got = {r["doc_id"]: r["labels"] for r in lic.scan(frame(spark, rows)).collect()}
    assert {k: v for k, v in got.items() if v} == {}


def test_a_notice_at_any_place_is_found(spark):
    filler = lic.template_words(prose(400, 3))
    rows = [(at * 100 + i, " ".join(filler[:at] + lic.template_words(t) + filler[at : at + 37]), "en", "a", 0) for i, (_, t) in enumerate(lic.TEMPLATES) for at in (0, 1, 2, 3, 5, 8, 13, 40, 59)]
    got = {r["doc_id"]: r["labels"].split(",") for r in lic.scan(frame(spark, rows)).collect()}
    assert all(lic.TEMPLATES[i % 100][0] in labels for i, labels in got.items())


def test_other_rows(spark):
    docs = frame(spark).withColumn("row", F.lit(1)).withColumn("said", F.lit("x")).withColumn("words", F.lit(2))
    got = lic.scan(docs).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *scanned(t))) for i, t, *_ in documents())
    assert lic.scan(frame(spark, [])).count() == 0
