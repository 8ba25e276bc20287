import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from millrace.llm import golay, simhash
from millrace.llm.common import row_key

from .fixtures import documents, frame, prose


def fingerprint(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps):
    """The least member that each fingerprint reaches by steps of two bits at most."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_golay_code_is_perfect():
    words = np.arange(1 << 23)
    index = golay.index(words)
    assert np.bincount(index).tolist() == [2048] * 4096
    one = golay.index(words[:5000, None] ^ (1 << np.arange(23)))
    near = [set(r) | {i} for r, i in zip(one.tolist(), index[:5000].tolist(), strict=True)]
    assert {len(s) for s in near} == {1, 6}


def test_contract(spark):
    rows = documents()
    got = simhash.near_duplicates(frame(spark)).collect()
    fps = {fingerprint(t) for _, t, *_ in rows}
    root, first = linked(fps), {}
    for i, t, *_ in rows:
        if i is not None:
            r = root[fingerprint(t)]
            first[r] = min(i, first.get(r, i))
    want = sorted((str(i), f"{fingerprint(t):016x}", str(first.get(root[fingerprint(t)]))) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_links_find_every_component(spark):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:4]:
        for _ in range(120):
            x = base
            for _ in range(rnd.randint(1, 6)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = linked(fps)
    groups = lambda d: {frozenset(k for k in d if d[k] == r) for r in d.values()}
    for crowd in (3, 64):
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(table, crowd=crowd)).collect()}
        assert groups({x: found.get(signed(x), signed(x)) for x in fps}) == groups(want)


def test_empty_table_and_long_text(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    text = prose(simhash.BLOCK + 100, 9)
    assert simhash.fingerprint_of(text) == fingerprint(text)


def test_one_document_of_each_class_stays(spark):
    docs = frame(spark).withColumn("row", F.lit(1)).withColumn("fp", F.lit("x"))
    kept = simhash.distinct_documents(docs, simhash.classes(docs))
    assert kept.columns == docs.columns
    rows = documents()
    root = linked({fingerprint(t) for _, t, *_ in rows})
    classes = {root[fingerprint(t)] for _, t, *_ in rows}
    got = [r for r in kept.collect()]
    assert len(got) == len(classes) == len({root[fingerprint(r["text"])] for r in got})
    for r in got:
        ids = [i for i, t, *_ in rows if root[fingerprint(t)] == root[fingerprint(r["text"])] and i is not None]
        assert r["doc_id"] == (min(ids) if ids else None)


def edited(text, seed, share):
    rnd = random.Random(seed)
    return " ".join(f"edit{rnd.randrange(10**6)}" if rnd.random() < share else w for w in text.split())


def test_resembling_texts_are_linked(spark):
    words = lambda n, seed: " ".join(f"w{random.Random(f'{seed}-{i}').randrange(4000)}" for i in range(n))
    passage = words(60, "passage")
    rows = [(i, words(300, i)) for i in range(3)]
    rows += [(100 + i, edited(rows[0][1], i, 0.006)) for i in range(60)]  # a crowd
    rows += [(200 + i, words(200, 1000 + i) + " " + passage) for i in range(40)]  # a passage in common is not enough
    rows += [(300, edited(rows[1][1], 9, 0.01)), (301, edited(rows[2][1], 9, 0.3)), (302, None), (303, "")]
    text = dict(rows)
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in rows])
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(docs, similarity=0.8).collect()}
    alike = lambda i, j: jaccard(text[i], text[j]) >= 0.8
    assert alike(1, 300) and got[300] == 1
    assert all(got[100 + i] == 0 for i in range(60) if alike(0, 100 + i)) and sum(alike(0, 100 + i) for i in range(60)) > 50
    assert all(got[200 + i] == 200 + i for i in range(40)) and got[301] == 301 and got[302] == got[303] == 302
    assert simhash.classes(frame(spark, []), similarity=0.8).count() == 0


def shingles(t):
    """The set of five-word shingles; of fewer words, all are one."""
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def test_resemblance_is_that_of_the_shingle_sets():
    rnd = random.Random(1)
    texts = ["", None, "a", "A b", "a b c d e", "a b c d e a b c d e", "b a"] + [" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    assert all(simhash.resemblance(a, b) == jaccard(a, b) for a in texts for b in texts)
    assert all(len(simhash.shingle_hashes(t)) == len(shingles(t)) for t in texts)


def classes_by_force(rows):
    """The partition of the texts that 0.8 of five-word shingles and two bits of the fingerprints connect."""
    prints = {i: fingerprint(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, t in rows:
        for j, u in rows:
            if i < j and find(i) != find(j) and ((prints[i] ^ prints[j]).bit_count() <= 2 or jaccard(t, u) >= 0.8):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i, _ in rows}


def random_words(n, seed):
    rnd = random.Random(str(seed))
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def one_edit(words, seed):
    at = random.Random(str(seed)).randrange(len(words))
    return words[:at] + [f"edit{seed}"] + words[at + 1 :]


def test_near_copies_within_a_crowd(spark):
    passage = random_words(200, "passage")
    own = [random_words(60, i) for i in range(80)]
    rows = [(i, " ".join(w + passage)) for i, w in enumerate(own)]  # more than CROWD share the passage
    rows += [(1000 + i, " ".join(one_edit(one_edit(w, i), 500 + i) + passage)) for i, w in enumerate(own)]
    # Mostly passage: one in two pairs is near, so that its shingles are crowded in the prefixes.
    rows += [(2000 + i, " ".join(random_words(8 + i % 30, f"few{i}") + random_words(120, "other"))) for i in range(90)]
    want = classes_by_force(rows)
    assert sum(want[1000 + i] == i for i in range(80)) == 80 and 2 < len({want[2000 + i] for i in range(90)}) < 90
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(frame(spark, [(i, t, "en", "a", 0) for i, t in rows]), similarity=0.8).collect()}
    assert got == want


def test_short_texts_with_one_edited_word(spark):
    rows = []
    for i in range(120):
        words = random_words(50 + i % 20, i)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(one_edit(words, i)))]
    # The same shingles in another order: other fingerprints, one set.
    a, b = random_words(30, "a"), random_words(30, "b")
    rows += [(1000, " ".join(a + b + a + b + a)), (1001, " ".join(b + a + b + a + b + a + b[:4])), (1002, "one two"), (1003, "One  two"), (1004, "")]
    want = classes_by_force(rows)
    assert sum(want[2 * i + 1] == 2 * i for i in range(120)) > 100
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(frame(spark, [(i, t, "en", "a", 0) for i, t in rows]), similarity=0.8).collect()}
    assert got == want


def test_recall_of_near_copies(spark):
    """One edit in texts of 12 to 100 words, and the links that five-word shingles at 0.8 want: none is lost."""
    rows, want = [], 0
    for i in range(300):
        words = random_words((12, 20, 30, 60, 100)[i % 5] + i % 7, f"r{i}")
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(one_edit(words, i)))]
        want += jaccard(rows[-1][1], rows[-2][1]) >= 0.8
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(frame(spark, [(i, t, "en", "a", 0) for i, t in rows]), similarity=0.8).collect()}
    assert want > 100
    assert all(got[2 * i + 1] == 2 * i for i in range(300) if jaccard(rows[2 * i][1], rows[2 * i + 1][1]) >= 0.8)


def test_a_prefix_meets_whatever_is_similar():
    rnd = random.Random(4)
    common, often = np.arange(0, 400, 3, dtype=np.uint64), np.array([rnd.randrange(3, 50) for _ in range(0, 400, 3)])
    for _ in range(3000):
        x = set(rnd.sample(range(400), rnd.randint(1, 60)))
        y = (x - set(rnd.sample(sorted(x), rnd.randint(0, len(x) // 4)))) | set(rnd.sample(range(400), rnd.randint(0, 8)))
        if len(x & y) >= 0.8 * len(x | y):
            p, q = (simhash.prefix_of(np.array(sorted(s), dtype=np.uint64), common, often, 0.8)[0] for s in (x, y))
            assert set(p.tolist()) & set(q.tolist())


def test_rows_whose_parts_run_into_each_other_stay_apart(spark):
    text = prose(60, 3)
    rows = [("a|b", text), ("a", "b|" + prose(60, 9)), ("a", "b|" + text), (None, prose(50, 4)), ("null", prose(50, 4) + " more of it"), ("x", None), ("x", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert docs.select(row_key(docs)).distinct().count() == len(rows)
    kept = simhash.distinct_documents(docs, simhash.classes(docs))
    roots = simhash.classes(docs).select("root").distinct().count()
    assert kept.count() == roots


def test_common_shingles_decide_on_no_link(spark, monkeypatch):
    """Whatever shingles are told to be common, none or others, the classes are the same: they only order the prefixes."""
    base = [prose(60, s).split() for s in range(6)]
    rows = []
    for b in base:
        for k in range(4):
            w = list(b)
            w[k * 9] = f"edit{k}"
            rows.append((len(rows), " ".join(w if k else b), "en", "a", 0))
    docs = frame(spark, rows)
    classes = lambda: {r["doc_id"]: r["component_id"] for r in simhash.classes(docs, similarity=0.8).collect()}
    sampled = classes()
    every = np.unique(np.concatenate([simhash.shingle_hashes(r[1]) for r in rows]))
    for told in (every[:0], every[::2]):
        monkeypatch.setattr(simhash, "common_shingles", lambda *_, told=told: (told, np.arange(3, 3 + len(told))))
        assert classes() == sampled
