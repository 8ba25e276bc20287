import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from millrace.llm import alignment as al

from .fixtures import documents, frame

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["  lead", "trail  \n", "a b c", "x ▁y z", "tab\tin  two  spaces", "日本語 テキスト 😀 ok", "<s> </s> <|endoftext|> <unk> <0x41>", "it's we'll they've", "é" * 300 + " " + "ab1" * 200, "\x00 \x1c a", "a b", " ", "\n", "1 22 333 4444", "ﬁne ½ ²"]


def whole(t):
    """Tokens of a whole text, None if the bytes are not given back; then groups and links by their places."""
    if not t:
        return None
    p = al.pieces(A, B)
    a, b, raw = p.a.encode(" " + t, add_special_tokens=False).ids, p.b.encode(t), (" " + t).encode()
    if b"".join(p.a_bytes[i] for i in a) != raw or b"".join(p.b_bytes[i] for i in b) != raw:
        return None

    def places(ids, names):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(names[i])))
            at = out[-1][2]
        return out

    x, y = places(a, p.a_bytes), places(b, p.b_bytes)
    ends = sorted({e for *_, e in x} & {e for *_, e in y})
    groups = [([i for i, s, e in x if low <= s and e <= high], [i for i, s, e in y if low <= s and e <= high]) for low, high in zip([0, *ends], ends)]
    return a, b, groups, [(i, j) for i, s, e in x for j, f, g in y if s < g and f < e]


def by_force(rows):
    found = [(i, whole(t)) for i, t, *_ in rows]
    counts = Counter(link for _, w in found if w for link in w[3])
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for i, w in found:
        if not w:
            out.append((i, 0, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = w
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(len(g) * len(h) for g, h in groups), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str), counts, found


def test_by_force(spark):
    rows = [r for r in documents() if len(r[1] or "") < 5000] + [(100 + i, t, "x", "a", 0) for i, t in enumerate(ODD)]
    want, counts, found = by_force(rows)
    docs = frame(spark, rows).withColumn("row", F.lit(1)).withColumn("pairs", F.lit(1)).withColumn("pair", F.lit(1))
    for broadcast in (10, 1 << 20):
        got = al.align(docs, A, B, rows=broadcast)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    shared = Counter((i, j) for _, w in found if w for g, h in w[2] for i in g for j in h)
    assert {(r["a_id"], r["b_id"]): r["n"] for r in al.shared_links(docs, A, B).collect()} == shared
    assert set(counts) <= set(shared)


def test_long_text_and_small_blocks(spark):
    t = " ".join(f"w{i}é{i * i}" for i in range(3000)) + "x" * 3000
    p = al.Pieces(A, B)
    said = p.aligned([t, None, "", t])
    p.apart = False
    p.forget()
    assert [(*x[:6], list(x[6])) for x in p.aligned([t, None, "", t])] == [(*x[:6], list(x[6])) for x in said]
    a, b = (np.array(x) for x in ([3, 1, 4, 1, 5], [2, 2, 4, 6]))
    for block in (1, 5, 100):
        i, j = al.overlaps(a, b, block)
        assert [*zip(i.tolist(), j.tolist())] == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 3), (4, 3)]


def test_products_are_those_of_dense_matrices():
    draw = np.random.default_rng(1)
    x, y = draw.integers(0, 2, (7, 9)), draw.integers(0, 2, (9, 5))
    rows = lambda m: al.Rows(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.nonzero(m)[1], m.shape[1])
    i, j, v = al.product(rows(x), rows(y))
    dense = np.zeros((7, 5), dtype=int)
    dense[i, j] = v
    assert (dense == x @ y).all()
    assert (al.row_sizes(rows(x), rows(y)) == (x @ y).sum(axis=1)).all()
    z = al.transposed(rows(x))
    assert al.product(z, rows(np.eye(7, dtype=int)))[0].tolist() == np.nonzero(x.T)[0].tolist()


def test_the_quick_encoder_is_the_files_own():
    p, draw = al.pieces(A, B), random.Random(2)
    texts = ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(0x300), draw.randrange(0xD800), draw.randrange(0x10000, 0x110000)])) for _ in range(60)) for _ in range(300)]
    texts += [f" a{chr(c)}b 1{chr(c)}2 {chr(c)} .{chr(c)}." for c in [*range(0x3000), *range(0xF000, 0x10000, 7)]] + ODD
    assert [p.quick.encode_ordinary(t) for t in texts] == [e.ids for e in p.a.encode_batch(texts, add_special_tokens=False)]


def test_pairs_with_very_many_times():
    code, times = np.array([5, 9]), np.array([3, 2 * al.MOST_TIMES + 1])
    got = al.packed(code, times)
    assert Counter({c: int(sum((got >> al.PAIR_BITS)[(got & ((1 << al.PAIR_BITS) - 1)) == c])) for c in (5, 9)}) == Counter({5: 3, 9: 2 * al.MOST_TIMES + 1})


def test_empty_table(spark):
    assert al.align(frame(spark, []), A, B).count() == 0
