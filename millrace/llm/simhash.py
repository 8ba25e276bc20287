"""Operator 2: SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A, B, C of 22, 21 and 21 bits. If two
fingerprints differ in two bits at most, the errors fall (2, 0, 0) or (1, 1, 0)
over the segments or are fewer; either way one of the pairs (A, B), (B, C),
(C, A) has no error in its first segment and one at most in its second. So a
key is the first segment as it is with the number of the Golay codeword nearest
to the second. One side of the join has that key for each pair (three a
fingerprint); the other has also the codewords of all words one bit from the
second segment (about six numbers). Matches are verified by the bits
themselves; no link is lost, at about 33 bits of key.

Only distinct fingerprints are joined: copies of a text, however many, are one
row by then. A key shared by more than `crowd` fingerprints is not joined, as
its matches would grow with the square of the crowd. Two words within two bits
of each other have a word within one bit of both; every fingerprint with a
crowded key is listed under the 65 words within one bit of it, and those that
meet at a word are linked to the least of them: exact, and linear.

Texts that share four fifths of their five-word shingles can differ in a dozen
bits. `classes(similarity=0.8)` finds all of them too, by an exact join of the
distinct shingle sets with prefix and positional filters. Any one order of the
shingles gives all pairs; a sample of the texts tells which shingles are common
and go last, which decides on the speed only. Shingles that more than CROWD
prefixes have lead their sets to one of them first; what is not in one
component by then is compared in full, so that a crowd of near copies costs
little and none of its links is lost.

Components come from alternating large-star and small-star steps over the
links, each checkpointed in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golay
from .common import bounded, checkpoint, free, row_key, small_batches, table

MAX_BITS = 2
#: A key with more fingerprints than this goes the exact linear way.
CROWD = 64
#: Rows of the components' rounds in a file of a checkpoint.
EDGES_A_FILE = 500_000
#: Start and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Shingles hashed at a time, so that a very long text needs no more memory.
BLOCK = 1 << 15
#: Words in a shingle of the sets that are compared.
FIVE = 5
#: One text in so many is sampled for common shingles, of a table of this many texts or more; fewer are sampled less thinly.
SAMPLED, ENOUGH = 8, 20_000
#: A shingle is common if so many sampled texts have it; common shingles that are told to the tasks, at most.
OFTEN, COMMON = 3, 1 << 18
#: Characters of a text whose shingles are kept while others are compared with it.
KEPT = 1 << 13
#: What rounding may take from a bound.
EPS = 1e-6


def fingerprint_of(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of one text; 0 without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, BLOCK):
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(start, min(n, start + BLOCK))], dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int, *keep: str, text: str = "text") -> DataFrame:
    """The columns `keep` and fp, the fingerprint as a signed long; a null text is an empty one."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, words) for t in texts], dtype="uint64").astype("int64")

    return docs.select(*keep, fp(F.col(text)).alias("fp"))


def shingle_hashes(text: str | None, words: int = FIVE) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending; of fewer words than a shingle has, all are one.

    Each distinct word is hashed once; a shingle's hash is made of those of its
    words, one after the other.
    """
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]
    if not ids:
        return np.zeros(0, dtype=np.uint64)
    said = np.fromiter((xxhash.xxh64_intdigest(w, 5) for w in number), dtype=np.uint64, count=len(number))[ids]
    k = min(words, len(ids))
    n = len(ids) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ said[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def common_shingles(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles, ascending, and how many sampled texts have them. Copies of a text count once."""
    small_batches(docs.sparkSession)
    one_in = min(SAMPLED, docs.count() // ENOUGH + 1)
    some = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t).view(np.int64))], names=["shingle"])

    counts = checkpoint(some.mapInArrow(hashed, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN))
    total, least = 0, OFTEN
    for n, how_many in sorted(map(tuple, counts.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True):
        total, least = total + how_many, n
        if total > COMMON:
            least = n + 1
            break
    told = counts.where(F.col("n") >= least).toPandas()
    hashes = told["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], told["n"].to_numpy(dtype=np.int64)[order]


def prefix_of(hashes: np.ndarray, common: np.ndarray, often: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The rarest of the ascending hashes, one of which any set of that similarity has too, rarest first; how many of them are not common."""
    seen = np.zeros(len(hashes), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        seen = np.where(common[at] == hashes, often[at], 0)
    first = np.argsort(seen, kind="stable")[: len(hashes) - int(np.ceil(similarity * len(hashes) - EPS)) + 1]
    return hashes[first], int((seen[first] == 0).sum())


def shingle_sets(docs: DataFrame, words: int, similarity: float, *keep: str, text: str = "text") -> DataFrame:
    """What fingerprints() gives, and set (a digest of the five-word shingles, null without words), n (their number), prefix and rare (what prefix_of gives)."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text))  # of bounded size
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<fp: long, set: long, n: int, rare: int, prefix: array<long>>")
    def said(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common, often = shared.value
        for texts in batches:
            found = []
            for t in texts:
                hashes = shingle_hashes(t)
                prefix, rare = prefix_of(hashes, common, often, similarity)
                of = np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64) if len(hashes) else None
                found.append((np.uint64(fingerprint_of(t, words)).astype(np.int64), of, len(hashes), rare, prefix[: len(hashes)].view(np.int64)))
            yield pd.DataFrame(found, columns=["fp", "set", "n", "rare", "prefix"]).astype({"fp": "int64", "set": "Int64"})

    return docs.select(*keep, said(F.col(text)).alias("f")).select(*keep, "f.*")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the unsigned fps: their keys (3 each) and the rows they belong to, then the fuzzy keys and theirs."""
    own, wide, wide_rows = [], [], []
    rows = np.arange(len(fps))
    cut = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    for pair in range(3):
        exact, fuzzy, width = cut[pair], cut[(pair + 1) % 3], SEGMENTS[(pair + 1) % 3][1]
        head = (pair << 34) | (exact << 12)
        near = np.stack([golay.index(fuzzy), *(golay.index(fuzzy ^ (1 << i)) for i in range(width))], axis=1)
        own.append(head | near[:, 0])
        near = np.sort(near, axis=1)
        fresh = np.concatenate([np.ones((len(fps), 1), dtype=bool), near[:, 1:] != near[:, :-1]], axis=1)
        wide.append((head[:, None] | near)[fresh])
        wide_rows.append(np.broadcast_to(rows[:, None], near.shape)[fresh])
    return np.concatenate(own), np.tile(rows, 3), np.concatenate(wide), np.concatenate(wide_rows)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        own, own_rows, wide, wide_rows = keys_of(fps.view(np.uint64))
        for keys, rows, is_own in ((own, own_rows, True), (wide, wide_rows, False)):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows]), pa.array(np.full(len(keys), is_own))], names=["key", "fp", "own"])


def links(fps: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """Links a < b among the distinct values of the column fp.

    They connect whatever pairs within max_bits connect: pairs that share an
    uncrowded key come as they are, crowds by links to their least members.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys find pairs that differ in two bits at most")
    keyed = checkpoint(fps.select("fp").mapInArrow(_keyed, "key long, fp long, own boolean"))
    own, wide = keyed.where("own").select("key", "fp"), keyed.where("NOT own").select("key", "fp")
    crowded = checkpoint(own.groupBy("key").count().where(F.col("count") > crowd).select("key"))
    pair = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = own.join(crowded, "key", "left_anti").withColumnRenamed("fp", "a").join(wide.withColumnRenamed("fp", "b"), "key")
    found = found.where((F.col("a") != F.col("b")) & (pair <= max_bits)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    masks = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    if max_bits == 0:
        masks = F.array(F.lit(0).cast("long"))
    members = keyed.join(crowded, "key", "left_semi").select("fp").distinct()
    met = members.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word"))
    if max_bits == 1:  # words that are no members would join pairs two bits apart
        met = met.join(members.select(F.col("fp").alias("word")), "word", "left_semi")
    least = met.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    crowds = met.join(least, "word").where(F.col("fp") > F.col("a")).select("a", F.col("fp").alias("b"))
    return found.union(crowds).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of the edges (a, b) reaches, for nodes that are no root themselves.

    A star's centre gets the least of its neighbours by a partial aggregate,
    never a list of them. Rounds go on until no edge changes: their number grows
    with the logarithm of the longest way, and edges become fewer. A round is kept in as many files as its edges, which
    are never more than in the round before, want.
    """
    edges = checkpoint(edges.select("a", "b"))
    parts, mark = max(4, edges.count() // EDGES_A_FILE + 1), None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("x"), F.explode(F.array(F.col("a"), F.col("b"))).alias("y")).where("x < y").distinct()
        edges = checkpoint(small.toDF("a", "b").coalesce(parts))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = now


_kept_hashes = lru_cache(maxsize=512)(shingle_hashes)


def resemblance(a: str | None, b: str | None, words: int = FIVE) -> float:
    """The Jaccard similarity of two texts' sets of shingles, by their hashes of 64 bits; of fewer words than a shingle has, all are one."""
    x, y = ((_kept_hashes if len(t or "") < KEPT else shingle_hashes)(t, words) for t in (a, b))
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return both / (len(x) + len(y) - both)


def _meeting(similarity: float, crowd: int):
    """A function of batches of (shingle, set, n, rest) in the order of shingle: pairs (a, b) that can have the similarity, and the rows of shingles with more than `crowd`, b null."""
    share = similarity / (1 + similarity)

    def told(rows: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
        shingle, a, n, rest = rows
        return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.array(shingle), pa.array(n), pa.array(rest)], names=["a", "b", "shingle", "n", "rest"])

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        sizes = np.diff(np.concatenate([starts, [rows.shape[1]]]))
        of = np.repeat(sizes, sizes)
        if (of > crowd).any():
            yield told(rows[:, of > crowd])
        rows = rows[:, (of > 1) & (of <= crowd)]
        for apart in range(1, min(crowd, rows.shape[1])):
            x, y = rows[:, :-apart], rows[:, apart:]
            same = x[0] == y[0]
            if not same.any():
                break
            same &= np.minimum(x[3], y[3]) >= share * (x[2] + y[2]) - EPS
            if same.any():
                x, y = x[:, same], y[:, same]
                yield told(np.stack([x[0], np.minimum(x[1], y[1]), x[2], x[3]]), np.maximum(x[1], y[1]))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = np.zeros((4, 0), dtype=np.int64), None
        for b in batches:
            rows = np.concatenate([held, np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])], axis=1)
            if crowded is not None:
                more = rows[0] == crowded
                if more.any():
                    yield told(rows[:, more])
                    rows = rows[:, ~more]
            held = rows
            if not rows.shape[1]:
                continue
            end = int(np.searchsorted(rows[0], rows[0, -1]))
            if end:
                yield from pairs(rows[:, :end])
            held = rows[:, end:]
            if held.shape[1] > crowd:
                crowded = held[0, 0]
                yield told(held)
                held = held[:, :0]
        if held.shape[1]:
            yield from pairs(held)

    return met


def resembling(rows: DataFrame, texts: DataFrame, similarity: float, known: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links a < b of fingerprints that connect, with the links `known`, all texts that resemble each other by `similarity`.

    rows has row and what shingle_sets() gives; texts has row and text. One
    text stands for each shingle set. Two sets of the similarity have their
    first common shingle in both prefixes, and from there on as many shingles
    as their overlap wants: no pair is lost by that. Sets of a crowded shingle
    are compared with one of them, that with the rarest shingle's place nearest
    to the front; then those outside the largest component of the shingle with
    all of other components.
    """
    share = similarity / (1 + similarity)
    reps = rows.where("set IS NOT NULL").groupBy("set").agg(F.min("fp").alias("fp"), F.min("row").alias("row"), F.max("n").alias("n"), F.max("rare").alias("rare"), F.first("prefix").alias("prefix"))
    reps = checkpoint(reps)
    sets = reps.select("set", "fp", "row")
    same = rows.where("set IS NOT NULL").select("set", "fp").distinct().join(sets.select("set", F.col("fp").alias("a")), "set").where("fp <> a").select("a", F.col("fp").alias("b"))
    posts = reps.select("set", "n", "rare", F.posexplode("prefix").alias("i", "shingle"))
    posts = posts.select("shingle", "set", F.col("n").cast("long").alias("n"), (F.col("n") - F.col("i")).cast("long").alias("rest"), (F.col("i") >= F.col("rare")).alias("common"))
    columns = ["shingle", "set", "n", "rest"]
    met = posts.where("NOT common").select(*columns).repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_meeting(similarity, crowd), "a long, b long, shingle long, n long, rest long")
    met = checkpoint(met)

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([resemblance(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = checkpoint(pairs.where("a <> b").distinct())
        wanted = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(sets, "set"))
        small_batches(rows.sparkSession)
        # Both joins find the texts dealt out by their sets; they are shuffled once.
        told = texts.join(bounded(wanted), "row").groupBy("set").agg(F.first("fp").alias("fp"), F.first("text").alias("text"))
        both = pairs.join(told.toDF("a", "fa", "x"), "a").join(told.toDF("b", "fb", "y"), "b").where("fa <> fb")
        return checkpoint(both.where(alike("x", "y") >= similarity).select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).distinct())

    pairs = met.where("b IS NOT NULL").select("a", "b")
    crowds = checkpoint(posts.where("common").select(*columns).union(met.where("b IS NULL").select("shingle", "a", "n", "rest")))
    # Kept apart from the join, so that Spark can split a shingle with very many sets over several tasks there.
    heads = checkpoint(crowds.groupBy("shingle").agg(F.count("*").alias("m"), F.min(F.struct((F.col("n") - F.col("rest")).alias("i"), "set", "n")).alias("h")).where("m > 1").select("shingle", F.col("h.set").alias("b"), F.col("h.n").alias("bn")))
    stars = crowds.join(heads, "shingle").where(F.least("n", "bn") >= similarity * F.greatest("n", "bn") - EPS)
    found = same.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(verified(pairs.union(stars.select(F.least("set", "b"), F.greatest("set", "b")))))
    found = checkpoint(found)
    if crowds.isEmpty():
        return found

    roots = components(known.select("a", "b").union(found))
    placed = crowds.join(sets.select("set", "fp"), "set").join(roots, F.col("fp") == F.col("node"), "left").select(*columns, F.coalesce("root", "fp").alias("root"))
    placed = checkpoint(placed)
    largest = placed.groupBy("shingle", "root").agg(F.count("*").alias("m")).groupBy("shingle").agg(F.max(F.struct("m", "root")).alias("g"), F.count("*").alias("k"))
    apart = checkpoint(placed.join(largest.where("k > 1").select("shingle", F.col("g.root").alias("giant")), "shingle"))
    other = apart.select("shingle", *[F.col(c).alias(f"b_{c}") for c in ("set", "n", "rest", "root")])
    fits = F.least("rest", "b_rest") >= share * (F.col("n") + F.col("b_n")) - EPS
    left = apart.where("root <> giant").join(other, "shingle").where((F.col("root") != F.col("b_root")) & fits & ((F.col("b_root") == F.col("giant")) | (F.col("set") < F.col("b_set"))))
    return found.union(verified(left.select(F.least("set", "b_set").alias("a"), F.greatest("set", "b_set").alias("b"))))


def classes(docs: DataFrame, words: int = 3, max_bits: int = MAX_BITS, key: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """row (a digest of key and text), doc_id, fp, root, component_id: one row for each row of docs.

    With `similarity`, texts that share that much of their five-word shingles
    are linked too. Fewer words than a shingle has are one shingle; no words
    (null, empty, blank texts) give fingerprint 0, and no shingle set, so that
    they resemble each other alone. Null ids count as no id. Repeated rows have
    the same row, and come out as often as they went in; an empty table gives
    no rows.
    """
    keyed = docs.select(row_key(docs, key, text).alias("row"), docs[key].alias("doc_id"), docs[text].alias("text"))
    rows = checkpoint(shingle_sets(keyed, words, similarity, "row", "doc_id") if similarity else fingerprints(keyed, words, "row", "doc_id"))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = links(distinct, max_bits)
    if similarity:
        found = checkpoint(found)
        found = found.union(resembling(rows, keyed.select("row", "text"), similarity, found))
    stars = components(found)
    rooted = distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # Kept apart from the join, so that Spark can split a component of very many fingerprints over several tasks there.
    ids = checkpoint(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    return rows.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp").select("row", "doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = MAX_BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id that links reach. Fewer words than a
    shingle has are one shingle; no words (empty or null texts) give
    fingerprint 0, which links like any other. Null doc_ids count as no id: a
    component with none has a null component_id. Repeated rows come out as
    often as they went in; an empty table gives no rows.
    """
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return classes(docs, words, max_bits, key, text).select("doc_id", hexed.alias("fingerprint"), "component_id")


def distinct_documents(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs less all but one of each class; found has row, doc_id, root.

    The least doc_id stays, null last. Of rows that repeat key and text one stays.
    """
    found = checkpoint(found.select("row", "doc_id", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    # Kept apart from the join, so that Spark can split a class with very many rows over several tasks there.
    stays = checkpoint(found.groupBy("root").agg(F.min(order).alias("s")).select("root", F.col("s.row").alias("stays")))
    lost = bounded(checkpoint(found.join(stays, "root").where("row <> stays").select("row").distinct()))
    again = bounded(checkpoint(found.groupBy("row").count().where("count > 1").select("row")))
    row = free(docs, "row")
    kept = docs.withColumn(row, row_key(docs, key, text)).join(lost.withColumnRenamed("row", row), row, "left_anti")
    again = again.withColumnRenamed("row", row)
    return kept.join(again, row, "left_anti").union(kept.join(again, row, "left_semi").dropDuplicates([row])).drop(row)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}
