"""Operator 13: alignment of two tokenizers by sparse products of incidence matrices.

The bytes of a text are the columns of two matrices with a row for each token
of A and of B. The product of the one with the other's transpose has an entry
where two tokens share bytes: an overlap link. Where tokens of both end at the
same byte the text falls into groups; tokens by groups, multiplied likewise,
link what shares a group. Matrices are compressed rows made by hand, and
products go row by row after Gustavson: the rows of the second that a row's
entries name, summed up; here those of all rows at once.

Neither tokenizer looks past a space between two other characters: A begins a
word there by its pattern, and no piece of B has a space after anything else
(`Pieces.apart` looks). So a text is cut there, each different part is encoded
and aligned once in a worker, and a text is the sum of its parts. Parts without
a space have any length; their products are made in blocks that end with a
group.

A text's pairs of ids come with it to a table in the shared folder. Their
counts in the corpus are sums by pair; each text then looks up its own. The
most frequent pairs, as many as may be broadcast, are looked up where the table
is read; the others are joined, and none of those is frequent enough to be hot.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpoint, delete_path, fresh_path, small_batches, table

#: A space between characters that are neither white space nor B's sign for a space.
BETWEEN = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
#: A part that can stand between two spaces and be told apart again.
PLAIN = re.compile("[^\\s▁](?:.*[^\\s▁])?", re.DOTALL)
#: Such parts that are encoded as one text.
TOGETHER = 4096
#: How byte-level vocabularies of this kind cut a text: a fixed pattern.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes in a block of a product, but for a longer group.
BLOCK = 1 << 18
#: Characters of the parts that a worker keeps, before those of one batch; a longer part than the other is encoded alone.
KEPT, LONG = 3_000_000, 256
#: Bits for a pair of ids, and times that a pair has in one number.
PAIR_BITS, MOST_TIMES = 36, (1 << 27) - 1
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]
LINKS = COUNTS.index("n_links")


class Rows(NamedTuple):
    """A sparse matrix of ones: the columns of row i are column[start[i]:start[i + 1]]."""

    start: np.ndarray
    column: np.ndarray
    width: int


def spans(lengths: np.ndarray) -> Rows:
    """Tokens by bytes, of tokens that follow each other."""
    start = np.concatenate([[0], np.cumsum(lengths)])
    return Rows(start, np.arange(start[-1]), int(start[-1]))


def members(groups: np.ndarray, width: int) -> Rows:
    """Tokens by groups, each token in one."""
    return Rows(np.arange(len(groups) + 1), groups, width)


def transposed(m: Rows) -> Rows:
    rows = np.repeat(np.arange(len(m.start) - 1), np.diff(m.start))
    start = np.concatenate([[0], np.cumsum(np.bincount(m.column, minlength=m.width))])
    return Rows(start, rows[np.argsort(m.column, kind="stable")], len(m.start) - 1)


def row_sizes(a: Rows, b: Rows) -> np.ndarray:
    """How many products each row of a with b sums up."""
    sums = np.concatenate([[0], np.cumsum(np.diff(b.start)[a.column])])
    return np.diff(sums[a.start])


def product(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the entries of a times b, by rows, then columns."""
    many = np.diff(b.start)[a.column]
    rows = np.repeat(np.repeat(np.arange(len(a.start) - 1), np.diff(a.start)), many)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(b.start[a.column], many)
    place = rows * b.width + b.column[at]
    if (place[1:] < place[:-1]).any():
        place = np.sort(place)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, dtype=np.int64)
    value = np.diff(np.concatenate([first, [len(place)]]))
    return place[first] // max(b.width, 1), place[first] % max(b.width, 1), value


def blocks(a: np.ndarray, b: np.ndarray, block: int = BLOCK) -> Iterator[tuple[slice, slice]]:
    """The tokens of a and of b, whose ends these are, in blocks that end with a group and have so many bytes, or a single group."""
    common = np.intersect1d(a, b, assume_unique=True)
    if not len(common):
        return
    cuts = np.unique(common[np.minimum(np.searchsorted(common, np.arange(block, common[-1] + block, block)), len(common) - 1)])
    i, j = (np.concatenate([[0], np.searchsorted(x, cuts, side="right")]) for x in (a, b))
    for k in range(len(cuts)):
        yield slice(i[k], i[k + 1]), slice(j[k], j[k + 1])


def overlaps(a: np.ndarray, b: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The places of the tokens of a and b, whose lengths these are, that share bytes; in order. Both have the same bytes."""
    found = [(np.zeros(0, dtype=np.int64),) * 2]
    for i, j in blocks(np.cumsum(a), np.cumsum(b), block):
        x, y, _ = product(spans(a[i]), transposed(spans(b[j])))
        found.append((x + i.start, y + j.start))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def shared(a: np.ndarray, b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the tokens of a and b, whose groups these are, that share a group."""
    x, y, _ = product(members(a, groups), transposed(members(b, groups)))
    return x, y


@lru_cache(maxsize=1)
def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary is: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked(path: str):
    """A quicker encoder of a byte-level vocabulary whose ids are in the order of its merges; None for others.

    It gives what the file's own library gives: tests compare both by texts and by single code points.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    if told.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or model.get("dropout") or model.get("ignore_merges"):
        return None
    letters, vocabulary = _letters(), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocabulary.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)):
        return None
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class Aligned(NamedTuple):
    """Parts, whether both tokenizers give their bytes, their COUNTS and groups as text (each ends in ';'), and where the codes of their linked pairs begin."""

    parts: list[str]
    right: np.ndarray
    counts: np.ndarray
    said: list[str]
    first: np.ndarray
    code: np.ndarray

    def then(self, more: Aligned) -> Aligned:
        self.parts.extend(more.parts)
        self.said.extend(more.said)
        first = np.concatenate([self.first, more.first[1:] + len(self.code)])
        return Aligned(self.parts, np.concatenate([self.right, more.right]), np.concatenate([self.counts, more.counts]), self.said, first, np.concatenate([self.code, more.code]))


class Pieces:
    """Both tokenizers of a worker, the bytes of their tokens, and the parts that are aligned already."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.quick = ranked(a)
        letters, vocabulary = _letters(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[1:-1], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.apart = not any(re.search("[^▁]▁", x) for x in names)
        self.a_size, self.b_size = (np.array([*map(len, x)], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        if len(self.a_bytes) * len(self.b_bytes) > 1 << PAIR_BITS:
            raise ValueError("the vocabularies are too large")
        # What is said of an id when another follows in its half of a group, and when none does.
        sizes = len(self.a_bytes), len(self.b_bytes)
        self.said = [f"{i}," for n in sizes for i in range(n)] + [f"{i}{end}" for n, end in zip(sizes, "|;", strict=True) for i in range(n)]
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, dtype=np.int64)
        self.place: dict[str, int] = {}
        self.known, self.held = Aligned([], none.astype(bool), np.zeros((0, len(COUNTS)), dtype=np.int64), [], np.zeros(1, dtype=np.int64), none), 0

    def parts(self, text: str) -> list[str]:
        return BETWEEN.split(text) if self.apart else [text]

    def _encode(self, texts: list[str], way: str) -> list[list[int]]:
        if way == "b":
            return self.b.encode(texts, num_threads=1)
        if self.quick and max(map(len, texts)) <= LONG:  # of long texts it takes the square
            return [self.quick.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def _encoded(self, plain: list[str], odd: list[str], way: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all parts, how many each has, and whether its tokens have the bytes of space and part.

        Plain parts can stand beside each other and be told apart again; they are encoded as one text.
        """
        names, size = (self.a_bytes, self.a_size) if way == "a" else (self.b_bytes, self.b_size)
        ids, many, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=bool)]
        single = [*odd]
        for start in range(0, len(plain), TOGETHER):
            some = plain[start : start + TOGETHER]
            text = " ".join(some)
            got = self.quick.encode_ordinary(" " + text) if way == "a" and self.quick else self._encode([text], way)[0]
            got_ids = np.array(got, dtype=np.int64)
            bounds = np.cumsum([len(p.encode()) + 1 for p in some])
            ends = np.cumsum(size[got_ids])
            at = np.searchsorted(ends, bounds)
            if b"".join([names[i] for i in got]) == b" " + text.encode() and (ends[at] == bounds).all():
                ids.append(got_ids)
                many.append(np.diff(np.concatenate([[-1], at])))
                right.append(np.ones(len(some), dtype=bool))
            else:
                self._alone(some, way, names, ids, many, right)
        if single:
            self._alone(single, way, names, ids, many, right)
        return np.concatenate(ids), np.concatenate(many), np.concatenate(right)

    def _alone(self, parts: list[str], way: str, names: list[bytes], ids: list, many: list, right: list) -> None:
        got = self._encode(parts, way)
        ids.append(np.array([i for x in got for i in x], dtype=np.int64))
        many.append(np.array([*map(len, got)], dtype=np.int64))
        right.append(np.array([b"".join([names[i] for i in x]) == b" " + p.encode() for x, p in zip(got, parts, strict=True)], dtype=bool))

    def align(self, parts: list[str]) -> Aligned:
        """The different parts, aligned; not in their order."""
        plain = [p for p in parts if len(p) <= LONG and self.apart and PLAIN.fullmatch(p)]
        kept = {*plain}
        odd = [p for p in parts if p not in kept]
        (a, many_a, right_a), (b, many_b, right_b) = self._encoded(plain, odd, "a"), self._encoded(plain, odd, "b")
        right = right_a & right_b
        a, b = a[np.repeat(right, many_a)], b[np.repeat(right, many_b)]
        many_a, many_b = many_a * right, many_b * right
        len_a, len_b = self.a_size[a], self.b_size[b]
        end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        x, y = overlaps(len_a, len_b)
        code = a[x] * len(self.b_bytes) + b[y]
        alike = row_sizes(members(of_a, len(common)), transposed(members(of_b, len(common))))
        # Groups as text: a group's tokens of A, then those of B.
        half = np.concatenate([2 * of_a, 2 * of_b + 1])
        order = np.argsort(half, kind="stable")
        half = half[order]
        last = np.concatenate([half[1:] != half[:-1], [True]]) if len(half) else np.zeros(0, dtype=bool)
        said = [self.said[i] for i in (np.concatenate([a, b + len(self.a_bytes)])[order] + last * (len(self.said) // 2)).tolist()]
        # Where each part's tokens, groups and links begin.
        at_a, at_b = (np.concatenate([[0], np.cumsum(m)]) for m in (many_a, many_b))
        group = np.concatenate([of_a, [len(common)]])[at_a]
        link = np.searchsorted(x, at_a)
        alike = np.concatenate([[0], np.cumsum(alike)])[at_a]
        words = (at_a + at_b).tolist()
        texts = ["".join(said[i:j]) for i, j in zip(words, words[1:])]
        counts = np.stack([many_a, many_b, *(np.diff(c) for c in (group, link, alike))], axis=1)
        return Aligned(plain + odd, right, counts, texts, link, code)

    def aligned(self, texts: list[str | None]) -> list[tuple]:
        """For each text the COUNTS, the digest of its groups, and its pairs: times and code in one number each."""
        parts = [self.parts(t) if t else [] for t in texts]
        if self.held > KEPT:
            self.forget()
        new = self.align([*{p: 0 for of in parts for p in of if p not in self.place}])
        self.place |= zip(new.parts, range(len(self.known.parts), len(self.known.parts) + len(new.parts)), strict=True)
        self.held += sum(map(len, new.parts))
        k = self.known = self.known.then(new)
        out = []
        for of in parts:
            at = np.array([self.place[p] for p in of], dtype=np.int64)
            if not len(at) or not k.right[at].all():
                out.append((0, 0, 0, 0, 0, "", []))
                continue
            counts = k.counts[at]
            many = counts[:, LINKS]
            each = np.repeat(k.first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            code, times = np.unique(k.code[each], return_counts=True)
            said = "".join([k.said[i] for i in at.tolist()])
            out.append((*counts.sum(axis=0).tolist(), hashlib.sha256(said[:-1].encode()).hexdigest(), packed(code, times)))
        return out


def packed(code: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Times above the code's bits; a pair of more times than fit has several numbers."""
    out = []
    while len(code):
        now = np.minimum(times, MOST_TIMES)
        out.append(now << PAIR_BITS | code)
        code, times = code[times > now], (times - now)[times > now]
    return np.concatenate(out) if out else code


@lru_cache(maxsize=2)
def pieces(a: str, b: str) -> Pieces:
    return Pieces(a, b)


def aligned(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, the COUNTS, groups_sha256, pairs for each row of docs."""
    small_batches(docs.sparkSession)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pieces(a, b)
        for batch in batches:
            rows = both.aligned(batch.column(2).to_pylist())
            columns = [*zip(*rows, strict=True)] if rows else [()] * (len(COUNTS) + 2)
            arrays = [pa.array(c, pa.int64()) for c in columns[: len(COUNTS)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays, pa.array(columns[-2], pa.string()), pa.array(columns[-1], pa.list_(pa.int64()))], names=["row", "doc_id", *COUNTS, "groups_sha256", "pairs"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("doc_id"), docs[text].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(told, f"row long, doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, pairs array<long>")


def linked(found: DataFrame) -> DataFrame:
    """row, pair, times of what aligned() gives."""
    pairs = found.select("row", F.explode("pairs").alias("p"))
    return pairs.select("row", F.col("p").bitwiseAND((1 << PAIR_BITS) - 1).alias("pair"), F.shiftright("p", PAIR_BITS).alias("times"))


def pair_counts(links: DataFrame, b_size: int) -> DataFrame:
    """pair, n (its links in the corpus), best (1 if its B id has no pair of more, else 0)."""
    counts = checkpoint(links.groupBy("pair").agg(F.sum("times").alias("n")))
    of_b = F.col("pair") % b_size
    most = checkpoint(counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("most")))
    # One row an id of a vocabulary.
    counts = counts.withColumn("b", of_b).join(F.broadcast(most), "b")
    return counts.select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def frequent(counts: DataFrame, rows: int = BROADCAST_ROWS) -> int:
    """The least power of two that `rows` pairs at most reach; 0 if that is all of them."""
    power = F.length(F.bin("n"))
    sizes = dict(counts.groupBy(power.alias("power")).count().collect())  # 64 at most
    total = 0
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > rows:
            return 1 << p
    return 0


def scored(links: DataFrame, counts: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """row, n_best, count_sum: sums over a row's links."""
    counts = checkpoint(counts)
    least = frequent(counts, rows)
    common = F.broadcast(counts.where(F.col("n") >= least))
    sums = [F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    found = links.join(common, "pair").groupBy("row").agg(*sums)
    if least:
        rare = links.join(common, "pair", "left_anti").join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(*sums)
        found = found.union(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256.

    a is the file of a byte-level tokenizer, b that of a sentencepiece model
    that puts a space before a text. n_links counts overlap links, n_shared
    pairs of a group. A null or empty text, and one whose bytes either
    tokenizer does not give back, has no tokens: zeros, and no digest. Repeated
    rows count each time, in the corpus too; null keys stay; an empty table
    gives no rows; other columns do not matter.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "alignment")
    aligned(docs, a, b, key, text).write.option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    links = linked(found)
    sums = scored(links, pair_counts(links, len(pieces(a, b).b_bytes)), rows)
    none = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    out = checkpoint(found.drop("pairs").join(sums, "row", "left").select("doc_id", *COUNTS, *none, "groups_sha256"))
    delete_path(spark, path)  # what is read of it stands in a checkpoint
    return out


def shared_links(docs: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """a_id, b_id, n: how often two tokens share a group, in all texts that both tokenizers give back."""
    small_batches(docs.sparkSession)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pieces(a, b)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                parts = both.parts(t) if t else []
                k = both.align([*{*parts}])
                if not k.right.all():
                    continue
                said_of = dict(zip(k.parts, k.said, strict=True))
                for said in (said_of[p] for p in parts):
                    ids = [[[*map(int, s.split(","))] for s in g.split("|")] for g in said[:-1].split(";")]
                    x, y = ([i for g in ids for i in g[w]] for w in (0, 1))
                    of = [np.repeat(np.arange(len(ids)), [len(g[w]) for g in ids]) for w in (0, 1)]
                    i, j = shared(*of, len(ids))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(x)[i], pa.int64()), pa.array(np.array(y)[j], pa.int64())], names=["a_id", "b_id"])

    return docs.select(text).mapInArrow(told, "a_id long, b_id long").groupBy("a_id", "b_id").agg(F.count("*").alias("n"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op13_alignment": op13_alignment}
ORACLES: dict[str, str] = {}
