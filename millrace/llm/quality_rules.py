"""Operator 10: quality rules, and gradient-boosted trees over document statistics.

A document's statistics are counted in one pass over its whole text. Two rules
on them reject outright; what they pass, trees judge that are trained here on a
bounded sample of labelled documents. The model is a few thousand numbers,
which the scoring tasks get with their code.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbdt
from .common import checkpoint, small_batches, table

ASCII_RUN = re.compile(r"[\x00-\x7f]+")
UPPER = bytes(range(65, 91))
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Labelled documents for training, at most.
SAMPLE = 20_000
#: A document is rejected if the trees put the probability of bad quality above this.
REJECT = 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_word_lines", "n_distinct_words", "n_upper", "n_alpha", "n_digits", "n_marks", "n_ends", "longest_word")
#: Features and how the probability of bad quality may move with them: 1 only up, -1 only down, 0 freely.
FEATURES = {"log_words": 0, "word_length": 0, "longest_word": 0, "symbols": 1, "dup_lines": 1, "repeated": 1, "distinct": -1, "upper": 1, "digits": 1, "marks": 1, "line_ends": 0, "words_a_line": 0}


def statistics_of(text: str | None) -> tuple:
    """BASE and MORE of one text; words are runs without ASCII white space."""
    text = text or ""
    raw, rest = text.encode("utf-8", "surrogatepass"), ASCII_RUN.sub("", text)
    words = raw.split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    repeated = 0
    if n >= 3:
        kinds = ids[:-2] * len(number) + ids[1:-1]
        if len(number) > 1 << 20:  # else the product of three fits in 63 bits
            kinds = np.unique(kinds, return_inverse=True)[1].reshape(-1)
        kinds = kinds * len(number) + ids[2:]
        _, which, often = np.unique(kinds, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(often[which.reshape(-1)] > 1)
        covered = np.zeros(n, dtype=bool)
        for i in range(3):
            covered[twice + i] = True
        repeated = int(covered.sum())
    lines = text.split("\n")
    worded = Counter(line for line in lines if line.encode("utf-8", "surrogatepass").split())
    of = lambda kind, test: len(raw) - len(raw.translate(None, kind)) + sum(map(test, rest))
    return (
        n,
        len(text) - sum(text.count(c) for c in " \t\n\v\f\r"),
        len(SYMBOLS.findall(text)),
        sum(worded.values()) - len(worded),
        repeated,
        len(lines),
        sum(worded.values()),
        len(number),
        of(UPPER, str.isupper),
        of(UPPER + UPPER.lower(), str.isalpha),
        of(b"0123456789", str.isdigit),
        text.count("!") + text.count("?"),
        sum(line.rstrip().endswith((".", "!", "?", ":", '"')) for line in worded),
        max(map(len, words), default=0),
    )


def statistics(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns `keep` of docs and a struct `stats` of BASE and MORE."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<" + ", ".join(f"{c}: long" for c in BASE + MORE) + ">")
    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics_of(t) for t in texts], columns=[*BASE, *MORE], dtype="int64")

    return docs.select(*keep, stats(F.col(text)).alias("stats"))


def features(s: pd.DataFrame) -> np.ndarray:
    per = lambda a, b: s[a] / np.maximum(s[b], 1)
    columns = {
        "log_words": np.log1p(s["n_words"]),
        "word_length": per("word_chars", "n_words"),
        "longest_word": np.log1p(s["longest_word"]),
        "symbols": per("n_symbols", "word_chars"),
        "dup_lines": per("n_dup_lines", "n_word_lines"),
        "repeated": per("n_repeat_words", "n_words"),
        "distinct": per("n_distinct_words", "n_words"),
        "upper": per("n_upper", "n_alpha"),
        "digits": per("n_digits", "word_chars"),
        "marks": per("n_marks", "n_words"),
        "line_ends": per("n_ends", "n_word_lines"),
        "words_a_line": np.log1p(per("n_words", "n_word_lines")),
    }
    return np.stack([np.asarray(columns[k], dtype=float) for k in FEATURES], axis=1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> gbdt.Trees:
    """Trees for the probability that a document's label `quality` is 0.

    Learns from `sample` labelled rows at most, those with the least hashes of
    their doc_id; labels that are null or contradict each other are left out.
    A doc_id that stands in several rows counts once, with the text of least
    digest; a null text is an empty one. Only their statistics come to the
    driver (14 numbers for each of the sample). Without labels, or without
    documents, the trees say the same of every document.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    chosen = known.where("quality = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "quality")
    # At most `sample` pairs of numbers are broadcast.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(checkpoint(chosen)), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.md5("text")).alias("text"))
    got = statistics(rows, "doc_id", "quality").select("doc_id", "quality", "stats.*").toPandas().sort_values(["doc_id", *BASE])
    return gbdt.train(features(got), (got["quality"] == 0).to_numpy(dtype=float), np.array(list(FEATURES.values())))


def judge(docs: DataFrame, trees: gbdt.Trees, *keep: str, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The columns `keep`, BASE, bad (probability of bad quality), base_failed and kept, a row for each row of docs.

    Empty and null texts have no words and fail the base rule, which wants 50.
    Repeated rows are judged alike; an empty table gives no rows.
    """

    @F.pandas_udf("double")
    def bad(stats: pd.DataFrame) -> pd.Series:
        return pd.Series(trees.probability(features(stats)))

    judged = statistics(docs, *keep, text=text).withColumn("bad", bad("stats"))
    s = F.col("stats")
    failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    return judged.select(*keep, *[s[c].alias(c) for c in BASE], "bad", failed.alias("base_failed"), (~failed & (F.col("bad") <= reject)).alias("kept"))


def kept_rows(docs: DataFrame, trees: gbdt.Trees, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of docs that judge() keeps, with the columns of docs.

    Empty and null texts go, having fewer than 50 words; repeated rows all stay
    or all go; null ids do not matter.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        s = pd.DataFrame([statistics_of(t) for t in texts], columns=[*BASE, *MORE], dtype="int64")
        failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
        return ~failed & (trees.probability(features(s)) <= reject)

    return docs.where(keep(docs[text]))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")), "doc_id").select("doc_id", *BASE, "base_failed", "kept", "bad")


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES: dict[str, str] = {}
