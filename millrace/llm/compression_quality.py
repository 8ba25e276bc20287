"""Operator 5: quality by compression.

Two zstandard dictionaries are built, from texts labelled good and from texts
labelled bad. A text is compressed with either, block by block; the difference
of the sizes, by the length of the text, says which kind it resembles. (Over
the sum of the sizes it says less: texts that repeat one word compress to almost
nothing either way, and their ratio is noise.) A logistic curve,
fitted on labelled texts that neither dictionary has seen, turns the difference
into a score.

Blocks start afresh from the dictionary: without them a long text would mostly
be compressed by what it said before, and the difference would fade. All blocks
of a text count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, small_batches, table

#: Bounds of the training sample, for each class: labelled texts for the dictionary, their bytes, and texts for the curve.
DICTIONARY_TEXTS = 2_000
DICTIONARY_BYTES = 4 << 20
CURVE_TEXTS = 4_000
DICTIONARY_SIZE = 112 << 10
BLOCK = 1 << 11
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in (good, bad):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO) if raw else None
        if d:
            d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
    return out


def difference(text: str | None, good: bytes, bad: bytes) -> float:
    """(size with the bad dictionary - size with the good one) / (bytes of the text + 64); 0 for an empty or null text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    g, b = (sum(len(c.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for c in _compressors(good, bad))
    return (b - g) / (len(raw) + 64) if raw else 0.0  # 64 more bytes, so that one byte of a few words does not weigh much


def dictionary(texts: list[str], size: int = DICTIONARY_SIZE) -> bytes:
    """A dictionary for blocks of the texts; of too few texts, their own last bytes; of none, none."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    blocks = [t[i : i + BLOCK] for t in raw for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:]


def curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (x, y), weighed as if `share` of the rows had y = 1; a slope of 0 if a class is missing."""
    if not 0 < y.sum() < len(y):
        return 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    w = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum())) * len(y)
    scale = max(float(np.std(x)), 1e-9)
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + np.eye(2) * 1e-2
        step = np.linalg.solve(h, a.T @ (w * (y - p)) - 1e-2 * beta)
        beta += step
        if abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def third(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text, modulo 3; rows with 1 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, dictionary_texts: int = DICTIONARY_TEXTS, dictionary_bytes: int = DICTIONARY_BYTES, curve_texts: int = CURVE_TEXTS) -> Model:
    """The model, from labelled rows that are not held out.

    Rows with remainder 0 make the dictionaries, rows with 2 the curve: of each
    class those with the least hashes of doc_id, up to the bounds. A text that
    would pass the bytes of a dictionary is left out, and those after it are
    looked at still. Null and contradicting labels are left out, as are null
    texts; an empty text is a point of the curve and nothing to a dictionary.
    A doc_id that stands in several rows counts once, with the text of least
    digest. Without labels, or without documents, every score is the share of
    good labels, or 0.5.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.where("quality = other").withColumn("third", third()).withColumn("order", F.xxhash64("doc_id"))
    chosen = None
    for remainder, most in ((0, dictionary_texts), (2, curve_texts)):
        for quality in (0, 1):
            part = known.where((F.col("third") == remainder) & (F.col("quality") == quality)).orderBy("order", "doc_id").limit(most)
            chosen = part if chosen is None else chosen.union(part)
    # Four bounded lists of numbers are broadcast; a row for each of them is what is kept of the documents.
    chosen = F.broadcast(checkpoint(chosen.select("doc_id", "quality", "third", "order")))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where("text IS NOT NULL")
    rows = checkpoint(rows.groupBy("doc_id", "quality", "third", "order").agg(F.min_by("text", F.md5("text")).alias("text")))
    train = rows.where("third = 0").select("quality", "order", "doc_id", F.octet_length("text").alias("bytes"), "text")
    left, kept = {0: dictionary_bytes, 1: dictionary_bytes}, []
    for r in train.select("quality", "order", "doc_id", "bytes").orderBy("order", "doc_id").collect():
        if r["bytes"] <= left[r["quality"]]:
            left[r["quality"]] -= r["bytes"]
            kept.append(r["doc_id"])
    keep = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in kept], rows.select("doc_id").schema))
    got = train.join(keep, "doc_id").orderBy("order", "doc_id").select("quality", "text").collect()
    good, bad = (dictionary([r["text"] for r in got if r["quality"] == q]) for q in (1, 0))
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([difference(t, good, bad) for t in texts], dtype=float)

    points = rows.where("third = 2").select("quality", measured("text").alias("x")).toPandas().sort_values(["x", "quality"])
    share = known.where("third = 2").agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return Model(good, bad, *curve(points["x"].to_numpy(dtype=float), (points["quality"] == 1).to_numpy(dtype=float), share if share is not None else 0.5))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (likelier good the higher), predicted.

    Only the text decides. Empty and null texts have the difference 0, and the
    score the curve gives it. Repeated rows score alike; an empty table gives
    no rows. A null doc_id is not held out.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            x = np.array([difference(t, m.good, m.bad) for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -30, 30))))

    rows = docs.select(F.col(key).alias("doc_id"), scored(F.col(text)).alias("score"))
    return rows.select("doc_id", F.coalesce(third() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id: int) -> bool:
    """What `third` says, for one number."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op5_compression_quality": op5_compression_quality}
ORACLES: dict[str, str] = {}
