"""Operator 7: secrets by pattern, and by token efficiency.

Three patterns find secrets that say what they are. For those that do not, long
runs of letters, digits and signs are encoded with a byte-pair vocabulary:
language takes few tokens for its characters, random strings take many. Runs
that are known digests or identifiers are left out before.

The vocabulary's path is a parameter; each Python worker loads it once. Rows are
independent: nothing is shuffled, and a batch of texts bounds the memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Kinds in their order, with the least length of what counts (of group 2 where there is one).
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
#: A run of 32 or more is what [0-9a-f]+ with 32 or more characters finds: both are maximal runs from the left.
FAST_HEX = re.compile(r"[0-9a-f]{32,}")
RANDOM = "random"
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Fewer characters a token than this look random.
RATIO = 2.2
DIGEST = re.compile(r"(?:sha(?:1|224|256|384|512)[-=:_]?|md5[-=:_]?)?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
SRI = re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/]+={0,2}")
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.IGNORECASE)
#: Words or numbers joined by signs, each of one kind of character: names, paths, dates, versions.
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,14})(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,14}))*[+/_=-]*")
#: Names in camel case: words of three letters or more.
CAMEL = re.compile(r"[a-z]*(?:[A-Z][a-z]{2,})+[0-9]{0,4}")
#: The words of an identifier.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def looks_random(run: str, enc, ratio: float = RATIO) -> bool:
    """Whether a run is no known digest or identifier and takes a token for less than `ratio` characters; numbers alone are identifiers.

    Names, paths and words joined by signs are identifiers if each of their
    words is one token or passes the ratio itself: random letters of one case
    look like a word, but do not pass.
    """
    if not re.search("[A-Za-z]", run):
        return False
    if DIGEST.fullmatch(run) or SRI.fullmatch(run) or UUID.fullmatch(run.strip("-_=/+")):
        return False
    if IDENTIFIER.fullmatch(run) or CAMEL.fullmatch(run):
        counted = ((len(word), tokens_of(word, enc)) for word in PART.findall(run))
        if all(n == 1 or size >= ratio * n for size, n in counted):
            return False
    return len(run) < ratio * tokens_of(run, enc)


def tokens_of(run: str, enc) -> int:
    """A run's tokens. The encoder takes long time for one long run without breaks; pieces of 256 characters have the same ratio but for their ends."""
    return sum(len(enc.encode_ordinary(run[i : i + 256])) for i in range(0, len(run), 256))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of what the patterns find, in order."""
    found = []
    for place, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        for m in (FAST_HEX if kind == "hex" else pattern).finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), place, m.end()))
    return sorted(found)


def random_spans(text: str, taken: list[tuple[int, int, str]], enc, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """Runs that look random and that no base span overlaps."""
    found, i = [], 0
    covered: list[list[int]] = []  # the base spans, merged where they overlap
    for a, b in sorted((a, b) for a, _, b in taken):
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    for m in RUN.finditer(text):
        while i < len(covered) and covered[i][1] <= m.start():
            i += 1
        if (i == len(covered) or covered[i][0] >= m.end()) and looks_random(m[0], enc, ratio):
            found.append((m.start(), len(KINDS), m.end()))
    return found


def _said(spans: list[tuple[int, int, str]]) -> str:
    names = [*KINDS, RANDOM]
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, vocabulary: str, pattern: str, ratio: float = RATIO, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    A span is kind:start:end in code points of the text, its end exclusive;
    spans go by start, then kind. An empty or null text has none, and the
    digest of an empty string. Repeated rows are scanned alike; an empty table
    gives no rows; other columns do not matter.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<n_assign: long, n_access: long, n_hex: long, n_random: long, base_sha256: string, spans: string>")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary, pattern)
        for texts in batches:
            rows = []
            for t in texts:
                t = t or ""
                base = base_spans(t)
                more = random_spans(t, base, enc, ratio)
                n = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
                rows.append((*n, len(more), hashlib.sha256(_said(base).encode()).hexdigest(), _said(sorted(base + more))))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select(F.col(key).alias("doc_id"), scanned(F.col(text)).alias("found")).select("doc_id", "found.*")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op7_secrets": op7_secrets}
ORACLES: dict[str, str] = {}
