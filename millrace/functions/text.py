"""Column expressions over text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a secret, and as a private path, in a record.
SECRETS = {
    "private_key": r"-----BEGIN (?:RSA |OPENSSH )?PRIVATE KEY-----",
    "prefixed_token": r"\b(?:sk|ghp|github_pat)_[A-Za-z0-9_-]{12,}\b",
    "access_key": r"\bAKIA[A-Z0-9]{16}\b",
    "vault_reference": r"\bop://",
}
PRIVATE_PATHS = {
    "home_path": r"/(?:Users|home)/[^/\s]+/",
    "windows_home_path": r"[A-Za-z]:\\Users\\[^\\\s]+\\",
    "env_file": r"(?:^|[/\\])\.env(?:$|[/\\\s])",
}
#: Found in generated corpora beside the above.
MORE_SECRETS = {"assigned_token": r'token = "[0-9a-f]{40}"', "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}


def sha256(c: Column) -> Column:
    """Hex digest of the UTF-8 bytes."""
    return F.sha2(c, 256)


def casefold(c: Column) -> Column:
    """The text as case-insensitive comparison wants it: ß is ss. Null stays null.

    lower() does that for ASCII; texts with other letters go through Python.
    """

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t.casefold())

    return F.when(F.regexp_like(c, F.lit(r"\A\p{ASCII}*\z")), F.lower(c)).otherwise(folded(c))


def fold(c: Column) -> Column:
    """casefold() without Python, for use within lambdas: the same but for dotless i, Cherokee and letters too young for Python's tables."""
    upper = F.translate(F.upper(c), "ẞ", "ß")  # also keeps the two conversions apart, of which one would be left out
    return F.replace(F.translate(F.lower(upper), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def _joined(c: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """Lower case, runs of Unicode white space as one space, none at the ends."""
    return _joined(F.lower(c))


def normalize_folded(c: Column) -> Column:
    """As normalize(), but with the case folded: what digests of a denylist are made of."""
    return _joined(casefold(c))


def fingerprint(c: Column) -> Column:
    return sha256(normalize(c))


def folded_fingerprint(c: Column) -> Column:
    return sha256(normalize_folded(c))


def tokens(c: Column) -> Column:
    """The set of lower-cased runs of a-z and 0-9, a plural s taken off those of four and more letters."""
    parts = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")
    stem = lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return F.array_distinct(F.transform(parts, stem))


#: What a text that a pattern finds must have, one of them: looked for first, as most texts have none.
LITERALS = {
    "private_key": ["PRIVATE KEY-----"], "prefixed_token": ["sk_", "ghp_", "github_pat_"], "access_key": ["AKIA"], "vault_reference": ["op://"], "home_path": ["/Users/", "/home/"], "windows_home_path": [":\\Users\\"], "env_file": [".env"],
    "assigned_token": ['token = "'], "email": ["@"],
}


def _matches(c: Column, name: str, pattern: str) -> Column:
    """Whether the pattern is found; false for null."""
    found = F.regexp_like(c, F.lit(pattern))
    may = None
    for x in LITERALS.get(name, []):
        may = c.contains(x) if may is None else may | c.contains(x)
    return F.coalesce(found if may is None else F.when(may, found), F.lit(False))


def flags(c: Column, patterns: dict[str, str]) -> list[Column]:
    """A boolean column for each pattern, by its name; false for null."""
    return [_matches(c, name, p).alias(name) for name, p in patterns.items()]


def leaks(c: Column) -> Column:
    """Whether a serialized record has a secret or a private path."""
    found = F.lit(False)
    for name, p in {**SECRETS, **PRIVATE_PATHS}.items():
        found = found | _matches(c, name, p)
    return found


def spans(c: Column) -> Column:
    """Runs without white space as structs of text, start and end (code points, end exclusive).

    An array cannot grow in place, so pieces are put together in blocks, whose
    number and size both stay small: a text of n pieces takes n^(4/3) steps.
    """
    kind = "array<struct<text:string,start:int,end:int>>"

    def placed(p: Column, at: Column) -> Column:
        """The spans of a block that begins there."""
        start = F.struct(at.alias("at"), F.array().cast(kind).alias("out"))
        one = lambda acc, x: F.array(F.struct(x.alias("text"), acc["at"].alias("start"), (acc["at"] + F.length(x)).alias("end")))
        step = lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.when(x == "", acc["out"]).otherwise(F.concat(acc["out"], one(acc, x))).alias("out"))
        return F.aggregate(p, start, step, lambda acc: acc["out"])

    def starts(blocks: Column) -> Column:
        """Where each block begins."""
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x) + 1))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(lengths, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def cut(p: Column) -> Column:
        size = F.ceil(F.cbrt(F.size(p))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), lambda k: F.slice(p, k * size + 1, size))

    # Each transform of an array of one is a name for its value, which lambdas would otherwise compute anew for each element.
    pieces = F.array(F.split(c, r"(?U)\s", -1))
    blocks = F.transform(pieces, cut)
    out = F.transform(blocks, lambda b: F.flatten(F.zip_with(b, starts(b), placed)))
    return F.get(out, F.lit(0))
