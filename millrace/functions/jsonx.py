"""Strict column expressions over JSON: closed key sets, exact types, canonical text.

Casting a variant is lenient (true becomes 1, "5" becomes 5), so every typed
access here asks for the value's own type first.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def variant(c: Column) -> Column:
    """The parsed value; null if the text is no JSON or repeats a key."""
    return F.try_parse_json(c)


def _schema(v: Column, path: str) -> Column:
    """The SQL type of what is there; of a scalar it costs little, of an array or an object all below it is gone through."""
    return F.schema_of_variant(v if path == "$" else F.try_variant_get(v, path, "variant"))


def kind(v: Column, path: str = "$") -> Column:
    """BIGINT, DECIMAL, DOUBLE, BOOLEAN, STRING, ARRAY, OBJECT, VOID (JSON null); null where nothing is."""
    return F.regexp_extract(_schema(v, path), "^[A-Z]+", 0)


def is_object(v: Column, path: str = "$") -> Column:
    """Whether an object is there: only one casts to a map, whatever its values are."""
    return F.try_variant_get(v, path, "map<string,boolean>").isNotNull()


def object_keys(v: Column, path: str = "$") -> Column:
    """The sorted keys of an object in a variant; null for anything else."""
    return F.sort_array(F.map_keys(F.try_variant_get(v, path, "map<string,boolean>")))


def keys(c: Column) -> Column:
    """The sorted keys of a JSON object; null for anything else."""
    return F.sort_array(F.json_object_keys(c))


def closed(c: Column, names: list[str]) -> Column:
    """Whether the object has these keys and no other."""
    return F.coalesce(keys(c) == F.lit(sorted(names)), F.lit(False))


def unknown_keys(c: Column, names: list[str]) -> Column:
    return F.array_except(keys(c), F.lit(sorted(names)))


def integer(v: Column, path: str) -> Column:
    """A value that is an integer, true and "5" not among them."""
    return F.when(_schema(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def number(v: Column, path: str) -> Column:
    return F.when(kind(v, path).isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(v, path, "double"))


def string(v: Column, path: str) -> Column:
    return F.when(_schema(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def filled(v: Column, path: str) -> Column:
    """Whether a string with more than white space is there."""
    return F.coalesce(F.trim(string(v, path)) != "", F.lit(False))


def canonical(c: Column) -> Column:
    """JSON text with sorted keys, for equality and grouping: 6.0 and 6 are the same."""
    return F.to_json(F.try_parse_json(c))


def items(v: Column, path: str) -> Column:
    """An array of a variant as an array of variants; null if it is none, which casts to no array."""
    return F.try_variant_get(v, path, "array<variant>")


def boolean(v: Column, path: str) -> Column:
    """A value that is true or false, no number or text among them."""
    return F.when(_schema(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


#: What json raises for a text that is none, or nested deeper than Python's stack.
NO_JSON = (ValueError, RecursionError)


def canonical_bytes(c: Column, ascii_only: bool = False) -> Column:
    """JSON text with sorted keys and no spaces, numbers as they were written: for digests. Null if it is no JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), ensure_ascii=ascii_only, sort_keys=True, separators=(",", ":"))
        except NO_JSON:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(c)


def leaves(value: object, keys: frozenset[str], key: str | None = None, protected: bool = False, path: str = "$") -> Iterator[tuple[str, str | None, str, bool]]:
    """(path, key, text, protected) of the strings below a value.

    A string below one of the keys is protected. Other strings that are JSON
    themselves are gone through in turn.
    """
    todo = [(value, key, protected, path)]
    while todo:
        v, k, p, at = todo.pop()
        if isinstance(v, dict):
            todo += [(x, name, p or name in keys, f"{at}.{name}") for name, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(x, k, p, f"{at}[{i}]") for i, x in reversed(list(enumerate(v)))]
        elif isinstance(v, str):
            yield at, k, v, p
            if not p:
                try:
                    inner = json.loads(v)
                except NO_JSON:
                    continue
                if isinstance(inner, (dict, list)):
                    todo.append((inner, None, False, f"{at}~"))


def json_leaves(c: Column, protected_keys: list[str]) -> Column:
    """The leaves of a JSON text as an array of structs path, key, value, protected; empty if it is no JSON."""
    names = frozenset(protected_keys)

    @F.pandas_udf("array<struct<path: string, key: string, value: string, protected: boolean>>")
    def walk(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            try:
                return [] if t is None else [dict(zip(("path", "key", "value", "protected"), x, strict=True)) for x in leaves(json.loads(t), names)]
            except NO_JSON:
                return []

        return texts.map(one)

    return walk(c)


def _parsed(t: str | None) -> object:
    """The value of a JSON text; None if it is none, or nested too deep to be read."""
    try:
        return None if t is None else json.loads(t)
    except NO_JSON:
        return None


def guarded(f: Callable[[object], object], otherwise: object) -> Callable[[object], object]:
    """f, or `otherwise` for a value nested too deep for it."""

    def run(v: object) -> object:
        try:
            return f(v)
        except RecursionError:
            return otherwise

    return run


def masked(c: Column, names: list[str], mask: str) -> Column:
    """JSON text with the values of these keys replaced, at any depth; canonical form. Null if it is no JSON."""
    hidden = frozenset(names)

    def rewrite(v: object) -> object:
        if isinstance(v, dict):
            return {k: mask if k in hidden else rewrite(x) for k, x in v.items()}
        return [rewrite(x) for x in v] if isinstance(v, list) else v

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_parsed).map(guarded(lambda v: None if v is None else json.dumps(rewrite(v), ensure_ascii=False, sort_keys=True, separators=(",", ":")), None))

    return run(c)


def count_keys(c: Column, names: list[str]) -> Column:
    """How often these keys occur, at any depth; 0 if it is no JSON."""
    wanted = frozenset(names)

    def count(v: object) -> int:
        if isinstance(v, dict):
            return sum((k in wanted) + count(x) for k, x in v.items())
        return sum(map(count, v)) if isinstance(v, list) else 0

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_parsed).map(guarded(count, 0)).astype("int64")

    return run(c)
