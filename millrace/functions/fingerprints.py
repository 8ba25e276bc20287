"""Digests that find copies of records whose ids were changed: column expressions over a record's JSON text."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsonx
from . import text as T
from .jsonx import items

#: The keys whose values are masked, and the form of a catalog key.
EXTERNAL = ["tmdbId", "tvdbId"]
CATALOG_KEY = r'"(?:movie|series):[a-z0-9_-]+:[A-Za-z0-9._-]+"'


def intent(record: Column) -> Column:
    """A case's intent, or a trace's first user message."""
    v = jsonx.variant(record)
    users = F.filter(items(v, "$.messages"), lambda m: F.coalesce(jsonx.string(m, "$.role") == "user", F.lit(False)))
    return F.coalesce(jsonx.string(v, "$.intent"), jsonx.string(v, "$.intent.description"), F.get(F.transform(users, lambda m: jsonx.string(m, "$.content")), F.lit(0)))


def _calls(record: Column) -> Column:
    made = F.transform(items(jsonx.variant(record), "$.messages"), lambda m: F.coalesce(items(m, "$.toolCalls"), F.array().cast("array<variant>")))
    return F.flatten(made)


def steps(record: Column, with_results: bool = True) -> Column:
    """JSON texts of what a record asks, in order: its script, or its calls, with what each was answered.

    A call without answer has a mark in its place.
    """
    v = jsonx.variant(record)
    sub = lambda x, p: F.to_json(F.try_variant_get(x, p, "variant"))
    answers = F.filter(items(v, "$.messages"), lambda m: F.coalesce(jsonx.string(m, "$.role") == "tool", F.lit(False)))
    answer = lambda c: F.get(F.transform(F.filter(answers, lambda m: F.coalesce(jsonx.string(m, "$.toolCallId") == jsonx.string(c, "$.id"), F.lit(False))), lambda m: sub(m, "$.content")), F.lit(0))
    pair = lambda a, r: F.concat(F.lit('{"arguments":'), a, F.lit(',"result":'), r, F.lit("}"))
    called = F.transform(_calls(record), lambda c: pair(sub(c, "$.arguments"), F.coalesce(answer(c), F.lit('{"unresolved":true}'))) if with_results else sub(c, "$.arguments"))
    scripted = F.transform(items(v, "$.script"), lambda s: pair(sub(s, "$.arguments"), F.coalesce(sub(s, "$.result"), F.lit("null"))) if with_results else sub(s, "$.arguments"))
    return F.coalesce(scripted, called)


def semantic_digest(record: Column, with_results: bool = True) -> Column:
    """SHA-256 over the normalized intent and the steps with ids and catalog keys masked: relabelled copies collide."""
    masked = F.array_join(steps(record, with_results), ",")
    for k in EXTERNAL:
        masked = F.regexp_replace(masked, rf'"{k}":(?:"[^"]*"|[^,}}\]]+)', f'"{k}":"#"')
    masked = F.regexp_replace(masked, CATALOG_KEY, '"#"')
    return T.sha256(F.concat_ws("\n", T.normalize(F.coalesce(intent(record), F.lit(""))), masked))


def identities(record: Column) -> Column:
    """The distinct candidates (media:id) that a record's script or tool results surface."""
    v = jsonx.variant(record)
    none = F.array().cast("array<variant>")
    of = lambda path, inner: F.flatten(F.transform(F.coalesce(items(v, path), none), lambda x: F.coalesce(items(x, inner), none)))
    every = F.concat(of("$.script", "$.result.candidates"), of("$.messages", "$.content.candidates"))
    named = F.transform(every, lambda c: F.concat(jsonx.string(c, "$.mediaType"), F.lit(":"), jsonx.integer(c, "$.tmdbId").cast("string")))
    return F.array_distinct(F.filter(named, lambda x: x.isNotNull()))


def catalog_keys(record: Column) -> Column:
    """The distinct catalog keys anywhere in a record."""
    return F.array_distinct(F.regexp_extract_all(record, F.lit(CATALOG_KEY), F.lit(0)))


def tool_schema_digest(tools: Column) -> Column:
    """SHA-256 of tool declarations with Name, Description, Parameters in this order and the keys sorted below Parameters.

    Numbers stay as they were written. Null unless it is a list of objects with
    these keys.
    """

    def one(t: str | None) -> str | None:
        try:
            said = [{k: tool[k] for k in ("Name", "Description")} | {"Parameters": json.loads(json.dumps(tool["Parameters"], sort_keys=True))} for tool in json.loads(t)]
        except (*jsonx.NO_JSON, TypeError, KeyError):
            return None
        return hashlib.sha256(json.dumps(said, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")).hexdigest()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(tools)
