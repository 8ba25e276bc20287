"""Prompts and templates: column expressions where text is put together, batches where a given template or tokenizer is called."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsonx
from . import text as T


def user_prompt(intent: Column) -> Column:
    """A request's prompt from its parts (JSON text: description, era, refineText, mustInclude, mustExclude); parts that are empty have no line."""
    v = jsonx.variant(intent)
    listed = lambda k: F.array_join(F.transform(F.when(jsonx.kind(v, f"$.{k}") == "ARRAY", F.try_variant_get(v, f"$.{k}", "array<string>")), lambda x: x), ", ")
    line = lambda label, c: F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(f"{label}: "), F.trim(c)))
    return F.concat_ws("\n", line("Build a channel", jsonx.string(v, "$.description")), line("Era", jsonx.string(v, "$.era")), line("Refine", jsonx.string(v, "$.refineText")), line("Must include", listed("mustInclude")), line("Must exclude", listed("mustExclude")))


def coordinates(intent: Column) -> Column:
    """The words of a request's description with their places (code points, end exclusive), for anchors of dates."""
    return T.spans(F.coalesce(jsonx.string(jsonx.variant(intent), "$.description"), F.lit("")))


def protected_payload(record: Column) -> Column:
    """What of a record (JSON text) is held against a denylist: a case's id, intent, script and expectation, or a trace's id and its messages other than the system's."""
    v = jsonx.variant(record)
    sub = lambda k: F.coalesce(F.to_json(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("null"))
    case = F.concat(*[F.lit(x) if isinstance(x, str) else x for k, lead in (("caseId", '{"caseId":'), ("expectation", ',"expectation":'), ("intent", ',"intent":'), ("script", ',"script":')) for x in (lead, sub(k))], F.lit("}"))
    kept = F.filter(F.try_variant_get(v, "$.messages", "array<variant>"), lambda m: F.coalesce(jsonx.string(m, "$.role") != "system", F.lit(False)))
    trace = F.concat(F.lit('{"messages":['), F.array_join(F.transform(kept, lambda m: F.to_json(m)), ","), F.lit('],"traceId":'), sub("traceId"), F.lit("}"))
    return F.when(F.try_variant_get(v, "$.caseId", "variant").isNotNull(), case).when(kept.isNotNull(), trace)


def rendered(conversation: Column, template: Callable[[list[dict]], str]) -> Column:
    """Conversations (JSON text, arrays of messages) through a chat template, in batches; null for what is no array."""

    def one(t: str | None) -> str | None:
        try:
            messages = None if t is None else json.loads(t)
        except ValueError:
            return None
        return template(messages) if isinstance(messages, list) else None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(conversation)


def token_count(text: Column, count: Callable[[list[str]], list[int]]) -> Column:
    """Tokens of each text by a given counter of batches; 0 for null."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(count([t or "" for t in texts]), dtype="int64")

    return run(text)
