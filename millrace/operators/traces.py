"""Traces of tool-calling conversations, taken apart into messages, calls, results, candidates and picks, and checked.

A trace is a row with a key and its JSON text. Each part is a table of its own,
so the checks are joins and predicates; a trace's own problem is the first in
the order of its messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions import text as T
from ..functions.jsonx import items
from ..sources.tables import checkpoint
from .arguments import MEDIA, search_reason

#: What stands after all messages.
END = 1 << 30


def messages(traces: DataFrame, key: str = "trace_id", text: str = "trace") -> DataFrame:
    """key, position (from 0), role, message (a variant), last."""
    return _messages(traces.select(key, items(jsonx.variant(F.col(text)), "$.messages").alias("_said")), key)


def _messages(parsed: DataFrame, key: str) -> DataFrame:
    rows = parsed.select(key, F.size("_said").alias("n"), F.posexplode("_said").alias("position", "message"))
    return rows.select(key, "position", jsonx.string(F.col("message"), "$.role").alias("role"), "message", (F.col("position") == F.col("n") - 1).alias("last"))


def calls(rows: DataFrame, key: str = "trace_id") -> DataFrame:
    """key, position, nth, call_id, name, arguments (JSON text) of the calls that assistants make; rows as messages() gives them."""
    made = rows.where(F.col("role") == "assistant").select(key, "position", F.posexplode(items(F.col("message"), "$.toolCalls")).alias("nth", "c"))
    c = F.col("c")
    shape = F.coalesce(jsonx.closed(F.to_json(c), ["id", "name", "arguments"]), F.lit(False))
    return made.select(key, "position", "nth", jsonx.string(c, "$.id").alias("call_id"), jsonx.string(c, "$.name").alias("name"), F.to_json(F.try_variant_get(c, "$.arguments", "variant")).alias("arguments"), shape.alias("complete"))


def results(rows: DataFrame, key: str = "trace_id") -> DataFrame:
    """key, position, call_id, name, content (a variant), complete."""
    m = F.col("message")
    complete = jsonx.closed(F.to_json(m), ["role", "toolCallId", "name", "content"])
    return rows.where(F.col("role") == "tool").select(key, "position", jsonx.string(m, "$.toolCallId").alias("call_id"), jsonx.string(m, "$.name").alias("name"), F.try_variant_get(m, "$.content", "variant").alias("content"), complete.alias("complete"))


def candidates(found: DataFrame, key: str = "trace_id") -> DataFrame:
    """key, position, nth, media, id, name of what the results surface."""
    rows = found.select(key, "position", F.posexplode(items(F.col("content"), "$.candidates")).alias("nth", "c"))
    c = F.col("c")
    return rows.select(key, "position", "nth", jsonx.string(c, "$.mediaType").alias("media"), jsonx.integer(c, "$.tmdbId").alias("id"), jsonx.string(c, "$.name").alias("name"))


def finals(rows: DataFrame, key: str = "trace_id") -> DataFrame:
    """key, final: what the last message says, parsed, where it is an assistant's text."""
    content = jsonx.string(F.col("message"), "$.content")
    return rows.where(F.col("last") & (F.col("role") == "assistant") & content.isNotNull()).select(key, jsonx.variant(content).alias("final"))


def picks(last: DataFrame, key: str = "trace_id") -> DataFrame:
    """key, nth, media, id, name, confidence of what a final proposal picks."""
    rows = last.select(key, F.posexplode(items(F.col("final"), "$.picks")).alias("nth", "p"))
    p = F.col("p")
    return rows.select(key, "nth", jsonx.string(p, "$.mediaType").alias("media"), jsonx.integer(p, "$.tmdbId").alias("id"), jsonx.string(p, "$.name").alias("name"), jsonx.number(p, "$.confidence").alias("confidence"))


def problems(traces: DataFrame, prompt: str, declared: list[str] | None = None, key: str = "trace_id", text: str = "trace") -> DataFrame:
    """key, position, rule, reason: everything wrong with the conversations; a sound trace has no row.

    The system prompt stands first, an intent second; calls are sound, named
    once and answered by the next result that names them; the last message is
    an assistant's JSON with eight picks at most, each surfaced under the name
    it has there and sure between 0 and 1. Texts that are no JSON have a
    problem of their own; null texts too.
    """
    # Parsed once; every check below reads what is kept.
    parsed = checkpoint(traces.select(key, items(jsonx.variant(F.col(text)), "$.messages").alias("_said")))
    rows = checkpoint(_messages(parsed, key))
    m = F.col("message")
    no = lambda holds: ~F.coalesce(holds, F.lit(False))

    def say(df: DataFrame, position: Column, *found: tuple[int, Column, Column | str]) -> DataFrame:
        """A row for each (rule, whether it is broken, reason) of a row, in one pass."""
        each = F.array(*[F.when(broken, F.struct(F.lit(rule).alias("rule"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))) for rule, broken, reason in found])
        return df.select(F.col(key), position.alias("position"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select(key, "position", "x.rule", "x.reason")

    n = F.size("_said")
    short = say(parsed, F.lit(-1), (0, F.coalesce(n < 3, F.lit(True)), "fewer than three messages"))
    at, role = F.col("position"), F.col("role")
    first = (jsonx.string(m, "$.content") == prompt) & (role == "system") & jsonx.closed(F.to_json(m), ["role", "content"])
    intent = (role == "user") & (jsonx.string(m, "$.content") != "")
    has_calls = F.coalesce(F.array_contains(jsonx.keys(F.to_json(m)), "toolCalls"), F.lit(False))
    is_text = jsonx.string(m, "$.content").isNotNull()
    known = F.when(role == "assistant", has_calls | is_text).when(role == "user", is_text).otherwise(role == "tool")
    turn = jsonx.closed(F.to_json(m), ["role", "toolCalls"]) & (F.size(items(m, "$.toolCalls")) > 0)
    wrong = say(
        rows, at, (1, (at == 0) & no(first), "the conversation begins with another system prompt"), (2, (at == 1) & no(intent), "no intent in second place"),
        (3, (at > 1) & no(known), "a message of no known form"), (4, (at > 1) & (role == "assistant") & has_calls & no(turn), "a turn of calls with other fields"),
    )

    later = rows.where("position > 1")
    made = checkpoint(calls(later, key))
    sound = F.coalesce(F.col("complete") & (F.col("name") == "catalog_search") & (F.col("call_id") != ""), F.lit(False))
    why = F.when(~sound, "a call of no search, or without id").otherwise(search_reason(F.col("arguments"), declared))
    wrong = wrong.union(short).union(say(made.withColumn("why", why), at, (5, F.col("why").isNotNull(), F.col("why"))))

    found = checkpoint(results(later, key))
    content = F.col("content")
    shape = F.col("complete") & (jsonx.kind(content) == "OBJECT") & (F.size(jsonx.unknown_keys(F.to_json(content), ["candidates", "error"])) == 0)
    wrong = wrong.union(say(found, at, (6, no(shape & F.coalesce(jsonx.kind(content, "$.candidates") == "ARRAY", F.lit(True))), "a result of no known form")))

    # Along a trace, each use of an id opens a call and each result closes one; its neighbours say where that fails.
    steps = made.select(key, "position", "nth", "call_id", "name", F.lit(1).alias("opens")).union(found.select(key, "position", F.lit(0), "call_id", "name", F.lit(-1)))
    w = Window.partitionBy(key, "call_id").orderBy("position", "nth")
    state = steps.withColumn("before", F.coalesce(F.lag("opens").over(w), F.lit(-1))).withColumn("after", F.lead("opens").over(w)).withColumn("called", F.lag("name").over(w))
    opens = F.col("opens") == 1
    wrong = wrong.union(say(
        state, F.when(opens & F.col("after").isNull() & (F.col("before") == -1), END).otherwise(at), (7, opens & (F.col("before") == 1), "a call's id is taken"),
        (8, ~opens & ((F.col("before") == -1) | ~F.col("called").eqNullSafe(F.col("name"))), "a result answers no open call"), (9, opens & F.col("after").isNull(), "a call is left unanswered"),
    ))

    shown = candidates(found, key)
    bad = no(F.col("media").isin(MEDIA) & (F.col("id") > 0))
    wrong = wrong.union(say(shown, at, (10, bad, "a candidate without identity"), (11, ~bad & (F.coalesce("name", F.lit("")) == ""), "a candidate without name")))

    last = checkpoint(finals(rows, key))
    listed = items(F.col("final"), "$.picks")
    whole = parsed.where(n >= 3).select(key).join(last, key, "left")
    wrong = wrong.union(say(
        whole, F.lit(END), (12, F.col("final").isNull(), "the end is no JSON of the assistant"), (13, F.col("final").isNotNull() & listed.isNull(), "the proposal lacks picks"),
        (14, F.coalesce(F.size(listed) > 8, F.lit(False)), "more than eight picks"),
    ))
    surfaced = shown.groupBy(key, "media", "id").agg(F.max_by("name", F.struct("position", "nth")).alias("shown"), F.lit(True).alias("is_shown"))
    taken = picks(last, key).join(surfaced, [key, "media", "id"], "left")
    return wrong.union(say(
        taken, F.lit(END), (15, F.col("is_shown").isNull(), "unsupported selected id"), (16, F.col("is_shown") & ~F.col("name").eqNullSafe(F.col("shown")), "a pick goes by another name"),
        (17, no(F.col("confidence").between(0, 1)), "a confidence outside 0 to 1"),
    ))


def first_problems(traces: DataFrame, prompt: str, declared: list[str] | None = None, key: str = "trace_id", text: str = "trace") -> DataFrame:
    """key, reason for every trace: its first problem, or null."""
    first = problems(traces, prompt, declared, key, text).groupBy(key).agg(F.min_by("reason", F.struct("position", "rule", "reason")).alias("reason"))
    return traces.select(key).join(first, key, "left")


def record_reason(text: Column, split: list[str]) -> Column:
    """Why a trace's record is refused, its messages aside: closed keys, version, id, split, axes, secrets, review and provenance."""
    from .rules import Rule, first_reason

    v = jsonx.variant(text)
    axes = items(v, "$.axes")
    approved = jsonx.string(v, "$.review.status") == "approved"
    evidence = jsonx.filled(v, "$.review.reviewer") & jsonx.filled(v, "$.review.reviewedAt")
    return first_reason([
        Rule("the record has other fields", jsonx.closed(text, ["schemaVersion", "traceId", "split", "axes", "contract", "tools", "messages", "review", "provenance"])),
        Rule("not version 1", jsonx.integer(v, "$.schemaVersion") == 1),
        Rule("the id is not of its form", F.regexp_like(jsonx.string(v, "$.traceId"), F.lit(r"\Aplanner-[a-z0-9-]+\z"))),
        Rule("the split is not open to records", jsonx.string(v, "$.split").isin(split)),
        Rule("no axis", F.size(axes) > 0),
        Rule("an axis twice", F.size(F.array_distinct(F.transform(axes, lambda x: F.to_json(x)))) == F.size(axes)),
        Rule("possible secret or private path", ~T.leaks(text)),
        Rule("the review's evidence is not that of its status", F.coalesce(approved == evidence, F.lit(False))),
        Rule("a blank provenance", jsonx.filled(v, "$.provenance.source") & jsonx.filled(v, "$.provenance.author")),
    ])
