"""Synthetic cases, the perfect model's turns for them, and traces made of both: families by variants, by arithmetic on a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators.replay import RECOVERY

AXES = ["title-lookup", "genre-discovery", "keyword-discovery", "language-filter", "runtime-bounds", "abstention", *RECOVERY]
GENRES = ["western", "noir", "comedy", "animation", "mystery"]
PROMPT = "Answer with a proposal in JSON; search the catalog first."


def _json(template: str, *parts: object) -> Column:
    return F.format_string(template, *parts)


def cases(spark: SparkSession, variants: int = 5) -> DataFrame:
    """case_id, axis, intent, script, selected, forbidden, policy, abstain: `variants` cases for each axis.

    Recovery axes find nothing, or an error, at the first search and the
    candidates at a second; abstention finds nothing at all. Bounds of runtimes
    begin anew before they would pass a day, those of votes before 100 million.
    """
    at = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), i.cast("int"))
    rows = spark.range(len(AXES) * variants).select("id", at(AXES, F.floor(F.col("id") / variants)).alias("axis"), (F.col("id") % variants).alias("v"))
    genre, media = at(GENRES, F.col("v") % len(GENRES)), F.when(F.col("v") % 2 == 0, "movie").otherwise("series")
    own = (
        F.when(F.col("axis") == "title-lookup", _json('{"query":"Title %d"}', F.col("id")))
        .when(F.col("axis") == "keyword-discovery", _json('{"keywords":["k%d"],"media_type":"%s"}', F.col("v"), media))
        .when(F.col("axis") == "language-filter", _json('{"genres":["%s"],"original_language":"en"}', genre))
        .when(F.col("axis") == "runtime-bounds", _json('{"genres":["%s"],"runtime_max":%d,"runtime_min":%d}', genre, 90 + F.col("v") % 136 * 10, 40 + F.col("v") % 136))
        .otherwise(_json('{"genres":["%s"],"media_type":"%s"}', genre, media))
    )
    number = lambda k: 10_000 + F.col("id") * 10 + k
    shown = F.concat_ws(",", *[_json('{"mediaType":"%s","tmdbId":%d,"name":"Title %d"}', media, number(k), number(k)) for k in range(4)])
    found = F.when(F.col("axis") == "abstention", '{"candidates":[]}').otherwise(F.concat(F.lit('{"candidates":['), shown, F.lit("]}")))
    first = F.when(F.col("axis").contains("tool-error"), '{"candidates":[],"error":"synthetic outage"}').otherwise('{"candidates":[]}')
    step = lambda a, r: F.struct(a.alias("arguments"), r.alias("result"))
    twice = F.col("axis").isin([x for x in RECOVERY if x != "malformed-final-repair"])
    script = F.when(twice, F.array(step(_json('{"genres":["%s"],"vote_count_min":%d}', genre, 100 + F.col("v") % 99_999_901), first), step(own, found))).otherwise(F.array(step(own, found)))
    ids = lambda *ks: F.array(*[F.concat_ws(":", media, number(k).cast("string")) for k in ks])
    none = F.array().cast("array<string>")
    abstain = F.col("axis") == "abstention"
    return rows.select(
        _json("case-%s-%02d", F.col("axis"), F.col("v")).alias("case_id"), "axis", _json("A synthetic request for a %s channel, number %d.", genre, F.col("v")).alias("intent"), script.alias("script"),
        F.when(abstain, none).otherwise(ids(0, 1)).alias("selected"), F.when(abstain, none).otherwise(ids(3)).alias("forbidden"), F.lit('{"ordering":"shuffle"}').alias("policy"), abstain.alias("abstain"),
    )


def answers(rows: DataFrame) -> DataFrame:
    """case_id, content: the proposal that a case wants."""
    pick = lambda k: F.struct(F.split(k, ":")[0].alias("mediaType"), F.split(k, ":")[1].cast("long").alias("tmdbId"), F.concat(F.lit("Title "), F.split(k, ":")[1]).alias("name"), F.lit("It fits.").alias("rationale"), F.lit(0.5).alias("confidence"))
    final = F.struct(F.lit("Synthetic Channel").alias("channelName"), F.lit("Picked from what was found.").alias("rationale"), F.transform("selected", pick).alias("picks"), F.struct(F.lit("shuffle").alias("ordering")).alias("policy"))
    return rows.select("case_id", F.to_json(final).alias("content"))


def perfect_log(rows: DataFrame) -> DataFrame:
    """The turns of a model that does what every script wants: case_id, call_number, turn, latency."""
    asked = rows.select("case_id", F.posexplode("script").alias("nth", "step"))
    call = F.format_string('{"role":"assistant","toolCalls":[{"id":"call-%d","name":"catalog_search","arguments":%s}]}', F.col("nth") + 1, F.col("step.arguments"))
    said = asked.select("case_id", (F.col("nth") + 1).alias("call_number"), call.alias("turn"))
    last = answers(rows).join(rows.select("case_id", (F.size("script") + 1).alias("call_number")), "case_id")
    said = said.union(last.select("case_id", "call_number", F.to_json(F.struct(F.lit("assistant").alias("role"), "content"))))
    return said.select("case_id", "call_number", "turn", (F.col("call_number") * 1_000_000).cast("long").alias("latency"))


def traces(rows: DataFrame, prompt: str = PROMPT) -> DataFrame:
    """trace_id, trace: each case as a trace in which the model does what it should."""
    system = F.to_json(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content")))
    user = F.to_json(F.struct(F.lit("user").alias("role"), F.col("intent").alias("content")))
    turn = lambda s, i: F.array(
        F.format_string('{"role":"assistant","toolCalls":[{"id":"call-%d","name":"catalog_search","arguments":%s}]}', i + 1, s["arguments"]),
        F.format_string('{"role":"tool","toolCallId":"call-%d","name":"catalog_search","content":%s}', i + 1, s["result"]),
    )
    said = F.flatten(F.transform("script", turn))
    final = F.to_json(F.struct(F.lit("assistant").alias("role"), F.col("content")))
    body = F.array_join(F.concat(F.array(system, user), said, F.array(final)), ",")
    record = F.concat(F.lit('{"schemaVersion":1,"traceId":"planner-'), "case_id", F.lit('","split":"train","axes":["'), "axis", F.lit('"],"contract":{"promptVersion":"1"},"tools":[],"messages":['), body, F.lit('],"review":{"status":"pending"},"provenance":{"source":"generated","author":"range"}}'))
    return rows.join(answers(rows), "case_id").select(F.concat(F.lit("planner-"), "case_id").alias("trace_id"), record.alias("trace"))


def denylist(sources: DataFrame, protected: list[str], least_length: int, text: str = "record") -> DataFrame:
    """kind, digest: of all protected leaves of the records, their digests as they are and normalized (case folded, single spaces); the values stay behind."""
    from ..functions import text as T

    leaf = sources.select(F.explode(jsonx.json_leaves(F.col(text), protected)).alias("l")).where("l.protected").select("l.value")
    leaf = leaf.where(F.length(F.trim("value")) >= least_length)
    both = leaf.select(F.lit("exact").alias("kind"), T.sha256(F.col("value")).alias("digest")).union(leaf.select(F.lit("normalized"), T.folded_fingerprint(F.col("value"))))
    return both.distinct()
