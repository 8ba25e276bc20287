"""Synthetic scenarios of single behaviours, entity routes and dated capabilities, by arithmetic on a range; traces and cases made of them.

A scenario has an axis, a number, an intent, a script (searches with what they
find), a policy and what is to be picked. The rules of operators.behaviors hold
for all that is made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators import behaviors as B

GENRES = ["western", "noir", "comedy", "animation", "mystery"]
LANGUAGES, COUNTRIES = ["en", "fr", "ja", "de"], ["US", "FR", "JP", "DE"]
PROMPT = "Answer with a proposal in JSON; search the catalog first."
NO_DATES = '{"anchors":[],"axes":[],"kind":"none"}'
ENDED = "Retrieval is complete. Answer now."


def _range(spark: SparkSession, axes: list[str], variants: int) -> DataFrame:
    """id, axis, v: `variants` rows for each axis."""
    at = F.get(F.array(*[F.lit(a) for a in axes]), F.floor(F.col("id") / variants).cast("int"))
    return spark.range(len(axes) * variants).select("id", at.alias("axis"), (F.col("id") % variants).alias("v"))


def _of(names: list[str], i: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in names]), (i % len(names)).cast("int"))


def _step(arguments: Column, result: Column) -> Column:
    return F.struct(arguments.alias("arguments"), result.alias("result"))


def _number(k: int) -> Column:
    return 10_000 + F.col("id") * 10 + k


def _shown(media: Column, genre: Column, n: int) -> Column:
    """A result with n candidates, marked as synthetic."""
    one = lambda k: F.format_string('{"mediaType":"%s","tmdbId":%d,"name":"Title %d","genres":["%s"],"overview":"A synthetic title."}', media, _number(k), _number(k), genre)
    return F.concat(F.lit('{"candidates":['), F.concat_ws(",", *[one(k) for k in range(n)]), F.lit("]}"))


def behaviours(spark: SparkSession, variants: int = 20) -> DataFrame:
    """axis, v, id, intent, script, policy, picks (how many of the last finds), media: scenarios of the six behaviours."""
    rows = _range(spark, B.BEHAVIORS, variants)
    v, axis = F.col("v"), F.col("axis")
    genre, media = _of(GENRES, v), F.when(v % 2 == 0, "movie").otherwise("series")
    era, low, rating = F.format_string("%ds", 1950 + 10 * (v % 7)), 40 + v % 50, F.format_string("%d.%d", 1 + v % 9, v % 10)
    canonical = F.format_string(
        '{"genres":["%s"],"era":"%s","media_type":"%s","original_language":"%s","origin_country":"%s","runtime_min":%d,"runtime_max":%d,"vote_average_min":%s,"vote_count_min":%d}',
        genre, era, media, _of(LANGUAGES, v), _of(COUNTRIES, v), low, low + 30, rating, 100 + v,
    )
    said = F.format_string(
        "Build a synthetic %s channel from %s, media type %s, original language %s, origin country %s, runtime %d-%d minutes, minimum rating %s, and minimum %d votes; do not add other qualifiers.",
        genre, era, media, _of(LANGUAGES, v), _of(COUNTRIES, v), low, low + 30, rating, 100 + v,
    )
    by_genre = F.format_string('{"genres":["%s"]}', genre)
    found, nothing = _shown(media, genre, 3), F.lit('{"candidates":[]}')
    script = (
        F.when(axis == B.CANONICAL, F.array(_step(canonical, found)))
        .when(axis == B.RETRY, F.array(_step(F.format_string('{"keywords":["Title %d"]}', v), nothing), _step(F.format_string('{"query":"Title %d"}', v), found)))
        .when(axis == B.RECOVER, F.array(_step(F.format_string('{"query":"Title %d"}', v), F.lit('{"candidates":[],"error":"synthetic outage"}')), _step(by_genre, found)))
        .otherwise(F.array(_step(by_genre, found)))
    )
    policy = F.when(axis == B.AMBIGUOUS, F.format_string('{"genres":{"include":["%s"]}}', genre)).otherwise("{}")
    intent = F.when(axis == B.CANONICAL, said).otherwise(F.format_string("A synthetic request for something %s, number %d.", genre, v))
    return rows.select("axis", "v", "id", intent.alias("intent"), script.alias("script"), policy.alias("policy"), F.when(axis == B.ABSTAIN, 0).otherwise(2).alias("picks"), media.alias("media"))


def entities(spark: SparkSession, variants: int = 10) -> DataFrame:
    """The same of the routes by network, person and country."""
    rows = _range(spark, list(B.ROUTES), variants)
    v, axis = F.col("v"), F.col("axis")
    media = F.when(axis.isin("network-routing", "network-country-routing", "series-person-evidence-routing"), "series").otherwise("movie")
    part = {
        "media_type": F.format_string('"media_type":"%s"', media), "network": F.format_string('"network":"Network %d"', v), "cast": F.format_string('"cast":["Actor %d"]', v),
        "creators": F.format_string('"creators":["Creator %d"]', v), "origin_country": F.format_string('"origin_country":"%s"', _of(COUNTRIES, v)),
    }
    arguments = None
    for name, keys in B.ROUTES.items():
        one = F.concat(F.lit("{"), F.concat_ws(",", *[part[k] for k in keys]), F.lit("}"))
        arguments = F.when(axis == name, one) if arguments is None else arguments.when(axis == name, one)
    script = F.array(_step(arguments, _shown(media, _of(GENRES, v), 3)))
    return rows.select("axis", "v", "id", F.format_string("A synthetic request by entity, number %d.", v).alias("intent"), script.alias("script"), F.lit("{}").alias("policy"), F.lit(2).alias("picks"), media.alias("media"))


def _final(meaning: str = "") -> Column:
    pick = lambda k: F.format_string('{"mediaType":"%s","tmdbId":%d,"name":"Title %d","rationale":"It fits.","confidence":0.5}', F.col("media"), _number(k), _number(k))
    picks = F.when(F.col("picks") == 0, F.lit("")).otherwise(F.concat_ws(",", pick(0), pick(1)))
    return F.concat(F.lit('{"channelName":"Synthetic Channel","rationale":"Picked from what was found.","picks":['), picks, F.lit('],"policy":'), F.col("policy"), F.lit("}"))


def _quoted(c: Column) -> Column:
    return F.to_json(c.cast("variant"))


def _turns(content: bool) -> Column:
    """The script as messages; results are objects, or texts if `content`."""

    def turn(s: Column, i: Column) -> Column:
        result = _quoted(s["result"]) if content else s["result"]
        return F.array(F.format_string('{"role":"assistant","toolCalls":[{"id":"call-%d","name":"catalog_search","arguments":%s}]}', i + 1, s["arguments"]), F.format_string('{"role":"tool","toolCallId":"call-%d","name":"catalog_search","content":%s}', i + 1, result))

    return F.flatten(F.transform("script", turn))


def _message(role: str, content: Column) -> Column:
    return F.concat(F.lit(f'{{"role":"{role}","content":'), _quoted(content), F.lit("}"))


def traces(scenarios: DataFrame, prompt: str = PROMPT) -> DataFrame:
    """trace_id, axis, trace: what the scenarios want, as conversations."""
    body = F.array_join(F.concat(F.array(_message("system", F.lit(prompt)), _message("user", F.col("intent"))), _turns(False), F.array(_message("assistant", _final()))), ",")
    record = F.concat(F.lit('{"schemaVersion":1,"split":"train","axes":["'), "axis", F.lit('"],"messages":['), body, F.lit("]}"))
    return scenarios.select(F.format_string("planner-%s-%03d", "axis", "v").alias("trace_id"), "axis", record.alias("trace"))


def cases(scenarios: DataFrame) -> DataFrame:
    """case_id, axis, case: what the scenarios want, as evaluation cases; one of the finds is forbidden."""
    script = F.array_join(F.transform("script", lambda s: F.concat(F.lit('{"arguments":'), s["arguments"], F.lit(',"result":'), s["result"], F.lit("}"))), ",")
    identity = lambda k: F.format_string('{"mediaType":"%s","tmdbId":%d}', F.col("media"), _number(k))
    wanted = F.when(F.col("picks") == 0, F.lit("")).otherwise(F.concat_ws(",", identity(0), identity(1)))
    expected = F.format_string('{"selectedIds":[%s],"forbiddenIds":[%s],"expectedPolicy":%s,"abstain":%s,"maxToolCalls":%d}', wanted, identity(2), F.col("policy"), F.when(F.col("picks") == 0, "true").otherwise("false"), F.size("script"))
    record = F.concat(F.lit('{"schemaVersion":1,"axis":"'), "axis", F.lit('","intent":'), _quoted(F.col("intent")), F.lit(',"script":['), script, F.lit('],"expectation":'), expected, F.lit("}"))
    return scenarios.select(F.format_string("%s-%03d", "axis", "v").alias("case_id"), "axis", record.alias("case"))


def capabilities(spark: SparkSession, names: list[str], variants: int = 1) -> DataFrame:
    """axis, v, id, intent, script (results as payload texts), media: scenarios of the dated contract; the recovery capability meets a fault first."""
    rows = _range(spark, names, variants)
    v, media = F.col("v"), F.when(F.col("id") % 2 == 0, "movie").otherwise("series")
    arguments = F.format_string('{"genres":["%s"],"dateMeaning":%s}', _of(GENRES, F.col("id")), F.lit(NO_DATES))
    one = lambda k: F.format_string('{"mediaType":"%s","key":"%s:src:%d","name":"Title %d"}', media, media, _number(k), _number(k))
    found = F.concat(F.lit("["), F.concat_ws(",", *[one(k) for k in range(3)]), F.lit("]"))
    fault = F.lit('{"error":"synthetic outage","fault":{"injected":true,"observed":true}}')
    script = F.when(F.col("axis") == B.FAULT, F.array(_step(arguments, fault), _step(arguments, found))).otherwise(F.array(_step(arguments, found)))
    return rows.select("axis", "v", "id", F.format_string("A synthetic request, number %d.", "id").alias("intent"), script.alias("script"), media.alias("media"))


def current_traces(scenarios: DataFrame, prompt: str = PROMPT) -> DataFrame:
    """trace_id, axis, trace of the dated contract, pending review."""
    pick = lambda k: F.format_string('{"mediaType":"%s","key":"%s:src:%d","name":"Title %d"}', F.col("media"), F.col("media"), _number(k), _number(k))
    final = F.format_string('{"channelName":"Synthetic Channel","rationale":"Picked from what was found.","dateMeaning":%s,"picks":[%s],"policy":{}}', F.lit(NO_DATES), F.concat_ws(",", pick(0), pick(1)))
    body = F.array_join(F.concat(F.array(_message("system", F.lit(prompt)), _message("user", F.col("intent"))), _turns(True), F.array(_message("user", F.lit(ENDED)), _message("assistant", final))), ",")
    record = F.concat(F.lit('{"schemaVersion":1,"split":"train","axes":["'), "axis", F.lit('"],"messages":['), body, F.lit(f'],"review":{B.PENDING}}}'))
    return scenarios.select(F.format_string("planner-%s-%03d", "axis", "v").alias("trace_id"), "axis", record.alias("trace"))


def current_cases(scenarios: DataFrame) -> DataFrame:
    """case_id, axis, case of the dated contract; one of the finds is forbidden."""
    script = F.array_join(F.transform("script", lambda s: F.concat(F.lit('{"arguments":'), s["arguments"], F.lit(',"result":'), _quoted(s["result"]), F.lit("}"))), ",")
    key = lambda k: F.format_string('"%s:src:%d"', F.col("media"), _number(k))
    flags = F.when(F.col("axis") == B.FAULT, ',"faultInjected":true,"faultObserved":true').otherwise("")
    expected = F.format_string('{"dateMeaning":%s,"selectedKeys":[%s],"forbiddenKeys":[%s]%s}', F.lit(NO_DATES), F.concat_ws(",", key(0), key(1)), key(2), flags)
    record = F.concat(F.lit('{"schemaVersion":1,"split":"development-eval","axis":"'), "axis", F.lit('","script":['), script, F.lit('],"expectation":'), expected, F.lit("}"))
    return scenarios.select(F.format_string("%s-%03d", "axis", "v").alias("case_id"), "axis", record.alias("case"))


def accept_rule(arguments: Column, loose: tuple[str, ...] = ()) -> Column:
    """The rule (JSON text, see cases.step_accepts) that takes these arguments and no others: texts but for their case, lists whole, the rest as it is.

    Names in `loose` may come besides. The date meaning is no field of it.
    """
    v = jsonx.variant(arguments)
    names = F.array_except(jsonx.keys(arguments), F.lit(["dateMeaning"]))

    def field(n: Column) -> Column:
        value = F.try_variant_get(v, F.concat(F.lit("$."), n), "variant")
        kind = F.schema_of_variant(value)
        match = F.when(F.startswith(kind, F.lit("ARRAY")), "containsAll").when(kind == "STRING", "ci").otherwise("exact")
        return F.concat(_quoted(n), F.lit(':{"match":"'), match, F.lit('","required":true,"value":'), F.to_json(value), F.lit("}"))

    besides = ",".join(f'"{x}"' for x in loose)
    return F.concat(F.lit('{"allowed":['), F.lit(besides), F.lit('],"fields":{'), F.array_join(F.transform(names, field), ","), F.lit('},"requireAny":[]}'))
