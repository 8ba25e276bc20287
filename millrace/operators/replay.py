"""Recorded turns of a model, played again against scripted searches, and scored.

A case has a script: searches it expects, in order, and what each returns. The
log has what the model said, a row a turn. A case's turns, a handful, are folded
in order within its row: a search that is the script's next one moves the script
on, any other is answered with an error. All of it is column expressions, one
shuffle by case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.jsonx import items
from ..sources.tables import checkpoint
from . import arguments as A

#: Axes on which a case must recover, and keys that claim an authority a proposal does not have.
RECOVERY = ["empty-results", "tool-error-recovery", "synthetic-tool-error-recovery", "malformed-final-repair"]
REPAIR = "malformed-final-repair"
AUTHORITY = ["approved", "authorized", "channelId", "acquisitionApproved", "admissionApproved", "playbackAuthorized"]
STEP = "array<struct<arguments: string, result: string>>"
CASE = f"case_id string, axis string, script {STEP}, selected array<string>, forbidden array<string>, policy string, abstain boolean"
LOG = "case_id string, call_number int, turn string, latency long"


def turns(log: DataFrame) -> DataFrame:
    """The log with each turn's kind (calls, content, other), its one call's arguments, and whether they are valid."""
    t = jsonx.variant(F.col("turn"))
    made = items(t, "$.toolCalls")
    call = F.get(made, F.lit(0))
    keys = jsonx.keys(F.col("turn"))
    kind = (
        F.when(~F.coalesce(jsonx.string(t, "$.role") == "assistant", F.lit(False)), "other")
        .when(F.array_contains(keys, "toolCalls"), F.when(F.size(made) == 1, "call").otherwise("calls"))
        .when((keys == F.lit(["content", "role"])) & jsonx.string(t, "$.content").isNotNull(), "content")
        .otherwise("other")
    )
    args = F.to_json(F.try_variant_get(call, "$.arguments", "variant"))
    named = jsonx.closed(F.to_json(call), ["id", "name", "arguments"]) & (jsonx.string(call, "$.name") == "catalog_search") & (jsonx.string(call, "$.id") != "")
    return log.select("case_id", "call_number", "latency", F.coalesce(kind, F.lit("other")).alias("kind"), args.alias("arguments"), F.coalesce(named, F.lit(False)).alias("named"), jsonx.string(t, "$.content").alias("content"))


def keys_of(result: Column) -> Column:
    """Identities media:id of the candidates in a result (JSON text)."""
    c = items(jsonx.variant(result), "$.candidates")
    return F.coalesce(F.transform(c, lambda x: F.concat_ws(":", jsonx.string(x, "$.mediaType"), jsonx.integer(x, "$.tmdbId").cast("string"))), F.array().cast("array<string>"))


def played(cases: DataFrame, log: DataFrame, max_calls: int = 5, valid: Callable[[Column], Column] = A.scored_search_valid, accepts: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Each case with its fold: step, model_calls, tool_calls, calls_match, arguments_valid, final, latency.

    accepts(wanted, given) says whether a search is the script's next one; by
    default the two are equal as JSON. Turns after a text, after several calls
    at once, or beyond max_calls are not played. A case without turns has none.
    """
    accepts = accepts or (lambda wanted, given: jsonx.canonical(wanted) == jsonx.canonical(given))
    each = turns(log).where(F.col("call_number") <= max_calls).withColumn("valid", F.col("named") & valid(F.col("arguments")))
    listed = each.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("call_number", "kind", "arguments", "valid", "content", "latency"))).alias("turns"))  # at most max_calls
    start = F.struct(F.lit(0).alias("step"), F.lit(0).alias("model_calls"), F.lit(0).alias("tool_calls"), F.lit(True).alias("calls_match"), F.lit(True).alias("arguments_valid"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("final"), F.lit(0).cast("long").alias("latency"))

    def move(s: Column, t: Column) -> Column:
        wanted = F.get(F.col("script"), s["step"])["arguments"]
        hit = t["valid"] & F.coalesce(accepts(wanted, t["arguments"]), F.lit(False))
        is_call, said = t["kind"] == "call", t["kind"] == "content"
        return F.when(s["done"], s).otherwise(
            F.struct(
                (s["step"] + (is_call & hit).cast("int")).alias("step"),
                (s["model_calls"] + 1).alias("model_calls"),
                (s["tool_calls"] + is_call.cast("int")).alias("tool_calls"),
                (s["calls_match"] & (t["kind"] != "calls") & (~is_call | hit)).alias("calls_match"),
                (s["arguments_valid"] & (~is_call | t["valid"])).alias("arguments_valid"),
                (~is_call).alias("done"),
                F.when(said, t["content"]).otherwise(s["final"]).alias("final"),
                (s["latency"] + F.coalesce(t["latency"], F.lit(0))).alias("latency"),
            )
        )

    both = cases.join(listed, "case_id", "left").withColumn("turns", F.coalesce("turns", F.array().cast(listed.schema["turns"].dataType)))
    return both.withColumn("s", F.aggregate("turns", start, move)).drop("turns").select(*cases.columns, "s.*").drop("done")


def score(cases: DataFrame, log: DataFrame, max_calls: int = 5) -> DataFrame:
    """One row a case: its flags, counters and hard failures; the input of scoring.summary."""
    p = played(cases, log, max_calls)
    p = checkpoint(p.withColumn("_v", jsonx.variant(F.col("final"))))  # folded and parsed once
    final = F.col("_v")
    schema_valid = A.proposal_valid(final)
    surfaced = F.flatten(F.transform(F.slice("script", F.lit(1), F.col("step")), lambda x: keys_of(x["result"])))
    chosen = F.when(schema_valid, F.transform(items(final, "$.picks"), lambda x: F.concat_ws(":", jsonx.string(x, "$.mediaType"), jsonx.integer(x, "$.tmdbId").cast("string")))).otherwise(F.array().cast("array<string>"))
    p = p.withColumn("schema_valid", schema_valid).withColumn("surfaced", surfaced).withColumn("chosen", chosen)
    p = p.withColumn("unsupported", F.size(F.filter("chosen", lambda x: ~F.array_contains(F.col("surfaced"), x))))
    n_script, n = F.size("script"), F.size("chosen")
    p = p.withColumn("correct_operation", F.col("calls_match") & (F.col("step") == n_script) & (F.col("tool_calls") == n_script))
    sound = F.col("schema_valid") & (F.col("unsupported") == 0)
    p = p.withColumn("grounded", sound & F.when(F.col("abstain"), n == 0).otherwise(n > 0))
    same = (F.size(F.array_except("chosen", "selected")) == 0) & (F.size(F.array_except("selected", "chosen")) == 0)
    name_words = F.size(F.filter(F.split(jsonx.string(final, "$.channelName"), r"(?U)\s+"), lambda x: x != ""))
    quality = sound & same & ~F.arrays_overlap("chosen", "forbidden") & F.coalesce(name_words.between(2, 4), F.lit(False))
    policy = F.col("schema_valid") & F.coalesce(F.to_json(F.try_variant_get(final, "$.policy", "variant")) == jsonx.canonical(F.col("policy")), F.lit(False))
    p = p.withColumn("proposal_quality", quality).withColumn("policy_accuracy", policy).withColumn("recovery_expected", F.col("axis").isin(RECOVERY))
    repaired = (F.col("axis") != REPAIR) | (F.col("step") == n_script)
    p = p.withColumn("recovery_successful", ~F.col("recovery_expected") | (F.col("correct_operation") & F.col("grounded") & F.col("proposal_quality") & repaired))
    p = p.withColumn("authority", F.coalesce(jsonx.count_keys(F.when(final.isNotNull(), F.col("final")), AUTHORITY), F.lit(0)))
    failures = F.array(
        F.when(~F.col("schema_valid"), "schema_invalid"), F.when(F.col("unsupported") > 0, "unsupported_id"), F.when(F.col("authority") > 0, "authority_violation"), F.when((n > 0) & (F.size("surfaced") == 0), "grounding_bypass")
    )
    return p.select(
        "case_id", "axis", "grounded", "correct_operation", "arguments_valid", "schema_valid", "policy_accuracy", "proposal_quality", "recovery_expected", "recovery_successful",
        "unsupported", "authority", "model_calls", "tool_calls", "latency", F.filter(failures, lambda x: x.isNotNull()).alias("hard_failures"),
    )


#: The axis of the later contract on which a fault is injected and must be overcome.
FAULT = "observed-fault-recovery"
DATED_CASE = f"case_id string, axis string, script {STEP}, selected array<string>, forbidden array<string>, policy string, date_meaning string, abstain boolean"


def score_dated(cases: DataFrame, log: DataFrame, max_calls: int = 3, accepts: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """One row a case of the later contract, whose searches carry a date meaning and whose picks carry catalog keys.

    The first search that the script takes fixes the meaning; the others and
    the proposal must keep it. accepts(wanted, given) may be more tolerant than
    equality, e.g. cases.step_accepts with the step's rule in place of its
    arguments.
    """
    from .cases import payload_state

    meaning_of = lambda a: F.to_json(F.try_variant_get(jsonx.variant(a), "$.dateMeaning", "variant"))
    p = played(cases, log, max_calls, valid=lambda a: A.dated_search_reason(a).isNull(), accepts=accepts)
    calls = turns(log).where("kind = 'call'").select("case_id", "call_number", meaning_of(F.col("arguments")).alias("m"))
    # A script's steps are taken by the first calls; as many as were taken count.
    asked = calls.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("call_number", "m"))).alias("asked"))
    p = p.join(asked, "case_id", "left")
    taken = F.slice("script", F.lit(1), F.col("step"))
    p = checkpoint(p)
    p = p.withColumn("payloads", F.transform(taken, lambda x: payload_state(x["result"]))).withColumn("final_v", jsonx.variant(F.col("final")))
    p = p.withColumn("keys", F.flatten(F.transform("payloads", lambda x: x["keys"]))).withColumn("injected", F.exists("payloads", lambda x: x["injected"])).withColumn("observed", F.exists("payloads", lambda x: x["observed"]))
    p = p.withColumn("meaning", F.when(F.col("step") > 0, F.get(F.transform("asked", lambda x: x["m"]), F.lit(0))))
    same = F.forall(F.slice("asked", F.lit(1), F.greatest("step", F.lit(1))), lambda x: x["m"] == F.col("meaning"))
    n_script, v = F.size("script"), F.col("final_v")
    p = p.withColumn("correct_operation", F.col("calls_match") & (F.col("step") == n_script) & (F.col("tool_calls") == n_script) & F.coalesce(same, n_script == 0))
    chosen = F.filter(F.transform(items(v, "$.picks"), lambda x: jsonx.string(x, "$.key")), lambda x: x.isNotNull())
    p = p.withColumn("chosen", F.coalesce(chosen, F.array().cast("array<string>")))
    told = F.to_json(F.try_variant_get(v, "$.dateMeaning", "variant"))
    valid = A.dated_proposal_valid(v) & (told == F.col("meaning")) & (F.size(F.array_except("chosen", "keys")) == 0) & (F.size("chosen") == F.size(items(v, "$.picks")))
    p = p.withColumn("schema_valid", F.coalesce(valid, F.lit(False)))
    p = p.withColumn("date_accuracy", F.col("schema_valid") & F.coalesce(told == jsonx.canonical(F.col("date_meaning")), F.lit(False)))
    p = p.withColumn("unsupported", F.size(F.filter("chosen", lambda x: ~F.array_contains(F.col("keys"), x))))
    n = F.size("chosen")
    sound = F.col("schema_valid") & (F.col("unsupported") == 0)
    p = p.withColumn("grounded", sound & F.when(F.col("abstain"), n == 0).otherwise(n > 0))
    alike = (F.size(F.array_except("chosen", "selected")) == 0) & (F.size(F.array_except("selected", "chosen")) == 0) & ~F.arrays_overlap("chosen", "forbidden")
    p = p.withColumn("proposal_quality", sound & alike & jsonx.filled(v, "$.channelName") & jsonx.filled(v, "$.rationale"))
    p = p.withColumn("policy_accuracy", F.col("schema_valid") & F.coalesce(F.to_json(F.try_variant_get(v, "$.policy", "variant")) == jsonx.canonical(F.col("policy")), F.lit(False)))
    p = p.withColumn("recovery_expected", F.col("axis") == FAULT)
    p = p.withColumn("recovery_successful", ~F.col("recovery_expected") | (F.col("injected") & F.col("observed") & F.col("correct_operation") & F.col("proposal_quality") & (F.col("tool_calls") >= 2)))
    p = p.withColumn("authority", F.coalesce(jsonx.count_keys(F.when(v.isNotNull(), F.col("final")), AUTHORITY), F.lit(0)))
    failures = F.array(
        F.when(~F.col("schema_valid"), "schema_invalid"), F.when(~F.col("arguments_valid"), "invalid_tool_arguments"), F.when(~F.col("correct_operation"), "incorrect_tool_operation"), F.when(F.col("unsupported") > 0, "unsupported_key"),
        F.when(F.col("authority") > 0, "authority_violation"), F.when(F.col("meaning").isNotNull() & ~F.col("date_accuracy"), "date_meaning_mismatch"), F.when(~F.col("recovery_successful"), "recovery_without_observed_fault"),
    )
    return p.select(
        "case_id", "axis", "grounded", "correct_operation", "arguments_valid", "schema_valid", "date_accuracy", "policy_accuracy", "proposal_quality", "recovery_expected", "injected", "observed", "recovery_successful",
        "unsupported", "authority", "model_calls", "tool_calls", "latency", F.filter(failures, lambda x: x.isNotNull()).alias("hard_failures"),
    )
