"""Evidence from outside held against what was planned: completions, settlements, bills, capacities, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions import text as T
from ..functions.numbers import money, seconds, within
from ..functions.jsonx import items
from ..sources.tables import numbered
from .rules import Rule, first_reason


def envelope_reason(response: Column, model: Column, provider: Column) -> Column:
    """Why a completion's envelope (JSON text) ends a run: no id, another model or provider, choices or usage amiss."""
    v = jsonx.variant(response)
    usage = lambda k: jsonx.number(v, f"$.usage.{k}")
    said = jsonx.string(v, "$.provider")
    return first_reason([
        Rule("no generation id", jsonx.string(v, "$.id") != ""),
        Rule("another model than asked for", jsonx.string(v, "$.model") == model),
        Rule("another provider than pinned", said.isNull() | (said == provider)),
        Rule("not exactly one choice", F.size(items(v, "$.choices")) == 1),
        *[Rule(f"invalid {k}", usage(k) >= 0) for k in ("prompt_tokens", "completion_tokens", "total_tokens", "cost")],
        Rule("the usage does not add up to its total", usage("total_tokens") >= usage("prompt_tokens") + usage("completion_tokens")),
    ])


def content_reason(response: Column, expected_ids: Column) -> Column:
    """Why a completion's content sets one row aside: cut short, no text, no JSON, or reviews that are not those asked for in order."""
    v = jsonx.variant(response)
    content = jsonx.string(v, "$.choices[0].message.content")
    told = F.transform(items(jsonx.variant(content), "$.reviews"), lambda r: jsonx.string(r, "$.traceId"))
    return first_reason([
        Rule("did not stop by itself", jsonx.string(v, "$.choices[0].finish_reason") == "stop"),
        Rule("no text content", content.isNotNull()),
        Rule("content is not JSON", jsonx.variant(content).isNotNull()),
        Rule("reviews are not those asked for", told == expected_ids),
    ])


def completions(responses: DataFrame, response: str, model: str, provider: str, expected: str) -> DataFrame:
    """responses with `state`: ok, quarantined (its content) or aborted (its envelope), and `reason`."""
    envelope = envelope_reason(F.col(response), F.col(model), F.col(provider))
    content = content_reason(F.col(response), F.col(expected))
    rows = responses.withColumn("_e", envelope).withColumn("_c", content)
    state = F.when(F.col("_e").isNotNull(), "aborted").when(F.col("_c").isNotNull(), "quarantined").otherwise("ok")
    return rows.withColumn("state", state).withColumn("reason", F.coalesce("_e", "_c")).drop("_e", "_c")


def settlement_problems(calls: DataFrame, settlements: DataFrame) -> DataFrame:
    """id, problem: calls (id, provider, model, finish, cost as text) without an equal settlement of the same columns; costs are exact."""
    s = settlements.select("id", *[F.col(c).alias(f"s_{c}") for c in ("provider", "model", "finish", "cost")])
    both = calls.join(s, "id", "left")
    rules = [
        Rule("not settled", F.col("s_cost").isNotNull()),
        *[Rule(f"{c} differs", F.col(c) == F.col(f"s_{c}")) for c in ("provider", "model", "finish")],
        Rule("invalid cost", money(F.col("s_cost")).isNotNull()),
        Rule("cost does not reconcile", money(F.col("cost")) == money(F.col("s_cost"))),
    ]
    return both.select("id", first_reason(rules).alias("problem")).where("problem IS NOT NULL")


def billing_reason(start: Column, created: Column, deleted: Column, end: Column, captured: Column, parts: list[Column], total: Column, gpu: Column, rate: str, reserved: Column, tolerance: str, most_seconds: int) -> Column:
    """Why a provider's bill is refused: times out of order, too long, another GPU charge than rate times hours, sums that do not add up, above its reservation."""
    ran = seconds(created, deleted)
    charge = (ran * F.lit(rate).cast("decimal(10,6)") / F.lit(3600).cast("decimal(4,0)")).cast("decimal(30,10)")
    added = parts[0]
    for p in parts[1:]:
        added = added + p
    return first_reason([
        Rule("times are out of order", (start <= created) & (created <= deleted) & (deleted <= end) & (end <= captured)),
        Rule("ran longer than allowed", ran <= most_seconds),
        Rule("GPU charge is not rate times hours", F.abs(gpu - charge) <= F.lit("0.01").cast("decimal(10,6)")),
        Rule("components do not add up to the total", within(added, total, tolerance)),
        Rule("total exceeds its reservation", total <= reserved),
    ])


def capacity(measured: DataFrame, case: str, stage: str, tokens: str, limit: int, reserve: int) -> DataFrame:
    """One row: cases, stages, most input tokens, least left, and the first (case, stage) that leaves less than the reserve."""
    rows = measured.withColumn("_left", F.lit(limit) - F.col(tokens))
    failing = F.min(F.when(F.col("_left") < reserve, F.struct(case, stage)))
    return rows.agg(F.count_distinct(case).alias("cases"), F.count("*").alias("stages"), F.max(tokens).alias("most"), F.min("_left").alias("least_left"), failing.alias("f")).select("cases", "stages", "most", "least_left", F.col(f"f.{case}").alias("failing_case"), F.col(f"f.{stage}").alias("failing_stage"))


def contract_reason(bundle: Column, keys: list[str]) -> Column:
    """Why a contract bundle (JSON text) is refused: other keys than its own, or digests that are not those of its prompt and tools."""
    from ..functions.fingerprints import tool_schema_digest

    v = jsonx.variant(bundle)
    tools = F.to_json(F.try_variant_get(v, "$.tools", "variant"))
    return first_reason([
        Rule("the contract has other fields", jsonx.closed(bundle, keys)),
        Rule("system prompt digest differs", T.sha256(jsonx.string(v, "$.systemPrompt")) == jsonx.string(v, "$.systemPromptSha256")),
        Rule("tool schema digest differs", tool_schema_digest(tools) == jsonx.string(v, "$.toolSchemaSha256")),
    ])


def identity_problems(records: DataFrame, contract: dict[str, str], key: str) -> DataFrame:
    """key, field: fields of records that are not as the contract has them."""
    off = F.array(*[F.when(~F.col(f).eqNullSafe(F.lit(v)), F.lit(f)) for f, v in contract.items()])
    return records.select(key, F.explode(F.filter(off, lambda x: x.isNotNull())).alias("field"))


def redaction_problems(results: DataFrame, generations: DataFrame, case: str = "case_id") -> DataFrame:
    """case, problem: cases whose generations are not as many as their model calls, still have a raw text, or have no digest for it.

    generations has case, raw (null when redacted), raw_sha256.
    """
    per = generations.groupBy(case).agg(F.count("*").alias("n"), F.count("raw").alias("raw"), F.count_if(~F.coalesce(F.regexp_like("raw_sha256", F.lit(r"\A[0-9a-f]{64}\z")), F.lit(False))).alias("bad"))
    both = results.select(case, "model_calls").join(per, case, "full_outer")
    why = F.when(~F.coalesce("n", F.lit(0)).eqNullSafe(F.coalesce("model_calls", F.lit(0))), "generations are not the model calls").when(F.col("raw") > 0, "raw text is still there").when(F.col("bad") > 0, "no digest of the raw text")
    return both.select(case, why.alias("problem")).where("problem IS NOT NULL")


def first_divergence(results: DataFrame, classes: dict[str, Column], key: str) -> DataFrame:
    """key, class: failed rows under the first class whose condition holds; 'other' if none does. A partition: every row has one class."""
    out = F.lit("other")
    for name, holds in reversed(classes.items()):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return results.select(key, out.alias("class"))


def ordinal_coverage(found: DataFrame, expected: DataFrame, key: str, order: str) -> DataFrame:
    """position, found, expected: places where two lists of keys, each in its own order, differ."""
    a, b = (numbered(df.select(order, F.col(key).alias(name)), "position", order).select("position", name) for df, name in ((found, "found"), (expected, "expected")))
    return a.join(b, "position", "full_outer").where(~F.col("found").eqNullSafe(F.col("expected")))


def endpoint(listing: Column, wanted: list[str]) -> Column:
    """What a route is pinned by, of an endpoint's listing (JSON text): its name after the last bar, its provider, prices, and the wanted parameters it has."""
    v = jsonx.variant(listing)
    parameters = F.transform(items(v, "$.supported_parameters"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.struct(
        F.trim(F.element_at(F.split(jsonx.string(v, "$.name"), r"\|"), -1)).alias("name"),
        jsonx.string(v, "$.provider_name").alias("provider"),
        money(jsonx.string(v, "$.pricing.prompt")).alias("prompt_price"),
        money(jsonx.string(v, "$.pricing.completion")).alias("completion_price"),
        F.array_sort(F.array_intersect(parameters, F.lit(wanted))).alias("parameters"),
    )


def request_document(model: Column, instructions: Column, packet: Column, most_tokens: int, effort: str | None = None) -> Column:
    """A request as canonical JSON text: two messages, greedy, a bound on tokens, and an effort where the family has one."""
    quoted = lambda c: F.to_json(c.cast("variant"))
    message = lambda role, c: F.concat(F.lit('{"content":'), quoted(c), F.lit(f',"role":"{role}"}}'))
    effort_part = f',"reasoning":{{"effort":"{effort}"}}' if effort else ""
    return F.concat(F.lit(f'{{"max_tokens":{most_tokens},"messages":['), message("system", instructions), F.lit(","), message("user", packet), F.lit('],"model":'), quoted(model), F.lit(effort_part + ',"temperature":0}'))


def replay_differences(stored: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """key, field, stored, again: where a summary that was kept differs from one computed anew; rows of one side only are there in every field."""
    fields = [c for c in stored.columns if c != key]
    both = stored.select(key, *[F.col(c).cast("string").alias(f"_s_{c}") for c in fields], F.lit(True).alias("_s")).join(again.select(key, *[F.col(c).cast("string").alias(f"_a_{c}") for c in fields], F.lit(True).alias("_a")), key, "full_outer")
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_s_{c}").alias("stored"), F.col(f"_a_{c}").alias("again")) for c in fields])
    one_side = F.col("_s").isNull() | F.col("_a").isNull()
    return both.select(key, one_side.alias("_one"), F.explode(each).alias("x")).where("_one OR NOT x.stored <=> x.again").select(key, "x.*")


def plan_totals(requests: DataFrame, reserved: str) -> DataFrame:
    """One row: requests, bytes, tokens, worst (exact cost at the most tokens), within (its reservation); requests has bytes, tokens, worst_cost (text)."""
    return requests.agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum(money(F.col("worst_cost"))).alias("worst")).withColumn("within", F.coalesce(F.col("worst") <= F.lit(reserved).cast("decimal(38,22)"), F.lit(True)))
