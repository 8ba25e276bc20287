"""Rules that hold for one behaviour of a trace or a case only: what it is to search for, in which order, and what it is to answer.

A record is JSON text, parsed once to typed columns by `trace_parts`,
`case_parts` or `current_parts`; the rules are predicates over these, the first
broken one is the reason. A record of another behaviour keeps a rule that is
not about it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions import text as T
from ..functions.jsonx import items
from . import arguments as A
from .cases import payload_state
from .rules import Rule, first_reason, let

#: The behaviours, what an intent of the first says, and the arguments that each route of an entity takes.
CANONICAL, RETRY, COMPLETE, ABSTAIN, RECOVER, AMBIGUOUS = "canonical-argument-preservation", "one-tool-operation-per-turn", "complete-proposal-json", "structured-json-abstention", "synthetic-tool-error-recovery", "ambiguous-intent-mapping"
BEHAVIORS = [CANONICAL, RETRY, COMPLETE, ABSTAIN, RECOVER, AMBIGUOUS]
CANONICAL_INTENT = r"\ABuild a synthetic ([A-Za-z ]+) channel from (\d{4}s), media type (movie|series), original language ([a-z]{2}), origin country ([A-Z]{2}), runtime (\d+)-(\d+) minutes, minimum rating (\d+(?:\.\d)?), and minimum (\d+) votes; do not add other qualifiers\.\z"
ROUTES = {
    "network-routing": ["media_type", "network"],
    "cast-routing": ["media_type", "cast"],
    "creator-routing": ["media_type", "creators"],
    "combined-person-routing": ["media_type", "cast", "creators"],
    "network-country-routing": ["media_type", "network", "origin_country"],
    "series-person-evidence-routing": ["media_type", "network"],
}
PROPOSAL = ["channelName", "rationale", "picks", "policy"]
PENDING = '{"notes":"","reviewedAt":null,"reviewer":"","status":"pending"}'
FAULT = "observed-fault-recovery"

_VARIANTS = "array<variant>"


def _sub(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _json(v: Column, path: str = "$") -> Column:
    """Canonical text of a value: equal values have equal texts."""
    return F.to_json(F.try_variant_get(v, path, "variant"))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _keys(v: Column) -> Column:
    return jsonx.object_keys(v)


def _only(v: Column, names: list[str]) -> Column:
    return _yes(_keys(v) == F.lit(sorted(names)))


def _has(v: Column, path: str) -> Column:
    """Whether an array there has an element."""
    return _yes(F.size(items(v, path)) > 0)


def _number(text: Column) -> Column:
    """A number as canonical JSON writes it."""
    return F.to_json(F.try_parse_json(text))


def canonical_arguments(intent: Column) -> Column:
    """The arguments (canonical JSON text) that a canonical intent spells out; null for any other."""
    part = lambda i: F.regexp_extract(intent, CANONICAL_INTENT, i)
    quoted = lambda i: F.concat(F.lit('"'), part(i), F.lit('"'))
    said = F.concat(
        F.lit('{"era":'), quoted(2), F.lit(',"genres":['), quoted(1), F.lit('],"media_type":'), quoted(3), F.lit(',"origin_country":'), quoted(5), F.lit(',"original_language":'), quoted(4),
        F.lit(',"runtime_max":'), part(7), F.lit(',"runtime_min":'), part(6), F.lit(',"vote_average_min":'), part(8), F.lit(',"vote_count_min":'), part(9), F.lit("}"),
    )
    return F.when(F.regexp_like(intent, F.lit(CANONICAL_INTENT)), jsonx.canonical(said))


def _same_arguments(v: Column, wanted: Column) -> Column:
    return _yes(jsonx.canonical(F.to_json(v)) == wanted)


def _steps_reason(behavior: Column, intent: Column, args: Column, found: Column, policy: Column, picks: Column, banned: Column) -> list[Rule]:
    """The rules that traces and cases of a behaviour share: args and found are arrays of variants, in order; picks and banned count."""
    n = F.size(args)
    at = lambda a, i: F.get(a, F.lit(i))
    of = lambda name, holds: (behavior != name) | _yes(holds)
    empty_policy = policy == "{}"
    genre = jsonx.string(F.get(items(at(found, 0), "$.candidates"), F.lit(0)), "$.genres[0]")
    listed = F.concat(F.lit('{"genres":['), F.to_json(genre.cast("variant")), F.lit("]}"))
    return [
        Rule("a canonical intent names one search", of(CANONICAL, canonical_arguments(intent).isNotNull() & (n == 1))),
        Rule("the search is not what the canonical intent says", of(CANONICAL, _same_arguments(at(args, 0), canonical_arguments(intent)))),
        Rule("a canonical intent leaves its finds unpicked", of(CANONICAL, picks > 0)),
        Rule("a retry has two searches", of(RETRY, n == 2)),
        Rule("a retry asks for a keyword, then for it as a title", of(RETRY, _only(at(args, 0), ["keywords"]) & _only(at(args, 1), ["query"]) & (_json(at(args, 0), "$.keywords") == F.concat(F.lit("["), _json(at(args, 1), "$.query"), F.lit("]"))))),
        Rule("a retry finds nothing first and something then", of(RETRY, ~_has(at(found, 0), "$.candidates") & _has(at(found, 1), "$.candidates"))),
        Rule("a retry leaves its finds unpicked", of(RETRY, picks > 0)),
        Rule("a complete proposal has one search, picks and an empty policy", of(COMPLETE, (n == 1) & empty_policy & (picks > 0))),
        Rule("an abstention has one search, no picks and an empty policy", of(ABSTAIN, (n == 1) & empty_policy & (picks == 0) & banned)),
        Rule("a recovery has two searches", of(RECOVER, n == 2)),
        Rule("a recovery meets an error first and none then", of(RECOVER, _yes(F.array_contains(_keys(at(found, 0)), "error")) & ~_yes(jsonx.string(at(found, 1), "$.error") != ""))),
        Rule("a recovery goes from a title to genres and picks", of(RECOVER, _only(at(args, 0), ["query"]) & _only(at(args, 1), ["genres"]) & (picks > 0))),
        Rule("an ambiguous intent has one search that finds something to pick", of(AMBIGUOUS, (n == 1) & _has(at(found, 0), "$.candidates") & (picks > 0))),
        Rule("an ambiguous intent is searched by the genre of its finds", of(AMBIGUOUS, _same_arguments(at(args, 0), jsonx.canonical(listed)))),
        Rule("an ambiguous intent's policy has the genre of its finds", of(AMBIGUOUS, policy == jsonx.canonical(F.concat(F.lit('{"genres":{"include":'), F.lit("["), F.to_json(genre.cast("variant")), F.lit("]}}"))))),
        Rule("unknown behaviour", behavior.isin(BEHAVIORS)),
    ]


def trace_parts(text: Column) -> Column:
    """A trace as struct axis, intent, turns (role, and how many calls; null where there is no list of them), calls (their number in each turn that has any list), args, found, final."""
    return let(let(jsonx.variant(text), lambda v: F.struct(v.alias("v"), items(v, "$.messages").alias("m"))), lambda x: _trace_parts(x["v"], x["m"]))


def _trace_parts(v: Column, m: Column) -> Column:
    # Of each message that is a turn: its role and calls, taken out once.
    told = F.transform(F.slice(m, F.lit(3), F.greatest(F.size(m), F.lit(0))), lambda t: F.struct(jsonx.string(t, "$.role").alias("role"), items(t, "$.toolCalls").alias("calls"), t.alias("t")))
    final = F.get(m, F.size(m) - 1)
    answer = F.when(_only(final, ["role", "content"]), jsonx.variant(jsonx.string(final, "$.content")))
    ends = F.struct(jsonx.string(v, "$.axes[0]").alias("axis"), jsonx.string(F.get(m, F.lit(1)), "$.content").alias("intent"), answer.alias("final"))
    return let(told, lambda turns: _with_turns(ends, turns))


def _with_turns(ends: Column, turns: Column) -> Column:
    calling = F.filter(turns, lambda t: _yes(t["role"] == "assistant") & t["calls"].isNotNull())
    answers = F.filter(turns, lambda t: _yes(t["role"] == "tool"))
    return let(calling, lambda c: F.struct(
        ends["axis"].alias("axis"), ends["intent"].alias("intent"), F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.when(t["calls"].isNotNull(), F.size(t["calls"])).alias("calls"))).alias("turns"), F.transform(c, lambda t: F.size(t["calls"])).alias("calls"),
        F.transform(c, lambda t: _sub(F.get(t["calls"], F.lit(0)), "$.arguments")).alias("args"), F.transform(answers, lambda t: _sub(t["t"], "$.content")).alias("found"), ends["final"].alias("final"),
    ))


def trace_reason(parts: Column) -> Column:
    """Why the conversation of a trace (as trace_parts gives it) is not its behaviour's."""
    return let(parts, _trace_reason)


def _trace_reason(parts: Column) -> Column:
    turns, calls, final = parts["turns"], parts["calls"], parts["final"]
    n = F.size(calls)
    pairs = F.forall(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: _yes((F.get(turns, 2 * i)["role"] == "assistant") & F.get(turns, 2 * i)["calls"].isNotNull() & (F.get(turns, 2 * i + 1)["role"] == "tool")))
    return first_reason([
        Rule("a turn has more than one call, or none", F.forall(calls, lambda k: _yes(k == 1))),
        Rule("calls and results do not take turns", (F.size(turns) == 2 * n + 1) & ((n == 0) | pairs)),
        Rule("the last message is no proposal in JSON", _only(final, PROPOSAL)),
        Rule("the proposal has no name or rationale, or a policy that is none", jsonx.filled(final, "$.channelName") & jsonx.filled(final, "$.rationale") & jsonx.is_object(final, "$.policy")),
        *_steps_reason(parts["axis"], parts["intent"], parts["args"], parts["found"], jsonx.canonical(_json(final, "$.policy")), F.coalesce(F.size(items(final, "$.picks")), F.lit(0)), F.lit(True)),
    ])


def entity_reason(behavior: Column, arguments: Column, content: Column) -> Column:
    """Why a search (variant) and what it found (variant) are not the route of an entity; null for behaviours that are none."""
    parts = F.struct(behavior.alias("behavior"), _keys(arguments).alias("keys"), items(content, "$.candidates").alias("found"))
    return let(parts, lambda x: _entity_reason(x["behavior"], x["keys"], x["found"]))


def _entity_reason(behavior: Column, names: Column, found: Column) -> Column:
    routes = [Rule(f"{name} takes other arguments", (behavior != name) | _yes(names == F.lit(sorted(keys)))) for name, keys in ROUTES.items()]
    return first_reason([
        Rule("an entity's route finds nothing", ~behavior.isin(list(ROUTES)) | _yes(F.size(found) > 0)),
        *routes,
        Rule("evidence about a person takes two candidates", (behavior != "series-person-evidence-routing") | _yes(F.size(found) >= 2)),
    ])


def entity_trace_reason(parts: Column) -> Column:
    """Why a trace (as trace_parts gives it) of an entity's route is not one search with its answer."""
    return let(parts, _entity_trace_reason)


def _entity_trace_reason(parts: Column) -> Column:
    turns = parts["turns"]
    shape = (F.size(turns) == 3) & (F.get(turns, F.lit(0))["role"] == "assistant") & (F.get(turns, F.lit(1))["role"] == "tool")
    one = F.get(turns, F.lit(0))["calls"] == 1
    return F.coalesce(first_reason([Rule("a route has one turn of search, one answer and a proposal", shape), Rule("a route has one call", one)]), entity_reason(parts["axis"], F.get(parts["args"], F.lit(0)), F.get(parts["found"], F.lit(0))))


def case_reason(text: Column) -> Column:
    """Why a case (JSON text) is not its behaviour's: its script, what it expects, and what behaviour and entity ask of both."""
    return let(jsonx.variant(text), lambda v: let(F.struct(v.alias("v"), _steps(items(v, "$.script")).alias("script")), lambda x: let(_case_parts(x["v"], x["script"]), _case_reason)))


def _steps(script: Column) -> Column:
    """Each step of a script: its keys, its arguments and result with theirs, and the candidates."""
    return F.transform(script, lambda s: let(F.struct(_keys(s).alias("keys"), _sub(s, "$.arguments").alias("args"), _sub(s, "$.result").alias("found")), lambda x: F.struct(
        x["keys"].alias("keys"), x["args"].alias("args"), x["found"].alias("found"), _keys(x["args"]).alias("asked"), _keys(x["found"]).alias("told"), F.coalesce(items(x["found"], "$.candidates"), F.array().cast(_VARIANTS)).alias("shown"),
    )))


def _case_parts(v: Column, script: Column) -> Column:
    lists = lambda name: items(v, f"$.expectation.{name}").alias(name)
    return F.struct(v.alias("v"), script.alias("script"), jsonx.string(v, "$.axis").alias("axis"), F.flatten(F.transform(script, lambda s: s["shown"])).alias("shown"), lists("selectedIds"), lists("forbiddenIds"))


def _case_reason(x: Column) -> Column:
    v, script = x["v"], x["script"]
    args, found = F.transform(script, lambda s: s["args"]), F.transform(script, lambda s: s["found"])
    axis, n = x["axis"], F.size(script)
    every = lambda holds: F.forall(script, lambda s: _yes(holds(s)))
    selectors = lambda s: F.size(F.array_intersect(s["asked"], F.lit(["query", "genres", "keywords"]))) == 1
    alone = lambda s: ~F.array_contains(s["asked"], "query") | (F.size(s["asked"]) == 1)
    sound = lambda c: jsonx.string(c, "$.mediaType").isin(A.MEDIA) & (jsonx.integer(c, "$.tmdbId") > 0)
    whole = lambda c: sound(c) & (jsonx.string(c, "$.name") != "") & (F.size(items(c, "$.genres")) > 0) & F.lower(jsonx.string(c, "$.overview")).contains("synthetic")
    named = lambda a: F.transform(a, lambda c: F.concat_ws(":", jsonx.string(c, "$.mediaType"), jsonx.integer(c, "$.tmdbId").cast("string")))
    shown, wanted, banned = x["shown"], x["selectedIds"], x["forbiddenIds"]
    identity = lambda a: _yes(F.forall(a, lambda c: _yes(_only(c, ["mediaType", "tmdbId"]) & sound(c))))
    within = lambda a: F.size(F.array_except(named(a), named(shown))) == 0
    abstain = F.try_variant_get(v, "$.expectation.abstain", "boolean")
    entity = axis.isin(list(ROUTES))
    steps = [Rule(r.reason, entity | _yes(r.holds)) for r in _steps_reason(axis, jsonx.string(v, "$.intent"), args, found, jsonx.canonical(_json(v, "$.expectation.expectedPolicy")), F.size(wanted), F.size(banned) > 0)]
    route = entity_reason(axis, F.get(args, F.lit(0)), F.get(found, F.lit(0)))
    before = first_reason([
        Rule("a case has one or two steps", n.between(1, 2)),
        Rule("a step has a search and a result", every(lambda s: s["keys"] == F.lit(["arguments", "result"]))),
        Rule("a step asks for what no search takes", every(lambda s: (F.size(s["asked"]) > 0) & (F.size(F.array_except(s["asked"], F.lit(A.SEARCH))) == 0))),
        Rule("a step has several selectors, or none", entity | every(lambda s: selectors(s) & alone(s))),
        Rule("a result has candidates and an error at most", every(lambda s: F.size(F.array_except(s["told"], F.lit(["candidates", "error"]))) == 0)),
        Rule("a candidate is incomplete, or not marked as synthetic", _yes(F.forall(shown, lambda c: _yes(whole(c))))),
        Rule("an expected identity is none", identity(wanted) & identity(banned)),
        Rule("an id is expected that no step returns", within(wanted) & within(banned)),
        Rule("an id is both wanted and forbidden", F.size(F.array_intersect(named(wanted), named(banned))) == 0),
        Rule("abstention is expected where ids are, or not where none is", abstain == (F.size(wanted) == 0)),
        Rule("the calls allowed are not the script's", jsonx.integer(v, "$.expectation.maxToolCalls") == n),
        Rule("the expected policy is no object", jsonx.is_object(v, "$.expectation.expectedPolicy")),
    ])
    return F.coalesce(before, F.when(entity, route).otherwise(first_reason(steps)))


def _meaning(a: Column) -> Column:
    return _json(a, "$.dateMeaning")


def _grounded(keys: Column, wanted: Column) -> Column:
    return _yes(F.size(F.array_except(wanted, keys)) == 0)


def current_trace_reason(text: Column, capabilities: list[str], prompt: str, end: str = "Retrieval is complete") -> Column:
    """Why a trace (JSON text) of the dated contract is refused.

    One call a turn, answered by the next message; all calls and the proposal
    keep one date meaning; picks carry keys that were surfaced; a fault is
    there in its own capability and nowhere else; the review is pending.
    """

    def taken_apart(v: Column) -> Column:
        m = items(v, "$.messages")
        return F.struct(v.alias("v"), m.alias("m"), jsonx.variant(jsonx.string(F.get(m, F.size(m) - 1), "$.content")).alias("final"))

    def with_turns(x: Column) -> Column:
        n, m = F.size(x["m"]), x["m"]
        body = F.slice(m, F.lit(1), F.greatest(n - 2, F.lit(0)))
        pairs = F.zip_with(body, F.slice(m, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda a, b: F.struct(a.alias("t"), b.alias("next")))
        turns = F.filter(pairs, lambda p: _yes(jsonx.string(p["t"], "$.role") == "assistant") & _sub(p["t"], "$.toolCalls").isNotNull())
        return let(F.transform(turns, lambda p: _turn(p["t"], p["next"])), lambda t: F.struct(x.alias("x"), t.alias("turns"), F.transform(t, lambda p: p["state"]).alias("state")))

    return let(let(let(jsonx.variant(text), taken_apart), with_turns), lambda p: _current_trace_reason(text, p["x"]["v"], p["x"]["m"], p["x"]["final"], p["turns"], p["state"], capabilities, prompt, end))


def _turn(t: Column, following: Column) -> Column:
    """A turn of calls: how many, the first one's name, id, arguments and date meaning, and what the next message is and says."""
    call = let(_sub(t, "$.toolCalls[0]"), lambda c: F.struct(jsonx.string(c, "$.name").alias("name"), jsonx.string(c, "$.id").alias("id"), _sub(c, "$.arguments").alias("args")))
    return let(F.struct(F.size(items(t, "$.toolCalls")).alias("n"), call.alias("call")), lambda x: F.struct(
        x["n"].alias("n"), x["call"]["name"].alias("name"), x["call"]["id"].alias("id"), x["call"]["args"].alias("args"), _meaning(x["call"]["args"]).alias("meaning"),
        jsonx.string(following, "$.role").alias("role"), jsonx.string(following, "$.toolCallId").alias("answers"), payload_state(jsonx.string(following, "$.content")).alias("state"),
    ))


def _current_trace_reason(text: Column, v: Column, m: Column, final: Column, turns: Column, state: Column, capabilities: list[str], prompt: str, end: str) -> Column:
    n, axis = F.size(m), jsonx.string(v, "$.axes[0]")
    every = lambda holds: F.forall(turns, lambda x: _yes(holds(x)))
    meaning = F.get(turns, F.lit(0))["meaning"]
    fault = F.exists(state, lambda s: s["injected"] & s["observed"])
    keys = F.flatten(F.transform(state, lambda s: s["keys"]))
    picked = F.transform(items(final, "$.picks"), lambda p: F.coalesce(jsonx.string(p, "$.key"), F.lit("")))
    return first_reason([
        Rule("no training record of version 1", (jsonx.integer(v, "$.schemaVersion") == 1) & (jsonx.string(v, "$.split") == "train")),
        Rule("not one known capability", (F.size(items(v, "$.axes")) == 1) & axis.isin(capabilities)),
        Rule("fewer than six messages", n >= 6),
        Rule("another system prompt", _only(F.get(m, F.lit(0)), ["role", "content"]) & (jsonx.string(F.get(m, F.lit(0)), "$.role") == "system") & (jsonx.string(F.get(m, F.lit(0)), "$.content") == prompt)),
        Rule("no turn ends the searches", (jsonx.string(F.get(m, n - 2), "$.role") == "user") & F.startswith(jsonx.string(F.get(m, n - 2), "$.content"), F.lit(end))),
        Rule("a turn of calls has not one call", every(lambda x: x["n"] == 1)),
        Rule("a call is no search with an id", every(lambda x: (x["name"] == "catalog_search") & x["id"].isNotNull())),
        Rule("a search breaks the contract", every(lambda x: A.dated_arguments_reason(x["args"]).isNull())),
        Rule("calls changed the date meaning", every(lambda x: x["meaning"] == meaning)),
        Rule("a call is not answered by the next message", every(lambda x: (x["role"] == "tool") & (x["answers"] == x["id"]))),
        Rule("a result is no payload", F.forall(state, lambda s: s["problem"].isNull())),
        Rule("no search at all", F.size(turns) > 0),
        Rule("the proposal breaks the contract", A.dated_proposal_valid(final)),
        Rule("the proposal has another date meaning", _meaning(final) == meaning),
        Rule("a pick was not surfaced", _grounded(keys, picked)),
        Rule("a recovery without observed fault and retry", (axis != FAULT) | (fault & (F.size(turns) >= 2))),
        Rule("a fault outside the recovery capability", (axis == FAULT) | ~fault),
        Rule("the review is not pending", _json(v, "$.review") == PENDING),
        Rule("possible secret or private path", ~T.leaks(text)),
    ])


def approved_trace_reason(text: Column, capabilities: list[str], prompt: str) -> Column:
    """Why an approved trace is refused: its review, then whatever it would be refused for while pending."""
    return let(jsonx.variant(text), lambda v: _approved_trace_reason(v, capabilities, prompt))


def _approved_trace_reason(v: Column, capabilities: list[str], prompt: str) -> Column:
    review = _sub(v, "$.review")
    at = jsonx.string(review, "$.reviewedAt")
    evidence = _only(review, ["status", "reviewer", "reviewedAt", "notes"]) & (jsonx.string(review, "$.status") == "approved") & (jsonx.string(review, "$.reviewer") != "") & F.regexp_like(at, F.lit(r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z\z")) & jsonx.string(review, "$.notes").isNotNull()
    pending = F.replace(F.to_json(v), F.concat(F.lit('"review":'), F.to_json(review)), F.lit(f'"review":{PENDING}'))
    return F.coalesce(first_reason([Rule("an approval without evidence", evidence)]), let(pending, lambda t: current_trace_reason(t, capabilities, prompt)))


def current_case_reason(text: Column, capabilities: list[str]) -> Column:
    """Why a case (JSON text) of the dated contract is refused: envelope, script, one date meaning, grounded keys, faults in their place."""

    def taken_apart(v: Column) -> Column:
        script = items(v, "$.script")
        return F.struct(v.alias("v"), script.alias("script"), F.transform(script, lambda s: payload_state(F.coalesce(jsonx.string(s, "$.result"), _json(s, "$.result")))).alias("state"), F.transform(script, lambda s: let(_sub(s, "$.arguments"), lambda a: F.struct(a.alias("args"), _meaning(a).alias("meaning")))).alias("asked"))

    return let(let(jsonx.variant(text), taken_apart), lambda p: _current_case_reason(text, p["v"], p["asked"], p["state"], capabilities))


def _current_case_reason(text: Column, v: Column, script: Column, state: Column, capabilities: list[str]) -> Column:
    axis = jsonx.string(v, "$.axis")
    meaning = F.get(script, F.lit(0))["meaning"]
    every = lambda holds: F.forall(script, lambda s: _yes(holds(s)))
    expected = _sub(v, "$.expectation")
    listed = lambda k: F.transform(items(expected, f"$.{k}"), lambda x: F.coalesce(jsonx.string(x, "$"), F.lit("")))
    fault = F.exists(state, lambda s: s["injected"] & s["observed"])
    flag = lambda k: F.try_variant_get(expected, f"$.{k}", "boolean")
    told = F.arrays_overlap(_keys(expected), F.lit(["faultInjected", "faultObserved"]))
    return first_reason([
        Rule("no development case of version 1", (jsonx.integer(v, "$.schemaVersion") == 1) & (jsonx.string(v, "$.split") == "development-eval")),
        Rule("not a known capability", axis.isin(capabilities)),
        Rule("a development case has no script", F.size(script) > 0),
        Rule("a search breaks the contract", every(lambda s: A.dated_arguments_reason(s["args"]).isNull())),
        Rule("the script changed the date meaning", every(lambda s: s["meaning"] == meaning)),
        Rule("a result is no payload", F.forall(state, lambda s: s["problem"].isNull())),
        Rule("another date meaning is expected", _meaning(expected) == meaning),
        Rule("expected keys are no lists", listed("selectedKeys").isNotNull() & listed("forbiddenKeys").isNotNull()),
        Rule("an expected key is not surfaced, or is forbidden", _grounded(F.flatten(F.transform(state, lambda s: s["keys"])), listed("selectedKeys")) & (F.size(F.array_intersect(listed("selectedKeys"), listed("forbiddenKeys"))) == 0)),
        Rule("no fault was seen that the case recovers from", (axis != FAULT) | (fault & (F.size(script) >= 2) & flag("faultInjected") & flag("faultObserved"))),
        Rule("a fault outside the recovery capability", (axis == FAULT) | (~fault & ~_yes(told))),
        Rule("possible secret or private path", ~T.leaks(text)),
    ])
