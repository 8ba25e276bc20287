"""Queries over rules: each row of a table gets one of some records, sound or with one thing wrong, and its own number in it.

What a rule must say of a record is written beside it; the SQL counts from
that, and the query from what the rule says of each row of the table.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx, numbers
from ..operators import arguments as A
from ..operators import behaviors, cases, evidence, review, traces
from ..sources import scenarios
from ..sources.tables import dealt, read

QUERIES, ORACLES = {}, {}
#: Stands for the row's number in a record.
NUMBER = "@"
TABLE, KEY = "customer", "c_custkey"


def changed(base: object, f: Callable[[object], object]) -> str:
    x = json.loads(json.dumps(base))
    f(x)
    return json.dumps(x)


def text_of(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x)


def planted(name: str, doc: str, examples: list[tuple], says: Callable[..., Column]) -> None:
    """Register a query that counts what `says` gives for each row; an example is what it takes, then what it must give ('none' for null)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = len(examples[0]) - 1
        rows = [(i, *map(text_of, e[:-1])) for i, e in enumerate(examples)]
        given = spark.createDataFrame(rows, "i long, " + ", ".join(f"x{k} string" for k in range(n)))
        table = dealt(read(spark, sf_dir, TABLE).select(F.col(KEY).alias("k"))).withColumn("i", F.col("k") % len(examples))
        own = table.join(F.broadcast(given), "i").select(*[F.replace(f"x{k}", F.lit(NUMBER), F.col("k").cast("string")).alias(f"x{k}") for k in range(n)])  # a few examples
        said = own.select(F.coalesce(says(*[F.col(f"x{k}") for k in range(n)]).cast("string"), F.lit("none")).alias("said"))
        return said.groupBy("said").agg(F.count("*").alias("n"))

    run.__name__, run.__doc__ = name, doc
    plain = lambda x: "none" if x is None else str(x).lower() if isinstance(x, bool) else x
    values = ", ".join("({}, '{}')".format(i, plain(e[-1]).replace("'", "''")) for i, e in enumerate(examples))
    QUERIES[name], ORACLES[name] = run, f"SELECT v.said, count(*) AS n FROM {TABLE} JOIN (VALUES {values}) v(i, said) ON {KEY} % {len(examples)} = v.i GROUP BY v.said"


NONE = {"kind": "none", "anchors": [], "axes": []}
ANCHOR = {"field": "description", "start": 3, "end": 9}
AXIS = {"kind": "movie_release", "combine": "any", "intervals": [{"anchor": 0, "start": 1980, "end": 1989}]}
DATED = {"kind": "constraints", "anchors": [ANCHOR], "axes": [AXIS]}
PERSON = {"cast": ["actor @"], "media_type": "movie"}

planted("search_rules", "Arguments of searches before they run.", [
    ({"query": "title @"}, None), ({"genres": ["g@"], "keywords": ["b"]}, None), ({}, "not the arguments of a search"), ("[@]", "not the arguments of a search"), ({"query": "x", "n@": 1}, "not the arguments of a search"),
    ({"query": "x@", "era": "1980s"}, "title query mixed with filters"), ({"media_type": "movie"}, "nothing to search by"), ({"query": "  "}, "the title is blank"), ({"genres": []}, "genres is not of its kind"), ({"genres": ["a@", " "]}, "genres is not of its kind"),
    ({"keywords": "k@"}, "keywords is not of its kind"), ({"genres": ["a"], "media_type": "book@"}, "media_type is not of its kind"), ({"era": "1980 to 1989"}, None), ({"era": "1880s"}, "era is not of its kind"), ({"original_language": "eng"}, "original_language is not of its kind"), ({"origin_country": "U1"}, "origin_country is not of its kind"),
    ({"runtime_min": True}, "runtime_min is not of its kind"), ({"runtime_max": 1441}, "runtime_max is not of its kind"), ({"vote_count_min": "@"}, "vote_count_min is not of its kind"), ({"runtime_min": 90, "runtime_max": 80}, "the least runtime is above the greatest"), ({"vote_average_min": 10.5}, "vote_average_min is not of its kind"),
    ({"network": "N@", "media_type": "series"}, None), ({"network": "N@"}, "a network is asked for without series"), (PERSON, None), ({"cast": ["a@", "A@ "], "media_type": "movie"}, "cast names someone twice"), ({"cast": ["a@"] * 5, "media_type": "movie"}, "cast is not of its kind"),
    ({"creators": ["c@"]}, "people of other media than movies"), ({"network": "N", "cast": ["a@"], "media_type": "series"}, "network and person constraints at once"),
], lambda a: A.search_reason(a))
planted("declared_searches", "Arguments that the tool's own declaration does not have.", [({"era": "80s"}, "an argument is not declared by target contract"), ({"query": "x@"}, None)], lambda a: A.search_reason(a, ["query"]))
planted("scored_searches", "The scorer's own rule of searches.", [
    ({"genres": ["a@"], "keywords": ["b"]}, False), ({"era": "1980s"}, False), ({"genres": ["a@"], "era": "whenever"}, True), ({"query": "x@"}, True), ({"query": "x", "runtime_min": 1}, False), ({"genres": ["a"], "original_language": " en"}, False), ({"keywords": ["k@"], "vote_average_min": 0}, False),
], A.scored_search_valid)
planted("dated_searches", "Searches that carry a date meaning.", [
    ({"dateMeaning": NONE, "genres": ["x@"]}, None), ({"genres": ["x@"]}, "dateMeaning is required"), ({"dateMeaning": NONE, "era": "80s"}, "era is no argument any more"), ({"dateMeaning": NONE, "tmdbId": 1}, "ids of other catalogs are no arguments"), ({"dateMeaning": NONE, "n@": 1}, "the tool takes other arguments"),
    ({"dateMeaning": NONE, "mode": "collection"}, "a collection without titles"), ({"dateMeaning": NONE, "mode": "collection", "titles": ["a@"]}, "a collection of no kind of media"), ({"dateMeaning": NONE, "mode": "collection", "titles": ["a@"], "media_type": "movie"}, None),
    ({"dateMeaning": NONE, "mode": "collection", "titles": ["a"], "media_type": "movie", "genres": ["@"]}, "a collection with filters"), ({"dateMeaning": NONE, "titles": ["a@"]}, "titles without a collection"), ({"dateMeaning": {**NONE, "kind": 1}}, "a date meaning's kind or lists are none"),
    ({"dateMeaning": NONE, "network": "n@"}, "a network of other media than series"), ({"dateMeaning": NONE, "cast": ["@"]}, "people of other media than movies"), ("@", "arguments are no object"),
], A.dated_search_reason)
planted("eras", "Years, decades and spans.", [("1980s", True), ("80s", True), ("1987", True), ("1980 to 1989", True), ("1980–89", True), ("1880s", False), ("eighties", False), ("1980-", False), ("", False), ("20@@@", False)], A.valid_era)
planted("date_meanings", "What a request says of dates.", [
    (NONE, None), (DATED, None), ({**NONE, "n@": 1}, "a date meaning has three fields"), ({**NONE, "kind": "maybe"}, "a date meaning's kind or lists are none"), ({**NONE, "anchors": [ANCHOR]}, "no dates, yet anchors or axes"), ({"kind": "ambiguous", "anchors": [], "axes": []}, "dates left open have anchors alone"),
    ({"kind": "constraints", "anchors": [ANCHOR], "axes": []}, "dates that bind have anchors and axes"), (changed(DATED, lambda d: d["anchors"][0].pop("end")), "an anchor lacks a field or has one too many"), (changed(DATED, lambda d: d["anchors"][0].update(field="f@")), "an anchor points to no field of a request"),
    (changed(DATED, lambda d: d["anchors"][0].update(end=3)), "an anchor ends before it starts"), (changed(DATED, lambda d: d["anchors"][0].update(field="mustInclude")), "an anchor in a list has no place there"), (changed(DATED, lambda d: d["anchors"][0].update(index=0)), "an anchor in a text has a place in a list"),
    (changed(DATED, lambda d: d["axes"][0].update(kind="tv@")), "an axis is of no known kind"), (changed(DATED, lambda d: d["axes"][0].update(intervals=[])), "an axis has no intervals, or combines them in no known way"), (changed(DATED, lambda d: d["axes"][0]["intervals"][0].update(anchor=1)), "an interval refers to no anchor"),
    (changed(DATED, lambda d: d["axes"][0]["intervals"][0].update(end=1979)), "an interval's years are none"),
], lambda a: A.date_meaning_reason(jsonx.variant(a)))
planted("policies", "Policies of proposals.", [
    ({}, None), ({"audience": {"ceiling": "c@"}}, None), ({"n@": 1}, "the policy has an unknown field"), ({"era": {"from": 1, "by": 2}}, "the policy's era has an unknown field"), ({"rules": {}}, "the policy's rules are none"), ({"rules": [{"when": 1, "who": "@"}]}, "the policy's rules are none"), ({"rules": [{"when": "@"}]}, None),
], lambda a: A.policy_reason(jsonx.variant(a)))
planted("policy_obligations", "What a prompt asks of a policy.", [
    ({"audience": {"ceiling": "TV-14"}, "ordering": "shuffle"}, True), ({"ordering": "shuffle"}, False), ({"audience": {"ceiling": "TV-14"}, "rules": []}, False), ({"audience": {"ceiling": "TV-14"}, "ordering": "odd@"}, False), ({"audience": {"ceiling": "TV-14"}, "seasonal": {"mode": "auto"}}, True),
], lambda a: A.policy_obliges(F.lit("TV-14"), F.lit(False), jsonx.variant(a)))
planted("field_matches", "Arguments that a step accepts.", [
    ("exact", "90", "90.0", True), ("exact", '"a@"', '"A@"', False), ("ci", '"Ab@ "', '" aB@"', True), ("ci", '"STRASSE@"', '"Straße@"', True), ("containsAll", '["a@"]', '["B", " A@"]', True), ("containsAll", '["a", "c@"]', '["a"]', False),
    ("tokens", '"space operas @"', '["Opera in Space @"]', True), ("tokens", '"space"', "[1]", False), ("ci", '"a@"', "[]", False),
], lambda m, w, g: A.field_matches(m, F.try_parse_json(w), F.try_parse_json(g)))
planted("equal_meanings", "Date meanings that say the same.", [
    (DATED, DATED, True), ({**DATED, "anchors": [{**ANCHOR, "start": 5}]}, DATED, True), ({**DATED, "anchors": [{**ANCHOR, "start": 9, "end": 12}]}, DATED, False), ({**DATED, "axes": [{**AXIS, "combine": "all"}]}, DATED, False), (NONE, NONE, True), (NONE, DATED, False),
], lambda a, b: A.meanings_equivalent(jsonx.variant(a), jsonx.variant(b)))

PICK = {"mediaType": "movie", "tmdbId": 7, "name": "Title @", "rationale": "fits", "confidence": 0.5}
ANSWER = {"channelName": "Channel @", "rationale": "because", "picks": [PICK], "policy": {}}
planted("proposals", "Proposals of the first contract.", [
    (ANSWER, True), (changed(ANSWER, lambda x: x.pop("policy")), False), (changed(ANSWER, lambda x: x.update(picks=[])), True), (changed(ANSWER, lambda x: x.update(picks=x["picks"] * 2)), False), (changed(ANSWER, lambda x: x["picks"][0].update(confidence=True)), False), (changed(ANSWER, lambda x: x["picks"][0].update(tmdbId="7")), False),
    (changed(ANSWER, lambda x: x["picks"][0].update(more="@")), False), (changed(ANSWER, lambda x: x["picks"][0].update(tvdbId=3)), True), (changed(ANSWER, lambda x: x.update(channelName=" ")), False), (changed(ANSWER, lambda x: x.update(picks=[{**PICK, "tmdbId": i} for i in range(1, 10)])), False),
], lambda a: A.proposal_valid(jsonx.variant(a)))
KEYED = {"channelName": "Channel @", "rationale": "because", "dateMeaning": NONE, "picks": [{"mediaType": "movie", "key": "movie:src:@", "name": "n"}], "policy": {}}
planted("dated_proposals", "Proposals of the dated contract.", [
    (KEYED, True), (changed(KEYED, lambda x: x["picks"][0].update(tmdbId=1)), False), (changed(KEYED, lambda x: x.update(dateMeaning={})), False), (changed(KEYED, lambda x: x.update(policy={"n@": 1})), False), (changed(KEYED, lambda x: x["picks"][0].update(mediaType="book")), False), (changed(KEYED, lambda x: x.update(dateMeaning=DATED)), True),
], lambda a: A.dated_proposal_valid(jsonx.variant(a)))
SHOWN = {"mediaType": "movie", "key": "movie:src:@", "name": "n"}
planted("tool_payloads", "What tools answer.", [
    ([SHOWN], None), ([], None), ("{", "the payload is no JSON"), ({"candidates": []}, "the payload has neither candidates nor an error"), ([{**SHOWN, "key": "src-@"}], "a candidate without key, name or kind"), ({"error": "down @"}, None), ([{**SHOWN, "name": ""}], "a candidate without key, name or kind"),
], lambda a: cases.payload_state(a)["problem"])
planted("accepted_steps", "Searches that a step's rule takes.", [
    ({"fields": {"genres": {"match": "containsAll", "value": ["a@"], "required": True}}, "allowed": "*", "requireAny": []}, {"genres": ["A@", "b"], "era": "80s"}, True), ({"fields": {"genres": {"match": "containsAll", "value": ["a@"], "required": True}}, "allowed": [], "requireAny": []}, {"genres": ["a@"], "era": "80s"}, False),
    ({"fields": {"genres": {"match": "exact", "value": ["a@"], "required": True}}, "allowed": "*", "requireAny": []}, {"era": "80s"}, False), ({"fields": {"genres": {"match": "exact", "value": ["a"], "required": False}}, "allowed": ["query"], "requireAny": ["query", "keywords"]}, {"query": "q@"}, True),
    ({"fields": {}, "allowed": "*", "requireAny": ["query"]}, {"keywords": ["k@"]}, False), ({"fields": {}, "allowed": "*", "requireAny": []}, "[@]", False),
], cases.step_accepts)

DECISION = {"schemaVersion": 1, "traceId": "t@", "primary": {"verdict": "approved", "reviewer": "r@", "reviewedAt": "2024-01-01T00:00:00Z", "notes": ""}, "secondary": {"required": True, "verdict": "approved", "reviewer": "s@", "reviewedAt": "2024-01-02T00:00:00Z", "notes": ""}}
planted("review_decisions", "Decisions of two reviewers.", [
    (DECISION, None), (changed(DECISION, lambda d: d.update(more=1)), "the decision has other fields"), (changed(DECISION, lambda d: d["primary"].pop("notes")), "the first review has other fields"), (changed(DECISION, lambda d: d["secondary"].update(required=False)), "a second review is wanted where it is not required, or the other way round"),
    (changed(DECISION, lambda d: d["primary"].update(verdict="maybe")), "unknown verdict"), (changed(DECISION, lambda d: d["primary"].update(reviewedAt="2024-01-01")), "a settled verdict needs a reviewer and a UTC time"), (changed(DECISION, lambda d: d["secondary"].update(verdict="pending")), "a pending verdict carries evidence"),
    (changed(DECISION, lambda d: d["secondary"].update(reviewer="r@")), "both reviews are by one person"), (changed(DECISION, lambda d: d["secondary"].update(reviewedAt="2023-01-02T00:00:00Z")), "the second review is not after the first"),
], lambda d: review.decision_reason(d, F.lit(True)))
planted("utc_times", "Times of records.", [("2024-02-29T23:59:59Z", True), ("2023-02-29T00:00:00Z", False), ("2024-01-01T00:00:00.123456Z", True), ("2024-01-01T00:00:00+00:00", False), ("2024-01-01 00:00:00Z", False), ("@", False)], lambda c: numbers.utc(c).isNotNull())
planted("exact_amounts", "Amounts that keep all digits.", [("0.1000000000000000000001", "0.1000000000000000000001"), ("7", "7.0000000000000000000000"), ("-1", None), ("1e3", None), ("NaN", None), (".5", None)], lambda c: numbers.money(c).cast("string"))

REPLY = {"id": "g@", "model": "m", "choices": [{"finish_reason": "stop", "message": {"content": "{}"}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2, "total_tokens": 7, "cost": 0.25}}
planted("completion_envelopes", "Replies that end a run.", [
    (REPLY, None), (changed(REPLY, lambda x: x.update(model="n@")), "another model than asked for"), (changed(REPLY, lambda x: x.pop("id")), "no generation id"), (changed(REPLY, lambda x: x.update(choices=[])), "not exactly one choice"), (changed(REPLY, lambda x: x["usage"].update(total_tokens=6)), "the usage does not add up to its total"), (changed(REPLY, lambda x: x["usage"].update(cost="@")), "invalid cost"),
], lambda r: evidence.envelope_reason(r, F.lit("m"), F.lit("p")))


RECORD = {"schemaVersion": 1, "traceId": "planner-@", "split": "train", "axes": ["a"], "contract": {}, "tools": [], "messages": [], "review": {"status": "approved", "reviewer": "r", "reviewedAt": "t"}, "provenance": {"source": "s", "author": "a@"}}
planted("trace_records", "Records of traces, their messages aside.", [
    (RECORD, None), (changed(RECORD, lambda x: x.update(more="@")), "the record has other fields"), (changed(RECORD, lambda x: x.update(schemaVersion=2)), "not version 1"), (changed(RECORD, lambda x: x.update(traceId="Planner-@")), "the id is not of its form"), (changed(RECORD, lambda x: x.update(split="test")), "the split is not open to records"),
    (changed(RECORD, lambda x: x.update(axes=[])), "no axis"), (changed(RECORD, lambda x: x.update(axes=["a", "a"])), "an axis twice"), (changed(RECORD, lambda x: x.update(tools=["/home/u@/x"])), "possible secret or private path"), (changed(RECORD, lambda x: x["review"].update(status="pending")), "the review's evidence is not that of its status"),
    (changed(RECORD, lambda x: x["provenance"].update(author=" ")), "a blank provenance"),
], lambda t: traces.record_reason(t, ["train"]))

CANON = {"genres": ["noir"], "era": "1980s", "media_type": "movie", "original_language": "en", "origin_country": "US", "runtime_min": 80, "runtime_max": 120, "vote_average_min": 6.5, "vote_count_min": 100}
CANON_INTENT = "Build a synthetic noir channel from 1980s, media type movie, original language en, origin country US, runtime 80-120 minutes, minimum rating 6.5, and minimum 100 votes; do not add other qualifiers."
CANDIDATE = {"mediaType": "movie", "tmdbId": 10, "name": "Title @", "genres": ["noir"], "overview": "A synthetic title."}
FOUND, NOTHING, DOWN = {"candidates": [CANDIDATE]}, {"candidates": []}, {"candidates": [], "error": "synthetic outage @"}


def trace(axis: str, intent: str, steps: list[tuple[dict, dict]], picks: bool = True, policy: dict | None = None) -> dict:
    turns = [m for i, (a, r) in enumerate(steps) for m in ({"role": "assistant", "toolCalls": [{"id": f"c{i}", "name": "catalog_search", "arguments": a}]}, {"role": "tool", "toolCallId": f"c{i}", "name": "catalog_search", "content": r})]
    final = {**ANSWER, "picks": [{**PICK, "tmdbId": 10}] if picks else [], "policy": policy or {}}
    return {"axes": [axis], "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": intent}, *turns, {"role": "assistant", "content": json.dumps(final)}]}


B = behaviors
SOUND = {
    B.CANONICAL: trace(B.CANONICAL, CANON_INTENT, [(CANON, FOUND)]),
    B.RETRY: trace(B.RETRY, "i @", [({"keywords": ["k@"]}, NOTHING), ({"query": "k@"}, FOUND)]),
    B.COMPLETE: trace(B.COMPLETE, "i @", [({"genres": ["noir"]}, FOUND)]),
    B.ABSTAIN: trace(B.ABSTAIN, "i @", [({"genres": ["noir"]}, NOTHING)], picks=False),
    B.RECOVER: trace(B.RECOVER, "i @", [({"query": "k@"}, DOWN), ({"genres": ["noir"]}, FOUND)]),
    B.AMBIGUOUS: trace(B.AMBIGUOUS, "i @", [({"genres": ["noir"]}, FOUND)], policy={"genres": {"include": ["noir"]}}),
}


def amiss(behavior: str, f: Callable[[list], object]) -> str:
    return changed(SOUND[behavior], lambda x: f(x["messages"]))


def search(m: dict) -> dict:
    return m["toolCalls"][0]["arguments"]


planted("behaviour_traces", "Traces by the rules of their behaviour.", [
    *[(t, None) for t in SOUND.values()],
    (amiss(B.CANONICAL, lambda m: search(m[2]).update(runtime_max=121)), "the search is not what the canonical intent says"), (amiss(B.CANONICAL, lambda m: m[1].update(content="noir please @")), "a canonical intent names one search"), (amiss(B.CANONICAL, lambda m: search(m[2]).update(vote_average_min=6.50)), None),
    (amiss(B.CANONICAL, lambda m: m[2]["toolCalls"].append(m[2]["toolCalls"][0])), "a turn has more than one call, or none"), (amiss(B.CANONICAL, lambda m: m.insert(3, m[3])), "calls and results do not take turns"), (amiss(B.CANONICAL, lambda m: m[-1].update(content="prose @")), "the last message is no proposal in JSON"),
    (amiss(B.RETRY, lambda m: search(m[4]).update(query="other @")), "a retry asks for a keyword, then for it as a title"), (amiss(B.RETRY, lambda m: m[3].update(content=FOUND)), "a retry finds nothing first and something then"), (changed(trace(B.RETRY, "i", [({"keywords": ["k@"]}, NOTHING)]), lambda x: None), "a retry has two searches"),
    (changed(trace(B.COMPLETE, "i @", [({"genres": ["noir"]}, FOUND)], policy={"ordering": "shuffle"}), lambda x: None), "a complete proposal has one search, picks and an empty policy"), (changed(trace(B.ABSTAIN, "i @", [({"genres": ["noir"]}, FOUND)]), lambda x: None), "an abstention has one search, no picks and an empty policy"),
    (amiss(B.RECOVER, lambda m: m[3].update(content=NOTHING)), "a recovery meets an error first and none then"), (amiss(B.RECOVER, lambda m: search(m[4]).update(era="1980s")), "a recovery goes from a title to genres and picks"), (amiss(B.AMBIGUOUS, lambda m: search(m[2]).update(genres=["comedy"])), "an ambiguous intent is searched by the genre of its finds"),
    (changed(trace(B.AMBIGUOUS, "i @", [({"genres": ["noir"]}, FOUND)]), lambda x: None), "an ambiguous intent's policy has the genre of its finds"), (changed(SOUND[B.COMPLETE], lambda x: x.update(axes=["other"])), "unknown behaviour"),
], lambda t: behaviors.trace_reason(behaviors.trace_parts(t)))

VALUE = {"media_type": "series", "network": "N@", "cast": ["a@"], "creators": ["c@"], "origin_country": "GB"}


def routed(axis: str, keys: list[str], n: int = 2) -> dict:
    return trace(axis, "i @", [({k: VALUE[k] for k in keys}, {"candidates": [CANDIDATE] * n})])


planted("entity_routes", "Traces of a route by network, person or country.", [
    *[(routed(axis, keys), None) for axis, keys in B.ROUTES.items()], *[(routed(axis, [*keys, "origin_country"] if "origin_country" not in keys else keys[:2]), f"{axis} takes other arguments") for axis, keys in B.ROUTES.items()],
    (routed("network-routing", B.ROUTES["network-routing"], 0), "an entity's route finds nothing"), (routed("series-person-evidence-routing", B.ROUTES["series-person-evidence-routing"], 1), "evidence about a person takes two candidates"),
    (changed(routed("cast-routing", B.ROUTES["cast-routing"]), lambda x: x["messages"].pop(3)), "a route has one turn of search, one answer and a proposal"), (changed(routed("cast-routing", B.ROUTES["cast-routing"]), lambda x: x["messages"][2].update(toolCalls=x["messages"][2]["toolCalls"] * 2)), "a route has one call"),
], lambda t: behaviors.entity_trace_reason(behaviors.trace_parts(t)))

ID = {"mediaType": "movie", "tmdbId": 10}
OTHER = {**CANDIDATE, "tmdbId": 11}


def case(axis: str, intent: str, steps: list[tuple[dict, dict]], wanted: list, policy: dict | None = None) -> dict:
    script = [{"arguments": a, "result": r} for a, r in steps]
    return {"axis": axis, "intent": intent, "script": script, "expectation": {"selectedIds": wanted, "forbiddenIds": [{**ID, "tmdbId": 11}], "expectedPolicy": policy or {}, "abstain": not wanted, "maxToolCalls": len(script)}}


BOTH = {"candidates": [CANDIDATE, OTHER]}
CASES = {
    B.CANONICAL: case(B.CANONICAL, CANON_INTENT, [(CANON, BOTH)], [ID]), B.RETRY: case(B.RETRY, "i @", [({"keywords": ["k@"]}, NOTHING), ({"query": "k@"}, BOTH)], [ID]), B.COMPLETE: case(B.COMPLETE, "i @", [({"genres": ["noir"]}, BOTH)], [ID]),
    B.ABSTAIN: case(B.ABSTAIN, "i @", [({"genres": ["noir"]}, {"candidates": [OTHER]})], []), B.RECOVER: case(B.RECOVER, "i @", [({"query": "k@"}, DOWN), ({"genres": ["noir"]}, BOTH)], [ID]), B.AMBIGUOUS: case(B.AMBIGUOUS, "i @", [({"genres": ["noir"]}, BOTH)], [ID], {"genres": {"include": ["noir"]}}),
    "cast-routing": case("cast-routing", "i @", [({"media_type": "movie", "cast": ["a@"]}, BOTH)], [ID]),
}
planted("behaviour_cases", "Cases by the rules of their behaviour.", [
    *[(c, None) for c in CASES.values()],
    (changed(CASES[B.RETRY], lambda x: x["script"].append(x["script"][0])), "a case has one or two steps"), (changed(CASES[B.COMPLETE], lambda x: x["script"][0].update(more="@")), "a step has a search and a result"), (changed(CASES[B.COMPLETE], lambda x: x["script"][0]["arguments"].update(n=1)), "a step asks for what no search takes"),
    (changed(CASES[B.COMPLETE], lambda x: x["script"][0]["arguments"].update(keywords=["@"])), "a step has several selectors, or none"), (changed(CASES[B.COMPLETE], lambda x: x["script"][0]["result"].update(more=1)), "a result has candidates and an error at most"), (changed(CASES[B.COMPLETE], lambda x: x["script"][0]["result"]["candidates"][0].update(overview="real @")), "a candidate is incomplete, or not marked as synthetic"),
    (changed(CASES[B.COMPLETE], lambda x: x["expectation"]["selectedIds"][0].update(tmdbId=0)), "an expected identity is none"), (changed(CASES[B.COMPLETE], lambda x: x["expectation"]["selectedIds"][0].update(tmdbId=99)), "an id is expected that no step returns"), (changed(CASES[B.COMPLETE], lambda x: x["expectation"].update(forbiddenIds=[ID])), "an id is both wanted and forbidden"),
    (changed(CASES[B.COMPLETE], lambda x: x["expectation"].update(abstain=True)), "abstention is expected where ids are, or not where none is"), (changed(CASES[B.COMPLETE], lambda x: x["expectation"].update(maxToolCalls=2)), "the calls allowed are not the script's"), (changed(CASES[B.COMPLETE], lambda x: x["expectation"].update(expectedPolicy=[])), "the expected policy is no object"),
    (changed(CASES[B.CANONICAL], lambda x: x["script"][0]["arguments"].update(era="1990s")), "the search is not what the canonical intent says"), (changed(CASES[B.ABSTAIN], lambda x: x["expectation"].update(forbiddenIds=[])), "an abstention has one search, no picks and an empty policy"), (changed(CASES["cast-routing"], lambda x: x["script"][0]["arguments"].update(era="80s")), "cast-routing takes other arguments"),
], behaviors.case_reason)

ENDED = {"role": "user", "content": "Retrieval is complete. Answer @."}


def current(axis: str, results: list[object], picks: int = 1) -> dict:
    turns = [m for i, r in enumerate(results) for m in ({"role": "assistant", "toolCalls": [{"id": f"c{i}", "name": "catalog_search", "arguments": {"genres": ["g@"], "dateMeaning": NONE}}]}, {"role": "tool", "toolCallId": f"c{i}", "name": "catalog_search", "content": json.dumps(r)})]
    final = changed(KEYED, lambda x: x.update(picks=x["picks"] * picks))
    return {"schemaVersion": 1, "split": "train", "axes": [axis], "messages": [{"role": "system", "content": "prompt"}, {"role": "user", "content": "i @"}, *turns, ENDED, {"role": "assistant", "content": final}], "review": {"status": "pending", "reviewer": "", "reviewedAt": None, "notes": ""}}


OUTAGE = {"error": "down @", "fault": {"injected": True, "observed": True}}
NOW, AGAIN = current("genre-discovery", [[SHOWN]]), current(B.FAULT, [OUTAGE, [SHOWN]])
CAPABILITIES = ["genre-discovery", B.FAULT]


def later(f: Callable[[dict], object], base: dict = NOW) -> str:
    return changed(base, f)


CURRENT = [
    (NOW, None), (AGAIN, None), (later(lambda x: x.update(split="test")), "no training record of version 1"), (later(lambda x: x.update(axes=["n@"])), "not one known capability"), (later(lambda x: x.update(messages=x["messages"][1:])), "fewer than six messages"), (later(lambda x: x["messages"][0].update(content="other @")), "another system prompt"),
    (later(lambda x: x["messages"][-2].update(content="go on @")), "no turn ends the searches"), (later(lambda x: x["messages"][2].update(toolCalls=x["messages"][2]["toolCalls"] * 2)), "a turn of calls has not one call"), (later(lambda x: x["messages"][2]["toolCalls"][0].update(id=1)), "a call is no search with an id"), (later(lambda x: search(x["messages"][2]).pop("dateMeaning")), "a search breaks the contract"),
    (later(lambda x: search(x["messages"][4]).update(dateMeaning=DATED), AGAIN), "calls changed the date meaning"), (later(lambda x: x["messages"][3].update(toolCallId="other")), "a call is not answered by the next message"), (later(lambda x: x["messages"][3].update(content="{")), "a result is no payload"), (later(lambda x: x["messages"][-1].update(content="prose @")), "the proposal breaks the contract"),
    (later(lambda x: x["messages"][-1].update(content=changed(KEYED, lambda y: y.update(dateMeaning=DATED)))), "the proposal has another date meaning"), (later(lambda x: x["messages"][-1].update(content=changed(KEYED, lambda y: y["picks"][0].update(key="movie:src:other")))), "a pick was not surfaced"),
    (later(lambda x: x.update(axes=[B.FAULT])), "a recovery without observed fault and retry"), (later(lambda x: x.update(axes=["genre-discovery"]), AGAIN), "a fault outside the recovery capability"), (later(lambda x: x["review"].update(notes="n @")), "the review is not pending"),
]
planted("current_traces", "Traces of the dated contract.", CURRENT, lambda t: behaviors.current_trace_reason(t, CAPABILITIES, "prompt"))
APPROVED = {"status": "approved", "reviewer": "r@", "reviewedAt": "2024-01-01T00:00:00Z", "notes": ""}
planted("approved_traces", "Approved traces of the dated contract.", [
    (later(lambda x: x.update(review=APPROVED)), None), (NOW, "an approval without evidence"), (later(lambda x: x.update(review={**APPROVED, "reviewedAt": "2024"})), "an approval without evidence"), (later(lambda x: x.update(review=APPROVED, split="test")), "no training record of version 1"), (later(lambda x: x.update(review={**APPROVED, "reviewer": ""})), "an approval without evidence"),
], lambda t: behaviors.approved_trace_reason(t, CAPABILITIES, "prompt"))
STEP = {"arguments": {"genres": ["g@"], "dateMeaning": NONE}, "result": json.dumps([SHOWN])}
LATER = {"schemaVersion": 1, "split": "development-eval", "axis": "genre-discovery", "script": [STEP], "expectation": {"dateMeaning": NONE, "selectedKeys": ["movie:src:@"], "forbiddenKeys": ["movie:src:x"]}}
FAULTY = changed(LATER, lambda x: (x.update(axis=B.FAULT, script=[{**STEP, "result": json.dumps(OUTAGE)}, STEP]), x["expectation"].update(faultInjected=True, faultObserved=True)))
planted("current_cases", "Cases of the dated contract.", [
    (LATER, None), (FAULTY, None), (changed(LATER, lambda x: x.update(schemaVersion=2)), "no development case of version 1"), (changed(LATER, lambda x: x.update(axis="n@")), "not a known capability"), (changed(LATER, lambda x: x.update(script=[])), "a development case has no script"), (changed(LATER, lambda x: x["script"][0]["arguments"].pop("dateMeaning")), "a search breaks the contract"),
    (changed(json.loads(FAULTY), lambda x: x["script"][1]["arguments"].update(dateMeaning=DATED)), "the script changed the date meaning"), (changed(LATER, lambda x: x["script"][0].update(result="{")), "a result is no payload"), (changed(LATER, lambda x: x["expectation"].update(dateMeaning=DATED)), "another date meaning is expected"), (changed(LATER, lambda x: x["expectation"].update(selectedKeys="k@")), "expected keys are no lists"),
    (changed(LATER, lambda x: x["expectation"].update(selectedKeys=["movie:src:other@"])), "an expected key is not surfaced, or is forbidden"), (changed(json.loads(FAULTY), lambda x: x["expectation"].update(faultObserved=False)), "no fault was seen that the case recovers from"), (changed(LATER, lambda x: x["expectation"].update(faultInjected=False)), "a fault outside the recovery capability"),
], lambda c: behaviors.current_case_reason(c, CAPABILITIES))


def generated(name: str, doc: str, axes: list[str], says: Callable[[SparkSession, int], DataFrame]) -> None:
    """Register a query over scenarios, as many of each axis as the table has rows for it: says(spark, variants) gives axis and reason, null for all of them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        told = says(spark, max(1, read(spark, sf_dir, TABLE).count() // (10 * len(axes))))
        return told.select("axis", F.coalesce("reason", F.lit("none")).alias("reason")).groupBy("axis", "reason").agg(F.count("*").alias("n"))

    run.__name__, run.__doc__ = name, doc
    values = ", ".join(f"('{a}')" for a in axes)
    QUERIES[name], ORACLES[name] = run, f"SELECT axis, 'none' AS reason, greatest(1, (SELECT count(*) FROM {TABLE}) // {10 * len(axes)}) AS n FROM (VALUES {values}) t(axis)"


DATED_AXES = [f"capability-{i:02d}" for i in range(23)] + [B.FAULT]
generated("behaviour_corpus", "Generated traces of the behaviours.", B.BEHAVIORS, lambda s, n: scenarios.traces(scenarios.behaviours(s, n)).select("axis", B.trace_reason(B.trace_parts(F.col("trace"))).alias("reason")))
generated("behaviour_suite", "Generated cases of the behaviours.", B.BEHAVIORS, lambda s, n: scenarios.cases(scenarios.behaviours(s, n)).select("axis", B.case_reason(F.col("case")).alias("reason")))
generated("entity_corpus", "Generated traces of the entity routes.", list(B.ROUTES), lambda s, n: scenarios.traces(scenarios.entities(s, n)).select("axis", B.entity_trace_reason(B.trace_parts(F.col("trace"))).alias("reason")))
generated("entity_suite", "Generated cases of the entity routes.", list(B.ROUTES), lambda s, n: scenarios.cases(scenarios.entities(s, n)).select("axis", B.case_reason(F.col("case")).alias("reason")))
generated("dated_corpus", "Generated traces of the dated contract.", DATED_AXES, lambda s, n: scenarios.current_traces(scenarios.capabilities(s, DATED_AXES, n)).select("axis", B.current_trace_reason(F.col("trace"), DATED_AXES, scenarios.PROMPT).alias("reason")))
generated("dated_suite", "Generated cases of the dated contract.", DATED_AXES, lambda s, n: scenarios.current_cases(scenarios.capabilities(s, DATED_AXES, n)).select("axis", B.current_case_reason(F.col("case"), DATED_AXES).alias("reason")))
generated(
    "accept_rules", "Each generated search is taken by the rule made of it.", B.BEHAVIORS,
    lambda s, n: scenarios.behaviours(s, n).select("axis", F.when(~F.forall("script", lambda x: cases.step_accepts(scenarios.accept_rule(x["arguments"]), x["arguments"])), "refused").alias("reason")),
)
