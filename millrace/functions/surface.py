"""What Spark SQL alone can call: the rules over single values as SQL functions, and table functions.

register() makes them temporary functions of a session. The SQL functions are
expressions that the optimizer sees through; the turn protocol, a state carried
from row to row, is an Arrow table function over TABLE(...) PARTITION BY ...
ORDER BY ..., so that Spark deals and sorts the conversations.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from .text import LITERALS, PRIVATE_PATHS, SECRETS


def _any(patterns: dict[str, str]) -> str:
    """Whether t has one of the patterns; each is looked for only where its literals are."""
    literals = {name: " OR ".join(f"contains(t, r'{x}')" for x in LITERALS[name]) for name in patterns}
    return " OR ".join(f"(({literals[name]}) AND regexp_like(t, r'{p}'))" for name, p in patterns.items())


#: Name, parameters, what it gives, and the expression or query. Each gives what the function of the same use in this package gives.
FUNCTIONS = [
    ("normalized_text", "t STRING", "STRING", r"trim(regexp_replace(lower(t), r'(?U)\s+', ' '))"),
    ("text_fingerprint", "t STRING", "STRING", r"sha2(trim(regexp_replace(lower(t), r'(?U)\s+', ' ')), 256)"),
    ("text_tokens", "t STRING", "ARRAY<STRING>", r"array_distinct(transform(filter(split(lower(t), r'[^a-z0-9]+'), x -> x <> ''), x -> CASE WHEN length(x) > 3 AND endswith(x, 's') THEN substring(x, 1, length(x) - 1) ELSE x END))"),
    ("has_secret", "t STRING", "BOOLEAN", f"coalesce({_any(SECRETS)}, false)"),
    ("has_private_path", "t STRING", "BOOLEAN", f"coalesce({_any(PRIVATE_PATHS)}, false)"),
    ("utc_time", "t STRING", "TIMESTAMP", r"CASE WHEN regexp_like(t, r'\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?Z\z') THEN try_to_timestamp(t) END"),
    ("exact_amount", "t STRING", "DECIMAL(38,22)", r"CASE WHEN regexp_like(t, r'\A[0-9]+(?:\.[0-9]+)?\z') THEN try_cast(t AS DECIMAL(38,22)) END"),
    ("hour_up", "t TIMESTAMP", "TIMESTAMP", "CASE WHEN t = date_trunc('HOUR', t) THEN t ELSE date_trunc('HOUR', t) + INTERVAL 1 HOUR END"),
    ("safe_path", "p STRING", "BOOLEAN", r"p <> '' AND NOT regexp_like(p, r'(?:^|[/\\])\.\.(?:[/\\]|$)|^[/\\]|^[A-Za-z]:|\x00')"),
    ("closed_object", "j STRING, keys ARRAY<STRING>", "BOOLEAN", "coalesce(array_sort(json_object_keys(j)) = array_sort(keys) AND try_parse_json(j) IS NOT NULL, false)"),
    # Runs without white space, with the code points where they begin and end.
    ("text_spans", "t STRING", "TABLE (piece STRING, start INT, stop INT)", r"""SELECT s.x.piece, s.x.start, s.x.stop FROM LATERAL explode(get(transform(transform(array(split(t, r'(?U)\s', -1)),
        p -> transform(sequence(0, (size(p) - 1) DIV CAST(ceil(cbrt(size(p))) AS INT)), k -> slice(p, CAST(k * ceil(cbrt(size(p))) + 1 AS INT), CAST(ceil(cbrt(size(p))) AS INT)))),
        b -> flatten(zip_with(b, aggregate(transform(b, q -> aggregate(q, 0, (n, x) -> n + length(x) + 1)), named_struct('at', 0, 'got', CAST(array() AS ARRAY<INT>)), (a, n) -> named_struct('at', a.at + n, 'got', concat(a.got, array(a.at))), a -> a.got),
            (q, first) -> aggregate(q, named_struct('at', first, 'got', CAST(array() AS ARRAY<STRUCT<piece: STRING, start: INT, stop: INT>>)),
                (a, x) -> named_struct('at', a.at + length(x) + 1, 'got', CASE WHEN x = '' THEN a.got ELSE concat(a.got, array(named_struct('piece', x, 'start', a.at, 'stop', a.at + length(x)))) END), a -> a.got)))), 0)) AS s(x)"""),
]


@arrow_udtf(returnType="conv string, turn bigint, problem string, pending bigint")
class TurnProtocol:
    """Every place where a conversation breaks the protocol of calls and results, and its calls that no result ends.

    Takes columns conv, turn, role, calls (array of call ids), result (a call
    id or null), dealt by conv in the order of turn. What is kept between
    batches is the pending calls, however long the conversation. A row whose
    result is that of a call it makes itself ends this call. Null conv is a
    conversation; the row at the end has a null turn.
    """

    def __init__(self):
        self.conv, self.pending = None, set()

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        found = []
        columns = (rows.column(c).to_pylist() for c in ("conv", "turn", "role", "calls", "result"))
        for conv, turn, role, calls, result in zip(*columns, strict=True):
            self.conv = conv
            calls = set(calls or [])
            if calls & self.pending:
                found.append((turn, "a call id is pending already"))
            if role == "user" and self.pending:
                found.append((turn, "a user turn comes before the results"))
            self.pending |= calls
            if result is not None and result not in self.pending:
                found.append((turn, "a result answers no pending call"))
            self.pending.discard(result)
        if found:
            yield self._table(found, 0)

    def terminate(self) -> Iterator[pa.Table]:
        if self.pending:
            yield self._table([(None, "calls without results")], len(self.pending))

    def _table(self, found: list[tuple[int | None, str]], pending: int) -> pa.Table:
        n = len(found)
        return pa.table({
            "conv": pa.array([None if self.conv is None else str(self.conv)] * n, pa.string()),
            "turn": pa.array([t for t, _ in found], pa.int64()),
            "problem": pa.array([p for _, p in found], pa.string()),
            "pending": pa.array([pending] * n, pa.int64()),
        })


def register(spark: SparkSession) -> None:
    """All of them as temporary functions of the session; those of the same name are replaced."""
    for name, takes, gives, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    spark.udtf.register("turn_protocol", TurnProtocol)
