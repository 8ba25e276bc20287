"""Queries that are written in Spark SQL alone, with the functions that functions.surface registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import surface

QUERIES, ORACLES = {}, {}


def spoken(name: str, doc: str, text: str, sql: str) -> None:
    """Register a query of Spark SQL, in which {table} is a table of the folder, and its SQL for DuckDB."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        surface.register(spark)
        tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("conversations", "documents", "events")}
        return spark.sql(text.format(**tables))

    run.__name__, run.__doc__ = name, doc
    QUERIES[name], ORACLES[name] = run, sql


spoken(
    "sql_turn_protocol",
    "Each user turn is a call; an assistant turn answers the turn before it or, where its text has a length that three divides, the one before that. What breaks the protocol, by an Arrow table function.",
    """SELECT problem, count(*) AS n, sum(pending) AS pending, min(CAST(conv AS BIGINT)) AS first_conv FROM turn_protocol(TABLE(
        SELECT CAST(conv_id AS STRING) AS conv, turn, role, IF(role = 'user', array(CAST(turn AS STRING)), NULL) AS calls, IF(role = 'assistant', CAST(turn - IF(length(text) % 3 = 0, 2, 1) AS STRING), NULL) AS result FROM {conversations}
    ) PARTITION BY conv ORDER BY turn) GROUP BY problem""",
    """WITH a AS (SELECT conv_id, turn, turn - CASE WHEN length(text) % 3 = 0 THEN 2 ELSE 1 END AS result FROM conversations WHERE role = 'assistant'),
    u AS (SELECT conv_id, turn, (SELECT min(a.turn) FROM a WHERE a.conv_id = c.conv_id AND a.result = c.turn) AS ended FROM conversations c WHERE role = 'user'),
    p AS (SELECT conv_id, 'a result answers no pending call' AS problem, 0 AS pending FROM a WHERE NOT EXISTS (FROM u WHERE u.conv_id = a.conv_id AND u.turn = a.result AND u.ended = a.turn)
    UNION ALL SELECT conv_id, 'a user turn comes before the results', 0 FROM u WHERE EXISTS (FROM u v WHERE v.conv_id = u.conv_id AND v.turn < u.turn AND (v.ended IS NULL OR v.ended > u.turn))
    UNION ALL SELECT conv_id, 'calls without results', count(*) FROM u WHERE ended IS NULL GROUP BY 1)
    SELECT problem, count(*) AS n, CAST(sum(pending) AS BIGINT) AS pending, min(conv_id) AS first_conv FROM p GROUP BY 1""",
)
spoken(
    "sql_text_rules",
    "Secrets, private paths, distinct texts and sizes of token sets, by language.",
    """SELECT lang, count_if(has_secret(text)) AS secrets, count_if(has_private_path(text)) AS paths, count(DISTINCT text_fingerprint(text)) AS texts, sum(size(text_tokens(text))) AS tokens FROM {documents} GROUP BY lang""",
    r"""SELECT lang, count(*) FILTER (regexp_matches(text, '-----BEGIN (?:RSA |OPENSSH )?PRIVATE KEY-----|\b(?:sk|ghp|github_pat)_[A-Za-z0-9_-]{12,}\b|\bAKIA[A-Z0-9]{16}\b|\bop://')) AS secrets,
    count(*) FILTER (regexp_matches(text, '/(?:Users|home)/[^/\s]+/|[A-Za-z]:\\Users\\[^\\\s]+\\|(?:^|[/\\])\.env(?:$|[/\\\s])')) AS paths,
    count(DISTINCT trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS texts,
    CAST(sum(len(list_distinct(list_transform(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: CASE WHEN length(x) > 3 AND suffix(x, 's') THEN left(x, length(x) - 1) ELSE x END)))) AS BIGINT) AS tokens FROM documents GROUP BY lang""",
)
spoken(
    "sql_text_spans",
    "Runs without white space and where they stand, by language.",
    """SELECT lang, count(*) AS n, sum(s.start) AS starts, sum(s.stop) AS stops, max(s.stop - s.start) AS longest FROM {documents}, LATERAL text_spans(text) s GROUP BY lang""",
    r"""WITH p AS (SELECT doc_id, lang, string_split_regex(text, '\s') AS p FROM documents), x AS (SELECT doc_id, lang, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM p),
    s AS (SELECT lang, x, CAST(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - 1 AS stop FROM x)
    SELECT lang, count(*) AS n, CAST(sum(stop - length(x)) AS BIGINT) AS starts, CAST(sum(stop) AS BIGINT) AS stops, CAST(max(length(x)) AS INTEGER) AS longest FROM s WHERE x <> '' GROUP BY lang""",
)
spoken(
    "sql_event_records",
    "Events by the hour they are settled in: times that are no UTC and amounts that are none have no part.",
    """WITH e AS (SELECT event_type, props, utc_time(concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), IF(value >= 5, 'Z', '+00:00'))) AS at, exact_amount(concat(IF(user_id % 9 = 0, '-', ''), CAST(value AS STRING))) AS amount FROM {events})
    SELECT event_type, unix_seconds(hour_up(at)) DIV 3600 AS hour, count(*) AS n, count_if(closed_object(props, array('k'))) AS closed, CAST(sum(amount) AS DECIMAL(18, 2)) AS amount FROM e GROUP BY 1, 2""",
    """SELECT event_type, CASE WHEN value >= 5 THEN CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) END AS hour, count(*) AS n, count(*) FILTER (coalesce(json_keys(props) = ['k'], false)) AS closed,
    CAST(sum(CASE WHEN user_id % 9 <> 0 AND value >= 0 THEN CAST(value AS DECIMAL(18, 2)) END) AS DECIMAL(18, 2)) AS amount FROM events GROUP BY 1, 2""",
)
