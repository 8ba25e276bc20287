"""Queries over documents, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions import text as T
from ..operators import leakage, rules, turns
from ..sources.tables import read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS n_long, count(*) FILTER (text IS NULL) AS n_null FROM documents GROUP BY lang""")
def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("n_long"), F.count_if(F.col("text").isNull()).alias("n_null"))


@query("""SELECT coalesce(list_sort(json_keys(props)) = ['k'], false) AS closed, count(*) AS n FROM events GROUP BY 1""")
def props_closed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(jsonx.closed(F.col("props"), ["k"]).alias("closed")).agg(F.count("*").alias("n"))


@query("""SELECT floor(CAST(props->>'k' AS BIGINT) / 10.0)::BIGINT AS bucket, count(*) AS n, min(CAST(props->>'k' AS BIGINT)) AS least, max(CAST(props->>'k' AS BIGINT)) AS most
FROM events WHERE json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') GROUP BY 1""")
def props_typed_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = jsonx.integer(jsonx.variant(F.col("props")), "$.k")
    typed = read(spark, sf_dir, "events").select(k.alias("k")).where("k IS NOT NULL")
    return typed.groupBy(F.floor(F.col("k") / 10).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"))


@query("""SELECT doc_id, sha256(text) AS digest FROM documents""")
def text_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.sha256(F.col("text")).alias("digest"))


NORMAL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(f"""SELECT doc_id, sha256({NORMAL}) AS fingerprint FROM documents""")
def normalized_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


@query(r"""SELECT doc_id,
  regexp_matches(text, '-----BEGIN (?:RSA |OPENSSH )?PRIVATE KEY-----') AS private_key, regexp_matches(text, '\b(?:sk|ghp|github_pat)_[A-Za-z0-9_-]{12,}\b') AS prefixed_token,
  regexp_matches(text, '\bAKIA[A-Z0-9]{16}\b') AS access_key, regexp_matches(text, '\bop://') AS vault_reference,
  regexp_matches(text, '/(?:Users|home)/[^/\s]+/') AS home_path, regexp_matches(text, '[A-Za-z]:\\Users\\[^\\\s]+\\') AS windows_home_path, regexp_matches(text, '(?:^|[/\\])\.env(?:$|[/\\\s])') AS env_file,
  regexp_matches(text, 'token = "[0-9a-f]{40}"') AS assigned_token, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS email
FROM documents""")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", *T.flags(F.col("text"), {**T.SECRETS, **T.PRIVATE_PATHS, **T.MORE_SECRETS}))


@query("""WITH t AS (SELECT item_id, list_distinct([CASE WHEN len(x) > 3 AND x LIKE '%s' THEN x[1:len(x) - 1] ELSE x END for x in regexp_split_to_array(lower(text), '[^a-z0-9]+') if x <> '']) AS w FROM benchmark)
SELECT item_id, CAST(len(w) AS INTEGER) AS n, list_min(w) AS least, list_max(w) AS most FROM t""")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("w"))
    return w.select("item_id", F.size("w").alias("n"), F.array_min("w").alias("least"), F.array_max("w").alias("most"))


@query("""SELECT event_id, '{"event_type":"' || event_type || '","k":' || (props->>'k') || '}' AS canonical FROM events""")
def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-sorted JSON of a row's type and its k."""
    k = jsonx.integer(jsonx.variant(F.col("props")), "$.k")
    return read(spark, sf_dir, "events").select("event_id", jsonx.canonical(F.to_json(F.struct(k.alias("k"), "event_type"))).alias("canonical"))


@query(f"""SELECT sha256({NORMAL}) AS fingerprint, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.duplicate_groups(read(spark, sf_dir, "documents").select(T.fingerprint(F.col("text")).alias("fingerprint")), "fingerprint")


@query(f"""SELECT doc_id, owner FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256({NORMAL})) AS owner FROM documents) WHERE doc_id <> owner""")
def first_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))
    return leakage.owners(docs, "fingerprint", "doc_id", "doc_id")


@query(f"""WITH d AS (SELECT DISTINCT 's' || (doc_id % 4) AS split, sha256({NORMAL}) AS f FROM documents)
SELECT a.split AS "left", b.split AS "right", count(*) AS n FROM d a JOIN d b ON a.f = b.f AND a.split < b.split GROUP BY 1, 2""")
def split_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("s"), F.pmod("doc_id", F.lit(4)).cast("string")).alias("split"), T.fingerprint(F.col("text")).alias("fingerprint"))
    return leakage.split_overlaps(docs, "split", "fingerprint")


@query("""SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.containing(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id")


LEAF = r"trim(regexp_replace(lower(x), '\s+', ' ', 'g'))"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), b AS (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark)
SELECT doc_id, sha256({LEAF}) AS digest, count(*) AS n FROM l WHERE len(trim(x)) >= 12 AND sha256({LEAF}) IN (SELECT sha256({LEAF}) FROM b) GROUP BY 1, 2""")
def hashed_denylist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents whose normalized digest is that of a benchmark item's line."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x")).where(F.length(F.trim("x")) >= 12).select("doc_id", T.fingerprint(F.col("x")).alias("digest"))
    deny = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("x")).select(T.fingerprint(F.col("x")).alias("digest")).distinct()
    return lines.join(leakage.bounded(deny), "digest", "left_semi").groupBy("doc_id", "digest").agg(F.count("*").alias("n"))


@query("""SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def label_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id").distinct()
    return docs.join(known, "doc_id", "left_anti").withColumn("labelled", F.lit(False)).union(docs.join(known, "doc_id", "left_semi").withColumn("labelled", F.lit(True)))


@query("""WITH t AS (SELECT conv_id, turn, role, lag(role) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT conv_id, CASE WHEN role = 'system' AND b IS NOT NULL THEN 'late_system' WHEN role = b THEN 'repeated_role' WHEN role = 'assistant' AND (b IS NULL OR b = 'system') THEN 'assistant_first' END AS finding FROM t),
s AS (SELECT conv_id, count(*) AS n_turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1)
SELECT first_role, last_role, n_turns, count(*) AS n, CAST(sum(coalesce(k, 0)) AS BIGINT) AS findings FROM s LEFT JOIN (SELECT conv_id, count(*) AS k FROM f WHERE finding IS NOT NULL GROUP BY 1) USING (conv_id) GROUP BY 1, 2, 3""")
def turn_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by their first role, last role and number of turns, with the protocol findings among them."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    found = turns.adjacency(t).groupBy("conv_id").agg(F.count("*").alias("k"))
    return turns.shape(t).join(found, "conv_id", "left").groupBy("first_role", "last_role", "n_turns").agg(F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("findings"))


@query("""SELECT conv_id, count(*) AS n, count(*) FILTER (turn <> e) AS off FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS e FROM conversations) GROUP BY 1""")
def turn_gap_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn")
    off = turns.gaps(t).groupBy("conv_id").agg(F.count("*").alias("off"))
    return t.groupBy("conv_id").agg(F.count("*").alias("n")).join(off, "conv_id", "left").select("conv_id", "n", F.coalesce("off", F.lit(0)).cast("bigint").alias("off"))


@query("""SELECT conv_id, max(turn) AS turn, length(arg_max(text, turn)) AS n_chars FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def last_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.last_of_role(read(spark, sf_dir, "conversations"), "assistant").select("conv_id", "turn", F.length("text").cast("bigint").alias("n_chars"))


@query("""SELECT user_id, count(*) AS n, count(DISTINCT event_type) + max(CAST(event_type IS NULL AS INT)) = 1 AS constant FROM events GROUP BY 1""")
def constant_over_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.constant(read(spark, sf_dir, "events"), "user_id", "event_type")


@query("""SELECT u.conv_id, u.turn, a.conv_id IS NOT NULL AS resolved FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def call_result_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.next_turn_pairs(read(spark, sf_dir, "conversations"))


def _document_rules() -> list[rules.Rule]:
    t = F.col("text")
    return [
        rules.Rule("short", F.col("n_chars") >= 200),
        rules.Rule("long", F.col("n_chars") <= 20_000),
        rules.Rule("email", ~F.regexp_like(t, F.lit(T.MORE_SECRETS["email"]))),
        rules.Rule("token", ~F.regexp_like(t, F.lit(T.MORE_SECRETS["assigned_token"]))),
        rules.Rule("shouting", ~t.contains("!!")),
    ]


REASONS = r"""[CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 20000 THEN 'long' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'email' END,
  CASE WHEN regexp_matches(text, 'token = "[0-9a-f]{40}"') THEN 'token' END, CASE WHEN contains(text, '!!') THEN 'shouting' END]"""


@query(f"""WITH r AS (SELECT doc_id, [x for x in {REASONS} if x IS NOT NULL] AS rs FROM documents),
e AS (SELECT unnest(rs) AS reason FROM r UNION ALL SELECT 'none' FROM r WHERE len(rs) = 0) SELECT reason, count(*) AS n FROM e GROUP BY 1""")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.histogram(read(spark, sf_dir, "documents").select(rules.all_reasons(_document_rules()).alias("reasons")))


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), q(lang, expected) AS (VALUES ('en', 500), ('de', 150), ('fr', 150), ('it', 1))
SELECT coalesce(c.lang, q.lang) AS lang, coalesce(n, 0) AS n, CAST(coalesce(expected, 0) AS BIGINT) AS expected, coalesce(n, 0) = coalesce(expected, 0) AS met FROM c FULL JOIN q ON c.lang = q.lang""")
def quota_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([("en", 500), ("de", 150), ("fr", 150), ("it", 1)], "lang string, expected long")
    return rules.quota(read(spark, sf_dir, "documents"), "lang", expected)


@query(f"""SELECT source, min(doc_id) AS doc_id, arg_min([x for x in {REASONS} if x IS NOT NULL][1], doc_id) AS reason FROM documents WHERE len([x for x in {REASONS} if x IS NOT NULL]) > 0 GROUP BY 1""")
def first_failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = read(spark, sf_dir, "documents").select("source", "doc_id", rules.first_reason(_document_rules()).alias("reason")).where("reason IS NOT NULL")
    return bad.groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.min_by("reason", "doc_id").alias("reason"))


@query(r"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '\S+')) AS t FROM benchmark) SELECT item_id, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM w GROUP BY 1""")
def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank-separated tokens with their places; counted and measured by item."""
    s = read(spark, sf_dir, "benchmark").select("item_id", F.explode(T.spans(F.col("text"))).alias("s"))
    return s.groupBy("item_id").agg(F.count("*").alias("n"), F.sum((F.col("s.end") - F.col("s.start")).cast("bigint")).alias("n_chars"))


@query("""SELECT d.split, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM (SELECT 'train' AS split, n_chars FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'development', n_chars FROM documents WHERE doc_id % 10 = 0) d GROUP BY 1""")
def named_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    train, dev = docs.where("doc_id % 10 <> 0").withColumn("split", F.lit("train")), docs.where("doc_id % 10 = 0").withColumn("split", F.lit("development"))
    return train.unionByName(dev).groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, role AS final_role, turn FROM t WHERE back = 1""")
def final_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role").withColumn("back", F.row_number().over(w))
    return t.where("back = 1").select("conv_id", F.col("role").alias("final_role"), "turn")
