"""Queries that write what they read: JSON lines, publications, the log of a ledger, arrivals of streams. What is written is deleted when the result is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transitions
from ..sources import archives, files, records, sinks
from ..sources.tables import checkpoint, numbered, read, shared_dir
from ..streaming import flows

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def written(spark: SparkSession, what: Callable[[str], DataFrame]) -> DataFrame:
    """What is made of a fresh path in the shared folder; the path is gone by the time it is returned."""
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    try:
        return checkpoint(what(path))
    finally:
        files.delete(spark, path)


@query("""WITH l AS (SELECT role, sha256('{"conv_id":' || conv_id || ',"role":' || to_json(role) || ',"text":' || to_json(text) || ',"turn":' || turn || '}' || chr(10)) AS digest FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)
SELECT role, count(*) AS n, min(digest) AS least, max(digest) AS most FROM l GROUP BY 1""")
def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as canonical JSON lines, read strictly with the digest of each line."""
    rows = read(spark, sf_dir, "conversations").where("text IS NOT NULL AND role IS NOT NULL")

    def made(path: str) -> DataFrame:
        sinks.write_lines(rows.select(F.to_json(F.struct("turn", "text", "role", "conv_id")).alias("record")), path)
        role = F.get_json_object("record", "$.role").alias("role")
        return records.line_digests(spark, path).groupBy(role).agg(F.count("*").alias("n"), F.min("digest").alias("least"), F.max("digest").alias("most"))

    return written(spark, made)


@query("""WITH l AS (SELECT CASE event_id % 4 WHEN 0 THEN left(props, length(props) - 1) WHEN 1 THEN '[' || props || ']' WHEN 2 THEN '   ' ELSE props END AS line FROM events)
SELECT CASE WHEN NOT json_valid(line) THEN 'no JSON, or a key twice' WHEN json_type(line) <> 'OBJECT' THEN 'no object' END AS problem, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS size FROM l WHERE trim(line) <> '' GROUP BY 1""")
def lax_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some are cut off, some hold lists and some are blank, read without failing."""
    kind, props = F.col("event_id") % 4, F.col("props")
    line = F.when(kind == 0, props.substr(F.lit(1), F.length(props) - 1)).when(kind == 1, F.concat(F.lit("["), props, F.lit("]"))).when(kind == 2, "   ").otherwise(props)

    def made(path: str) -> DataFrame:
        read(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
        return records.read_lax(spark, path).groupBy("problem").agg(F.count("*").alias("n"), F.sum(F.length("record")).alias("size"))

    return written(spark, made)


@query("""SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS customers, 0 AS missing, 0 AS surplus FROM orders GROUP BY 1""")
def published_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, published and read back, and held against what would be published now."""
    orders = read(spark, sf_dir, "orders")

    def made(path: str) -> DataFrame:
        sinks.publish(orders, path)
        off = sinks.stale(orders, path).first()
        counts = spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("customers"))
        return counts.withColumns({"missing": F.lit(int(off["missing"])), "surplus": F.lit(int(off["surplus"]))})

    return written(spark, made)


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS version, o_orderstatus AS status, o_orderpriority[1] AS p FROM orders),
log AS (SELECT version, CASE p WHEN '1' THEN 'settle' ELSE 'reserve' END AS kind, 1 AS amount, version + CASE status WHEN 'P' THEN 5 ELSE 0 END AS outstanding FROM o),
held AS (SELECT *, outstanding - lag(outstanding) OVER (ORDER BY version) AS moved FROM log)
SELECT CAST(version AS BIGINT) AS version, CASE kind WHEN 'reserve' THEN 'a reservation moved something else' ELSE 'a settlement moved something else' END AS problem
FROM held WHERE version > 0 AND (kind = 'settle' OR moved <> amount)""")
def ledger_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger's log made of orders, one unit reserved a version; settlements move nothing they should, and some balances are off."""
    rows = numbered(read(spark, sf_dir, "orders"), "nth", "o_orderkey").select((F.col("nth") - 1).alias("version"), "o_orderstatus", F.col("o_orderpriority").substr(1, 1).alias("p"))
    held = (F.col("version") + F.when(F.col("o_orderstatus") == "P", 5).otherwise(0)).cast("string")
    log = rows.select("version", F.when(F.col("p") == "1", "settle").otherwise("reserve").alias("kind"), F.lit("1").alias("cost"), F.lit("1").alias("reserved"), F.lit("0").alias("posted"), held.alias("outstanding"), held.alias("committed"), F.lit("10000000000").alias("authorized"))
    return transitions.problems(log)


#: Runs in which the rows of a stream arrive.
ARRIVALS = 3


def arriving(sides: dict[str, DataFrame], path: str, within: str) -> tuple[dict[str, str], int, int]:
    """The sides' folders, how late a row can be in milliseconds, and the latest time of a row in microseconds; slices are staged under `staged-` and the side's name.

    Rows arrive by equal slices of the time of both sides, every seventh id one slice late.
    In the last slice of each side stands a row of no id so late that all before it is final.
    Watermarks count whole milliseconds, and a row at the watermark is late already: slices
    are so many milliseconds wide, and rows may be one more late.
    """
    spans = [s.agg(F.min("at").alias("a"), F.max("at").alias("b")) for s in sides.values()]
    span = spans[0].unionByName(spans[1]).agg(F.unix_micros(F.min("a")).alias("a"), F.unix_micros(F.max("b")).alias("b")).first()
    first, last = span["a"] or 0, span["b"] or 0
    width = ((last - first) // (1000 * ARRIVALS) + 1) * 1000
    folders = {}
    for name, rows in sides.items():
        slices = F.floor((F.unix_micros("at") - first) / width) + F.when(F.col("id") % 7 == 0, 1).otherwise(0)
        far = F.timestamp_micros(F.lit(last + 4 * width)) + F.expr(f"INTERVAL {within}")
        end = rows.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("id"), far.alias("at"), F.lit(None).cast("string").alias("cost"), F.lit(None).cast("string").alias("status"))
        late = rows.select("*", F.least(slices, F.lit(ARRIVALS - 1)).cast("int").alias("arrival")).unionByName(end.withColumn("arrival", F.lit(ARRIVALS - 1)))
        folders[name] = f"{path}/{name}"
        late.write.partitionBy("arrival").parquet(f"{path}/staged-{name}")
    return folders, width // 1000 + 1, last


@query("""WITH c AS (SELECT o_orderkey AS id, o_orderdate AS at, CAST(o_custkey % 5 AS VARCHAR) AS cost, o_orderstatus AS status FROM orders),
s AS (SELECT l_orderkey AS id, l_shipdate AS at, CASE WHEN l_linenumber = 5 THEN '-' ELSE '' END || CAST(CAST(l_quantity AS BIGINT) % 5 AS VARCHAR) AS cost, l_linestatus AS status FROM lineitem),
p AS (SELECT coalesce(c.id, s.id) AS id, year(coalesce(c.at, s.at)) AS year,
CASE WHEN c.at IS NULL THEN 'settled without a call' WHEN s.at IS NULL THEN 'not settled in time' WHEN c.status IS DISTINCT FROM s.status THEN 'status differs' WHEN s.cost LIKE '-%' THEN 'invalid cost' WHEN c.cost <> s.cost THEN 'cost does not reconcile' END AS problem
FROM c FULL JOIN s ON c.id = s.id AND s.at BETWEEN c.at AND c.at + INTERVAL 200 DAY)
SELECT CAST(year AS INTEGER) AS year, problem, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM p GROUP BY 1, 2""")
def streamed_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders met with the lines that ship them within 200 days, as two streams whose rows arrive in three runs, some of them late."""
    within = "200 days"
    calls = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"), (F.col("o_custkey") % 5).cast("string").alias("cost"), F.col("o_orderstatus").alias("status"))
    sign = F.when(F.col("l_linenumber") == 5, "-").otherwise("")
    settled = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("timestamp").alias("at"), F.concat(sign, (F.col("l_quantity").cast("bigint") % 5).cast("string")).alias("cost"), F.col("l_linestatus").alias("status"))

    def made(path: str) -> DataFrame:
        folders, delay, last = arriving({"calls": calls, "settled": settled}, path, within)
        for k in range(ARRIVALS):  # each a run of its own, which goes on from the state of the one before
            for name, folder in folders.items():
                files.folder(spark, folder)
                if files.exists(spark, f"{path}/staged-{name}/arrival={k}"):
                    files.place(spark, f"{path}/staged-{name}/arrival={k}", f"{folder}/{k}")
            sides = [flows.source(spark, f"{folder}/*", "id long, at timestamp, cost string, status string", files=10_000) for folder in folders.values()]
            flows.drain(flows.settlements(*sides, ["status"], within, f"{delay} milliseconds"), f"{path}/out", f"{path}/state")
        met = spark.read.parquet(f"{path}/out").where(F.unix_micros(F.coalesce("at", "settled_at")) <= last)  # without the rows that end the sides
        return met.groupBy(F.year(F.coalesce("at", "settled_at")).alias("year"), "problem").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))

    return written(spark, made)


@query("""SELECT doc_id, octet_length(encode(text)) AS size, sha256(text) AS sha256, greatest(1, (octet_length(encode(text)) + 4095) // 4096) AS pieces FROM documents WHERE text IS NOT NULL""")
def archived_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the documents as members of tar archives, one a task, found again by an index and read by ranges: their digests, and the pieces of 4 KiB they come in."""
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.concat("doc_id", F.lit(".txt")).alias("member"), F.col("text").cast("binary").alias("content"))

    def made(path: str) -> DataFrame:
        archives.write(docs, path)
        rows = archives.index(archives.found(spark, path, "*.tar"))
        cut = archives.contents(rows, 4096).groupBy("archive", "nth").agg(F.count("*").alias("pieces"), F.sum(F.length("content")).alias("size"))
        doc_id = F.regexp_extract("member", "[0-9]+", 0).cast("bigint").alias("doc_id")
        return archives.digested(rows).select("archive", "nth", doc_id, "sha256").join(cut, ["archive", "nth"]).select("doc_id", "size", "sha256", "pieces")

    return written(spark, made)
