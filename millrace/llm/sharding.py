"""Operator 1: sharding by a hierarchical weighted hash tree.

A tree has regions, racks and places for shards; a place has a weight, and a
rack or a region has the sum of what is below it. A row descends: at each level
every child draws -ln(u) / weight, u being a hash of the row's key and the
child's name, and the least draw wins. So each child wins in proportion to its
weight, and a changed weight changes that child's draws alone: rows move to or
from that child, and below a node whose children keep their weights nothing
moves.

Places are there before their shards. A row that descends to a vacant one draws
again in that region, and its draws there add up: the region has a row only if
the row comes to a shard before the draws pass those of the other regions. So a
shard that fills a place takes from every other shard its share, and no row
moves between the others; the number of shards alone decides the tree.

Rows equal in key, bytes and CRC are merged before anything is shuffled and
numbered together. Their counts by shard and bucket, 4,096 a shard at most, are
joined where the rows are already dealt out by both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, key_text, table, uniform

#: Hex digits of the bucket in which rows of a shard are put in order: 4,096 buckets.
BUCKET_DIGITS = 3
#: Equal rows that are numbered at a time.
PART = 10_000
#: Draws of a row in one region, at most. Of two shards in a region of eight places, one row in 10,000 meets neither in all of them.
DRAWS = 32


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0
    vacant: bool = False


def layout(shards: int, per_rack: int = 4, per_region: int = 8) -> list[Leaf]:
    """Equal places, dealt to racks and regions in their order; those of the last region that have no shard yet are vacant."""
    places = -(-shards // per_region) * per_region
    return [Leaf(s // per_region, s // per_rack, s, vacant=s >= shards) for s in range(places)]


def _least(key: Column, level: str, children: Column) -> Column:
    """The name of the child with the least draw."""
    drawn = F.transform(children, lambda c: F.struct((-F.log(uniform(key, F.lit(level), c["name"].cast("string"))) / c["weight"]).alias("draw"), c["name"].alias("name")))
    return F.array_min(drawn)["name"]


def _sum(tree: list[Leaf], parent: str | None, child: str) -> dict[int, dict[int, float]]:
    found: dict[int, dict[int, float]] = {}
    for x in tree:
        below = found.setdefault(getattr(x, parent) if parent else 0, {})
        below[getattr(x, child)] = below.get(getattr(x, child), 0.0) + x.weight
    return found


def _children(below: dict[int, float]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in sorted(below.items()) if w > 0])


def _descend(key: Column, region: Column, tree: list[Leaf]) -> Column:
    """The place that a key comes to in a region."""
    node = region
    for parent, child in (("region", "rack"), ("rack", "shard")):
        branches = F.create_map(*[y for n, below in sorted(_sum(tree, parent, child).items()) for y in (F.lit(n), _children(below))])
        node = _least(key, child, F.element_at(branches, node))
    return node


def _draw(key: Column, region: int, weight: float) -> Column:
    return -F.log(uniform(key, F.lit("region"), F.lit(region).cast("string"))) / F.lit(float(weight))


def _against(key: Column, tree: list[Leaf], weight: float, have: Column) -> Column:
    """A struct of draw and shard: `have`, such a struct, or what a region partly vacant gives if it draws less."""
    region = tree[0].region
    vacant = F.array(*[F.lit(x.shard) for x in tree if x.vacant])

    def looked_at(h: Column) -> Column:
        def step(acc: Column, nth: Column) -> Column:
            again = F.when(nth == 1, key).otherwise(F.concat_ws("|", key, nth.cast("string")))
            drawn = acc["draw"] + _draw(again, region, weight)
            came = _descend(again, F.lit(region), tree)
            came = F.when((drawn < h["draw"]) & ~F.array_contains(vacant, came), came)
            return F.when(acc["shard"].isNotNull() | (acc["draw"] >= h["draw"]), acc).otherwise(F.struct(drawn.alias("draw"), came.alias("shard")))

        came = F.aggregate(F.sequence(F.lit(1), F.lit(DRAWS)), F.struct(F.lit(0.0).alias("draw"), F.lit(None).cast("int").alias("shard")), step)
        return F.transform(F.array(came), lambda c: F.when(c["shard"].isNull(), h).otherwise(c))[0]

    # What is looked at again and again stands in an array of one, and so is drawn once.
    return F.transform(F.array(have), looked_at)[0]


def place(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key.

    A weight of 0 takes nothing. A place that is not vacant and has a weight
    above 0 must be there; the first of them gets the rows that meet none but
    vacant places in all their draws.
    """
    if any(x.weight < 0 for x in tree) or not any(x.weight > 0 and not x.vacant for x in tree):
        raise ValueError("weights must not be negative, and one place with a weight above 0 must not be vacant")
    tree = [x for x in tree if x.weight > 0]
    weights = _sum(tree, None, "region")[0]
    partly = sorted({x.region for x in tree if x.vacant} & {x.region for x in tree if not x.vacant})
    whole = sorted({x.region for x in tree} - {x.region for x in tree if x.vacant})
    have = F.struct(F.lit(float("inf")).alias("draw"), F.lit(min(x.shard for x in tree if not x.vacant)).alias("shard"))
    if whole:
        best = F.array_min(F.array(*[F.struct(_draw(key, r, weights[r]).alias("draw"), F.lit(r).alias("region")) for r in whole]))
        within = [x for x in tree if x.region in whole]
        have = F.transform(F.array(best), lambda b: F.struct(b["draw"].alias("draw"), _descend(key, b["region"], within).alias("shard")))[0]
    for r in partly:  # one, where shards fill the places in order
        have = _against(key, [x for x in tree if x.region == r], weights[r], have)
    return have["shard"]


def assign(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's shard and its slot there, and its shard if there were one more.

    The key and the number of shards decide. Rows that share a key share a
    shard; a null key is a key like any other. A null text has no bytes and
    the CRC 0. Slots of a shard run from 0 without gaps, ordered by the first
    digits of the MD5 of key, CRC, size and part (each PART rows equal in all
    three are one), then by these themselves; rows equal in all of these take
    their slots in any order. An empty table gives no rows. Other columns are
    left behind.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw.cast("binary")).cast("long").alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    # A row that is there very often goes on in parts, which fall in buckets of their own.
    rows = rows.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PART).cast("long"))).alias("part", "at"))
    name = key_text("doc_id")
    bucket = F.substring(F.md5(F.concat_ws("|", name, F.col("text_crc32").cast("string"), F.col("size").cast("string"), F.col("part").cast("string"))), 1, BUCKET_DIGITS)
    shard, grown = (place(name, layout(n)).cast("int") for n in (shards, shards + 1))
    rows = checkpoint(rows.select("doc_id", "size", "text_crc32", "part", F.least(F.col("n") - F.col("at"), F.lit(PART)).alias("n"), shard.alias("shard"), grown.alias("grown_shard"), bucket.alias("bucket")))
    counts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("nth", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["shard", "bucket"]).withColumn("start", F.col("start") + F.col("nth"))
    slot = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), shards=40)


def _least_sql(name: str, level: str, nodes: str, on: str) -> str:
    """The row of `name` with the node of least draw below it, by its own columns k and name (what is hashed)."""
    return f"""
    SELECT p.*, n.node FROM {name} p JOIN {nodes} n ON {on}
    QUALIFY row_number() OVER (PARTITION BY p.k, p.a ORDER BY -ln((CAST(('0x' || substr(md5(p.name || '|{level}|' || n.node), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0) / n.weight, n.node) = 1"""


def _tree_sql(suffix: str, shards: int) -> str:
    """shard{suffix}(k, node): each key's shard, drawn in whole regions, and again and again in the one partly filled."""
    whole, places = shards // 8 * 8, -(-shards // 8) * 8
    draw = "-ln((CAST(('0x' || substr(md5(name || '|region|' || region), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0) / 8.0"
    return f"""
drawn{suffix} AS (SELECT k, 1 AS a, name, region, {draw} AS draw FROM keys, (SELECT unnest(range({whole // 8})) AS region)),
best{suffix} AS (SELECT * FROM drawn{suffix} QUALIFY row_number() OVER (PARTITION BY k ORDER BY draw, region) = 1),
again{suffix} AS (
  SELECT *, sum({draw}) OVER (PARTITION BY k ORDER BY a) AS draw
  FROM (SELECT k, a, CASE WHEN a = 1 THEN name ELSE name || '|' || a END AS name, {whole // 8} AS region FROM keys, (SELECT unnest(range(1, {DRAWS + 1 if places > whole else 1})) AS a))),
both{suffix} AS (SELECT k, a, name, region, draw FROM best{suffix} UNION ALL SELECT k, 1 + a, name, region, draw FROM again{suffix}),
rack{suffix} AS ({_least_sql(f"both{suffix}", "rack", "(SELECT unnest(range(1000)) AS node, 4.0 AS weight)", "n.node // 2 = p.region")}),
leaf{suffix} AS ({_least_sql(f"(SELECT * RENAME (node AS rack) FROM rack{suffix})", "shard", "(SELECT unnest(range(4000)) AS node, 1.0 AS weight)", "n.node // 4 = p.rack")}),
shard{suffix} AS (SELECT k, node FROM leaf{suffix} WHERE node < {shards} QUALIFY row_number() OVER (PARTITION BY k ORDER BY draw) = 1)"""


#: CRC-32 of a text: its bytes one by one, by the reflected polynomial's table, which the rule makes.
_CRC = """
bits0 AS (SELECT i, i AS c, 0 AS n FROM range(256) t(i)),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM (
  WITH RECURSIVE r AS (SELECT i, c::BIGINT AS c, n FROM bits0 UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM r WHERE n < 8)
  SELECT i, c FROM r WHERE n = 8))"""

ORACLE = f"""
WITH keys AS (SELECT doc_id AS k, coalesce(CAST(doc_id AS VARCHAR), 'null') AS name FROM (SELECT DISTINCT doc_id FROM documents)),
{_tree_sql("_a", 40)},
{_tree_sql("_b", 41)},
{_CRC},
sized AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
      lambda a, b: xor(tab[CAST(xor(a, b) & 255 AS BIGINT) + 1], a >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT) AS text_crc32
  FROM documents, crc_table),
parts AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // {PART} AS part FROM sized),
bucketed AS (SELECT *, substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || text_crc32 || '|' || size || '|' || part), 1, {BUCKET_DIGITS}) AS bucket FROM parts)
SELECT s.doc_id, size, text_crc32, 'key' AS law, CAST(a.node AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY a.node ORDER BY bucket, s.doc_id NULLS FIRST, text_crc32, size, part) - 1 AS BIGINT) AS slot,
  CAST(b.node AS INTEGER) AS grown_shard
FROM bucketed s JOIN shard_a a ON s.doc_id IS NOT DISTINCT FROM a.k JOIN shard_b b ON s.doc_id IS NOT DISTINCT FROM b.k
"""

QUERIES = {"op1_sharding": op1_sharding}
ORACLES = {"op1_sharding": ORACLE}
