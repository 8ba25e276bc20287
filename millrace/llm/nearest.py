"""Operator 12: nearest neighbours by inner product, as a block matrix join.

Queries and candidates are dealt to blocks by their hashes; each pair of a
block of queries and one of candidates is a tile, whose size is bounded. In a
tile the vectors are rounded to int8, each by a scale of its own. With
u = a + x and v = b + y, a and b rounded, <u, v> is <a, b> but for at most
|a||y| + |x||v|: the product of integers comes with the bounds of its error.
Of a query's candidates those stay whose upper bound reaches the k-th best lower
bound, or the k-th best product so far; they are computed in double precision.
Nothing is lost: the result is that of comparing everything.

Tiles give each query's k best, and those of its tiles are merged by a heap.

Equal vectors are one candidate with their k least ids, and one query, however
often they stand. Integer products are made by single-precision matrix
products, exact below 2^24; longer vectors are multiplied in pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

K = 20
#: Of the queries and of the candidates of a tile: their numbers by hash are near these; values in a block, at most, which long vectors come to first.
QUERIES_A_TILE, CANDIDATES_A_TILE, VALUES_A_TILE = 2048, 16_384, 1 << 22
#: Blocks of candidates at least, so that small tables use many tasks, too.
LEAST_BLOCKS = 16
#: Candidates of a tile that are compared at a time, pairs computed at a time, and dimensions whose integer products stay exact.
STRIP, PAIRS, EXACT = 1024, 1 << 16, 1024
#: What rounding of doubles may take from a bound, relative to the norms.
SLACK = 1e-12
TILE = "query string, best array<struct<less: double, no_id: boolean, id: bigint, same: boolean>>"


def rounded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of v: int8 codes, scales, norms of the rounded, of what rounding left, and of the rows."""
    scale = np.abs(v).max(axis=1) / 127
    # The least numbers have no scale that can be divided by; they count as rounded to nothing.
    ok = scale >= np.finfo(np.float64).tiny
    codes = np.rint(v / np.where(ok, scale, np.inf)[:, None]).astype(np.int8)
    scale = np.where(ok, scale, 0.0)
    back = codes * scale[:, None]
    norm = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x))
    return codes, scale, norm(back), norm(v - back), norm(v)


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of the rows of a with those of b, exact."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT):
        out += a[:, i : i + EXACT].astype(np.float32) @ b[:, i : i + EXACT].astype(np.float32).T
    return out


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the columns i of a with the columns j of b, in double precision, summed in the order of the dimensions."""
    out = np.zeros(len(i))
    for start in range(0, len(i), PAIRS):
        p, q = i[start : start + PAIRS], j[start : start + PAIRS]
        for x, y in zip(a, b, strict=True):
            out[start : start + PAIRS] += x[p] * y[q]
    return out


def best_of_tile(q: np.ndarray, c: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, candidate, product: the k best candidates of each query, or all if they are fewer.

    Rows of q and c are vectors; `first` orders candidates of equal product.
    """
    qc, qs, qa, qx, qn = rounded(q)
    qt, ct = np.ascontiguousarray(q.T), np.ascontiguousarray(c.T)
    kept_q, kept_c, kept_s = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    least = np.full(len(q), -np.inf)  # each query's k-th best so far
    for start in range(0, len(c), STRIP):
        cc, cs, _, cx, cn = rounded(c[start : start + STRIP])
        with np.errstate(all="ignore"):  # what is not finite stays
            near = int8_products(qc, cc) * qs[:, None] * cs
            error = qa[:, None] * cx + qx[:, None] * cn + SLACK * qn[:, None] * cn
            lower, upper = near - error, near + error
        lower[~np.isfinite(lower)], upper[~np.isfinite(upper)] = -np.inf, np.inf
        wanted = least
        if lower.shape[1] >= k:
            wanted = np.maximum(least, np.partition(lower, -k, axis=1)[:, -k])
        i, j = np.nonzero(upper >= wanted[:, None])
        with np.errstate(all="ignore"):
            s = products(qt, ct, i, j + start)
        i, j, s = np.concatenate([kept_q, i]), np.concatenate([kept_c, j + start]), np.concatenate([kept_s, s])
        order = np.lexsort((first[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        begins = np.searchsorted(i, np.arange(len(q)))
        rank = np.arange(len(i)) - begins[i]
        full = rank == k - 1
        least[i[full]] = s[full]
        kept_q, kept_c, kept_s = (x[rank < k] for x in (i, j, s))
    return kept_q, kept_c, kept_s


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _tile(k: int):
    def found(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return pa.table({"query": pa.array([], pa.string()), "best": pa.array([], _BEST)})
        q, c = _vectors(queries["vector"]), _vectors(candidates["vector"])
        lists = candidates["ids"].to_pylist()
        order = np.empty(len(c), dtype=np.int64)
        order[sorted(range(len(c)), key=lambda i: (lists[i][0] is None, lists[i][0] or 0))] = np.arange(len(c))
        i, j, s = best_of_tile(q, c, order, k)
        same = (q[i] == c[j]).all(axis=1)
        best: list[list] = [[] for _ in range(len(q))]
        for a, b, x, y in zip(i.tolist(), j.tolist(), (-s).tolist(), same.tolist(), strict=True):
            best[a] += [(x, n is None, n, y) for n in lists[b]]
        best = [sorted(x, key=_order)[:k] for x in best]
        rows = [[{"less": x, "no_id": m, "id": n, "same": y} for x, m, n, y in of] for of in best]
        return pa.table({"query": queries["query"], "best": pa.array(rows, _BEST)})

    return found


_BEST = pa.list_(pa.struct([("less", pa.float64()), ("no_id", pa.bool_()), ("id", pa.int64()), ("same", pa.bool_())]))


def _order(x: tuple) -> tuple:
    """Nearest first, then the least id, no id last."""
    return x[0], x[1], x[2] or 0


def _merge(k: int):
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come query by query; of one query at a time the k best are held."""
        query, heap = None, []
        for b in batches:
            said, out = [], []
            for of, best in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                best = [(x["less"], x["no_id"], x["id"], x["same"]) for x in best]
                if of != query:
                    if query is not None:
                        said.append(query)
                        out.append(heap)
                    query, heap = of, best
                else:
                    heap = list(islice(heapq.merge(heap, best, key=_order), k))
            yield _told(said, out)
        if query is not None:
            yield _told([query], [heap])

    return merged


def _told(queries: list[str], best: list[list[tuple]]) -> pa.RecordBatch:
    rows = [[{"less": x, "no_id": m, "id": n, "same": y} for x, m, n, y in of] for of in best]
    return pa.RecordBatch.from_arrays([pa.array(queries, pa.string()), pa.array(rows, _BEST)], names=["query", "best"])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: it has numbers alone, all finite, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, asks: Column, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that `asks`, the k rows of largest inner product but itself.

    Ids are integers, vectors arrays of numbers; vectors of different lengths
    are not compared. Null, empty and zero vectors and those with null or
    non-finite values neither ask nor are found. Ties go to the least id, null
    ids last. Rows that repeat id and vector are one; of one id with several
    vectors each row asks for itself and may find the others. No rows give none.
    """
    spark = vectors.sparkSession
    # Only so many ids of equal vectors can be found, the own one besides.
    held = k + 1
    plus = F.transform(F.col(vector), lambda x: x + F.lit(0).cast("float"))  # -0 is 0
    rows = vectors.withColumn(vector, F.when(usable(F.col(vector)), plus)).where(F.col(vector).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    nth = F.row_number().over(Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last()))
    few = rows.select("id", "vector").distinct().withColumn("nth", nth).where(F.col("nth") <= held)
    sorted_ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col("nth"), F.col("id")))), lambda x: x["id"])
    candidates = checkpoint(few.groupBy("vector").agg(sorted_ids.alias("ids")))
    asking = rows.where("asks").select("id", F.sha2(F.to_json("vector"), 256).alias("query"), "vector").distinct()
    queries = checkpoint(asking.groupBy("query").agg(F.first("vector").alias("vector")))
    longest = candidates.agg(F.count("*"), F.max(F.size("vector"))).first()
    wide = longest[1] or 1
    a_tile = lambda n: max(1, min(n, VALUES_A_TILE // wide))
    across = max(LEAST_BLOCKS, -(-longest[0] // a_tile(CANDIDATES_A_TILE)))
    down = max(1, -(-queries.count() // a_tile(QUERIES_A_TILE)))
    block = lambda n: F.pmod(F.xxhash64("vector"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query", "vector", F.size("vector").alias("size"), block(down).alias("row"), every(across).alias("col"))
    right = candidates.select("vector", "ids", F.size("vector").alias("size"), every(down).alias("row"), block(across).alias("col"))
    tile = ["size", "row", "col"]
    found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(_tile(held), TILE)
    merged = found.repartition("query").sortWithinPartitions("query").mapInArrow(_merge(held), TILE)
    # Kept apart from the join, so that Spark can split a vector that very many rows ask with over several tasks there.
    merged = checkpoint(merged)
    others = lambda x: ~(x["same"] & x["id"].eqNullSafe(F.col("query_id")))
    answers = asking.select(F.col("id").alias("query_id"), "query").join(merged, "query").select("query_id", F.posexplode(F.slice(F.filter("best", others), 1, k)).alias("at", "x"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 20 ask."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = f"""
WITH rows AS (
  SELECT DISTINCT vec_id, e FROM (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM rows q JOIN rows c ON len(q.e) = len(c.e) AND (q.vec_id IS DISTINCT FROM c.vec_id OR q.e <> c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) <= {K}
"""

QUERIES = {"op12_nearest": op12_nearest}
ORACLES = {"op12_nearest": ORACLE}
