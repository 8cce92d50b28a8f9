"""Nearest neighbours by a block matrix join with quantised products.

Vectors are quantised to int8 with a scale each, which is all that travels in blocks: a block of queries meets each
block of candidates once (a stated query set against all rows), and a tile of int8 products gives every inner product
up to an error bound: with x = s q + e for the quantised q, |x.y - s t (q.p)| <= |e||y| + |s q||f|. A tile lets pass
what can reach its k-th best lower bound; over all tiles of a query only what can reach the k-th best lower bound of
all is left, a little more than k pairs. These are recomputed from the original vectors in double precision and merged
by heaps, so the result is exact. The shuffle holds a byte a component for each pair of blocks, k rows for each query
and block of candidates, and the original vectors of the pairs that are left. The int8 products run as float32 matrix
products, exact below 1000 dimensions and in double beyond.

Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so the others are not asked (a vector
that a third of all rows share costs no more than another); this drops nothing that a result could hold. Rows are
dealt into blocks by their number.

Cases: null or zero vectors and those with null or non-finite components take no part, as query or candidate, nor
do rows without an id. Ids must be whole numbers. Vectors of different lengths never meet. Ties go to the smaller id.
Fewer candidates than k: all of them. Repeated rows are candidates each, except for queries of the same id. Empty
table: no rows. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import map_arrow, quoted, stage, table, whole_numbers

BLOCK, QUERY_BLOCK, TILE = 65536, 4096, 2048


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, error norm, norm of the quantised vector) of each row."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(x - back, axis=1), np.linalg.norm(back, axis=1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, width).astype(np.float64)


def codes_of(b: pa.RecordBatch) -> dict:
    """(row, id, dim, query, code, scale, error, back, norm) of (row, id, dim, query, x)."""
    dim = b.column(2).to_numpy()
    code, out = [b""] * b.num_rows, np.zeros((4, b.num_rows))
    for d in np.unique(dim):
        at = np.nonzero(dim == d)[0]
        x = matrix(b.column(4).take(pa.array(at)), int(d))
        c, *sizes = quantise(x)
        out[:, at] = np.stack([*sizes, np.linalg.norm(x, axis=1)])
        for i, raw in zip(at.tolist(), c, strict=True):
            code[i] = raw.tobytes()
    return {"row": b.column(0), "id": b.column(1), "dim": b.column(2), "query": b.column(3), "code": code, "scale": out[0], "error": out[1], "back": out[2], "norm": out[3]}


def bounds(q: dict[str, np.ndarray], c: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of a query, place of a candidate, lower and upper bound of their product) for all pairs that can be among
    the query's k best of these candidates."""
    width = q["code"].shape[1]
    kind = np.float32 if width < 1000 else np.float64
    a = q["code"].astype(kind)
    best = np.full((len(a), k), -np.inf)
    found: list[tuple] = []
    for at in range(0, len(c["id"]), TILE):
        part = {n: x[at : at + TILE] for n, x in c.items()}
        near = (a @ part["code"].astype(kind).T).astype(np.float64) * q["scale"][:, None] * part["scale"][None]
        slack = (q["error"][:, None] * part["norm"][None] + q["back"][:, None] * part["error"][None]) * (1 + 1e-9) + 1e-9 * np.abs(near) + 1e-12
        lower = near - slack
        lower[q["id"][:, None] == part["id"][None]] = -np.inf
        best = -np.partition(-np.concatenate([best, lower], 1), k - 1, 1)[:, :k]
        floor = best.min(1)
        rows, cols = np.nonzero((near + slack >= floor[:, None]) & (lower > -np.inf))
        found.append((rows, cols + at, lower[rows, cols], (near + slack)[rows, cols]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0), np.zeros(0)
    rows, cols, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = high >= best.min(1)[rows]
    return rows[keep], cols[keep], low[keep], high[keep]


def nearest(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, key, score) of the k rows with the largest inner product, for each row that is a query."""
    whole_numbers(vectors, key)
    x = quoted(vector)
    good = vectors.where(quoted(key).isNotNull() & x.isNotNull()).where(F.size(x) > 0)
    good = good.where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0))
    good = good.select(F.monotonically_increasing_id().alias("row"), quoted(key).cast("long").alias("id"), F.size(x).alias("dim"), is_query.alias("query"), x.alias("x"))
    good = stage(good, "vectors")  # row numbers hold from here on
    sizes = good.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("query").alias("m")).collect()  # a row per dimension
    cut = {r["dim"]: (-(-r["n"] // block), max(1, -(-r["m"] // query_block))) for r in sizes if r["m"]}
    if not cut:
        return vectors.sparkSession.createDataFrame([], f"query_id bigint, rank int, `{key}` bigint, score double")
    of = lambda i: F.element_at(F.create_map(*[F.lit(v) for d, n in cut.items() for v in (d, n[i])]), F.col("dim"))
    good = good.where(F.col("dim").isin(list(cut)))
    # Equal vectors: the k + 1 smallest ids of each; Spark cuts groups before it shuffles them.
    place = F.row_number().over(Window.partitionBy(F.xxhash64("x"), "x").orderBy("id", "row"))
    needed = good.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    once = good.where("query").groupBy("id").agg(F.min(F.struct("dim", "x", "row"))["row"].alias("row"))  # an id asks once
    names = ["row", "id", "dim", "query", "x"]
    shape = "row bigint, id bigint, dim int, query boolean, code binary, scale double, error double, back double, norm double"
    codes = map_arrow(needed.select(names), shape, codes_of)
    asked = map_arrow(good.join(once.select("row"), "row", "left_semi").select(names), shape, codes_of)
    salt = F.xxhash64("row")
    blocks = codes.select("*", F.explode(F.sequence(F.lit(0), of(1) - 1)).alias("qb"), F.pmod(salt, of(0)).cast("int").alias("cb"))
    every = asked.select("*", F.pmod(salt, of(1)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), of(0) - 1)).alias("cb"))

    def arrays(t: pa.Table) -> dict[str, np.ndarray]:
        out = {n: t.column(n).to_numpy() for n in ("row", "id", "scale", "error", "back", "norm")}
        return out | {"code": np.frombuffer(b"".join(t.column("code").to_pylist()), np.int8).reshape(len(t), -1)}

    def tile(asked: pa.Table, candidates: pa.Table) -> pa.Table:
        cols = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)] * 2
        if len(asked) and len(candidates):
            q, c = arrays(asked), arrays(candidates)
            i, j, low, high = bounds(q, c, k)
            cols = [q["row"][i], q["id"][i], c["row"][j], low, high]
        return pa.table(dict(zip(("ask", "query_id", "row", "low", "high"), cols, strict=True)))

    met = every.groupBy("dim", "qb", "cb").cogroup(blocks.groupBy("dim", "qb", "cb")).applyInArrow(tile, "ask bigint, query_id bigint, row bigint, low double, high double")
    met = stage(met, "bounds")
    own = Window.partitionBy("query_id").orderBy(F.desc("low"))
    floor = met.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("low").alias("low"))
    floor = floor.select("query_id", F.when(F.col("n") == k, F.col("low")).otherwise(float("-inf")).alias("floor"))
    left = met.join(floor, "query_id").where("high >= floor").select("ask", "query_id", "row")
    left = left.join(good.select("row", "id", F.col("x")), "row").select("ask", "query_id", "id", "x")
    left = left.join(good.where("query").select(F.col("row").alias("ask"), F.col("x").alias("qx")), "ask").select("query_id", "id", F.size("x").alias("dim"), "qx", "x")

    def exact(b: pa.RecordBatch) -> dict:
        dim, score = b.column(2).to_numpy(), np.zeros(b.num_rows)
        for d in np.unique(dim):
            at = np.nonzero(dim == d)[0]
            q, c = (matrix(b.column(i).take(pa.array(at)), int(d)) for i in (3, 4))
            score[at] = np.einsum("ij,ij->i", q, c)
        # A batch passes on no more than k rows of a query.
        query, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
        order = np.lexsort((ids, -score, query))
        first = np.concatenate([[True], np.diff(query[order]) != 0])
        at = np.arange(len(order))
        keep = order[at - np.maximum.accumulate(np.where(first, at, 0)) < k]
        return {"query_id": query[keep], "id": ids[keep], "score": score[keep]}

    scored = map_arrow(left, "query_id bigint, id bigint, score double", exact)

    def merge(batches):
        query, heap = None, []

        def done():
            h = sorted(heap, reverse=True)
            return [(query, r, -i, v) for r, (v, i) in enumerate(h, 1)]

        for b in batches:
            out: list[tuple] = []
            for q, i, v in zip(*(b.column(n).to_pylist() for n in ("query_id", "id", "score")), strict=True):
                if q != query:
                    out += done()
                    query, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (v, -i))
                elif (v, -i) > heap[0]:
                    heapq.heapreplace(heap, (v, -i))
            yield rows(out)
        yield rows(done())

    def rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", key, "score"])

    return scored.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, f"query_id bigint, rank int, `{key}` bigint, score double")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
