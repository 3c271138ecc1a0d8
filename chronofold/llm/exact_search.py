"""Exact top-k search by inner product with a pivot table.

Every vector carries its distances to a set of pivots. The largest difference of two
distances bounds the distance of two vectors from below, which bounds their inner product
from above. A query evaluates candidates in the order of these bounds and stops once no
bound left reaches its k-th score. Queries and rows meet in cells of bounded size, each
row once for a block of queries; cells hand on k candidates for a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 32
QUERY_BLOCK, ROW_BLOCK = 2048, 4096
FIRST = 64
"""Candidates a query evaluates before it looks at its k-th score."""


def integer_vectors(table: DataFrame) -> DataFrame:
    """vec_id, dim, items (floor of 256 times each component) of the sound rows."""
    x = F.col("embedding")
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))
    )
    items = F.transform(x, lambda v: F.floor(v.cast("double") * 256))
    rows = table.where(F.col("vec_id").isNotNull() & sound)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.size(x).alias("dim"), items.alias("items")).distinct()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))


def _cell(q_ids, q, q_far, x_ids, x, x_far, k) -> tuple[list, list, list]:
    """For each query: up to k best (score, then smaller id) among the rows of one cell."""
    out_q, out_x, out_s = [], [], []
    size = (x * x).sum(1)
    for a in range(0, len(q), 64):
        low = np.zeros((len(q[a : a + 64]), len(x)))
        for p in range(x_far.shape[1]):
            np.maximum(low, np.abs(q_far[a : a + 64, p, None] - x_far[None, :, p]), out=low)
        own = (q[a : a + 64] ** 2).sum(1)
        bounds = (own[:, None] + size - np.maximum(low - 1e-6, 0) ** 2) / 2 + 1e-3
        for j, bound in enumerate(bounds):
            i = a + j
            bound[x_ids == q_ids[i]] = -np.inf
            head = np.argpartition(-bound, FIRST)[:FIRST] if len(x) > FIRST else np.arange(len(x))
            head = head[bound[head] > -np.inf]
            scores = x[head] @ q[i]
            kth = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
            rest = bound >= kth
            rest[head] = False
            rest &= bound > -np.inf
            rest = np.flatnonzero(rest)
            rest = rest[np.argsort(-bound[rest], kind="stable")]
            at, step = 0, FIRST
            while at < len(rest) and bound[rest[at]] >= kth:
                part = rest[at : at + step]
                head = np.concatenate([head, part])
                scores = np.concatenate([scores, x[part] @ q[i]])
                best = np.lexsort((x_ids[head], -scores))[: max(k, 1)]
                head, scores = head[best], scores[best]
                kth = scores[k - 1] if len(scores) >= k else -np.inf
                at, step = at + step, step * 4
            best = np.lexsort((x_ids[head], -scores))[:k]
            out_q += [q_ids[i]] * len(best)
            out_x += x_ids[head[best]].tolist()
            out_s += scores[best].astype(np.int64).tolist()
    return out_q, out_x, out_s


def exact_top_k(table: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query.

    Queries are the ids divisible by ``every``; candidates are all rows of another id and
    the same dimension. Null ids, null or empty vectors and vectors with a null or
    non-finite component take no part. Repeated rows count once; two different vectors of
    one id are both candidates, and as queries give one joint list. Ties go to the smaller
    id. Scores are exact: integers below 2**53. An empty table gives no rows.
    """
    spark = table.sparkSession
    rows = integer_vectors(table)
    # A fixed number of pivots; any choice is right, a spread one stops earlier.
    sample = rows.orderBy(F.xxhash64("vec_id"), "items").limit(PIVOTS).collect()
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    pivots = {}
    for r in sample:
        pivots.setdefault(r["dim"], []).append(r["items"])
    pivots = {d: np.array(p, np.float64) for d, p in pivots.items()}
    q_blocks, x_blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n // ROW_BLOCK))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = _matrix(part.column(2), int(d))
                table = _distances(x, pivots.get(int(d), np.zeros((1, int(d)))))
                at = pa.array(np.arange(len(x) + 1) * table.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(at, pa.array(table.ravel()))], ["vec_id", "dim", "items", "far"]
                )

    measured = rows.mapInArrow(far, "vec_id bigint, dim int, items array<bigint>, far array<double>")
    block = lambda name, count, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).alias(name)
    every_block = lambda name, count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))).alias(name)
    candidates = measured.select("*", block("x_block", x_blocks, 1)).select("*", every_block("q_block", q_blocks))
    queries = measured.where(F.col("vec_id") % every == 0).select("*", block("q_block", q_blocks, 2))
    queries = queries.select("*", every_block("x_block", x_blocks))
    cell = ["dim", "q_block", "x_block"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [], [], []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            sides = []
            for side in (left, right):
                side = side.combine_chunks()
                width = len(side.column("far")[0])
                ids = side.column("vec_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                x, f = (_matrix(side.column(c).combine_chunks(), w) for c, w in (("items", dim), ("far", width)))
                sides += [ids[order], x[order], f[order]]
            found = _cell(*sides, k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    both = queries.groupBy(*cell).cogroup(candidates.groupBy(*cell))
    best = both.applyInArrow(search, "query_id bigint, vec_id bigint, score bigint").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
