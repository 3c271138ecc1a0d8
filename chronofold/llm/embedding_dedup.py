"""Near-duplicate vectors by int8 tile products with error bounds.

Every vector of length one is stored as int8 codes of its own scale, and the length of what
the codes leave out is kept beside them. The product of two code rows is an integer; with
the two errors it bounds the cosine from both sides, so a pair whose upper bound is below
the threshold is no link, whatever rounding did. Only the other pairs are computed again
from the given components in double precision.

Vectors are spread over blocks; a cell is a pair of blocks and is worked through in tiles.
A cell hands on a count and a root for each of its vectors, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.components import components
from chronofold.llm.scratch import Scratch

BLOCK_ROWS = 8_192, 131_072
"""Fewest and most vectors of a block; between them the blocks grow with the table."""

BLOCKS = 64
TILE = 512, 8_192
EXACT_DIMS = 1_024
"""Up to so many products of two codes add up exactly in single precision."""

SLACK = 1e-6
"""More than the rounding of scales and bounds in single precision can amount to."""


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and error of each row, for rows that are finite and not zero.

    The unit vector differs from codes times scale by a vector no longer than the error.
    """
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9) + 1e-12
    return codes.astype(np.int8), scale, error


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of two tiles of codes. They run in floating point, where they are exact."""
    if a.shape[1] <= EXACT_DIMS:
        return a.astype(np.float32) @ b.astype(np.float32).T
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, at : at + EXACT_DIMS].astype(np.float32) @ b[:, at : at + EXACT_DIMS].astype(np.float32).T
    return out


def possible(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two quantised tiles whose cosine may reach the threshold."""
    (a_codes, a_scale, a_error), (b_codes, b_scale, b_error) = a, b
    bound = tile_product(a_codes, b_codes)
    bound *= a_scale.astype(np.float32)[:, None]
    bound *= b_scale.astype(np.float32)
    bound += b_error.astype(np.float32)
    widest = b_error.max(initial=0)
    return np.nonzero(bound >= (threshold - SLACK - a_error * (1 + widest)).astype(np.float32)[:, None])


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find of many links at once; every entry of the result points at its root."""
    while True:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            return parent
        np.minimum.at(parent, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def cell_links(x: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Links between two sets of rows of ``x``: weight linked to each row, root of each row,
    and how many pairs were computed in full precision. Equal sets give each pair once."""
    shift = np.frexp(np.abs(x).max(1))[1]
    x = np.ldexp(x, -shift[:, None])  # powers of two, so no product overflows and none changes
    size = np.sqrt((x * x).sum(1))
    codes, scale, error = quantise(x)
    found, parent, computed = np.zeros(len(x), np.int64), np.arange(len(x)), 0
    same = len(left) == len(right) and bool((left == right).all())
    for u in range(0, len(left), TILE[0]):
        rows = left[u : u + TILE[0]]
        for v in range(u // TILE[1] * TILE[1] if same else 0, len(right), TILE[1]):
            columns = right[v : v + TILE[1]]
            i, j = possible(*((codes[k], scale[k], error[k]) for k in (rows, columns)), threshold)
            if same:
                once = i + u < j + v
                i, j = i[once], j[once]
            i, j = rows[i], columns[j]
            computed += len(i)
            for at in range(0, len(i), 1 << 17):
                a, b = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
                linked = np.einsum("ij,ij->i", x[a], x[b]) / (size[a] * size[b]) >= threshold
                a, b = a[linked], b[linked]
                np.add.at(found, a, weight[b])
                np.add.at(found, b, weight[a])
                parent = hook(parent, a, b)
    return found, parent, computed


def near_duplicate_vectors(table: DataFrame, *, threshold: float = 0.9, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``table`` (vec_id, embedding).

    Two vectors are linked if they have one dimension and a cosine of ``threshold`` or more
    in double precision. n_links counts the other rows a row is linked with, copies
    included; component_id is the smallest vec_id reachable by links, itself included; kept
    says that it is the row's own. Rows of one vec_id share what they reach, and repeated
    rows are linked with each other. Vectors that are null, empty, zero or hold null or
    non-finite components and rows without vec_id link with nothing. An empty table gives
    no rows; other columns are not read. ``threshold`` is above 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = table.sparkSession
    scratch = scratch or Scratch(spark)
    x = F.col("x")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & whole & F.exists(x, lambda v: v != 0)
    given = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("x"))
    given = given.withColumn("sound", F.coalesce(sound, F.lit(False)))
    name = [F.xxhash64(F.lit(salt), x).alias(f"h{salt}") for salt in (1, 2)]
    rows = given.where("sound").select("vec_id", *name, "x")

    # Equal vectors are one class, so a vector in a third of all rows is compared once.
    classes = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("x").alias("x"))
    classes = scratch.keep(classes, "classes")
    total = classes.count()
    least, most = BLOCK_ROWS
    blocks = max(1, -(-total // min(max(least, total // BLOCKS), most)))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    placed = classes.select("*", F.size("x").alias("dim"), F.pmod("h1", F.lit(blocks)).cast("int").alias("block")).select("*", other)
    placed = placed.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).drop("other")

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        vectors = cell.column("x").chunk(0) if cell.num_rows else None
        dim = cell.column("dim")[0].as_py()
        block = cell.column("block").to_numpy()
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        full = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found, root, _ = cell_links(full, cell.column("n").to_numpy(), left, right, threshold)
        some = np.flatnonzero(found)
        reps = cell.column("rep").to_numpy()
        return pa.table(
            {
                "h1": cell.column("h1").take(pa.array(some)),
                "h2": cell.column("h2").take(pa.array(some)),
                "links": pa.array(found[some]),
                "rep": pa.array(reps[some]),
                "root": pa.array(reps[root[some]]),
            }
        )

    found = placed.groupBy("dim", "i", "j").applyInArrow(compare, "h1 bigint, h2 bigint, links bigint, rep bigint, root bigint")
    found = scratch.keep(found, "found")

    # An id with several different vectors ties them.
    held = rows.select("vec_id", "h1", "h2")
    kinds = held.groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high"))
    several = scratch.keep(kinds.where("low <> high").select("vec_id"), "several")
    tied = held.join(several, "vec_id").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select("vec_id", "rep")
    links = found.select("rep", "root").unionByName(tied.select("rep", F.col("vec_id").alias("root")))
    reached = components(links, scratch).select(F.col("node").alias("rep"), F.col("component").alias("component_id"))

    counts = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    facts = classes.select("h1", "h2", "rep", "n").join(counts, ["h1", "h2"], "left").join(reached, "rep", "left")
    zero = F.lit(0).cast("bigint")
    facts = facts.select(
        "h1",
        "h2",
        (F.col("n") - 1 + F.coalesce("links", zero)).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"),
    )
    # Written, so that the join is one of two exchanges and a frequent vector can be split.
    facts = scratch.keep(facts, "facts")
    linked = held.join(facts, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = given.where("not sound").select("vec_id", zero.alias("n_links"), F.col("vec_id").alias("component_id"))
    result = linked.unionByName(alone)
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
