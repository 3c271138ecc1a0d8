"""Connected components of links by union-find inside tasks and stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.scratch import Scratch


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: each node with the smallest it reaches."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(v, root(v)) for v in parent]
    out = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["v", "m"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m") % 1_000_000_007)).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reached.

    ``links`` has two long columns, without nulls. Each round ties all neighbours of a
    node to the smallest of them, first the larger ones, then the smaller ones, until
    nothing changes; a hub meets its neighbours by aggregate and join, never in one row.
    """
    a, b = links.columns
    pairs = links.select(F.col(a).alias("v"), F.col(b).alias("m")).where("v <> m")
    edges = scratch.keep(pairs.mapInArrow(_forest, "v bigint, m bigint").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.join(low, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m"))
        large = large.where("v <> m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(least, "v")
        small = small.select(F.col("m").alias("v"), F.col("low").alias("m")).unionByName(least.select("v", F.col("low").alias("m")))
        after = scratch.keep(small.where("v <> m").distinct(), "edges")
        now = _mark(after)
        scratch.drop(edges)
        edges, same, mark = after, now == mark, now
        if same:
            break
    tops = edges.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(tops)
