"""Ordered and grouped values over groups whose size nobody promised.

A plain ``Window.partitionBy(key)`` sends a whole group to one task. ``hot_groups``
counts the groups first (a narrow scan with map-side combine). When no group exceeds
``width`` rows the plain window is safe and is used as it is: one exchange serves every
window on the key. When some do, only their rows are cut into segments of consecutive
order values; the window runs inside a segment and what earlier segments leave behind is
carried over from a summary with one row per segment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_ROWS = 1 << 20
HOT_LIMIT = 50_000
SEGMENT = "_segment"


def null_safe_join(left: DataFrame, right: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """Join on ``key`` with null equal to null; the result holds the left side's key."""
    named = right.withColumnsRenamed({k: f"_key_{k}" for k in key})
    on = F.lit(True)
    for k in key:
        on = on & left[k].eqNullSafe(named[f"_key_{k}"])
    return left.join(named, on, how).drop(*[f"_key_{k}" for k in key])


@dataclass(frozen=True)
class HotGroups:
    """Groups with more than ``width`` rows; ``keys`` is null when there are none.

    ``bounded`` says the key list was counted and is small enough to broadcast. When it
    is not, every row is treated as part of a large group.
    """

    key: tuple[str, ...]
    width: int
    keys: DataFrame | None
    bounded: bool = True

    def mark(self, df: DataFrame, order: str) -> DataFrame:
        """Add the segment number: 0 in ordinary groups."""
        cut = F.expr(f"`{order}` div {self.width}")
        if self.keys is None:
            return df.withColumn(SEGMENT, F.lit(0).cast("bigint"))
        if not self.bounded:
            return df.withColumn(SEGMENT, cut)
        flags = self.keys.withColumn("_hot", F.lit(True))
        marked = null_safe_join(df, F.broadcast(flags), self.key, "left")
        return marked.withColumn(
            SEGMENT, F.when(F.col("_hot"), cut).otherwise(F.lit(0).cast("bigint"))
        ).drop("_hot")

    def only(self, df: DataFrame) -> DataFrame:
        """The rows of large groups."""
        if not self.bounded:
            return df
        return null_safe_join(df, F.broadcast(self.keys), self.key, "left_semi")


def hot_groups(df: DataFrame, key: Sequence[str], width: int = GROUP_ROWS) -> HotGroups:
    large = df.groupBy(*key).count().where(F.col("count") > width).select(*key)
    found = large.take(HOT_LIMIT + 1)
    if not found:
        return HotGroups(tuple(key), width, None)
    if len(found) > HOT_LIMIT:
        return HotGroups(tuple(key), width, large, bounded=False)
    return HotGroups(tuple(key), width, df.sparkSession.createDataFrame(found, large.schema))


def running_values(
    df: DataFrame,
    key: Sequence[str],
    order: str,
    *,
    hot: HotGroups,
    last: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    peak: Mapping[str, Column] | None = None,
    end_flag: str | None = None,
) -> DataFrame:
    """Add, for each row, values built from the earlier rows of its group.

    ``last``: latest non-null value; ``total``: sum, 0 when there is none; ``peak``:
    maximum. The row itself is left out. ``end_flag`` marks the last row of each segment,
    so final values can be read off without a second sort.
    """
    last, total, peak = dict(last or {}), dict(total or {}), dict(peak or {})
    key = list(key)
    split = hot.keys is not None
    base = hot.mark(df, order) if split else df
    part = [*key, SEGMENT] if split else key
    ordered = Window.partitionBy(*part).orderBy(order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    local = {n: F.last(c, ignorenulls=True).over(before) for n, c in last.items()}
    local |= {n: F.sum(c).over(before) for n, c in total.items()}
    local |= {n: F.max(c).over(before) for n, c in peak.items()}
    flag = {end_flag: F.lead(order).over(ordered).isNull()} if end_flag else {}
    if not split:
        local |= {n: F.coalesce(local[n], F.lit(0)) for n in total}
        return base.select("*", *[c.alias(n) for n, c in {**local, **flag}.items()])

    rows = base.select(
        "*",
        *[c.alias(f"_loc_{n}") for n, c in local.items()],
        *[c.alias(n) for n, c in flag.items()],
    )
    summary = hot.only(base).groupBy(*part).agg(
        *[F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(n) for n, c in last.items()],
        *[F.sum(c).alias(n) for n, c in total.items()],
        *[F.max(c).alias(n) for n, c in peak.items()],
    )
    earlier = (
        Window.partitionBy(*key).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = summary.select(
        *part,
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"_car_{n}") for n in last],
        *[F.sum(n).over(earlier).alias(f"_car_{n}") for n in total],
        *[F.max(n).over(earlier).alias(f"_car_{n}") for n in peak],
    )
    merged = null_safe_join(rows, carry, part, "left")
    value = {n: F.coalesce(f"_loc_{n}", f"_car_{n}") for n in last}
    value |= {
        n: F.coalesce(F.col(f"_loc_{n}"), F.lit(0)) + F.coalesce(F.col(f"_car_{n}"), F.lit(0))
        for n in total
    }
    value |= {n: F.greatest(f"_loc_{n}", f"_car_{n}") for n in peak}
    return merged.select(*df.columns, *[c.alias(n) for n, c in value.items()], *flag)


def group_values(
    df: DataFrame, key: Sequence[str], order: str, aggs: Mapping[str, Column], *, hot: HotGroups
) -> DataFrame:
    """Add whole-group aggregates to each row; ``hot`` must be keyed by ``key`` itself."""
    key = list(key)
    if hot.keys is None:
        whole = Window.partitionBy(*key)
        return df.select("*", *[c.over(whole).alias(n) for n, c in aggs.items()])
    if not hot.bounded:
        return null_safe_join(df, df.groupBy(*key).agg(*[c.alias(n) for n, c in aggs.items()]), key, "left")
    marked = hot.mark(df, order)
    whole = Window.partitionBy(*key, SEGMENT)
    rows = marked.select("*", *[c.over(whole).alias(f"_cold_{n}") for n, c in aggs.items()])
    large = hot.only(df).groupBy(*key).agg(
        *[c.alias(f"_hot_{n}") for n, c in aggs.items()], F.lit(True).alias("_is_hot")
    )
    merged = null_safe_join(rows, F.broadcast(large), key, "left")  # one row per counted hot group
    return merged.select(
        *df.columns,
        *[
            F.when(F.col("_is_hot"), F.col(f"_hot_{n}")).otherwise(F.col(f"_cold_{n}")).alias(n)
            for n in aggs
        ],
    )


def ordinal(
    df: DataFrame, key: Sequence[str], order: str, name: str = "ordinal", *, hot: HotGroups
) -> DataFrame:
    """Number the rows of each group from 0 in ``order``."""
    return running_values(df, key, order, hot=hot, total={name: F.lit(1).cast("bigint")})
