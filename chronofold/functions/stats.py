"""Quantiles, rates with bootstrap intervals, latency histograms."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chronofold.functions.joins import lookup_join
from chronofold.functions.running import hot_groups, ordinal
from chronofold.functions.storage import cut

RESAMPLES = 10_000
SEED = 20_260_823


def quantile(column: str | Column, probability: float) -> Column:
    """Linear interpolation between neighbours; the probability is clamped to [0, 1]."""
    return F.percentile(column, min(1.0, max(0.0, probability)))


def exact_quantiles(values: DataFrame, group: str, value: str, probabilities: Sequence[float]) -> DataFrame:
    """The same quantiles per group as columns ``q0``, ``q1``, ...; null and NaN are left out.

    The ``percentile`` aggregate keeps all distinct values of a group in one buffer. Here
    distinct values are counted and written once in ranges of (group, value) of sampled,
    hence about equal, size. Running counts inside a range and a total for each range give
    every value its ranks, so no outlier and no large group ends up in one task.
    """
    v = F.col(value).cast("double")
    sound = values.select(group, v.alias(value)).where(v.isNotNull() & ~F.isnan(v))
    counted = sound.groupBy(group, value).agg(F.count("*").alias("n")).repartitionByRange(group, value)
    counted = cut(counted.withColumn("_range", F.spark_partition_id()))
    totals = counted.groupBy(group, "_range").agg(F.sum("n").alias("in_range"))  # one row per range and group
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    last = F.lit(-1) + F.col("_n")
    ranks = []
    for i, p in enumerate(probabilities):
        position = F.lit(min(1.0, max(0.0, float(p)))) * last
        low, weight = F.floor(position), position - F.floor(position)
        ranks += [
            F.struct(F.lit(i).alias("i"), low.alias("rank"), (1 - weight).alias("weight")),
            F.struct(F.lit(i).alias("i"), F.ceil(position).alias("rank"), weight.alias("weight")),
        ]
    wanted = starts.withColumn("_n", F.sum("in_range").over(Window.partitionBy(group))).select(
        group, "_range", "_start", F.array(*ranks).alias("ranks")
    )
    inside = Window.partitionBy(group, "_range").orderBy(value)
    located = counted.withColumn("_upto", F.sum("n").over(inside)).join(wanted, [group, "_range"])
    end = F.col("_start") + F.col("_upto")
    hit = F.filter("ranks", lambda r: (r["rank"] >= end - F.col("n")) & (r["rank"] < end))
    return located.select(group, value, F.explode(hit).alias("w")).groupBy(group).agg(
        *[
            F.sum(F.when(F.col("w.i") == i, F.col(value) * F.col("w.weight"))).alias(f"q{i}")
            for i in range(len(probabilities))
        ]
    )


@F.pandas_udf(DoubleType())
def _normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(NormalDist().cdf)


@F.pandas_udf(DoubleType())
def _normal_inverse(p: pd.Series) -> pd.Series:
    return p.map(NormalDist().inv_cdf)


def rates(observations: DataFrame, group: str = "group_key") -> DataFrame:
    """Numerator, denominator and rate of 0/1 observations per group."""
    counts = observations.groupBy(group).agg(
        F.sum("value").cast("bigint").alias("numerator"), F.count("*").alias("denominator")
    )
    return counts.withColumn("rate", F.col("numerator") / F.col("denominator"))


def rate_intervals(
    observations: DataFrame,
    group: str = "group_key",
    *,
    resamples: int = RESAMPLES,
    seed: int = SEED,
    alpha: float = 0.05,
) -> DataFrame:
    """Numerator, denominator, rate and BCa interval of 0/1 observations per group.

    A resample of n observations of which k are 1 has a binomial number of ones, so a
    group needs its two counts and no copy of its rows: each of the ``resamples`` draws
    is one row whose uniform number comes from a hash of (seed, group, draw). The draw
    is the exact inverse of the binomial distribution for counts of any size.
    """
    counts = cut(rates(observations, group))  # one row per group, read four times
    varied = counts.where("numerator > 0 and numerator < denominator")
    draws = varied.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    uniform = (
        F.pmod(F.xxhash64(F.lit(seed), F.col(group), F.col("draw")), F.lit(1 << 52)) + 0.5
    ) / float(1 << 52)
    draws = draws.withColumn("ones", _binomial(F.col("denominator"), F.col("rate"), uniform))
    means = cut(
        draws.groupBy(group, (F.col("ones") / F.col("denominator")).alias("value")).agg(F.count("*").alias("n"))
    )
    shares = means.join(varied.select(group, "rate", "numerator", "denominator"), group).groupBy(group).agg(
        F.sum(F.when(F.col("value") < F.col("rate"), F.col("n")).otherwise(0)).alias("less"),
        F.sum(F.when(F.col("value") == F.col("rate"), F.col("n")).otherwise(0)).alias("equal"),
        F.first("rate").alias("rate"),
        F.first("numerator").alias("k"),
        F.first("denominator").alias("m"),
    )
    # Leave-one-out means in closed form: dropping x leaves (sum - x) / (n - 1).
    zero = (F.lit(0.0) - F.col("rate")) / (F.col("m") - 1)
    one = (F.lit(1.0) - F.col("rate")) / (F.col("m") - 1)
    k, m = F.col("k"), F.col("m")
    cubes = k * F.pow(one, 3) + (m - k) * F.pow(zero, 3)
    squares = k * F.pow(one, 2) + (m - k) * F.pow(zero, 2)
    acceleration = F.when(squares > 0, cubes / (6 * F.pow(squares, 1.5))).otherwise(0.0)
    tails = _tails(shares, group, acceleration, resamples, alpha)
    limits = _bounds(means, tails, group, resamples)
    joined = counts.join(limits, group, "left")
    return joined.select(
        group,
        "numerator",
        "denominator",
        "rate",
        F.coalesce("low", "rate").alias("low"),
        F.coalesce("high", "rate").alias("high"),
        F.col("low").isNull().alias("degenerate"),
    )


def mean_intervals(
    observations: DataFrame,
    group: str = "group_key",
    order: str = "place",
    *,
    resamples: int = RESAMPLES,
    seed: int = SEED,
    alpha: float = 0.05,
) -> DataFrame:
    """Mean and BCa interval of any real observations per group.

    Draw k of resample r takes the observation whose number is hash(seed, group, r, k)
    modulo n. Draws are rows, spread over the cluster and joined to the numbered values;
    the work is n * resamples by definition. For rates use ``rate_intervals``.
    """
    hot = hot_groups(observations, [group])
    numbered = cut(ordinal(observations.select(group, order, "value"), [group], order, "at", hot=hot))
    sizes = cut(
        numbered.groupBy(group).agg(
            F.count("*").alias("n"), F.avg("value").alias("mean"), (F.min("value") != F.max("value")).alias("varied")
        )
    )
    varied = sizes.where("varied")
    draws = varied.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn(
        "k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))
    )
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(group), F.col("r"), F.col("k")), F.col("n"))
    drawn = draws.select(group, "r", at.alias("at")).join(numbered, [group, "at"])
    means = cut(drawn.groupBy(group, "r").agg(F.avg("value").alias("value")))
    # Leave-one-out means in closed form: (sum - x) / (n - 1).
    gaps = lookup_join(numbered, varied, [group], "inner").withColumn(
        "gap", F.col("mean") - (F.col("mean") * F.col("n") - F.col("value")) / (F.col("n") - 1)
    )
    curve = gaps.groupBy(group).agg(F.sum(F.pow("gap", F.lit(3))).alias("cubes"), F.sum(F.pow("gap", F.lit(2))).alias("squares"))
    shares = lookup_join(means, varied.select(group, "mean"), [group], "inner").groupBy(group).agg(
        F.count_if(F.col("value") < F.col("mean")).alias("less"), F.count_if(F.col("value") == F.col("mean")).alias("equal")
    )
    acceleration = F.when(F.col("squares") > 0, F.col("cubes") / (6 * F.pow("squares", F.lit(1.5)))).otherwise(0.0)
    tails = _tails(shares.join(curve, group), group, acceleration, resamples, alpha)
    limits = _bounds(means.groupBy(group, "value").agg(F.count("*").alias("n")), tails, group, resamples)
    return sizes.join(limits, group, "left").select(
        group, "n", "mean", F.coalesce("low", "mean").alias("low"), F.coalesce("high", "mean").alias("high"),
        F.col("low").isNull().alias("degenerate"),
    )


def _tails(shares: DataFrame, group: str, acceleration: Column, resamples: int, alpha: float) -> DataFrame:
    """Corrected tail probabilities from the share of resamples below the estimate."""
    epsilon = 0.5 / resamples
    proportion = (F.col("less") + 0.5 * F.col("equal")) / resamples
    bias = _normal_inverse(F.least(F.lit(1 - epsilon), F.greatest(F.lit(epsilon), proportion)))
    rows = shares.select(group, bias.alias("bias"), acceleration.alias("acc"))

    def corrected(tail: float) -> Column:
        z = F.col("bias") + NormalDist().inv_cdf(tail)
        return _normal_cdf(F.col("bias") + z / (1 - F.col("acc") * z))

    return rows.select(group, corrected(alpha / 2).alias("p_low"), corrected(1 - alpha / 2).alias("p_high"))


def _bounds(counted: DataFrame, tails: DataFrame, group: str, resamples: int) -> DataFrame:
    """Quantiles ``p_low`` and ``p_high`` of counted resample means, interpolated."""
    order = Window.partitionBy(group).orderBy("value")  # at most ``resamples`` rows
    ranked = counted.withColumn("upto", F.sum("n").over(order)).join(tails, group)
    start = F.col("upto") - F.col("n")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= start) & (rank < F.col("upto")), F.col("value")))

    picks = []
    for side in ("low", "high"):
        position = F.col(f"p_{side}") * (resamples - 1)
        low = F.floor(position)
        picks += [
            value_at(low).alias(f"{side}0"),
            value_at(F.ceil(position)).alias(f"{side}1"),
            F.max(position - low).alias(f"{side}w"),
        ]
    limits = ranked.groupBy(group).agg(*picks)
    mixed = lambda s: F.col(f"{s}0") * (1 - F.col(f"{s}w")) + F.col(f"{s}1") * F.col(f"{s}w")
    return limits.select(group, mixed("low").alias("low"), mixed("high").alias("high"))


@F.pandas_udf(DoubleType())
def _binomial(n: pd.Series, p: pd.Series, u: pd.Series) -> pd.Series:
    """Number of ones in n draws at rate p, from one uniform number per row."""
    import numpy as np

    out = np.empty(len(u))
    frame = pd.DataFrame({"n": n, "p": p, "u": u})
    for (size, rate), part in frame.groupby(["n", "p"]):
        # Every number of ones whose probability is above zero in double precision.
        reach = 40 * (size * rate * (1 - rate)) ** 0.5 + 1500
        ks = np.arange(int(max(0, size * rate - reach)), int(min(size, size * rate + reach)) + 1)
        steps = np.log((size - ks[:-1]) / (ks[:-1] + 1.0)) + np.log(rate / (1 - rate))
        logs = np.concatenate([[0.0], np.cumsum(steps)])
        mass = np.exp(logs - logs.max())
        drawn = ks[np.searchsorted(np.cumsum(mass) / mass.sum(), part["u"].to_numpy(), side="right").clip(0, len(ks) - 1)]
        out[part.index.to_numpy()] = drawn
    return pd.Series(out)


# Upper bounds of the latency buckets, in nanoseconds.
LATENCY_BOUNDS_NS = (
    100_000, 1_000_000, 2_000_000, 6_000_000, 10_000_000, 50_000_000, 100_000_000, 250_000_000, 500_000_000,
    1_000_000_000, 1_400_000_000, 2_000_000_000, 5_000_000_000, 10_000_000_000, 20_000_000_000, 40_000_000_000,
    60_000_000_000,
)
FLUSH_SECONDS = 60


def latency_bucket(duration_ns: Column) -> Column:
    """Index of the first bucket whose bound the duration does not exceed; 17 is overflow."""
    bucket = F.lit(len(LATENCY_BOUNDS_NS))
    for i in reversed(range(len(LATENCY_BOUNDS_NS))):
        bucket = F.when(duration_ns <= LATENCY_BOUNDS_NS[i], i).otherwise(bucket)
    return bucket.cast("bigint")


def latency_histogram(spans: DataFrame) -> DataFrame:
    """Spans per minute of their end, service, name and bucket (delta counts)."""
    minute = F.expr(f"end_time_ns div {FLUSH_SECONDS * 1_000_000_000} * {FLUSH_SECONDS}")
    return spans.groupBy(
        minute.alias("window_start_s"), "mode", "name", latency_bucket(F.col("duration_ns")).alias("bucket")
    ).agg(F.count("*").alias("spans"), F.sum("duration_ns").alias("total_ns"))


# Our rule: find the first bucket whose running count reaches q * total and move linearly
# inside it from its lower bound (0 for the first). A rank in the overflow bucket gives
# the last finite bound; an empty histogram gives null.
HISTOGRAM_QUANTILE = """
case when aggregate({counts}, 0D, (a, c) -> a + c) > 0 then
  aggregate(
    zip_with({bounds}, {counts}, (b, c) -> named_struct('b', cast(b as double), 'c', cast(c as double))),
    named_struct('seen', 0D, 'low', 0D, 'value', cast(null as double)),
    (a, p) -> named_struct(
      'seen', a.seen + p.c,
      'low', coalesce(p.b, a.low),
      'value', case
        when a.value is not null or p.c <= 0
          or a.seen + p.c < least(1D, greatest(0D, {q})) * aggregate({counts}, 0D, (x, c) -> x + c) then a.value
        else coalesce(
          a.low + (p.b - a.low)
            * (least(1D, greatest(0D, {q})) * aggregate({counts}, 0D, (x, c) -> x + c) - a.seen) / p.c,
          a.low) end),
    a -> a.value)
end
"""


def histogram_quantile(bounds: str, counts: str, q: str) -> Column:
    """Quantile of a histogram; the arguments are SQL expressions of array<double>, q double."""
    return F.expr(HISTOGRAM_QUANTILE.format(bounds=bounds, counts=counts, q=q))


def register_sql_functions(spark: SparkSession) -> None:
    """``histogram_quantile(bounds, counts, q)`` as a SQL function of the session."""
    body = HISTOGRAM_QUANTILE.format(bounds="bounds", counts="counts", q="q")
    spark.sql(
        "create or replace temporary function histogram_quantile("
        f"bounds array<double>, counts array<double>, q double) returns double return {body}"
    )
