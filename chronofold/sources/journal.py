"""Reading journals: gates, upgrades, decoding, scans of runs and prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold import names as N
from chronofold.functions import scalar as X
from chronofold.schemas import JOURNAL, JOURNAL_V1, RUNS


class JournalSchemaError(ValueError):
    """The table cannot be a version 2 journal."""


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet journal with its schema checked, not inferred."""
    found = spark.read.parquet(path)
    require_columns(found)
    return found.select([F.col(f.name).cast(f.dataType) for f in JOURNAL.fields])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(path)


def missing_columns(df: DataFrame) -> list[str]:
    return sorted(set(JOURNAL.fieldNames()) - set(df.columns))


def require_columns(df: DataFrame) -> None:
    missing = missing_columns(df)
    if missing:
        raise JournalSchemaError("journal is older than version 2; missing columns: " + ", ".join(missing))


def upgrade(old: DataFrame) -> DataFrame:
    """A version 1 table in version 2 columns: no activation, no attempt, time from ``at``."""
    empty = old.sparkSession.createDataFrame([], JOURNAL)
    return (
        empty.unionByName(old.select(JOURNAL_V1.fieldNames()), allowMissingColumns=True)
        .withColumn("at_ns", F.coalesce("at_ns", F.lit(0).cast("bigint")))
        .select(JOURNAL.fieldNames())
    )


def run_events(events: DataFrame, run_id: str, upto_seq: int | None = None) -> DataFrame:
    """One run in order, or a prefix of it. Both filters reach the Parquet scan."""
    rows = events.where(F.col("run_id") == run_id)
    if upto_seq is not None:
        rows = rows.where(F.col("seq") <= upto_seq)
    return rows.orderBy("seq")


def list_runs(events: DataFrame) -> DataFrame:
    """Runs, the one that began last first."""
    return events.groupBy("run_id").agg(F.min("seq").alias("first_seq")).orderBy(F.desc("first_seq"))


def admit_rows(raw: DataFrame) -> DataFrame:
    """Rows with ``reason``: null when they decode, else why they are set aside."""
    known = F.col("type").isin(*N.LIVE_TYPES, *N.LEGACY_TYPES)
    shape = F.schema_of_variant(X.strict_json(F.col("payload")))
    reason = (
        F.when(F.col("seq").isNull(), "no_sequence")
        .when(~F.coalesce(known, F.lit(False)), "unknown_type")
        .when(shape.isNull(), "payload_not_json")
        .when(~shape.startswith("OBJECT"), "payload_not_object")
    )
    return raw.withColumn("reason", reason)


def split_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good rows, quarantine with reason)``."""
    judged = admit_rows(raw)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def save_bucketed(events: DataFrame, table: str, buckets: int) -> None:
    """A table from which run-ordered work reads without an exchange."""
    events.write.bucketBy(buckets, "run_id").sortBy("run_id", "seq").saveAsTable(table)


def with_sequence(rows: DataFrame, start: int, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """Give new rows the next sequence numbers; ``keep`` names the columns wanted of them, else all.

    The batch is range-partitioned by ``order``; each partition numbers its own rows and
    adds the size of the partitions before it, so no single task holds the batch.
    """
    from pyspark.sql import Window

    from chronofold.functions.storage import cut

    # Written out, because the partition a row is in must not change between the two reads.
    placed = cut(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*(keep or rows.columns))
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    offset = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("n").over(offset), F.lit(0)))  # one row per partition
    numbered = placed.join(F.broadcast(sizes.drop("n")), "_part")
    return numbered.withColumn("seq", F.lit(start) + F.col("_before") + F.col("_row") - F.col("_first")).drop(
        "_part", "_row", "_first", "_before"
    )


def effect_store(spark: SparkSession, attempts_path: str, kept_path: str) -> tuple[DataFrame, DataFrame]:
    attempts = spark.read.schema("seq bigint, idempotency_key string, amount_cents bigint, at double").parquet(attempts_path)
    kept = spark.read.schema("idempotency_key string, receipt string, amount_cents bigint").parquet(kept_path)
    return attempts, kept


def observations(counts: DataFrame) -> DataFrame:
    """Per run whether the control view counts more calls than the aware view.

    ``counts``: run_id, group_key, mode, executed.
    """
    aware = F.max(F.when(F.col("mode") == "aware", F.col("executed")))
    control = F.max(F.when(F.col("mode") == "control", F.col("executed")))
    return counts.groupBy("run_id", "group_key").agg((control > aware).cast("double").alias("value")).drop("run_id")
