"""Streams over an append-only journal.

Metrics, capture and repeated starts; ``runs.py`` follows runs with keyed state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronofold.functions.running import GROUP_ROWS, HotGroups
from chronofold.functions.stats import latency_bucket
from chronofold.functions.storage import LINES_COMPRESSION, cut
from chronofold.names import DEFAULT_NAMING, SpanNaming
from chronofold.operators.admission import judge_recorded, recorded_starts
from chronofold.operators.exports import span_document
from chronofold.schemas import JOURNAL

WATERMARK = "10 minutes"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    return spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def with_event_time(events: DataFrame, watermark: str = WATERMARK, time_ns: str = "at_ns") -> DataFrame:
    """Adds ``event_time``, in microseconds, for watermarks only."""
    return events.withColumn("event_time", F.timestamp_micros(F.expr(f"{time_ns} div 1000"))).withWatermark(
        "event_time", watermark
    )


def span_metrics(spans: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Latency histogram per minute; in append mode each minute is sent once (delta)."""
    timed = with_event_time(spans, watermark, "end_time_ns")
    return timed.groupBy(
        F.window("event_time", "60 seconds"), "name", latency_bucket(F.col("duration_ns")).alias("bucket")
    ).agg(F.count("*").alias("spans"), F.sum("duration_ns").alias("total_ns"))


def capture_lines(spans: DataFrame, path: str, checkpoint: str, *, every: str | None = "60 seconds", naming: SpanNaming = DEFAULT_NAMING) -> StreamingQuery:
    """Append spans as JSON lines. With no interval, take what is there and stop.

    Rows of an unfinished batch are read again from the source after a restart, so a
    hard exit loses nothing.
    """
    writer = (
        spans.select(span_document(naming).alias("value"))
        .writeStream.format("text")
        .option("path", path)
        .option("compression", LINES_COMPRESSION)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def coalesce_starts(
    requests: DataFrame,
    journal: Callable[[], DataFrame],
    sink: Callable[[DataFrame, int], None],
    *,
    checkpoint: str,
    watermark: str = WATERMARK,
    recorded: Callable[[DataFrame], DataFrame] = recorded_starts,
) -> StreamingQuery:
    """Repeated start requests of a run count once; each is judged against the journal.

    Each batch asks ``journal`` anew and takes the recorded starts from it. A caller whose
    journal stands still can make them once, hand them over in its place and leave
    ``recorded`` out by a function that returns what it is given.
    """
    once = requests.withWatermark("time", watermark).dropDuplicatesWithinWatermark(["run_id"])
    single = HotGroups(("run_id",), GROUP_ROWS, None)  # a run comes once, so no group is large

    def judge(batch: DataFrame, batch_id: int) -> None:
        # Written once: the judgement reads it more than once, and each read would run the state again.
        sink(judge_recorded(cut(batch.drop("time")), recorded(journal()), single), batch_id)

    return once.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
