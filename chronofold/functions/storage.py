"""Folders and writes that survive the loss of a machine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LINES_COMPRESSION = "gzip"
"""Of files of JSON lines: they repeat their keys, so plain files are several times larger."""

TABLE_COMPRESSION = "zstd"

CHECKPOINT_SETTING = "spark.checkpoint.dir"


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; one of our own only where all work is on one machine.

    On a cluster without that setting this is an error: executors would not see each
    other's files.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"{CHECKPOINT_SETTING} must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="chronofold-"))
    return _own_folder[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the frame once to the shared folder and read it back, ending its lineage."""
    path = fresh_path(df.sparkSession, "cut")
    df.write.option("compression", TABLE_COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json(df: DataFrame, path: str, *, replace: bool = False) -> None:
    """Refuse to replace what is there unless told to."""
    df.write.mode("overwrite" if replace else "errorifexists").option("compression", LINES_COMPRESSION).json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
