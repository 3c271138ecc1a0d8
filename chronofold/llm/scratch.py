"""Tables an operator writes on its way, in the folder the cluster shares.

``spark.checkpoint.dir`` names that folder. It is set here only where the session has
none and runs on one machine, as in tests. What is written for one step only is removed
when the step is over; what a result still reads stays until ``close``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chronofold.functions.storage import shared_folder


class Scratch:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"

    def path(self, label: str) -> str:
        return f"{self.folder}/{label}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, label: str = "table", **options: str) -> DataFrame:
        """Write once and read back: later steps don't compute it again, lost executors or not."""
        path = self.path(label)
        df.write.options(**options).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables whose rows no later step reads."""
        for df in frames:
            self.remove(df._scratch_path)

    def remove(self, path: str) -> None:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)

    def close(self) -> None:
        self.remove(self.folder)
