"""A journal whose appends are whole or not at all, by one commit record each.

Data files are written first, under a folder of their own that no reader looks into. The
record that names them is then created under the next number, which the store lets only one
writer do. Readers follow records, so a failed append leaves nothing to see, and a reader
that stops at a record sees a frozen journal whatever is appended later.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators.admission import admit_events
from chronofold.sources.journal import with_sequence

RECORD = "number bigint, batch_id string, expected bigint, next bigint, accepted bigint, refused bigint, folder string"


class AppendConflict(RuntimeError):
    """Another writer was there first: read the journal's end again."""


class CommittedJournal:
    """``first``: the sequence number of the first event ever."""

    def __init__(self, spark: SparkSession, root: str, first: int = 1) -> None:
        self.spark, self.root, self.first = spark, root.rstrip("/"), first

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self, upto: int | None = None) -> DataFrame:
        path, store = self._path("commits")
        if not store.exists(path):
            return self.spark.createDataFrame([], RECORD)
        found = self.spark.read.schema(RECORD).json(f"{self.root}/commits")
        return found if upto is None else found.where(F.col("number") <= upto)

    def end(self) -> tuple[int, int]:
        """Number of the last record (0 before the first) and the next sequence number."""
        last = self.commits().agg(F.max(F.struct("number", "next")).alias("last")).first()["last"]
        return (last["number"], last["next"]) if last else (0, self.first)

    def append(self, requests: DataFrame, runs: DataFrame, *, batch_id: str, expected: int, order: list[str]) -> dict:
        """Judge and append a batch; its record.

        ``expected`` is the next sequence number the writer knows of; if the journal went on
        since, nothing is written and the append is refused. A batch that was appended before
        changes nothing and gives its old record. Events get numbers in ``order``; refused
        requests stand beside them with their reason.
        """
        before = self.commits().where(F.col("batch_id") == batch_id).first()
        if before:
            return before.asDict()
        number, next_ = self.end()
        if next_ != expected:
            raise AppendConflict(f"the next event is {next_}, not {expected}")
        folder = f"data/{uuid.uuid4().hex}"
        judged = f"{self.root}/{folder}/judged"
        admit_events(requests.drop("seq"), runs).write.parquet(judged)
        judged = self.spark.read.parquet(judged)
        accepted = with_sequence(judged.where("reason is null").drop("reason"), expected, order)
        accepted.write.parquet(f"{self.root}/{folder}/journal")
        judged.where("reason is not null").write.parquet(f"{self.root}/{folder}/quarantine")
        good, bad = judged.agg(F.count_if(F.col("reason").isNull()), F.count_if(F.col("reason").isNotNull())).first()
        record = {
            "number": number + 1, "batch_id": batch_id, "expected": expected, "next": expected + good,
            "accepted": good, "refused": bad, "folder": folder,
        }
        self._commit(record)
        return record

    def _commit(self, record: dict) -> None:
        # Written aside and renamed, so no reader meets half a record; a taken name refuses the rename.
        waiting, store = self._path(f"waiting/{uuid.uuid4().hex}.json")
        name, _ = self._path(f"commits/{record['number']:020d}.json")
        store.mkdirs(name.getParent())
        out = store.create(waiting)
        out.write((json.dumps(record) + "\n").encode())
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(waiting.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(waiting, name, none)
        except Exception as error:
            raise AppendConflict(f"record {record['number']} was taken by another writer") from error

    def _read(self, part: str, upto: int | None) -> DataFrame | None:
        # One folder name per append, from the records only.
        folders = [r["folder"] for r in self.commits(upto).orderBy("number").select("folder").collect()]
        return self.spark.read.parquet(*[f"{self.root}/{f}/{part}" for f in folders]) if folders else None

    def journal(self, upto: int | None = None) -> DataFrame | None:
        """Events of all records, or of those up to one: a frozen journal. None before the first."""
        return self._read("journal", upto)

    def quarantine(self, upto: int | None = None) -> DataFrame | None:
        return self._read("quarantine", upto)
