"""Writes that count once: output and ledger become visible together, by one rename.

A run first writes its rows to a folder of its own attempt. Then one small file, the run's entry, names that folder and tells
how the run ended; it is written aside and renamed into the ledger, which is what makes the run count. A run that dies before the
rename leaves nothing that a reader sees, and is simply repeated; a run that is already in the ledger isn't written again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from fathomline.sources.landing import delete
from fathomline.sources.sinks import run_status

ENTRY = "run string, stage string, started_at string, status string, inputs_seen long, rows_written long, error string, folder string"


class LedgeredTable:
    """A table at ``place`` whose rows are those of the runs in its ledger; all runs have one schema."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place.rstrip("/")
        self.entries = f"{self.place}/ledger"

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, run: str) -> bool:
        path, fs = self._path(f"{self.entries}/{run}.json")
        return fs.exists(path)

    def stage(self, df: DataFrame) -> str:
        """Phase one: the rows in a folder of this attempt, which nothing refers to yet."""
        folder = f"attempt-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.place}/data/{folder}")
        return folder

    def commit(self, run: str, entry: dict) -> bool:
        """Phase two: the run's entry, by one rename; False if another attempt was first."""
        target, fs = self._path(f"{self.entries}/{run}.json")
        fs.mkdirs(target.getParent())
        aside, _ = self._path(f"{self.place}/aside/{run}-{uuid.uuid4().hex}.json")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps({"run": run, **entry}).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            return False
        return True

    def write(self, df: DataFrame, run: str, stage: str, started_at: str, inputs_seen: int | None = None) -> bool:
        """The run's rows and its entry; False if the run was already in the ledger. An error is entered, without rows, and raised again."""
        if self.committed(run):
            return False
        entry = {"stage": stage, "started_at": started_at, "inputs_seen": inputs_seen}
        try:
            folder = self.stage(df)
        except Exception as wrong:
            self.commit(f"{run}.failed-{uuid.uuid4().hex[:8]}", entry | {"status": "error", "rows_written": 0, "error": type(wrong).__name__, "folder": None})
            raise
        rows = self.spark.read.schema(df.schema).parquet(f"{self.place}/data/{folder}").count()
        done = self.commit(run, entry | {"status": run_status(rows, None), "rows_written": rows, "error": None, "folder": folder})
        if not done:
            delete(self.spark, f"{self.place}/data/{folder}")
        return done

    def ledger(self) -> DataFrame:
        """A row for each run that counted, and for each failure."""
        try:
            return self.spark.read.schema(ENTRY).json(self.entries)
        except AnalysisException:  # no run yet
            return self.spark.createDataFrame([], ENTRY)

    def _folders(self) -> list[str]:
        return [r.folder for r in self.ledger().where("folder is not null").select("folder").collect()]  # one a run

    def read(self, schema) -> DataFrame:
        """The rows of all runs in the ledger."""
        folders = self._folders()
        return self.spark.read.schema(schema).parquet(*[f"{self.place}/data/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def vacuum(self) -> int:
        """Delete attempts that no entry names, while no run is under way; how many there were."""
        known, (data, fs) = set(self._folders()), self._path(f"{self.place}/data")
        gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in known] if fs.exists(data) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)
