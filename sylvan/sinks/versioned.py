"""Tables that change in one step and take a repeated write once.

A table is a folder of data folders and a log of numbered commit files. A write
stages its rows in a new data folder, then publishes the next commit file by a
rename that fails if that number is taken. A commit file names every data
folder of the table and every run that is in it, so

* readers read the newest commit alone: the old table or the new one, never none
  and never half of one; a write that dies leaves a folder that nothing names;
* a run that is repeated, after a failure or by a retry, finds its id in the log
  and writes nothing;
* of two writers at once one gets the number, the other reads the new state and
  tries again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Times a writer tries for the next number before it gives up.
TRIES = 20


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- the log -------------------------------------------------------------

    def _commits(self) -> list[int]:
        folder = self._path(f"{self.path}/_log")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self) -> dict:
        """The newest commit: number, schema (DDL of the rows), folders, runs."""
        commits = self._commits()
        if not commits:
            return {"number": 0, "schema": None, "folders": [], "runs": []}
        stream = self._files.open(self._path(f"{self.path}/_log/{commits[-1]:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, state: dict) -> bool:
        """Put a commit file in place unless its number is taken."""
        staged = self._path(f"{self.path}/_log/{uuid.uuid4().hex}.staged")
        final = self._path(f"{self.path}/_log/{state['number']:020d}.json")
        out = self._files.create(staged, False)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if self._files.exists(final):
            self._files.delete(staged, False)
            return False
        return bool(self._files.rename(staged, final))

    # --- writing -------------------------------------------------------------

    def commit(self, df: DataFrame, run_id: str, append: bool = False) -> bool:
        """Replace the table by ``df`` or add its rows; False if the run is in the table already."""
        if run_id in self.state()["runs"]:
            return False
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        for _ in range(TRIES):
            old = self.state()
            if run_id in old["runs"]:
                return False
            if append and old["schema"] and json.loads(old["schema"]) != json.loads(df.schema.json()):
                raise ValueError("appended rows have another schema than the table")
            new = {"number": old["number"] + 1, "schema": df.schema.json(), "folders": (old["folders"] if append else []) + [folder],
                   "runs": [*old["runs"], run_id]}
            if self._publish(new):
                return True
        raise RuntimeError(f"{TRIES} other writers were faster")

    # --- reading -------------------------------------------------------------

    def read(self) -> DataFrame:
        from pyspark.sql import types as T
        now = self.state()
        if not now["folders"]:
            raise ValueError(f"nothing has been written to {self.path}")
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in now["folders"]])
