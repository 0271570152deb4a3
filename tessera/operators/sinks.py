"""Writing generations, and making one of them the active one, on storage that is shared.

Tables are partitioned by generation; a write replaces the partitions it brings and
leaves the files of all others as they are. What is active is told by a log of
states, one file for each sequence number, which is made by a rename that fails
where the file exists: of two writers that both read the same state one wins, the
other learns that it lost. All files are reached through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import runtime

GENERATION = "generation_id"


def put(rows: DataFrame, path: str) -> None:
    """Write rows; of a table that is there, the generations among them are replaced, the others are not touched."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(GENERATION).parquet(path)


def replace_rows(spark: SparkSession, path: str, gone: DataFrame, new: DataFrame, key: str) -> None:
    """In a table of generations, drop the rows listed in gone (generation_id, key) and add new ones.

    Only generations that are listed, or that new rows are of, are read and
    written; others keep their files. The rows that stay are stored before the
    partitions they came from are replaced.
    """
    touched = gone.select(GENERATION).unionByName(new.select(GENERATION)).distinct()
    here = spark.read.parquet(path)
    stay = here.join(F.broadcast(touched), GENERATION, "left_semi").join(gone.select(GENERATION, key).distinct(), [GENERATION, key], "left_anti")
    put(runtime.settled(stay.select(*here.columns).unionByName(new.select(*here.columns))), path)


class Log:
    """States by sequence number under ``uri``; the last one holds."""

    def __init__(self, spark: SparkSession, uri: str):
        self.jvm = spark._jvm.org.apache.hadoop
        self.conf = spark._jsc.hadoopConfiguration()
        self.dir = self.path(uri)
        self.fs = self.dir.getFileSystem(self.conf)
        self.gateway = spark.sparkContext._gateway
        self.fs.mkdirs(self.dir)

    def path(self, *steps: str):
        return self.jvm.fs.Path("/".join(s.rstrip("/") for s in steps))

    def sequences(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.dir)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _at(self, sequence: int):
        return self.path(str(self.dir), f"{sequence:020d}.json")

    def state(self) -> tuple[int, dict | None]:
        """The last sequence number and its state; (0, None) where nothing was committed."""
        every = self.sequences()
        if not every:
            return 0, None
        stream = self.fs.open(self._at(every[-1]))
        try:
            return every[-1], json.loads(bytes(self.gateway.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8"))
        finally:
            stream.close()

    def commit(self, after: int, state: dict) -> bool:
        """Make ``state`` what follows the state of sequence ``after``; False where another one was first."""
        draft = self.path(str(self.dir), f"_draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(state, sort_keys=True, separators=(",", ":")).encode("utf-8")))
            out.hsync()
        finally:
            out.close()
        never = self.gateway.new_array(getattr(self.jvm.fs, "Options$Rename"), 0)
        try:
            self.jvm.fs.FileContext.getFileContext(self.dir.toUri(), self.conf).rename(draft, self._at(after + 1), never)
            return True
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise

    def forget(self, keep: int) -> None:
        """Delete states but the last ``keep``; a sequence number is never used again, since the last one stays."""
        for s in self.sequences()[:-keep]:
            self.fs.delete(self._at(s), False)

    def children(self, path: str) -> list[str]:
        at = self.path(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)
