"""Batches of several tables that appear together or not at all: data files first, then one manifest by rename."""

from __future__ import annotations

import datetime
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import broadcast_if_small

MANIFEST = "batch bigint, attempt string, committed_at string, tables map<string,bigint>"


class Ledger:
    """Tables under one folder, written batch by batch.

    ``data/<table>/batch=/attempt=`` has what each attempt wrote, ``commits/<batch>.json`` names the attempt
    that counts. Readers see the attempts that a manifest names and nothing else, so a batch's tables appear
    at one moment; what a crashed writer left is never read. Of several attempts at a batch (a retry, two
    drivers) the first to publish wins, the others return False and remove their files. The rename fails
    if its target exists: in HDFS that is one step, in a local file system the look comes just before it, and an
    object store needs conditional puts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self.hadoop.Path(self.root).getFileSystem(self.conf)

    def _path(self, *parts: str):
        return self.files.makeQualified(self.hadoop.Path("/".join([self.root, *parts])))

    def stage(self, batch: int, tables: dict[str, DataFrame]) -> tuple[str, dict[str, int]]:
        """Write the tables as a new attempt: (attempt, rows of each table). Nobody reads it yet."""
        attempt, rows = f"a-{uuid.uuid4().hex}", {}
        for name, df in tables.items():
            seen = Observation(f"rows of {name}")
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(f"{self.root}/data/{name}/batch={batch}/attempt={attempt}")
            rows[name] = seen.get["n"]
        return attempt, rows

    def publish(self, batch: int, attempt: str, rows: dict[str, int]) -> bool:
        """Make an attempt the batch's content; False if another one is."""
        told = {"batch": batch, "attempt": attempt, "committed_at": datetime.datetime.now(datetime.UTC).isoformat(), "tables": rows}
        draft, target = self._path("drafts", f"{attempt}.json"), self._path("commits", f"{batch}.json")
        self.files.mkdirs(target.getParent())
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        context = self.hadoop.FileContext.getFileContext(target.toUri(), self.conf)
        no_options = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            context.rename(draft, target, no_options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self.files.delete(draft, False)
            return False

    def commit(self, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Write and publish a batch; False, and nothing changes, if the batch is there already."""
        if self.files.exists(self._path("commits", f"{batch}.json")):
            return False
        attempt, rows = self.stage(batch, tables)
        if self.publish(batch, attempt, rows):
            return True
        self._remove(batch, attempt, tables)
        return False

    def _remove(self, batch: int, attempt: str, names) -> None:
        for name in names:
            self.files.delete(self._path("data", name, f"batch={batch}", f"attempt={attempt}"), True)

    def manifests(self) -> DataFrame:
        """(batch, attempt, committed_at, tables: name to rows) of the batches that count."""
        if not self.files.exists(self._path("commits")):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/commits")

    def read(self, name: str, batches: list[int] | None = None) -> DataFrame:
        """A table of all published batches, with its batch number. It must have been staged once."""
        known = self.manifests().where(F.map_contains_key("tables", F.lit(name))).select("batch", "attempt")
        data = self.spark.read.option("basePath", f"{self.root}/data/{name}").option("mergeSchema", True).parquet(f"{self.root}/data/{name}")
        data = data.withColumn("batch", F.col("batch").cast("long"))
        if batches is not None:
            data, known = data.where(F.col("batch").isin(batches)), known.where(F.col("batch").isin(batches))
        return data.join(broadcast_if_small(known), ["batch", "attempt"], "left_semi").drop("attempt")

    def vacuum(self, hours: float = 24.0) -> int:
        """Remove attempts that no manifest names and that were begun more than ``hours`` ago; their number."""
        kept = {(r.batch, r.attempt) for r in self.manifests().select("batch", "attempt").toLocalIterator()}
        before, gone = datetime.datetime.now().timestamp() * 1000 - hours * 3_600_000, 0
        for found in self.files.globStatus(self._path("data", "*", "batch=*", "attempt=*")) or []:
            path = found.getPath()
            attempt, batch = path.getName().split("=", 1)[1], int(path.getParent().getName().split("=", 1)[1])
            if (batch, attempt) not in kept and found.getModificationTime() <= before:
                self.files.delete(path, True)
                gone += 1
        return gone
