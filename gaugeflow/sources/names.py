"""An index of names (metrics, tag values) that is kept up to date batch by batch.

Names are stored by type and by their first characters (`head`), sorted, each once: a batch adds what the index does not hold yet, and looks only into the
heads that it has itself. A suggestion prunes to the heads that its prefix can have, and in their files to the row groups whose statistics hold it. Each
batch has a name of its own; one that failed is run again and replaces what it wrote. `compact` puts the small files of many batches together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.sources.store import _children

#: Bytes of a name that make its head.
HEAD = 6


def _head(name: Column) -> Column:
    """The first bytes in hexadecimal: safe in the name of a folder, and a prefix of a name has a prefix of its head."""
    return F.hex(F.substring(F.encode(name, "UTF-8"), 1, HEAD))


class NameIndex:
    """The names under one shared folder: (type, name), each once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _version(self) -> int:
        """The newest complete version; a compaction makes another one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return max((int(v) for v in _children(self.spark, self.root, "version=") if fs.exists(path(f"{self.root}/version={v}/_SUCCESS"))), default=0)

    def _rows(self) -> DataFrame | None:
        folder = f"{self.root}/version={self._version()}"
        if not _children(self.spark, folder, "type="):
            return None
        return self.spark.read.schema("name string, type string, head string, load string").parquet(folder)

    def names(self) -> DataFrame:
        rows = self._rows()
        return self.spark.createDataFrame([], "type string, name string") if rows is None else rows.select("type", "name")

    def _write(self, rows: DataFrame, version: int, load: str) -> None:
        by = ["type", "head", "load"]
        out = rows.withColumn("load", F.lit(f"load-{load}")).repartitionByRange(*by, "name").sortWithinPartitions(*by, "name")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.root}/version={version}")

    def add(self, names: DataFrame, load: str) -> None:
        """Adds the names of a batch (type, name; null and empty ones and repeats are left out) that are not there yet."""
        fresh = names.select("type", "name").where("type is not null and name <> ''").distinct().withColumn("head", _head(F.col("name")))
        known = self._rows()
        if known is not None:
            # Of this batch's own earlier run nothing counts; only heads that the batch has are read.
            known = known.where(F.col("load") != f"load-{load}").select("type", "head", "name")
            fresh = fresh.join(known, ["type", "head", "name"], "left_anti")
        self._write(fresh.select("name", "type", "head"), self._version(), load)

    def suggest(self, kind: str, prefix: str, most: int = 25) -> DataFrame:
        """The first `most` (0 or less: all) names of a type that start with the prefix, sorted; no more than that many rows leave a task."""
        rows = self._rows()
        if rows is None:
            return self.spark.createDataFrame([], "name string")
        head = prefix.encode()[:HEAD].hex().upper()
        own = rows.where((F.col("type") == kind) & F.col("head").startswith(head) & F.col("name").startswith(prefix)).select("name").orderBy("name")
        return own.limit(most) if most > 0 else own

    def compact(self) -> None:
        """Writes all names as a version of their own, one file for a head; the version before stays until it is deleted."""
        rows = self._rows()
        if rows is not None:
            self._write(rows.select("name", "type", "head"), self._version() + 1, "compacted")

    def follow(self, stream: DataFrame, checkpoint: str):
        """Starts adding the names of a stream of (type, name), a micro-batch at a time, over what is there now."""
        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, epoch: self.add(batch, f"epoch-{epoch}")).start()
