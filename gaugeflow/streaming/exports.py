"""Named exports of streamed records with positions that can be reset and copied.

A reader's position is the newest timestamp that it has been handed of each timestamp group. Positions are tables with a version for each
micro-batch, kept beside the reader's checkpoint; a micro-batch reads the version before its own, hands the writer what lies beyond
it, and writes its version after the writer has succeeded. A failure between the two repeats the micro-batch with the same rows under the
same number, so that a sink that replaces what it has of a number gets no row twice and none is lost.

Setting a reader's position starts a new *generation* of it: a fresh checkpoint, over a first version with the positions wanted. Its stream
reads its source anew, and hands on what lies beyond them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.model import K
from gaugeflow.operators import rollup as R
from gaugeflow.sources.store import _children

Writer = Callable[[DataFrame, int], None]
POSITIONS = "reader string, host_name string, app_name string, group_id int, position double"
#: Versions of a reader's positions that are kept: a repeated micro-batch needs the one before it.
KEPT = 3


class NamedExports:
    """The named readers whose checkpoints and positions are kept under one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self, path: str, prefix: str) -> list[int]:
        return sorted(int(n) for n in _children(self.spark, path, prefix) if n.lstrip("-").isdigit())

    def generation(self, name: str) -> int:
        """The reader's newest generation; 0 if nobody has set its position yet."""
        return max(self._numbers(f"{self.root}/{name}", "generation="), default=0)

    def _folder(self, name: str, generation: int) -> str:
        return f"{self.root}/{name}/generation={generation}"

    def _versions(self, folder: str) -> list[int]:
        """Versions whose files are complete; version v is what was handed on before micro-batch v."""
        fs, path = self._fs(folder)
        return [v for v in self._numbers(f"{folder}/positions", "version=") if fs.exists(path(f"{folder}/positions/version={v}/_SUCCESS"))]

    def _fs(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self, folder: str, before: int | None = None) -> DataFrame:
        known = [v for v in self._versions(folder) if before is None or v <= before]
        if not known:
            return self.spark.createDataFrame([], POSITIONS)
        return self.spark.read.schema(POSITIONS).parquet(f"{folder}/positions/version={known[-1]}")

    def positions(self, name: str) -> DataFrame:
        """(reader, endpoint, group_id, position) of a reader, as of its last complete micro-batch."""
        return self._read(self._folder(name, self.generation(name)))

    def _begin(self, name: str, positions: DataFrame) -> None:
        """A new generation that stands where `positions` says. It counts once its first version is complete."""
        folder = self._folder(name, self.generation(name) + 1)
        positions.select(F.lit(name).alias("reader"), *K, "group_id", "position").write.mode("overwrite").parquet(f"{folder}/positions/version=0")

    def start_at_beginning(self, name: str) -> None:
        """The reader's next run hands on all that its source still has."""
        self._begin(name, self.spark.createDataFrame([], POSITIONS))

    def copy_position(self, source: str, target: str) -> None:
        """The target's next run hands on what the source has not been handed yet."""
        self._begin(target, self.positions(source))

    def export(self, stream: DataFrame, name: str, writer: Writer, hooks: tuple[Writer, ...] = (), crash: Callable[[int], None] | None = None):
        """Starts a reader over what its source has now. stream: records with endpoint, group_id and ts.

        writer(rows, number) gets each micro-batch's rows beyond the position, under a number that grows over generations and stays the same when a micro-batch is
        repeated: it must replace what it has written under that number. Hooks run after it. crash is for tests: it is called between writer and commit.
        """
        generation = self.generation(name)
        folder = self._folder(name, generation)

        def run(batch: DataFrame, epoch: int) -> None:
            before = self._read(folder, before=epoch)
            rows = R.unread(batch, before, name).persist()
            number = generation << 32 | epoch
            try:
                writer(rows, number)
                for hook in hooks:
                    hook(rows, number)
                if crash is not None:
                    crash(epoch)
                R.commit(before, name, rows).select("reader", *K, F.col("group_id").cast("int"), "position").write.mode("overwrite").parquet(f"{folder}/positions/version={epoch + 1}")
            finally:
                rows.unpersist()
            fs, path = self._fs(folder)
            for v in self._versions(folder):
                if v <= epoch + 1 - KEPT:
                    fs.delete(path(f"{folder}/positions/version={v}"), True)

        return stream.writeStream.queryName(f"{name}-{generation}").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(run).start()
