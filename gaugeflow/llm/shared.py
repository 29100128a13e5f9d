"""Where operators keep what executors must share, and small helpers."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made and not deleted, with the thread that made them: runs side by side in one process do not touch each other's.
_MADE: dict[str, int] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset, a new local one in local mode (tests), else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-")
        root = root if ":" in root.split("/")[0] else f"file://{root}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = threading.get_ident()
    return path


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def made() -> list[str]:
    """The folders that operators of this thread have made in the shared folder and not deleted."""
    return [path for path, thread in list(_MADE.items()) if thread == threading.get_ident()]


def remove_stored(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes folders that operators have made (all, or those given); call it once their results are written elsewhere."""
    for path in made() if paths is None else paths:
        if path in _MADE:
            del _MADE[path]
            _delete(spark, path)


def stored(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """The rows written once to the shared folder: cuts the lineage and survives lost executors. file_rows: the most rows of one file, for very large rows (0: any number)."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more: what came of it is stored."""
    remove_stored(df.sparkSession, [df.stored_at])


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
