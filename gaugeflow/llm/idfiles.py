"""Token-id files: documents encoded, range-coded in segments, written and read back (operator 8)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.llm import rangecoder, spans
from gaugeflow.llm.wordcache import text_encoder

END_ID, SEGMENT_IDS = 2, 8 << 20


_ROW = [("file", pa.int32()), ("segment", pa.int32()), ("nulls", pa.int64()), ("head", pa.binary()), ("blob", pa.binary())]
_ROW_DDL = "file int, segment int, nulls bigint, head binary, blob binary"


def write_ids(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes (doc_id, text), each with `end_id` after it, and writes segments in ascending doc_id order under `folder`.

    The file format: Parquet rows (file, segment, nulls, head, blob), each blob one segment of rangecoder and head a copy of its
    header; file and segment ascend with doc_id. Null and empty texts have the end id alone. Rows that repeat a doc_id are
    kept, in order of a hash of their text. Rows with a null doc_id come last (`nulls` of a segment's documents). An empty table writes no segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, part = text_encoder(vocabulary), 0, TaskContext.get().partitionId()
        ids, sizes, names, held = [], [], [], 0

        def segment() -> pa.RecordBatch:
            nonlocal number
            docs = pa.concat_arrays(names)
            blob = rangecoder.encode_segment(docs.fill_null(0).to_numpy(), np.concatenate(sizes), np.concatenate(ids))
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, (_, kind) in zip((part, number - 1, docs.null_count, rangecoder.header(blob), blob), _ROW)], names=[n for n, _ in _ROW])

        for batch in batches:
            for rows, _, _ in spans.chunks(batch, "text"):
                got, bounds = encoder.encode(rows.column("text").to_pylist())
                ids.append(np.insert(got, bounds[1:], np.uint32(end_id)))
                sizes.append(np.diff(bounds) + 1)
                names.append(rows.column("doc_id").cast(pa.int64()))
                held += len(ids[-1])
                if held >= segment_ids:
                    yield segment()
                    ids, sizes, names, held = [], [], [], 0
        if names:
            yield segment()

    # The hash spreads rows of one id over several ranges; texts themselves are no range keys, as those are sampled to the driver.
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash")]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.select("doc_id", "text").mapInArrow(run, _ROW_DDL).write.parquet(folder)


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Rows of the files, decoded: file, segment, place (in its segment), doc_id, before (ids before it in its segment), n_tokens, ids_crc32, and ids on request. Damaged segments raise an error."""
    fields = [("file", pa.int32()), ("segment", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int64()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, sizes, ids = rangecoder.decode_segment(row["blob"], row["head"])
                n, at = len(docs), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                doc_id = pa.array(docs, mask=np.arange(n) >= n - row["nulls"])
                out = [np.full(n, row["file"], np.int32), np.full(n, row["segment"], np.int32), np.arange(n, dtype=np.int32), doc_id, at[:-1], sizes.astype(np.int64), np.array(sums, np.int64)]
                out = [pa.array(x) if isinstance(x, np.ndarray) else x for x in out]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    ddl = "file int, segment int, place int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    return spark.read.schema(_ROW_DDL).parquet(folder).mapInArrow(run, ddl)


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds `start`, the ids of all documents before: totals of segments (a row each) are summed in order, then added to each row's own."""
    totals = rows.groupBy("file", "segment").agg(F.sum("n_tokens").alias("n"))
    # One row for each few million ids; summed first within a file, then over the files.
    files = totals.groupBy("file").agg(F.sum("n").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))
    inner = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", "segment", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("segment_start")).join(files, "file")
    return rows.join(starts, ["file", "segment"]).withColumn("start", F.col("file_start") + F.col("segment_start") + F.col("before"))
