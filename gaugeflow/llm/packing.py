"""Harmonic packing of token sequences (operator 1).

Capacity C = 2048. A length s belongs to class j = C // s, the reciprocal class (C/(j+1), C/j],
and a sequence of class j always takes exactly j pieces, so that each worker fills its own
sequences without knowing of the others. A long document is first cut into full sequences; what is
left is cut at the largest reciprocal size C // j that fits while the slot of the rest would waste
more than `waste` tokens. What a worker cannot complete (fewer than j pieces of class j) is
dealt again by class, first over some workers, then over more, last over all, and the last incomplete sequences, at most one of each class,
are filled first-fit.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm import spans
from gaugeflow.llm.shared import stored
from gaugeflow.llm.wordcache import text_encoder

CAPACITY, WASTE, END_ID = 2048, 4, 1
#: Tasks whose open sequences meet, in bits of the task number, in each round but the last.
ROUNDS = (3, 7, 12)

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, cls int, part int, sequence_id bigint, offset bigint"


def cut(length: int, capacity: int = CAPACITY, waste: int = WASTE) -> list[int]:
    """Piece lengths of a document of `length` tokens: full sequences, exact reciprocal sizes, then a rest whose slot wastes at most `waste`."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        j = capacity // rest
        if capacity // j - rest <= waste:
            out.append(rest)
            break
        size = capacity // (j + 1)
        out.append(size)
        rest -= size
    return out


def _pieces(path: str, capacity: int, waste: int, end_id: int, with_ids: bool):
    fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [("cls", pa.int32()), ("part", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made = text_encoder(path), 0
        task = TaskContext.get().partitionId()
        first = task << 33
        open_: dict[int, list[tuple]] = defaultdict(list)
        rows: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*(r[: len(schema)] for r in rows))) if rows else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for part, _, _ in spans.chunks(batch, "text"):
                ids, bounds = encoder.encode(part.column("text").to_pylist())
                for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    at = 0
                    for size in cut(len(own), capacity, waste):
                        piece = own[at : at + size]
                        j = capacity // size
                        open_[j].append((doc, at, size, zlib.crc32(piece), len(own), j, task, piece if with_ids else None))
                        at += size
                        if len(open_[j]) == j:
                            offset = 0
                            for p in open_.pop(j):
                                rows.append((*p[:7], first + made, offset, p[7]))
                                offset += p[2]
                            made += 1
                if len(rows) > 20_000:
                    yield flush(rows)
                    rows = []
        rows += [(*p[:7], None, None, p[7]) for own in open_.values() for p in own]
        yield flush(rows)

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, waste: int = WASTE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """All documents (doc_id, text) packed into sequences of `capacity` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids on
    request). Null and empty texts are one piece with the end id alone. A null doc_id is kept as null; rows
    that repeat are packed as often as they occur. Other columns are ignored. An empty table gives no rows.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    pieces = stored(docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, waste, end_id, with_ids), schema), "pieces")
    done = [pieces.where("sequence_id is not null").drop("part")]
    # At most j - 1 pieces of class j come from each task, and from each group of tasks: a few narrow rows.
    rest = pieces.where("sequence_id is null")
    names = done[0].columns
    for number, bits in enumerate((*ROUNDS, 31)):
        rest = rest.withColumn("some", F.shiftright("part", bits))
        group = ["cls", "some"]
        order = Window.partitionBy(*group).orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
        rest = rest.withColumn("n", F.row_number().over(order) - 1).withColumn("bin", F.floor(F.col("n") / F.col("cls")))
        rest = rest.withColumn("complete", (F.col("bin") + 1) * F.col("cls") <= F.count(F.lit(1)).over(Window.partitionBy(*group)))
        in_bin = Window.partitionBy(*group, "bin").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("length").over(in_bin), F.lit(0))
        number_of_bin = F.lit((1 << 62) + (number << 59)) + F.shiftleft(F.col("cls").cast("long"), 45) + F.shiftleft(F.col("some").cast("long"), 25) + F.col("bin")
        rest = rest.withColumn("offset", F.when(F.col("complete"), before)).withColumn("sequence_id", F.when(F.col("complete"), number_of_bin))
        rest = stored(rest.select(*names, "part"), "open")
        done.append(rest.where("sequence_id is not null").select(*names))
        rest = rest.where("sequence_id is null")
    # Fewer than one sequence of each class: at most capacity tokens for each of the under 2 * sqrt(capacity) classes.
    last = rest.select(*names).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_first_fit(capacity), done[0].schema)
    return reduce(DataFrame.unionByName, [*done, last]).drop("cls")


def _first_fit(capacity: int):
    def run(pdf):
        pdf = pdf.drop(columns="all").sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        room: list[int] = []
        bins, offsets = [], []
        for size in pdf["length"]:
            k = next((k for k, left in enumerate(room) if left >= size), len(room))
            if k == len(room):
                room.append(capacity)
            bins.append((1 << 61) + k)
            offsets.append(capacity - room[k])
            room[k] -= size
        pdf["sequence_id"], pdf["offset"] = bins, offsets
        return pdf

    return run
