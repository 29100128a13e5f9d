"""Homomorphic multiset hash of documents (operator 4).

A document is the multiset of its paragraphs (lines that are not empty). A paragraph gives a wide vector of
32-bit lanes, and the document's fingerprint is the sum of its paragraphs' vectors modulo 2^32: equal for
any order of the paragraphs, and changed by adding or subtracting one paragraph's vector alone.

The first 32 lanes are the paragraph's BLAKE2b digests (1024 bits in all) and decide equality. The others are a
signed sum over the paragraph's pairs of neighbouring words, and as such a sum over paragraphs too;
the cosine of two documents' lanes estimates the overlap of their word pairs.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm import spans
from gaugeflow.llm.shared import stored

EXACT_LANES, LIKE_LANES = 32, 160
LANES = EXACT_LANES + LIKE_LANES


def _lanes(paragraph: bytes) -> bytes:
    """The exact lanes of one paragraph: two BLAKE2b digests of 64 bytes."""
    return blake2b(paragraph, person=b"lanes 0").digest() + blake2b(paragraph, person=b"lanes 1").digest()


def fingerprints(texts: list[str]) -> np.ndarray:
    """uint32 lanes of each text (rows)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    raw = [t.encode() for t in texts]
    np.cumsum([len(t) for t in raw], out=offsets[1:])
    data = np.frombuffer(b"".join(raw), np.uint8)
    out = np.zeros((len(texts), LANES), np.uint32)
    if not len(data):
        return out
    # Paragraphs: runs of bytes other than the line feed, cut at the texts' bounds.
    solid = data != 10
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    cuts = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    start[cuts], end[cuts - 1] = solid[cuts], solid[cuts - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    owner = np.searchsorted(offsets, starts, side="right") - 1
    if len(starts):
        whole = data.tobytes()
        lanes = np.frombuffer(b"".join([_lanes(whole[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), "<u4").reshape(-1, EXACT_LANES)
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        some = first[:-1] < first[1:]
        out[some, :EXACT_LANES] = np.add.reduceat(lanes, first[:-1][some], axis=0, dtype=np.uint32)
    # Pairs of neighbouring words of one paragraph; a paragraph of one word gives the word itself.
    w0, w1, _ = spans.words(data, offsets)
    if len(w0):
        paragraph = np.searchsorted(starts, w0, side="right") - 1
        wh = spans.word_hashes(data, w0, w1)
        follows = np.zeros(len(w0), bool)
        follows[1:] = paragraph[1:] == paragraph[:-1]
        alone = ~follows & ~np.append(follows[1:], False)
        pair = spans.mix(np.where(follows, np.roll(wh, 1), 0) * np.uint64(3) + wh)[follows | alone]
        doc = owner[paragraph[follows | alone]]
        lane = (pair % np.uint64(LIKE_LANES)).astype(np.int64)
        sign = np.where(pair >> np.uint64(63), 1, -1)
        sums = np.bincount(doc * LIKE_LANES + lane, weights=sign, minlength=len(texts) * LIKE_LANES)
        out[:, EXACT_LANES:] = sums.astype(np.int64).reshape(len(texts), LIKE_LANES).astype(np.uint32)
    return out


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of both multisets of paragraphs together."""
    return a + b


def remove(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of a's paragraphs without b's."""
    return a - b


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows: 1 if equal, else the cosine of the likeness lanes, at least 0."""
    x, y = (v[:, EXACT_LANES:].astype(np.int32).astype(np.float64) for v in (a, b))
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.clip((x * y).sum(1) / np.where(norm > 0, norm, 1), 0, 1)
    return np.where((a == b).all(axis=1), 1.0, cosine)


def shown(lanes: np.ndarray) -> list[str]:
    return [base64.b64encode(row.astype("<u4").tobytes()).decode() for row in lanes]


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the following text (or all of it)."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def edited_lanes(texts: list[str], following: list[str], lanes: np.ndarray) -> np.ndarray:
    """Fingerprints of the edited texts from those of the texts: the paragraphs from the cut on are taken out, what stands there afterwards is put in."""
    gone, come = [], []
    for t, f in zip(texts, following):
        k = len(t) // 3
        cut = len(t) - k
        start = t.rfind("\n", 0, cut) + 1
        gone.append(t[start:])
        come.append(t[start:cut] + f[:k])
    return add(remove(lanes, fingerprints(gone)), fingerprints(come))


RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
RESULT_DDL = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _result(ids: list, texts: list[str], following: list[str], lanes: np.ndarray, next_lanes: np.ndarray) -> dict:
    new = [edited(t, f) for t, f in zip(texts, following)]
    changed = edited_lanes(texts, following, lanes)
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
        "fingerprint": [row.tobytes() for row in lanes.astype("<u4")],
        "edited_fingerprint": [row.tobytes() for row in changed.astype("<u4")],
        "near_edited": likeness(lanes, changed),
        "near_next": likeness(lanes, next_lanes),
    }


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, text) fingerprinted, against its edited text and the next document by descending doc_id (after the last: the first).

    Null texts count as empty; empty texts have the zero fingerprint, and two such are alike (1). A null doc_id
    comes last. Rows that repeat a doc_id stand in the order of their texts. One row's next is the
    row itself. Other columns are ignored. An empty table gives no rows.
    """
    schema = pa.schema([*RESULT, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True
        empty = {n: None for n, _ in RESULT}

        def edge(kind: str, doc: int | None, text: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([empty | {"doc_id": doc, "part": part, "edge": kind, "text": text}], schema=schema)

        for batch in batches:
            for rows, _, _ in spans.chunks(batch, "text"):
                ids, texts = rows.column("doc_id").to_pylist(), [t or "" for t in rows.column("text").to_pylist()]
                if first:
                    first = False
                    yield edge("first", ids[0], texts[0])
                lanes = fingerprints(texts)
                if held is not None:
                    ids, texts, lanes = [held[0], *ids], [held[1], *texts], np.vstack([held[2], lanes])
                held = (ids[-1], texts[-1], lanes[-1:])
                if len(ids) > 1:
                    out = _result(ids[:-1], texts[:-1], texts[1:], lanes[:-1], lanes[1:])
                    n = len(ids) - 1
                    yield pa.RecordBatch.from_pydict(out | {"part": [part] * n, "edge": [None] * n, "text": [None] * n}, schema=schema)
        if held is not None:
            yield edge("last", held[0], held[1])

    key = F.col("doc_id").desc_nulls_last()
    # Rows of one id, or without one, are dealt by the beginnings of their texts, which have the order of these.
    ordered = docs.select("doc_id", "text").repartitionByRange(key, F.substring("text", 1, 64)).sortWithinPartitions(key, "text")
    # A partition does not see the first document of the next one: it leaves its own first and last rows open.
    rows = stored(ordered.mapInArrow(run, RESULT_DDL + ", part int, edge string, text string"), "fingerprints")
    done = rows.where("edge is null").select(*(n for n, _ in RESULT))
    # One narrow row for each partition; the texts are joined by partition number.
    parts = rows.where("edge = 'first'").select("part")
    order = Window.orderBy("part")
    least = F.min("part").over(Window.partitionBy(F.lit(0)))
    parts = parts.select("part", F.coalesce(F.lead("part").over(order), least).alias("next_part"))
    last = rows.where("edge = 'last'").select("part", "doc_id", "text")
    first = rows.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    open_ = last.join(parts, "part").join(first, "next_part").select("doc_id", "text", "next_text")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following = batch.column("text").to_pylist(), batch.column("next_text").to_pylist()
            out = _result(batch.column("doc_id").to_pylist(), texts, following, fingerprints(texts), fingerprints(following))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(RESULT))

    out = done.unionByName(open_.mapInArrow(close, RESULT_DDL))
    return out.withColumns({c: F.translate(F.base64(c), "\r\n", "") for c in ("fingerprint", "edited_fingerprint")})
