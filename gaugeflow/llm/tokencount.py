"""Token counts by the compiled transducer (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeflow.llm import pretokens as P
from gaugeflow.llm import spans, transducer

#: Code points of one piece.
PIECE = 512


def count_chunk(machine: transducer.Merger, texts: list[str], specials: tuple[str, ...], piece: int = PIECE) -> np.ndarray:
    """Tokens of each text; a special string inside a text counts as one."""
    pieces, owner, extra = texts, None, None
    if any(s in t for s in specials for t in texts):
        cut = [P.split_special(t, specials) for t in texts]
        pieces = [p for parts in cut for p, _ in parts]
        owner = np.repeat(np.arange(len(texts)), [len(parts) for parts in cut])
        extra = np.array([len(parts) - 1 for parts in cut])
    points, offsets = P.code_points(pieces)
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(P.byte_widths(points), out=at[1:])
    data = np.frombuffer("".join(pieces).encode(), np.uint8)
    maps = transducer.PieceMaps(points, offsets, piece)
    met = maps.entered()
    tokens = np.zeros(len(maps.slot), np.int64)
    tokens[met] = machine.counts(data, at[maps.start[met]], at[maps.end[met]])
    out = maps.compose(tokens)
    return out if owner is None else np.bincount(owner, out, len(texts)).astype(np.int64) + extra


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each (doc_id, text); null and empty texts have 0. Rows keep their order and number; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer.merger(path)
        for batch in batches:
            for rows, _, offsets in spans.chunks(batch, "text"):
                n = count_chunk(machine, [t or "" for t in rows.column("text").to_pylist()], machine.specials)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
