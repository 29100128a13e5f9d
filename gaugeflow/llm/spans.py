"""Vectorised text arrays: words, pretokens and their hashes over Arrow string buffers.

Every helper works on one chunk of whole texts: `data` is the UTF-8 bytes of all
texts one after another, `offsets` (int64, n + 1) their bounds. Nulls count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa

#: Bytes of text that one chunk of rows aims at; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
#: Factors of the words of a window: fixed odd numbers, one for each place.
_FACTORS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SEEDS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def text_arrays(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text where possible."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    if not wide and not pa.types.is_string(col.type):
        col, wide = col.cast(pa.large_string()), True
    _, bounds, data = col.buffers()
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows of about `size` bytes of text."""
    data, offsets = text_arrays(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), batch.num_rows)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of [^\\x20\\x09-\\x0D], and the words before each text (n + 1)."""
    solid = ~_IS_SPACE[data]
    n = len(data)
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    cuts = np.unique(offsets[(offsets > 0) & (offsets < n)])
    start[cuts] = solid[cuts]
    end[cuts - 1] = solid[cuts - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (three multiply and shift rounds); one to one."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Edges:
    """First and last eight bytes and length of spans: all there is to know of a span of up to 16 bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        self.size = size = (ends - starts).astype(_U)
        cut = np.where(size < 8, _U(64) - np.minimum(size, 8) * _U(8), _U(0))
        self.first = eight[starts + 8]
        self.first = np.where(size > 0, (self.first << cut) >> cut, _U(0))
        self.last = eight[ends]
        self.last = np.where(size > 8, self.last, _U(0))

    def keys(self) -> np.ndarray:
        """A 64-bit number of each span: one to one for spans of up to 7 bytes, else a hash to be checked by `same`."""
        short = self.first | self.size << _U(56)
        return mix(np.where(self.size < 8, short, mix(self.first + _SEEDS[0]) + self.last * _SEEDS[1] + self.size))

    def same(self, other: np.ndarray) -> np.ndarray:
        """Whether each span is that of the index `other`, by its edges."""
        return (self.first == self.first[other]) & (self.last == self.last[other]) & (self.size == self.size[other])


def first_of(code: np.ndarray, n: int) -> np.ndarray:
    """The first place of each code 0 .. n - 1."""
    first = np.empty(n, np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return first


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Edges]:
    """(code of each span, first place of each code, key of each code, the edges): codes are equal if and only if the bytes are."""
    edges = Edges(data, starts, ends)
    key = edges.keys()
    code, values = pd.factorize(key)
    code = code.astype(np.int64)
    first = first_of(code, len(values))
    # Spans over 16 bytes, and any whose key is another's, are told apart by their bytes.
    odd = np.flatnonzero((edges.size > 16) | ~edges.same(first[code]))
    if len(odd):
        known: dict[bytes, int] = {}
        raw, more, place = data.tobytes(), len(values), []
        for a, b in zip(starts[odd].tolist(), ends[odd].tolist()):
            place.append(known.setdefault(raw[a:b], more + len(known)))
        code[odd] = place
        used = np.bincount(code) > 0
        code = (np.cumsum(used) - 1)[code]
        first = first_of(code, int(used.sum()))
    return code, first, key[first], edges


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, equal for equal bytes wherever they stand: one to one for up to 7 bytes, BLAKE2b for longer spans (once for each distinct one)."""
    code, first, key, edges = distinct(data, starts, ends)
    long = np.flatnonzero(edges.size[first] > 7)
    if len(long):
        raw, at = data.tobytes(), first[long]
        key[long] = np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[at].tolist(), ends[at].tolist())]), "<u8")
    return key[code]


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes (across texts too: callers mask those): a sum with a factor for each place."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for k in range(width):
        out += hashes[k : k + n] * _FACTORS[k]
    return mix(out)
