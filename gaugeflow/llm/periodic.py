"""Runs of repeating words in whole texts, by multi-scale minimizers (operator 12).

A *run* is a stretch of consecutive words with smallest period q and a length of at least max(LEAST, EXPONENT * q)
that no neighbouring word extends. Periods below SCAN are found by direct scans of each lag. Longer ones are found by scales: for the
periods from Q to 2Q - 1, texts are seen as grams of Q/2 words, and the leftmost least gram of every Q/2 successive ones is a
*minimizer*. Inside a run minimizers repeat at the period's distance, so that pairs of equal minimizers at a distance of the scale are the
seeds; each is extended to both sides as far as the lag holds.

So that the number of seeds stays a small multiple of the text's length, a minimizer counts only if the one before it of the same gram is over
Q/4 away: then at most a few of one gram lie within a scale. None of a run's is lost by that: were all of them so near to
each other, the gram's own short period would be the run's. The four periods of a run leave room for a pair
whose surroundings lie in the run whole.

Grams are exact: words are numbered by their bytes, and a gram of 2^j words by the pair of its halves. The same
numbers give the extension of a seed, by ever smaller steps.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeflow.llm import spans

LEAST, EXPONENT = 6, 4
#: Periods below this are found by direct lag scans (a power of two, 8 at least).
SCAN = 8


class Grams:
    """Numbers of the grams of 2^j words at each place of texts one after another; -1 where a text ends before."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        size = np.diff(first)
        self.left = np.repeat(first[1:], size) - np.arange(len(words))  # words from here to the text's end
        self.back = np.arange(len(words)) - np.repeat(first[:-1], size)  # words before here
        self.levels = [words.astype(np.int32)]
        longest = int(size.max(initial=0))
        while 2 << len(self.levels) - 1 <= longest:
            width, half = 1 << len(self.levels), self.levels[-1]
            at = np.flatnonzero(self.left >= width)
            pair = half[at].astype(np.int64) << 32 | half[at + width // 2]
            level = np.full(len(words), -1, np.int32)
            level[at] = pd.factorize(pair)[0]
            self.levels.append(level)

    def forward(self, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """How many words from `at` on equal those `lag` further on."""
        most, done = self.left[at] - lag, np.zeros(len(at), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(most - done >= 1 << j)
            here = at[fits] + done[fits]
            done[fits[self.levels[j][here] == self.levels[j][here + lag[fits]]]] += 1 << j
        return done

    def backward(self, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """How many words before `at` equal those `lag` further on."""
        most, done = self.back[at], np.zeros(len(at), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(most - done >= 1 << j)
            here = at[fits] - done[fits] - (1 << j)
            done[fits[self.levels[j][here] == self.levels[j][here + lag[fits]]]] += 1 << j
        return done


def minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the leftmost least gram (by a mixed order) of each `window` (a power of two) successive ones of one text."""
    order = spans.mix(grams.astype(np.int64).view(np.uint64) + np.uint64(1))
    none = grams < 0
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, run = np.arange(len(grams)), 1
    while run < window:
        a, b = best[: len(best) - run], best[run:]
        best, run = np.where(order[b] < order[a], b, a), run * 2
    # Only windows without a text's end: grams are missing just there.
    missing = np.concatenate([[0], np.cumsum(none)])
    return np.unique(best[:n][missing[window:] == missing[:n]])


def _seeds(grams: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, lags) of pairs of equal minimizers from `scale` to 2 * scale - 1 words apart."""
    at = minimizers(grams, scale // 2)
    if not len(at):
        return at, at
    at = at[np.argsort(grams[at], kind="stable")]
    gram = grams[at]
    far = np.append(True, (gram[1:] != gram[:-1]) | (at[1:] - at[:-1] > scale // 4))
    at, gram = at[far], gram[far]
    places, lags = [], []
    for k in range(1, 8):  # those kept of one gram are over scale / 4 apart: within two scales there are seven at most
        lag = at[k:] - at[:-k]
        good = (gram[k:] == gram[:-k]) & (lag >= scale) & (lag < 2 * scale)
        places.append(at[:-k][good])
        lags.append(lag[good])
    return np.concatenate(places), np.concatenate(lags)


def runs(words: np.ndarray, first: np.ndarray, scan: int = SCAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, smallest periods) of all runs of the texts words[first[i]:first[i + 1]], by start and then period; words are numbers."""
    n = len(words)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    found = []
    for lag in range(1, scan):
        same = np.zeros(n + 1, np.int8)
        same[: max(n - lag, 0)] = (words[: max(n - lag, 0)] == words[lag:]) & (left[: max(n - lag, 0)] > lag)
        # A stretch cannot go on over a text's end: its last `lag` words have no partner.
        turn = np.diff(same, prepend=np.int8(0))
        start, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        length = stop - start + lag
        good = length >= max(LEAST, EXPONENT * lag)
        found.append(np.stack([start[good], length[good], np.full(int(good.sum()), lag)]))
    if np.diff(first).max(initial=0) >= EXPONENT * scan:
        # Texts too short for the scales stay out of them.
        size = np.diff(first)
        big = size >= EXPONENT * scan
        inside = np.repeat(big, size)
        place = np.flatnonzero(inside)
        grams = Grams(words[inside], np.concatenate([[0], np.cumsum(size[big])]))
        scale = scan
        while EXPONENT * scale <= size.max():
            at, lag = _seeds(grams.levels[(scale // 2).bit_length() - 1], scale)
            if len(at):
                ahead, behind = grams.forward(at, lag), grams.backward(at, lag)
                start, length = at - behind, behind + ahead + lag
                good = length >= np.maximum(LEAST, EXPONENT * lag)
                found.append(np.stack([place[start[good]], length[good], lag[good]]))
            scale *= 2
    start, length, lag = np.concatenate(found, axis=1)
    # One stretch may be found with multiples of its period, and by many seeds.
    order = np.lexsort((lag, length, start))
    start, length, lag = start[order], length[order], lag[order]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(start) else np.zeros(0, bool)
    start, length, lag = start[new], length[new], lag[new]
    order = np.lexsort((lag, start))
    return start[order], length[order], lag[order]


def planted(first: np.ndarray, ids: list[int | None]) -> np.ndarray:
    """For each word of texts one after another the word that stands there: where crc32 of the doc_id says so, a text's words repeat from some place on."""
    source = np.arange(first[-1])
    for i, (x, a, b) in enumerate(zip(ids, first[:-1].tolist(), first[1:].tolist())):
        n = b - a
        h = zlib.crc32(str(x).encode()) if x is not None else 1
        if h % 10 == 0 and n > 0:
            g = h // 10
            at = g % n
            period = 1 + (n - at) // (3 + g % 8)
            source[a + at : b] = a + at + np.arange(n - at) % period
    return source


class ChunkRuns:
    """Runs of one chunk of texts and what is left of these: `digests` is all that the query needs, `collapsed` gives texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: list[int | None] | None = None):
        starts, ends, self.first = spans.words(data, offsets)
        code = spans.distinct(data, starts, ends)[0] if len(starts) else starts
        source = np.arange(len(starts)) if ids is None else planted(self.first, ids)
        self.start, self.length, self.period = runs(code[source], self.first)
        depth = np.zeros(len(starts) + 1, np.int64)
        np.add.at(depth, self.start + self.period, 1)
        np.add.at(depth, self.start + self.length, -1)
        kept = np.cumsum(depth)[:-1] == 0
        # Kept words, each with a space before it, one after another.
        word = source[kept]
        size = ends[word] - starts[word]
        stop = np.cumsum(size + 1)
        out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
        take = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(stop - size, size) + take] = data[np.repeat(starts[word], size) + take]
        before = np.concatenate([[0], np.cumsum(kept)])[self.first]
        self.bounds = np.concatenate([[0], stop])[before].tolist()
        self.raw = out.tobytes()
        self.of = np.searchsorted(self.start, self.first)

    def collapsed(self) -> list[bytes]:
        """Each text's kept words, joined by one space."""
        return [self.raw[a + 1 : b] for a, b in zip(self.bounds[:-1], self.bounds[1:])]

    def rows(self) -> list[np.ndarray]:
        """Each text's runs as rows (start, length, period)."""
        every = np.stack([self.start, self.length, self.period], axis=1)
        return [every[a:b] - [[f, 0, 0]] for a, b, f in zip(self.of[:-1], self.of[1:], self.first.tolist())]


def _longest(own: np.ndarray) -> tuple[int | None, ...]:
    """Start, length, period and exponent in thousandths of the longest run (ties: smallest start, then period)."""
    if not len(own):
        return None, None, None, None
    start, length, period = min(own.tolist(), key=lambda r: (-r[1], r[0], r[2]))
    return start, length, period, 1000 * length // period


_NO_RUNS = hashlib.sha256(b"").hexdigest()


def periodic_runs(docs: DataFrame, plant: bool = True) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the longest run), runs_sha256, collapsed_sha256, n_words, n_dropped of each (doc_id, text).

    With `plant`, the words of a tenth of the texts repeat from some place on, as crc32(doc_id) says (a null doc_id plants nothing). Null and empty
    texts have no words and no runs. Rows keep their order and number, repeated ones too; other columns are ignored. A text is
    one row's: it is read whole, whatever its length.
    """
    ddl = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, n_words bigint, n_dropped bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in spans.chunks(batch, "text"):
                chunk = ChunkRuns(data, offsets, rows.column("doc_id").to_pylist() if plant else [None] * rows.num_rows)
                own = chunk.rows()
                longest = list(zip(*map(_longest, own)))
                texts = ["".join([f"{a},{n},{q}\n" for a, n, q in x.tolist()]) if len(x) else None for x in own]
                kept = chunk.collapsed()
                n_words = np.diff(chunk.first)
                left = [x.count(b" ") + 1 if x else 0 for x in kept]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"), "n_runs": pa.array(np.diff(chunk.of), pa.int64()),
                    **{name: pa.array(longest[k], pa.int64()) for k, name in enumerate(("start", "length", "period", "exponent_milli"))},
                    "runs_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() if t else _NO_RUNS for t in texts], pa.string()),
                    "collapsed_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                    "n_words": pa.array(n_words, pa.int64()), "n_dropped": pa.array(n_words - np.array(left), pa.int64()),
                })

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, text and runs (start, length, period) of each (doc_id, text), with the words of each run after its first period taken out of the text.

    A text without runs stays as it is, another one becomes its kept words, joined by a space. Null texts stay null and have no runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in spans.chunks(batch, "text"):
                chunk = ChunkRuns(data, offsets)
                own = chunk.rows()
                texts = [t if not len(x) else k.decode() for t, x, k in zip(rows.column("text").to_pylist(), own, chunk.collapsed())]
                listed = [[dict(zip(("start", "length", "period"), r)) for r in x.tolist()] for x in own]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "text": pa.array(texts, pa.string()), "runs": pa.array(listed, kind)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string, runs array<struct<start: bigint, length: bigint, period: bigint>>")
