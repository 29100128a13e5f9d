"""Minimal acyclic transducer lexicon: exact BPE encoding and decoding (operator 2).

Frequent words of the corpus are compiled into one minimal acyclic automaton (words share suffixes).
Each arc holds how many accepted words come before it, so that the arcs of a word add up to
its number, and the number's ids stand in one table: the automaton's outputs. The compiled
arrays are one file that the workers of a machine map into memory. A word that the automaton does not
accept is merged exactly, by the vocabulary's ranks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm import pretokens as P
from gaugeflow.llm import spans
from gaugeflow.llm.wordcache import TextEncoder

#: Words compiled at most (a few MB), and the distinct words whose counts a task holds before it hands them on.
LEXICON_WORDS, HELD_WORDS = 1 << 16, 300_000
#: Longer words (in bytes) are merged alone, by a heap.
LONG_WORD = 256


class ExactMerge:
    """BPE with a word-end suffix over many words at once: each step merges the leftmost lowest-ranked pair of every word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        back = {b: c for c, b in P.byte_alphabet().items()}
        self.inner = np.array([vocab.get(back[b], -1) for b in range(256)], np.int64)
        self.final = np.array([vocab.get(back[b] + self.end, -1) for b in range(256)], np.int64)
        keys, ranks, made = [], [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[a] << 20 | vocab[b])
            ranks.append(rank)
            made.append(vocab[a + b])
        self.pairs: dict[int, tuple[int, int]] = {}
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = np.array(keys)[order], np.array(ranks)[order], np.array(made)[order]

    def __call__(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (not empty)."""
        out: list[np.ndarray] = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order and len(words[order[-1]]) > LONG_WORD:
            i = order.pop()
            out[i] = self._one(words[i])
        for k in range(0, len(order), 20_000):
            part = order[k : k + 20_000]
            # Words of like length go together, so that long ones do not widen the others' rows.
            while part:
                width = max(32, len(words[part[0]]) * 2)
                some = [i for i in part if len(words[i]) <= width]
                part = part[len(some) :]
                for i, ids in zip(some, self._merge([words[i] for i in some])):
                    out[i] = ids
        return out

    def _one(self, word: bytes) -> np.ndarray:
        """A long word by a heap of its pairs, the leftmost of the lowest rank first: n log n steps."""
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        ids = [*self.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.final[word[-1]])]
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            found = self.pairs.get(ids[i] << 20 | ids[j])
            if found is not None:
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return np.array([x for x in ids if x >= 0], np.uint32)

    def _merge(self, words: list[bytes]) -> list[np.ndarray]:
        size = np.array([len(w) for w in words])
        n, width = len(words), size.max()
        table = np.full((n, width + 1), -1, np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), size)
        column = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
        table[row, column] = self.inner[raw]
        table[np.arange(n), size - 1] = self.final[raw[np.cumsum(size) - 1]]
        none = len(self.ranks)
        rank = np.full((n, width), none, np.int64)
        made = np.zeros((n, width), np.int64)

        def look(rows, columns):
            key = table[rows, columns] << 20 | table[rows, columns + 1]
            spot = np.minimum(np.searchsorted(self.keys, key), none - 1)
            hit = (self.keys[spot] == key) & (table[rows, columns + 1] >= 0)
            rank[rows, columns], made[rows, columns] = np.where(hit, self.ranks[spot], none), self.made[spot]

        rows, columns = np.nonzero(table[:, 1:] >= 0)
        look(rows, columns)
        live = np.arange(n)
        while len(live):
            best = rank[live].argmin(axis=1)
            go = rank[live, best] < none
            live, best = live[go], best[go]
            if not len(live):
                break
            table[live, best] = made[live, best]
            # Close the gap: what stands after the pair moves one to the left.
            index = np.arange(width)[None, :]
            moved = index > best[:, None]
            shift = np.where(moved, np.minimum(index + 1, width), index)
            table[live, :width] = np.take_along_axis(table[live], shift, axis=1)
            table[live, width] = -1
            back = np.minimum(shift, width - 1)
            rank[live], made[live] = np.take_along_axis(rank[live], back, axis=1), np.take_along_axis(made[live], back, axis=1)
            rank[live, width - 1] = none
            for side in (best - 1, best):
                ok = side >= 0
                look(live[ok], side[ok])
        keep = table >= 0
        flat, bounds = table[keep], np.cumsum(keep.sum(axis=1))
        return np.split(flat.astype(np.uint32), bounds[:-1])


def compile_lexicon(words: list[bytes], ids: list) -> bytes:
    """The automaton of distinct words with their ids, as one byte string of aligned arrays."""
    pairs = sorted(zip(words, ids), key=lambda x: x[0])
    # Minimal automaton of sorted words: the path of the last word stays open, all else is registered by its right language.
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []
    counts: list[int] = []
    finals: list[bool] = []
    path: list[list] = [[False, []]]  # [final, arcs (byte, state)] from the root on
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, own = path.pop()
            key = (final, tuple(own))
            if key not in register:
                register[key] = len(arcs)
                arcs.append(key[1])
                finals.append(final)
                counts.append(final + sum(counts[s] for _, s in own))
            path[-1][1].append((last[len(path) - 1], register[key]))

    for word, _ in pairs:
        same = next((k for k, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        close(same)
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    close(0)
    root = len(arcs)
    arcs.append(tuple(path[0][1]))
    finals.append(path[0][0])
    key, to, skip = [], [], []
    for state, own in enumerate(arcs):
        before = int(finals[state])
        for byte, target in own:
            key.append(state << 8 | byte)
            to.append(target)
            skip.append(before)
            before += counts[target]
    sizes = np.array([len(x) for _, x in pairs], np.int64)
    flat = np.concatenate([np.asarray(x, np.int64) for _, x in pairs]) if pairs else np.zeros(0, np.int64)
    # State numbers stay far below 2^23 for a bounded lexicon, so that state and byte fit 32 bits.
    parts = [np.array(key, np.int64), np.array(to, np.int64), np.array(skip, np.int64), np.array(finals, np.int64), np.concatenate([[0], np.cumsum(sizes)]), flat]
    if len(arcs) >= 1 << 23:
        raise ValueError("a lexicon of too many states")
    head = np.array([root, *map(len, parts)], np.int64)
    return b"".join(x.astype("<i4").tobytes() for x in (head, *parts))


class Lexicon:
    """The compiled automaton, mapped from a file."""

    def __init__(self, path: str):
        data = np.memmap(path, "<i4", mode="r")
        self.root, at, parts = int(data[0]), 7, []
        for n in data[1:7].tolist():
            parts.append(data[at : at + n])
            at += n
        self.key, self.to, self.skip, self.final, self.bounds, self.flat = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where the automaton does not accept it; all words step together."""
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(size > 0)
        number[size == 0] = -1
        step = 0
        while len(live) and len(self.key):
            key = (state[live] << 8 | raw[first[live] + step]).astype(np.int32)
            spot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[spot] == key
            number[live[~hit]] = -1
            live, spot = live[hit], spot[hit]
            state[live], number[live] = self.to[spot], number[live] + self.skip[spot]
            step += 1
            ended = size[live] == step
            number[live[ended & (self.final[state[live]] == 0)]] = -1
            live = live[~ended]
        if not len(self.key):
            number[:] = -1
        return number

    def ids(self, number: int) -> np.ndarray:
        return self.flat[self.bounds[number] : self.bounds[number + 1]].astype(np.uint32)


def mapped(blob: bytes, name: str) -> Lexicon:
    """The lexicon mapped into memory from a file that has no name any more: it goes when the worker ends, and nobody else can change it.

    Each worker of a machine maps its own few MB; `name` tells lexicons apart while they are written.
    """
    with tempfile.NamedTemporaryFile(prefix=f"lexicon-{name}-") as f:
        f.write(blob)
        f.flush()
        return Lexicon(f.name)


@lru_cache(maxsize=2)
def _merge(path: str) -> ExactMerge:
    return ExactMerge(path)


class _Codec:
    """Encoder and decoder of one worker: the lexicon first, exact merging for the rest, both kept by distinct word."""

    def __init__(self, path: str, lexicon: Lexicon):
        self.lexicon, self.merge = lexicon, _merge(path)
        self.encoder = TextEncoder(path, self._encode, most=300_000)
        self.tokens = self._tokens()
        self.shown: list[bytes] = []
        self.generation = self.encoder.table.generation

    def _tokens(self) -> list[bytes]:
        vocab = self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            out[i] = t.encode()
        return out

    def _encode(self, words: list[bytes]) -> list[np.ndarray]:
        number = self.lexicon.find(words)
        rest = np.flatnonzero(number < 0)
        merged = dict(zip(rest.tolist(), self.merge([words[i] for i in rest]))) if len(rest) else {}
        return [merged[i] if k < 0 else self.lexicon.ids(k) for i, k in enumerate(number.tolist())]

    def decode_words(self) -> list[bytes]:
        """Decoded text of each kept word: its tokens joined by a space, as the library joins all tokens of a text."""
        table = self.encoder.table
        if self.generation != table.generation:
            self.shown, self.generation = [], table.generation
        bounds, flat = table.bounds, table.flat
        for k in range(len(self.shown), table.n):
            self.shown.append(b" ".join([self.tokens[i] for i in flat[bounds[k] : bounds[k + 1]].tolist()]))
        return self.shown

    def digests(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[str]]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text) of each text."""
        specials = tuple(self.encoder.specials)
        if any(s in t for s in specials for t in texts):
            ids, bounds = self.encoder.encode(texts)
            shown = [b" ".join([self.tokens[i] for i in ids[a:b].tolist()]) for a, b in zip(bounds[:-1], bounds[1:])]
        else:
            place, words = self.encoder.places(texts)
            ids, cut = self.encoder.table.ids(place)
            bounds, table, order = cut[words], self.decode_words(), place.tolist()
            shown = [b" ".join([table[k] for k in order[a:b]]) for a, b in zip(words[:-1].tolist(), words[1:].tolist())]
        raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
        at = (4 * bounds).tolist()
        return np.diff(bounds), [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])], [hashlib.sha256(s).hexdigest() for s in shown]


_CODECS: dict[str, _Codec] = {}


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, n) of the pretokens of all documents: tasks hand on partial counts, a shuffle adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(path, lambda words: [(0,)] * len(words))
        seen: dict[bytes, int] = {}

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

        for batch in batches:
            for rows, _, _ in spans.chunks(batch, "text"):
                texts = P.normalized_all([t or "" for t in rows.column("text").to_pylist()], encoder.tokenizer.normalizer.normalize_str)
                points, offsets = P.code_points(texts)
                starts, ends = P.word_level_spans(points, offsets)
                at = np.concatenate([[0], np.cumsum(P.byte_widths(points))])
                data = np.frombuffer("".join(texts).encode(), np.uint8)
                starts, ends = at[starts], at[ends]
                code, first, _, _ = spans.distinct(data, starts, ends)
                n = np.bincount(code, minlength=len(first))
                raw = data.tobytes()
                for a, b, k in zip(starts[first].tolist(), ends[first].tolist(), n.tolist()):
                    word = raw[a:b]
                    seen[word] = seen.get(word, 0) + k
                if len(seen) > HELD_WORDS:
                    yield counted()
                    seen = {}
        yield counted()

    counts = docs.select("text").mapInArrow(run, "word binary, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> bytes:
    """The lexicon of the `size` most frequent words (ties: smaller word); at most that many rows reach the driver."""
    top = word_counts(docs, path).orderBy(F.desc("n"), "word").limit(size).select("word")
    words = [bytes(r.word) for r in top.toLocalIterator()]
    return compile_lexicon(words, _merge(path)(words) if words else [])


def encode_decode(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each (doc_id, text).

    Null and empty texts have no ids and decode to the empty text. Special strings inside a text are special ids, as by
    default. Rows keep their number; other columns are ignored.
    """
    blob = build_lexicon(docs, path, size)
    name = hashlib.sha256(blob).hexdigest()[:24]
    shared = docs.sparkSession.sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _CODECS:
            _CODECS.clear()
            _CODECS[name] = _Codec(path, mapped(shared.value, name))
        codec = _CODECS[name]
        for batch in batches:
            for rows, _, _ in spans.chunks(batch, "text"):
                n, ids, shown = codec.digests([t or "" for t in rows.column("text").to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(shown, pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
