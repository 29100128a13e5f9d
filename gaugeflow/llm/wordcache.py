"""Encoding of whole texts by distinct pretokens.

A chunk's distinct pretokens are found by their bytes, each is encoded the first time a Python
worker meets it, and the ids of all are gathered from a table of bounded size. The split into
pretokens and the encoding of one pretoken are those of the tokenizer file.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np

from gaugeflow.llm import pretokens as P
from gaugeflow.llm import spans
from gaugeflow.llm.pretokens import byte_alphabet

#: Distinct pretokens kept by a worker (about 60 bytes each); beyond it, those met once go.
MOST_WORDS = 1_000_000


class WordTable:
    """Ids of distinct words, found by their bytes. encode: bytes of words -> list of id sequences."""

    def __init__(self, encode: Callable[[list[bytes]], list], most: int = MOST_WORDS):
        self.encode, self.most = encode, most
        self._reset()

    def _reset(self) -> None:
        # Sorted keys of words of up to 16 bytes with their places; first and last bytes and length of each place.
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.known = np.zeros((0, 3), np.uint64)
        self.longer: dict[bytes, int] = {}
        self.bounds, self.flat, self.n = np.zeros(1, np.int64), np.zeros(0, np.uint32), 0
        self.used = np.zeros(0, np.int64)
        self.room: dict[str, np.ndarray] = {}
        self.generation = getattr(self, "generation", -1) + 1

    def _forget(self) -> None:
        """Keeps the words met again since the last time, if they are at most half of what fits."""
        stay = np.flatnonzero(self.used > 1)
        if len(stay) > self.most // 2:
            stay = stay[np.argsort(-self.used[stay], kind="stable")[: self.most // 2]]
            stay.sort()
        number = np.full(self.n, -1, np.int64)
        number[stay] = np.arange(len(stay))
        flat, bounds = self.ids(stay)
        keys, place, known = self.keys, number[self.place], self.known[stay]
        longer = {w: int(number[k]) for w, k in self.longer.items() if number[k] >= 0}
        self._reset()
        self.keys, self.place, self.known, self.longer = keys[place >= 0], place[place >= 0], known, longer
        self.bounds, self.flat, self.n, self.used = bounds, flat, len(stay), np.zeros(len(stay), np.int64)

    def _append(self, name: str, more: np.ndarray) -> None:
        """Puts rows after those of an array; its room doubles when full, as copying it for each chunk would cost more than the new words."""
        old, room = getattr(self, name), self.room.get(name)
        n = len(old) + len(more)
        if room is None or n > len(room):
            room = self.room[name] = np.empty((2 * n, *old.shape[1:]), old.dtype)
            room[: len(old)] = old
        room[len(old) : n] = more
        setattr(self, name, room[:n])

    def _add(self, words: list[bytes], edges: np.ndarray) -> np.ndarray:
        """Places of new words."""
        found = self.encode(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        at = np.arange(self.n, self.n + len(words))
        self._append("bounds", self.bounds[-1] + np.cumsum(sizes))
        self._append("flat", ids)
        self._append("known", edges)
        self._append("used", np.zeros(len(words), np.int64))
        self.n += len(words)
        return at

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place in (bounds, flat) of each word data[starts:ends]."""
        if self.n > self.most:
            self._forget()
        code, first, key, edges = spans.distinct(data, starts, ends)
        own = np.stack([edges.first[first], edges.last[first], edges.size[first]], axis=1)
        place = np.full(len(first), -1, np.int64)
        order = np.argsort(key)
        if len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, key[order]), len(self.keys) - 1)
            # Up to 16 bytes, a word is its edges; a longer one, or another word's key, is looked up by its bytes.
            at = self.place[spot]
            known, asked = self.known[at], own[order]
            same = (self.keys[spot] == key[order]) & (asked[:, 2] <= 16)
            for k in range(3):
                same &= known[:, k] == asked[:, k]
            place[order[same]] = at[same]
        rest = np.flatnonzero(place < 0)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts[first[rest]].tolist(), ends[first[rest]].tolist())]
        met = np.fromiter((self.longer.get(w, -1) for w in words), np.int64, len(words))
        place[rest] = met
        new = np.flatnonzero(met < 0)
        if len(new):
            at = self._add([words[i] for i in new], own[rest[new]])
            rest = rest[new]
            place[rest] = at
            # A key that another word has already is left to it.
            plain = own[rest, 2] <= 16
            k, p = np.unique(key[rest[plain]], return_index=True)
            p = at[plain][p]
            spot = np.searchsorted(self.keys, k)
            free = np.ones(len(k), bool) if not len(self.keys) else self.keys[np.minimum(spot, len(self.keys) - 1)] != k
            listed = np.zeros(self.n, bool)
            listed[p[free]] = True
            self.keys, self.place = np.insert(self.keys, spot[free], k[free]), np.insert(self.place, spot[free], p[free])
            for i in np.flatnonzero(~listed[at]):
                self.longer[words[new[i]]] = int(at[i])
        place = place[code]
        np.add(self.used, np.bincount(place, minlength=self.n), out=self.used)
        return place

    def ids(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, bounds of each word's)."""
        size = self.bounds[place + 1] - self.bounds[place]
        bounds = np.zeros(len(place) + 1, np.int64)
        np.cumsum(size, out=bounds[1:])
        take = np.repeat(self.bounds[place] - bounds[:-1], size) + np.arange(bounds[-1])
        return self.flat[take], bounds


class TextEncoder:
    """Whole texts -> ids, as the tokenizers library encodes them with add_special_tokens=False."""

    def __init__(self, path: str, encode: Callable[[list[bytes]], list] | None = None, most: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.tokenizer.encode_special_tokens = True
        self.by_word = self.tokenizer.normalizer is not None
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.table = WordTable(encode or self._library, most)

    def _library(self, words: list[bytes]) -> list:
        """The model's ids of single pretokens, which need no further splitting: their bytes in the byte-level alphabet."""
        tokenize, ends = self.tokenizer.model.tokenize, list(accumulate(map(len, words)))
        text = b"".join(words).decode("latin-1").translate(self.shown)  # a character for each byte
        return [[t.id for t in tokenize(text[a:b])] for a, b in zip([0, *ends], ends)]

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(places of all pretokens, bounds of each text's) of texts without special strings."""
        if self.by_word:
            texts = P.normalized_all(texts, self.tokenizer.normalizer.normalize_str)
        points, offsets = P.code_points(texts)
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        if self.by_word:
            starts, ends = P.word_level_spans(points, offsets)
        else:
            starts = np.flatnonzero(P.byte_level_starts(points, offsets))
            ends = np.append(starts[1:], len(points)) if len(starts) else starts
        bounds = np.searchsorted(starts, offsets)
        # Where code points start in the bytes: at all but those that go on with one.
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        return self.table.find(data, at[starts], at[ends]), bounds

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's); null counts as empty."""
        texts = [t or "" for t in texts]
        cut = [i for i, t in enumerate(texts) if any(s in t for s in self.specials)]
        if not cut:
            place, words = self.places(texts)
            ids, bounds = self.table.ids(place)
            return ids, bounds[words]
        pieces, tails, owner = [], [], []
        for i, t in enumerate(texts):
            for part, special in P.split_special(t, tuple(self.specials)):
                pieces.append(part)
                tails.append(special)
                owner.append(i)
        place, words = self.places(pieces)
        ids, bounds = self.table.ids(place)
        bounds = bounds[words]
        tail = np.array([s is not None for s in tails], np.int64)
        spot = bounds[1:][tail > 0]
        ids = np.insert(ids, spot, [self.specials[s] for s in tails if s is not None])
        last = np.searchsorted(owner, np.arange(len(texts)), side="right")
        total = np.concatenate([[0], np.cumsum(np.diff(bounds) + tail)])
        return ids, np.concatenate([[0], total[last]])


@lru_cache(maxsize=4)
def text_encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker and file."""
    return TextEncoder(path)
