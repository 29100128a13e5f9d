"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 11).

A text, with a space before it, is cut into words before each run of spaces, which no piece
crosses. Each distinct word is encoded once by a worker: the symbols of all new words stand in one flat array, and a
round takes for each word the least rank of its adjacent pairs, merges the pairs of that rank from the left at once and
closes the gaps, until no word has a pair left.

Merging all pairs of one rank at once is what one merge after the other does, unless a merged piece could start or end
a piece of the same or a better rank; such a rank merges its leftmost pair alone. In a long word the least rank is taken among the
pairs within the longest piece's reach to either side instead of the word: what could take a pair's symbols away earlier lies
within that reach. So a long word takes few rounds, too. What merges only one by one (a long run of spaces) is ended by a heap.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeflow.llm import pretokens as P
from gaugeflow.llm import spans
from gaugeflow.llm.wordcache import WordTable

#: SentencePiece's mark for a space.
MARK = "▁"
#: From this many symbols on, a word's least ranks are those within reach; rounds that merge fewer than one in SLOW symbols go to the heap.
LONG, SLOW = 256, 512
#: Distinct words that a worker keeps.
KEPT_WORDS = 300_000
#: Symbols from here on are characters that are in no piece.
_UNKNOWN = 1 << 21


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the words in texts that each begin with a space, words before each text): a word is a run of spaces and what follows up to the next."""
    space = data == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(start)
    return at, np.searchsorted(at, offsets)


def spaced(texts: list[str | None]) -> list[str]:
    """Texts as the model reads them: a space before each that is not empty, the mark as a space."""
    return [" " + t.replace(MARK, " ") if t else "" for t in texts]


def utf8(run: bytes) -> str:
    """Bytes as the library shows them: each byte that is no part of a character is U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                n = 1
            i += n
        return "".join(out)


class PieceBPE:
    """Encoder and decoder of a SentencePiece BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(" a　ﬁ  ") != f"{MARK}{MARK}a　ﬁ{MARK}{MARK}":
            raise ValueError("the model normalises texts in another way than by a dummy prefix")
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        kinds = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        if any(map(sp.is_unused, range(n))) or sum(map(sp.is_byte, range(n))) != 256:
            raise ValueError("the model has unused pieces, or no byte fallback")
        number = {t: i for i, t in enumerate(names) if not kinds[i]}
        if any(a != MARK and b == MARK for t in number for a, b in zip(t, t[1:])):
            raise ValueError("a piece has a space after another character")
        self.byte_id = np.zeros(256, np.int64)
        self.shown: list[bytes] = [t.replace(MARK, " ").encode() for t in names]  # what an id stands for
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        for i in np.flatnonzero(self.is_byte).tolist():
            self.byte_id[int(names[i][3:5], 16)] = i
            self.shown[i] = bytes.fromhex(names[i][3:5])
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i):
                self.shown[i] = sp.decode([i]).encode()
        self.marked = np.array([t.startswith(MARK) and not k for t, k in zip(names, kinds)])
        self.control = np.array([sp.is_control(i) for i in range(n)])
        # Characters that occur in pieces without being one get symbols of their own.
        self.symbols = dict(number)
        self.points = {}
        for c in {c for t in number for c in t} - number.keys():
            self.points[len(names) + len(self.points)] = ord(c)
            self.symbols[c] = len(names) + len(self.points) - 1
        self.of_point = np.arange(_UNKNOWN, _UNKNOWN + 0x110000)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.of_point[ord(c)] = i
        self.of_point[0x20] = self.of_point[ord(MARK)]
        self.pieces = list(number)
        self._pairs(number, np.array([sp.get_score(i) for i in range(n)]))

    def _pairs(self, number: dict[str, int], scores: np.ndarray) -> None:
        """The table of pairs (sorted keys, ranks, made pieces) and which ranks merge one pair at a time."""
        order, rank = np.unique(-scores[list(number.values())], return_inverse=True)
        of = dict(zip(number, rank.tolist()))
        tied = np.bincount(rank, minlength=len(order)) > 1
        keys, made, single = [], [], tied.copy()
        for t, i in number.items():
            for k in range(1, len(t)):
                a, b = self.symbols.get(t[:k]), self.symbols.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 22 | b)
                    made.append(i)
                for part in (t[:k], t[k:]):
                    if part in of and of[t] <= of[part]:
                        single[of[part]] = True
        by_key = np.argsort(keys)
        self.keys = np.append(np.array(keys, np.int64)[by_key], np.iinfo(np.int64).max)
        self.made = np.append(np.array(made, np.int64)[by_key], -1)
        own = np.zeros(len(scores), np.int64)
        own[list(number.values())] = rank
        self.none = len(order)
        self.ranks = np.append(own[self.made[:-1]], self.none)
        self.single = np.append(single, True)
        self.reach = 1 << (max(map(len, number)) - 1).bit_length()

    def neighbours(self) -> np.ndarray:
        """Sorted keys (code point << 21 | code point) of the characters that stand side by side in a piece; the mark is a space."""
        return np.array(sorted({ord(a) << 21 | ord(b) for t in self.pieces for a, b in zip(t.replace(MARK, " "), t[1:].replace(MARK, " "))}), np.int64)

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of pairs in the table; its last place where there is none."""
        key = a << 22 | b
        spot = np.searchsorted(self.keys, key)
        return np.where(self.keys[spot] == key, spot, len(self.keys) - 1)

    def _short(self, rank: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Pairs to merge now: those of the least rank of their words, from the left."""
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
        at = np.flatnonzero((rank == low) & (rank < self.none))
        if not len(at):
            return at
        run = np.append(True, at[1:] != at[:-1] + 1)
        place = np.arange(len(at))
        even = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0
        leftmost = np.append(True, word[at[1:]] != word[at[:-1]])
        return at[np.where(self.single[rank[at]], leftmost, even)]

    def _long(self, rank: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Pairs to merge now: those of the least rank within reach to either side, from the left."""
        n, reach = len(rank), self.reach
        wide = np.full(n + 2 * reach, self.none, np.int64)
        wide[reach : reach + n] = rank
        run = 1
        while run < reach:  # wide[i] becomes the least of the `reach` ranks from i on
            wide[: len(wide) - run] = np.minimum(wide[: len(wide) - run], wide[run:])
            run *= 2
        left, right = wide[:n], wide[reach + 1 : reach + 1 + n]
        fits = (rank < self.none) & (rank <= left) & (rank <= right)
        # A run of equal ranks merges every second pair from its start on, as far as all of them may be merged.
        place = np.arange(n)
        head = np.append(True, rank[1:] != rank[:-1])
        start = np.maximum.accumulate(np.where(head, place, 0))
        held = np.cumsum(~fits)
        clear = held - held[start] + ~fits[start] == 0
        return np.flatnonzero(fits & np.where(self.single[rank], rank < left, clear & ((place - start) % 2 == 0)))

    def _heap(self, sym: list[int]) -> list[int]:
        """One merge after the other."""
        n = len(sym)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(ends: list[tuple[int, int]]) -> None:
            found = self._look(np.array([sym[i] for i, _ in ends]), np.array([sym[j] for _, j in ends]))
            for (i, j), spot in zip(ends, found.tolist()):
                if spot < len(self.keys) - 1:
                    heapq.heappush(heap, (int(self.ranks[spot]), i, sym[i], sym[j], int(self.made[spot])))

        if n > 1:
            offer([(i, i + 1) for i in range(n - 1)])
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = made, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            ends = [(x, y) for x, y in ((before[i], i), (i, after[i])) if x >= 0 and y >= 0]
            if ends:
                offer(ends)
        return [s for s in sym if s >= 0]

    def _rounds(self, sym: np.ndarray, word: np.ndarray, long: bool) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, words) after all merges, in the order of the words."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        spot = np.full(len(sym), len(self.keys) - 1)
        pick = self._long if long else self._short

        def look(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at < len(sym))]
            inner = at[at + 1 < len(sym)]
            inner = inner[word[inner] == word[inner + 1]]
            spot[at] = len(self.keys) - 1
            spot[inner] = self._look(sym[inner], sym[inner + 1])

        look(np.arange(len(sym)))
        while len(sym):
            rank = self.ranks[spot]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(word)))
            live = np.minimum.reduceat(rank, first) < self.none
            if not live.all():  # compaction: finished words leave
                stay = np.repeat(live, size)
                done.append((sym[~stay], word[~stay]))
                sym, word, spot, rank = sym[stay], word[stay], spot[stay], rank[stay]
                if not len(sym):
                    break
            at = pick(rank, word)
            if long and len(at) * SLOW < len(sym):
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1])).tolist()
                ended = [np.array(self._heap(sym[a:b].tolist()), np.int64) for a, b in zip(first, [*first[1:], len(sym)])]
                done.append((np.concatenate(ended), np.repeat(word[first], [len(x) for x in ended])))
                break
            sym[at] = self.made[spot[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # each earlier merge closes one gap
            sym, word, spot = sym[stay], word[stay], spot[stay]
            look(np.concatenate([at, at - 1]))
        sym, word = (np.concatenate(x) for x in zip(*done)) if done else (sym, word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words (UTF-8, with spaces for marks)."""
        texts = [w.decode() for w in words]
        size = np.array([len(t) for t in texts], np.int64)
        sym = self.of_point[P.code_points(texts)[0]]
        word = np.repeat(np.arange(len(words)), size)
        far = (size > LONG)[word]
        sym, word = (np.concatenate(x) for x in zip(self._rounds(sym[~far], word[~far], False), self._rounds(sym[far], word[far], True)))
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        for i, point in self.points.items():
            sym[sym == i] = _UNKNOWN + point
        # A character that is in no piece becomes its bytes.
        odd = sym >= _UNKNOWN
        points = (sym[odd] - _UNKNOWN).astype("<u4")
        wide = np.ones(len(sym), np.int64)
        wide[odd] = P.byte_widths(points)
        ids = np.repeat(sym, wide)
        raw = points.tobytes().decode("utf-32-le").encode()
        ids[np.repeat(odd, wide)] = self.byte_id[np.frombuffer(raw, np.uint8)]
        at = np.concatenate([[0], np.cumsum(np.bincount(word, wide, len(words)).astype(np.int64))]).tolist()
        flat = ids.tolist()
        return [flat[a:b] for a, b in zip(at[:-1], at[1:])]

    def raw(self, ids: list[int]) -> str:
        """The text of ids in the middle of a text: pieces as they are, runs of byte tokens as the characters that they spell."""
        whole = b"".join([self.shown[i] for i in ids])
        try:
            return whole.decode()
        except UnicodeDecodeError:
            out, run = [], b""
            for i in ids:
                if self.is_byte[i]:
                    run += self.shown[i]
                    continue
                out += [utf8(run), self.shown[i].decode()]
                run = b""
            return "".join([*out, utf8(run)])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first piece that shows anything loses the dummy prefix."""
        text = self.raw(ids)
        first = next((i for i in ids if not self.control[i]), None)
        return text[1:] if first is not None and self.marked[first] else text


class PieceCodec:
    """Whole texts -> ids and back, by distinct words."""

    def __init__(self, path: str, most: int = KEPT_WORDS):
        self.model = PieceBPE(path)
        self.table = WordTable(self.model, most)
        self.generation = self.table.generation
        self.listed: list[bytes] = []
        self.text: list[bytes] = []

    def _shown(self) -> None:
        """Brings up to date, for each kept word, its decimal ids and its text."""
        t = self.table
        if self.generation != t.generation:
            self.listed, self.text, self.generation = [], [], t.generation
        new = t.flat[t.bounds[len(self.listed)] :].tolist()
        at = (t.bounds[len(self.listed) :] - t.bounds[len(self.listed)]).tolist()
        for a, b in zip(at[:-1], at[1:]):
            own = new[a:b]
            self.listed.append(",".join(map(str, own)).encode())
            self.text.append(self.model.raw(own).encode())

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(places of all words, bounds of each text's)."""
        raw = [t.encode() for t in spaced(texts)]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw], dtype=np.int64)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        at, bounds = word_starts(data, offsets)
        return self.table.find(data, at, np.append(at[1:], len(data)) if len(at) else at), bounds

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's); null counts as empty."""
        place, words = self.places(texts)
        ids, bounds = self.table.ids(place)
        return ids, bounds[words]

    def digests(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[str]]:
        """(number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text) of each text."""
        place, words = self.places(texts)
        self._shown()
        size = np.concatenate([[0], np.cumsum(np.diff(self.table.bounds)[place])])
        order, ids, shown = place.tolist(), [], []
        for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
            own = order[a:b]
            ids.append(hashlib.sha256(b",".join([self.listed[k] for k in own])).hexdigest())
            # A text's first word starts with the dummy prefix, which decoding takes away.
            shown.append(hashlib.sha256(b"".join([self.text[k] for k in own])[1:]).hexdigest())
        return np.diff(size[words]), ids, shown


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec for each Python worker and file."""
    return PieceCodec(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids, joined by commas), decoded_sha256 of each (doc_id, text).

    Null and empty texts have no ids and decode to the empty text; strings of control pieces inside a text are plain text. Rows keep their
    order and number; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in spans.chunks(batch, "text"):
                n, ids, shown = codec(path).digests(rows.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(shown, pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def with_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of each (doc_id, text); null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in spans.chunks(batch, "text"):
                ids, bounds = codec(path).encode(rows.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each (doc_id, ids): what the library's decode(ids) gives; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = codec(path).model
            texts = [None if x is None else model.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
