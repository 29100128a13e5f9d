"""Finite-state tokenizer compilation: a deterministic transducer that counts BPE tokens.

Two machines run one after the other over a chunk of texts:

* the *scanner* has eight states over code point symbols and marks where pretokens start.
  Its input is cut into equal pieces. The map of a piece gives, for each entry state, the exit state and
  the pretokens that start in the piece. The maps of all pieces are computed at once and composed by a parallel prefix scan. That
  gives each piece its true entry state, and so each pretoken its true start, from which it is counted once; composed
  again with the counts, the maps leave the counts of all texts;
* the *merger* starts anew at each pretoken. A state holds, for each earlier position from
  which a vocabulary entry can still reach on, the trie node reached, the last token of the
  encoding that ends there and its token count relative to the current one. Reading a byte
  emits by how much the count of the encoding changes, so that the emissions of a path
  add up to the pretoken's token count. States are compiled when first met, and all
  pretokens of a chunk step together. A long pretoken (a text without spaces) is a chain of blocks instead, each a map from
  the state before it to the state after it and the tokens between: a map is kept by its block's bytes, so that like blocks are one.

The merger rests on two properties of BPE: the encoding of a prefix ends in one token, and a
sequence of tokens is an encoding if and only if each adjacent pair is the encoding of its own
concatenation. Both are checked against the library in the tests.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from gaugeflow.llm import pretokens as P

#: Symbols of the scanner.
S_LETTER, S_NUMBER, S_OTHER, S_SPACE_LAST, S_WHITE_LAST, S_WHITE, S_APOS1, S_APOS2, S_BEGIN = range(9)
#: States: before anything, in a letter, number or other run, after a space that a run may follow, in white space, one or two contraction letters to go.
Q_NEW, Q_LETTER, Q_NUMBER, Q_OTHER, Q_SPACE, Q_WHITE, Q_ONE, Q_TWO = range(8)


def _scanner() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start flag for each symbol and state."""
    to, flag = np.zeros((8, 8), np.uint8), np.zeros((8, 8), bool)
    runs = {S_LETTER: Q_LETTER, S_NUMBER: Q_NUMBER, S_OTHER: Q_OTHER}
    for q in range(8):
        for s, run in runs.items():
            to[s, q], flag[s, q] = run, q not in (run, Q_SPACE)
        to[S_LETTER, Q_TWO], flag[S_LETTER, Q_TWO] = Q_ONE, False
        to[S_LETTER, Q_ONE], flag[S_LETTER, Q_ONE] = Q_NEW, False
        for s, letters in ((S_APOS1, Q_ONE), (S_APOS2, Q_TWO)):
            to[s, q], flag[s, q] = (Q_OTHER, False) if q in (Q_OTHER, Q_SPACE) else (letters, True)
        to[S_SPACE_LAST, q], flag[S_SPACE_LAST, q] = Q_SPACE, True
        to[S_WHITE_LAST, q], flag[S_WHITE_LAST, q] = Q_NEW, True
        to[S_WHITE, q], flag[S_WHITE, q] = Q_WHITE, q != Q_WHITE
    return to, flag


_TO, _FLAG = _scanner()


def symbols(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scanner symbols; a text's first symbol also has S_BEGIN added, which resets the state."""
    n = len(points)
    kind = P._classes()[points]
    edge = P.edges(offsets, n)
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = (kind[1:] < P.SPACE) & ~edge[1:]
    out = kind.copy()
    out[kind == P.SPACE] = S_WHITE
    out[kind == P.WHITE] = S_WHITE
    out[(kind == P.SPACE) & solid_next] = S_SPACE_LAST
    out[(kind == P.WHITE) & solid_next] = S_WHITE_LAST
    two = P.contractions(points, edge)
    out[two == 1], out[two == 2] = S_APOS1, S_APOS2
    out[edge] += S_BEGIN
    return out


# A symbol with S_BEGIN goes on as from Q_NEW in any state; S_PAD leaves every state as it is.
S_PAD = 2 * S_BEGIN
_ALL_TO = np.vstack([_TO, np.repeat(_TO[:, Q_NEW : Q_NEW + 1], 8, axis=1), np.arange(8, dtype=np.uint8)[None, :]])
_ALL_FLAG = np.vstack([_FLAG, np.repeat(_FLAG[:, Q_NEW : Q_NEW + 1], 8, axis=1), np.zeros((1, 8), bool)])
_ALL_FLAG[S_BEGIN:S_PAD] = True


def scan_starts(points: np.ndarray, offsets: np.ndarray, piece: int = 128) -> np.ndarray:
    """Pretoken start flags, by state maps of pieces and a prefix scan over them."""
    n = len(points)
    if n == 0:
        return np.zeros(0, bool)
    sym = symbols(points, offsets)
    m = -(-n // piece)
    grid = np.full(m * piece, S_WHITE, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(m, piece).T)
    flat, flags = _ALL_TO.ravel(), _ALL_FLAG.ravel()
    maps = np.tile(np.arange(8, dtype=np.uint8), (m, 1))
    for k in range(piece):
        maps = flat[(grid[k].astype(np.int32) * 8)[:, None] + maps]
    gap = 1
    while gap < m:  # inclusive scan: maps[i] becomes the map of pieces 0..i
        ahead = maps.copy()
        ahead[gap:] = np.take_along_axis(maps[gap:], maps[:-gap], axis=1)
        maps, gap = ahead, gap * 2
    state = np.zeros(m, np.int32)
    state[1:] = maps[:-1, Q_NEW]
    out = np.zeros((piece, m), bool)
    for k in range(piece):
        at = grid[k].astype(np.int32) * 8 + state
        out[k] = flags[at]
        state = flat[at].astype(np.int32)
    return out.T.ravel()[:n]


class PieceMaps:
    """The maps of all pieces of a chunk of texts: exit states, and where the pretokens of each entry state start and end.

    `start`, `end` (in code points) and `slot` (piece * 8 + entry state, or -1 - piece where all entry states agree) list the pretokens
    by the piece that they start in; one that runs on into the next pieces ends where these, entered by the exit state, start another.
    """

    def __init__(self, points: np.ndarray, offsets: np.ndarray, piece: int):
        sizes = np.diff(offsets)
        self.pieces = -(-sizes // piece)
        m = int(self.pieces.sum())
        text = np.repeat(np.arange(len(sizes)), self.pieces)
        first = np.cumsum(self.pieces) - self.pieces
        begin = offsets[text] + piece * (np.arange(m) - first[text])
        self.last = np.zeros(m, bool)
        self.last[(first + self.pieces - 1)[self.pieces > 0]] = True
        own = np.repeat(np.arange(m), np.minimum(offsets[text + 1] - begin, piece))
        row = np.arange(len(points)) - begin[own]
        length = np.bincount(own, minlength=m)
        grid = np.full((piece, m), S_PAD, np.uint8)
        grid[row, own] = symbols(points, offsets)
        bits, agreed = self._run(grid, length)
        bits = bits[row, own]
        common = (bits != 0) & (row >= agreed[own])
        head = (bits != 0) & ~common
        # Where the first pretoken starts from each entry state, in a piece or after it.
        fresh, opens = self._firsts(np.flatnonzero(common), own, m), np.full((m, 8), -1, np.int64)
        by_state = [np.flatnonzero(head & (bits >> q & 1 > 0)) for q in range(8)]
        for q, at in enumerate(by_state):
            opens[:, q] = self._firsts(at, own, m)
        opens = np.where(opens >= 0, opens, fresh[:, None])
        stop = offsets[text + 1]
        missing = (opens < 0) & ~self.last[:, None]
        opens = np.where((opens < 0) & self.last[:, None], stop[:, None], opens)
        for j in np.flatnonzero(missing.any(axis=1))[::-1].tolist():  # pieces without a start, from behind
            opens[j] = np.where(missing[j], opens[j + 1][self.exit[j]], opens[j])
        after = np.empty((m, 8), np.int64)
        after[:-1] = np.take_along_axis(opens[1:], self.exit[:-1].astype(np.int64), axis=1) if m else 0
        after[self.last] = stop[self.last][:, None]
        start, end, slot = [], [], []
        for q, at in enumerate(by_state):
            piece_of = own[at]
            until = np.where(fresh[piece_of] >= 0, fresh[piece_of], after[piece_of, q])
            start.append(at)
            end.append(self._ends(at, piece_of, until))
            slot.append(piece_of * 8 + q)
        at = np.flatnonzero(common)
        start.append(at)
        end.append(self._ends(at, own[at], after[own[at], 0]))
        slot.append(-1 - own[at])
        self.start, self.end, self.slot = map(np.concatenate, (start, end, slot))

    def _run(self, grid: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start flags of the entry states as bits, the row from which all entry states agree); sets the exit states."""
        piece, m = grid.shape
        flat, flags = _ALL_TO.ravel(), _ALL_FLAG.ravel()
        state = np.tile(np.arange(8, dtype=np.uint8), (m, 1))
        bits, agreed = np.zeros((piece, m), np.uint8), np.full(m, piece)
        one = False
        for k in range(piece):
            at = grid[k].astype(np.int32) * 8
            if one:  # every piece that goes on has one state left
                at += state[:, 0]
                bits[k] = flags[at] * np.uint8(255)
                state = np.where((length > k)[:, None], flat[at][:, None], state)
                continue
            at = at[:, None] + state
            bits[k] = np.packbits(flags[at], axis=1, bitorder="little")[:, 0]
            state = flat[at]
            equal = (state == state[:, :1]).all(axis=1)
            agreed = np.where(equal & (agreed == piece), k + 1, agreed)
            one = bool((equal | (length <= k + 1)).all())
        self.exit = state
        return bits, agreed

    @staticmethod
    def _firsts(at: np.ndarray, own: np.ndarray, m: int) -> np.ndarray:
        out = np.full(m, -1, np.int64)
        out[own[at[::-1]]] = at[::-1]
        return out

    @staticmethod
    def _ends(at: np.ndarray, piece_of: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Each start's end: the next start in its piece, else `until`."""
        out = until.copy()
        if len(at) > 1:
            out[:-1] = np.where(piece_of[1:] == piece_of[:-1], at[1:], until[:-1])
        return out

    def entered(self) -> np.ndarray:
        """Which listed pretokens are met: those of each piece's true entry state, which the composed maps of the pieces before it give."""
        to, gap = self.exit.astype(np.int64), 1
        while gap < len(to):
            to, gap = np.concatenate([to[:gap], np.take_along_axis(to[gap:], to[:-gap], axis=1)]), gap * 2
        state = np.full(len(to), Q_NEW)
        state[1:] = to[:-1, Q_NEW]
        # A text's first piece resets the state itself.
        return (self.slot < 0) | (self.slot & 7 == state[self.slot >> 3])

    def compose(self, tokens: np.ndarray) -> np.ndarray:
        """Tokens of each text, from those of each listed pretoken."""
        m = len(self.exit)
        shared, own = self.slot < 0, self.slot >= 0
        total = np.bincount(self.slot[own], tokens[own], 8 * m).reshape(m, 8) + np.bincount(-1 - self.slot[shared], tokens[shared], m)[:, None]
        total, to, gap = total.astype(np.int64), self.exit.astype(np.int64), 1
        while gap < m:  # inclusive scan: the map of pieces 0..i is that of 0..i - gap, then that of the next gap pieces
            then, more = np.take_along_axis(to[gap:], to[:-gap], axis=1), np.take_along_axis(total[gap:], to[:-gap], axis=1)
            total = np.concatenate([total[:gap], total[:-gap] + more])
            to, gap = np.concatenate([to[:gap], then]), gap * 2
        done = np.concatenate([[0], total[:, Q_NEW]])
        at = np.concatenate([[0], np.cumsum(self.pieces)])
        return done[at[1:]] - done[at[:-1]]


#: Pretokens of more bytes go by blocks of so many, and so many maps of blocks are kept.
LONG, BLOCK, KEPT_BLOCKS = 256, 64, 100_000


class Merger:
    """The lazily compiled transducer of one byte-level BPE file. `most_states` bounds its memory: beyond it, it starts anew between chunks."""

    def __init__(self, path: str, most_states: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = tuple(t["content"] for t in spec["added_tokens"])
        back = P.byte_alphabet()
        self.ids = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.of = {i: t for t, i in self.ids.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = bytes(back[c] for c in a), bytes(back[c] for c in b)
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for text, i in self.ids.items():
            node = 0
            for b in text:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                node = self.trie[node][b]
            self.token[node] = i
        self.most_states = most_states
        self.fits: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.column = np.full(256, -1, np.int16)
        self.next = np.full((1024, 16), -1, np.int32)
        self.emit = np.zeros((1024, 16), np.int8)
        self.blocks: dict[tuple[int, bytes], tuple[int, int]] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        self._state(((0, -1, 0),))

    def _state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            if len(self.states) > len(self.next):
                self.next = np.vstack([self.next, np.full_like(self.next, -1)])
                self.emit = np.vstack([self.emit, np.zeros_like(self.emit)])
        return self.number[key]

    def merge(self, ids: list[int]) -> list[int]:
        """Plain BPE: the leftmost pair of lowest rank first."""
        ids = list(ids)
        while len(ids) > 1:
            best = min(((self.ranks[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.ranks), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.ranks[ids[k], ids[k + 1]][1]]
        return ids

    def _fits(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of its own text."""
        if a < 0:
            return True
        key = a << 20 | b
        if key not in self.fits:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = (a, b) not in self.ranks and self.merge([self.ids[bytes((x,))] for x in self.of[a] + self.of[b]]) == [a, b]
        return self.fits[key]

    def _compile(self, state: int, byte: int) -> None:
        live, last, count = [], -1, 0
        for node, ended, behind in self.states[state]:
            to = self.trie[node].get(byte)
            if to is None:
                continue
            if last < 0 and self.token[to] >= 0 and self._fits(ended, self.token[to]):
                last, count = self.token[to], behind + 1
            if self.trie[to]:
                live.append((to, ended, behind))
        assert last >= 0, "no token ends here"
        key = (*((to, ended, behind - count) for to, ended, behind in live), (0, last, 0))
        if self.column[byte] < 0:
            self.column[byte] = self.column.max() + 1
            if self.column[byte] >= self.next.shape[1]:
                self.next = np.hstack([self.next, np.full_like(self.next, -1)])
                self.emit = np.hstack([self.emit, np.zeros_like(self.emit)])
        to = self._state(key)
        self.next[state, self.column[byte]] = to
        self.emit[state, self.column[byte]] = count

    def _block(self, state: int, block: bytes) -> tuple[int, int]:
        """The state after a block of bytes and the tokens that it adds."""
        total = 0
        for byte in block:
            move = self.moves.get(state << 8 | byte)
            if move is None:
                if self.column[byte] < 0 or self.next[state, self.column[byte]] < 0:
                    self._compile(state, byte)
                column = self.column[byte]
                move = self.moves[state << 8 | byte] = (int(self.next[state, column]), int(self.emit[state, column]))
            state = move[0]
            total += move[1]
        return state, total

    def long_count(self, raw: bytes) -> int:
        """Token count of one long pretoken, block by block."""
        state, total = 0, 0
        for k in range(0, len(raw), BLOCK):
            if len(self.states) > self.most_states:  # anew, from the state reached
                key = self.states[state]
                self._reset()
                state = self._state(key)
            block = raw[k : k + BLOCK]
            found = self.blocks.get((state, block))
            if found is None:
                if len(self.blocks) >= KEPT_BLOCKS:
                    self.blocks.clear()
                found = self.blocks[state, block] = self._block(state, block)
            state, total = found[0], total + found[1]
        return total

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token count of each pretoken data[starts:ends]."""
        if len(self.states) > self.most_states:
            self._reset()
        lengths = ends - starts
        long = np.flatnonzero(lengths > LONG)
        if len(long):
            out, short = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths <= LONG)
            out[short] = self.counts(data, starts[short], ends[short])
            out[long] = [self.long_count(data[a:b].tobytes()) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
            return out
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
        state, total = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        for step, n in enumerate(active):
            byte = data[at[:n] + step]
            while True:
                column = self.column[byte]
                to = np.where(column < 0, -1, self.next[state[:n], column])
                missing = to < 0
                if not missing.any():
                    break
                for pair in np.unique(state[:n][missing].astype(np.int64) << 8 | byte[missing]):
                    self._compile(int(pair >> 8), int(pair & 255))
            total[:n] += self.emit[state[:n], column]
            state[:n] = to
        out = np.empty(len(at), np.int64)
        out[order] = total
        return out


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    """One machine for each Python worker and file; it lives as long as the worker."""
    return Merger(path)
