"""Adaptive context-mixing range coder for token ids (operator 8).

A *segment* is a run of whole documents: a header (document lengths, the ids in use and their frequencies) and blocks of
BLOCK ids. Each block starts from fresh contexts and weights, is coded apart and carries the CRC-32 of its ids, so
that a damaged block is found and does not spoil others. The header has a CRC-32 of its own; a copy of it may be kept beside the
segment. Blocks step together, one id at a time, as numpy lanes.

Prediction: order-2 and order-1 contexts (hashed into per-block tables) each name one id and a
confidence; the block's weights say, for each pair of confidences, how often each order's guess comes true. All of
these adapt as the block goes on. What the guesses leave goes to the segment's id frequencies (order 0), and an id takes the
mixture's interval: cum(id) = w2*[p2 < id] + w1*[p1 < id] + w0*C0(id), its width likewise.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, SLOT_BITS, LANES = 2048, 9, 4096
_MAGIC = b"CMR3"
#: The coder's numbers have 52 bits, so that they are exact as doubles; when a span has no more than 28, a word of 24 is settled.
_WINDOW, _WORD, _LOW = 52, 24, 28
_SHORT = _BELOW = (1 << _LOW) - 1
#: Symbols whose intervals an encoder works out at once.
_TOGETHER = 1 << 15
_HASH, _SHIFT, _ONE = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)), np.uint32(32 - SLOT_BITS), np.uint32(1)
#: Rates are fractions of 2^15; at first, by confidence 0 to 3. They move by 1 / 2^SPEED of the error.
_RATE, SPEED = 15, 5
_FIRST_RATES = (0, 4_000, 14_000, 24_000)
#: The bits of both halves of a pair of rates that are left by a shift of SPEED.
_HALVES = np.uint32(0x10001 * (0xFFFF >> SPEED))


def _order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(distinct ids, widths that add up to 2^bits, bits) of the order-0 distribution; each id has 1 at least."""
    have, n = np.unique(ids, return_counts=True)
    bits = max(17, len(have).bit_length() + 1)
    if bits > 24:
        raise ValueError("a segment holds less than 2^23 distinct ids")
    if not len(ids):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), bits
    width = 1 + (n * ((1 << bits) - len(have)) // n.sum()).astype(np.int64)
    width[np.argmax(width)] += (1 << bits) - width.sum()
    return have, width, bits


def _places(have: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The place in `have` of each id: from a table, unless that had to be large."""
    if not len(have) or have[-1] >= 1 << 24:
        return np.searchsorted(have, ids).astype(np.int32)
    place = np.zeros(int(have[-1]) + 1, np.int32)
    place[have] = np.arange(len(have), dtype=np.int32)
    return place[ids]


class _Model:
    """Contexts and weights of many blocks at once, over the order-0 table of their segment.

    A table entry is the symbol that a context named last (shifted) and a confidence of 0 to 3. Arrays of both orders have
    the shape (2, lanes), or (steps, 2, lanes): order 1, then order 2. The two rates of a pair of confidences are halves of one number.
    """

    def __init__(self, lanes: int, width: np.ndarray):
        bits = int(width.sum()).bit_length() - 1 if len(width) else 17
        self.low_bits, self.bits = bits, max(24, bits + 4)
        self.total = np.int32(1 << self.bits)
        #: Guesses get 7/8 of the total at most.
        self.unit = np.int32(7 << (self.bits - _RATE - 3))
        self.width = width.astype(np.int32)
        self.end = np.cumsum(width).astype(np.int32)
        self.start = self.end - self.width
        #: Short entries where they hold all symbols: the tables are read at random.
        self.kind = np.dtype(np.uint16 if len(width) <= 1 << 14 else np.uint32)
        self.base = (np.arange(2 * lanes) << SLOT_BITS).reshape(2, lanes)
        self.tables = np.zeros(2 * lanes << SLOT_BITS, self.kind)
        #: The two symbols before, the older one first; one more than their numbers.
        self.past = np.zeros((2, lanes), np.uint32)
        pair = np.arange(16)
        rates = np.array(_FIRST_RATES, np.uint32)
        self.pairs = np.arange(lanes) << 4
        self.rates = np.tile(rates[pair & 3] | rates[pair >> 2] << 16, lanes)

    def symbols(self) -> np.ndarray:
        """For decoding: the symbol at each place of order 0."""
        return np.repeat(np.arange(len(self.width), dtype=self.kind), self.width)

    def _slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Places in the tables of the contexts of the symbols before (one) and before those (two)."""
        n = one.shape[-1]
        slots = np.empty((*one.shape[:-1], 2, n), np.int64)
        h = one * _HASH[0]
        np.add(h >> _SHIFT, self.base[0, :n], out=slots[..., 0, :])
        h += two * _HASH[1]
        np.add(h >> _SHIFT, self.base[1, :n], out=slots[..., 1, :])
        return slots

    def _learn(self, slots: np.ndarray, e: np.ndarray, hit: np.ndarray, shifted: np.ndarray) -> None:
        """Entries after a symbol: a guess that came true gains confidence; one that did not loses it, or gives way. hit: 0 or 1."""
        after = np.minimum(e + (hit << 1) - 1, e | 3)
        keep = -(hit | ((e >> 1) & 1))
        fresh = shifted | 1
        after ^= fresh
        after &= keep
        after ^= fresh
        self.tables[slots] = after

    def _weights(self, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights w1, w2 of the guesses and the factor m of order 0."""
        r1, r2 = (rates & 0xFFFF).view(np.int32), (rates >> 16).view(np.int32)
        w1 = (((1 << _RATE) - r2) * r1 >> _RATE) * self.unit
        rest = self.total - w1
        m = (rest - r2 * self.unit) >> self.low_bits
        return w1, rest - (m << self.low_bits), m

    def intervals(self, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of symbols (steps, lanes), learned on the way; only tables and rates go step by step."""
        k, n = steps.shape
        past = np.concatenate([self.past[:, :n], steps.astype(np.uint32) + _ONE])
        self.past[:, :n] = past[-2:]
        slots = self._slots(past[1:-1], past[:-2])
        shifted = steps.astype(self.kind) << 2
        e, hit, rates = np.empty((k, 2, n), self.kind), np.empty((k, 2, n), self.kind), np.empty((k, n), np.uint32)
        for i in range(k):
            self.tables.take(slots[i], out=e[i], mode="clip")
            np.less(e[i] ^ shifted[i], 4, out=hit[i], casting="unsafe")
            self._learn(slots[i], e[i], hit[i], shifted[i])
        trust = e & 3
        pair = self.pairs[:n] + ((trust[:, 1] << 2) | trust[:, 0])
        gain = _gain(hit[:, 0], hit[:, 1])
        for i in range(k):
            self.rates.take(pair[i], out=rates[i], mode="clip")
            self.rates[pair[i]] = rates[i] - ((rates[i] >> SPEED) & _HALVES) + gain[i]
        w1, w2, m = self._weights(rates)
        # A guess of the symbol itself differs from it in the confidence alone.
        less = (e | 3) < shifted[:, None]
        at = steps.astype(np.int64)
        start = self.start.take(at) * m + w1 * less[:, 0] + w2 * less[:, 1]
        return start, self.width.take(at) * m + w1 * hit[:, 0] + w2 * hit[:, 1]

    def look(self, n: int) -> None:
        """Guesses of the next symbol and their weights."""
        self.n, self.slots = n, self._slots(self.past[1, :n], self.past[0, :n])
        self.e = self.tables.take(self.slots, mode="clip")
        self.guess, trust = self.e >> 2, self.e & 3
        self.pair = self.pairs[:n] + ((trust[1] << 2) | trust[0])
        self.r = self.rates.take(self.pair, mode="clip")
        self.w1, self.w2, self.m = self._weights(self.r)

    def find(self, target: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The symbol whose interval holds each target."""
        # Take off the weight of the guesses passed; a target inside a guess's own weight goes to the guess.
        last = self.end.take(self.guess, mode="clip") * self.m - 1
        last[1] += self.w1 * (self.guess[0] < self.guess[1])
        rest = np.maximum(target - self.w2, np.minimum(target, last[1]))
        rest = np.maximum(rest - self.w1, np.minimum(rest, last[0]))
        return symbols.take((rest / self.m).astype(np.int64), mode="clip")

    def learn(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the symbols found, which then are known to the contexts."""
        hit, less, at = (self.guess == s).astype(self.kind), self.guess < s, s.astype(np.int64)
        start = self.start.take(at) * self.m + self.w1 * less[0] + self.w2 * less[1]
        wide = self.width.take(at) * self.m + self.w1 * hit[0] + self.w2 * hit[1]
        self._learn(self.slots, self.e, hit, s << 2)
        self.rates[self.pair] = self.r - ((self.r >> SPEED) & _HALVES) + _gain(hit[0], hit[1])
        self.past[0, : self.n] = self.past[1, : self.n]
        np.add(s, _ONE, out=self.past[1, : self.n])
        return start, wide


def _gain(hit1: np.ndarray, hit2: np.ndarray) -> np.ndarray:
    """What guesses that came true add to the two halves of rates."""
    return (hit1.astype(np.uint32) << (_RATE - SPEED)) | (hit2.astype(np.uint32) << (_RATE - SPEED + 16))


def _active(lengths: np.ndarray) -> np.ndarray:
    """How many lanes (longest first) still have a symbol at each step."""
    return np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")


def encode_blocks(symbols: np.ndarray, width: np.ndarray, block: int = BLOCK, most: int = LANES) -> tuple[list[bytes], np.ndarray]:
    """(coded bytes, number of symbols) of each block; at most `most` blocks step together."""
    blobs, counts = [], []
    for first in range(0, len(symbols), block * most):
        own = symbols[first : first + block * most]
        lanes = -(-len(own) // block)
        lengths = np.full(lanes, block, np.int64)
        lengths[-1] = len(own) - block * (lanes - 1)
        steps = np.zeros((lanes, block), np.int32)
        steps.ravel()[: len(own)] = own
        steps = np.ascontiguousarray(steps.T)
        model = _Model(lanes, width)
        #: A step may settle a second word only if there are 2^19 distinct ids or more.
        turns = 1 if model.bits == 24 else 2
        low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << _WINDOW, np.int64)
        # Words of one time lie side by side; `at` is the place of each block's next.
        out = np.zeros((turns * block + 2) * lanes, np.int32)
        at = np.arange(lanes)
        few, t = max(1, _TOGETHER // lanes), 0
        for until, n in ((int(lengths[-1]), lanes), (block, lanes - 1)):
            low_n, span_n = low[:n], span[:n]
            while n and t < until:
                starts, wides = model.intervals(steps[t : min(t + few, until), :n])
                t += len(starts)
                for start, wide in zip(starts, wides):
                    unit = span_n >> model.bits
                    low_n += start * unit
                    np.multiply(wide, unit, out=span_n)
                    for _ in range(turns):
                        where = np.flatnonzero(span_n <= _SHORT)
                        settled, place = low_n.take(where), at.take(where)
                        out[place] = settled >> _LOW
                        at[where] = place + lanes
                        low_n[where] = (settled & _BELOW) << _WORD
                        span_n[where] = span_n.take(where) << _WORD
        # Two words more; whatever bits follow them, the number is inside the last span.
        flush = (low >> 4) + 1
        out[at] = flush >> _WORD
        out[at + lanes] = flush & ((1 << _WORD) - 1)
        count = at // lanes + 2
        out = out.reshape(-1, lanes)[: count.max()]
        while (carry := out >> _WORD).any():
            out &= (1 << _WORD) - 1
            out[:-1] += carry[1:]
        raw = np.ascontiguousarray(out.T.astype(">u4")).view(np.uint8).reshape(lanes, -1, 4)[:, :, 1:]
        blobs += [raw[i, :c].tobytes() for i, c in enumerate(count.tolist())]
        counts.append(lengths)
    return blobs, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def decode_blocks(blobs: list[bytes], lengths: np.ndarray, width: np.ndarray, most: int = LANES) -> np.ndarray:
    """Symbols of all blocks; lengths do not increase."""
    parts = [np.zeros(0, np.int32)]
    for first in range(0, len(blobs), most):
        own, sizes = blobs[first : first + most], lengths[first : first + most]
        lanes = len(own)
        model = _Model(lanes, width)
        turns = 1 if model.bits == 24 else 2
        symbols, active = model.symbols(), _active(sizes)
        # The words of all blocks one after another; a damaged block may read on, up to the zeros at the end.
        counts = np.fromiter(map(len, own), np.int64, lanes) // 3
        raw = np.frombuffer(b"".join([*(b[: n * 3] for b, n in zip(own, counts.tolist())), bytes(3 * (turns * len(active) + 4))]), np.uint8).reshape(-1, 3)
        words = (raw[:, 0].astype(np.int32) << 16) | (raw[:, 1].astype(np.int32) << 8) | raw[:, 2]
        # A number has 52 bits, two words and a part: from then on each read is across two words.
        over = _WINDOW - 2 * _WORD
        words[:-1] = ((words[:-1] << over) & ((1 << _WORD) - 1)) | (words[1:] >> (_WORD - over))
        del raw
        at = np.cumsum(counts) - counts
        firsts = np.fromiter((int.from_bytes(b[:6].ljust(6, b"\0"), "big") for b in own), np.int64, lanes)
        code = (firsts << over) | (words[at + 1] & ((1 << over) - 1))
        at += 2
        span = np.full(lanes, 1 << _WINDOW, np.int64)
        out = np.zeros((len(active), lanes), np.int32)
        for t, n in enumerate(active.tolist()):
            model.look(n)
            code_n, span_n = code[:n], span[:n]
            unit = span_n >> model.bits
            # Both are below 2^52, so that the quotient's whole part is exact (and any number in a damaged block).
            with np.errstate(invalid="ignore"):
                target = (code_n / unit).astype(np.int32)
            s = model.find(target, symbols)
            start, wide = model.learn(s)
            code_n -= start * unit
            np.multiply(wide, unit, out=span_n)
            for _ in range(turns):
                where = np.flatnonzero(span_n <= _SHORT)
                place = at.take(where)
                code_n[where] = (code_n.take(where) << _WORD) | words.take(place)
                span_n[where] = span_n.take(where) << _WORD
                at[where] = place + 1
            out[t, :n] = s
        parts.append(out.T[np.arange(len(active))[None, :] < sizes[:, None]])
    return np.concatenate(parts)


def encode_segment(docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment: `docs` (numbers that name them) and `sizes` (ids of each document), then all ids."""
    have, width, _ = _order0(ids)
    blobs, lengths = encode_blocks(_places(have, ids), width, block)
    wide = np.ascontiguousarray(ids.astype("<u4"))
    firsts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    sums = [zlib.crc32(wide[a:b]) for a, b in zip(firsts[:-1], firsts[1:])]
    head = zlib.compress(b"".join(np.asarray(x, k).tobytes() for x, k in ((docs, "<i8"), (sizes, "<u4"), (have, "<u4"), (width, "<u4"), (lengths, "<u4"), (list(map(len, blobs)), "<u4"), (sums, "<u4"))), 1)
    fixed = struct.pack("<4sIIIII", _MAGIC, len(docs), len(have), len(blobs), len(head), zlib.crc32(head))
    return b"".join([fixed, head, *blobs])


def header(blob: bytes) -> bytes:
    """The header of a segment, for a copy to be kept beside it."""
    return blob[: 24 + struct.unpack_from("<4sIIIII", blob)[4]]


def decode_segment(blob: bytes, spare: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(docs, sizes, ids); raises ValueError if a block is damaged, or the header and its copy (`spare`) are."""
    for start in (blob, spare):
        if start is not None and len(start) >= 24:
            magic, n_docs, n_ids, n_blocks, n_head, head_sum = struct.unpack_from("<4sIIIII", start)
            head, first = start[24 : 24 + n_head], 24 + n_head
            if magic == _MAGIC and zlib.crc32(head) == head_sum:
                break
    else:
        raise ValueError("damaged segment header")
    raw, at, fields = zlib.decompress(head), 0, []
    for n, kind in ((n_docs, "<i8"), (n_docs, "<u4"), (n_ids, "<u4"), (n_ids, "<u4"), (n_blocks, "<u4"), (n_blocks, "<u4"), (n_blocks, "<u4")):
        fields.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    docs, sizes, have, width, lengths, bytes_, sums = fields
    ends = first + np.cumsum(bytes_, dtype=np.int64)
    blobs = [blob[e - n : e] for e, n in zip(ends.tolist(), bytes_.tolist())]
    ids = have[decode_blocks(blobs, lengths.astype(np.int64), width.astype(np.int64))].astype("<u4") if n_blocks else np.zeros(0, "<u4")
    firsts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    for k, (a, b) in enumerate(zip(firsts[:-1], firsts[1:])):
        if zlib.crc32(np.ascontiguousarray(ids[a:b])) != sums[k]:
            raise ValueError(f"damaged block {k}")
    return docs, sizes, ids
