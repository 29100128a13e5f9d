"""Pretoken spans of the two public vocabularies, over whole chunks of code points.

A chunk of texts is classed once per code point (letter, number, white space, other),
and the published split patterns become rules on neighbouring classes.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import regex

#: Code point classes.
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    points = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        found = regex.findall(pattern, every)
        table[np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)] = kind
    # Python's \s also takes four separators (0x1C-0x1F) that the White_Space property leaves out.
    table[0x1C:0x20] = OTHER
    table[0x20] = SPACE
    del points
    return table


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of texts one after another."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def byte_widths(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def contractions(points: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Letters that follow an apostrophe in 's 't 'm 'd (1) or 're 've 'll (2), else 0; edge: a text starts here."""
    n = len(points)
    out = np.zeros(n, np.int8)
    at = np.flatnonzero(points == 39)
    at = at[at + 1 < n]
    at = at[~edge[at + 1]]
    one = points[at + 1]
    out[at[np.isin(one, (115, 116, 109, 100))]] = 1
    two = at[at + 2 < n]
    two = two[~edge[two + 2]]
    a, b = points[two + 1], points[two + 2]
    out[two[((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)]] = 2
    return out


def edges(offsets: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n, bool)
    edge[offsets[offsets < n]] = True
    return edge


def byte_level_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pretokens of 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ start (flags)."""
    n = len(points)
    if n == 0:
        return np.zeros(0, bool)
    kind = _classes()[points]
    edge = edges(offsets, n)
    white = kind >= SPACE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[edge] = 255
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = ~white[1:] & ~edge[1:]
    start = white & ((before < SPACE) | (before == 255) | solid_next) | ~white & (before != kind) & (before != SPACE)
    two = contractions(points, edge)
    at = np.flatnonzero((two > 0) & start)
    two = two[at]
    start[at + 1] = False
    after = at + 1 + two
    ok = (after < n)
    after = after[ok]
    start[after[~white[after]]] = True
    start[edge] = True
    return start


def word_level_spans(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in code points) of 's|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+; white space is dropped."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _classes()[points]
    edge = edges(offsets, n)
    white = kind >= SPACE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    before[edge] = 255
    start = ~white & ((before != kind) | (kind == NUMBER))
    two = contractions(points, edge)
    at = np.flatnonzero((two > 0) & start)
    two = two[at]
    start[at + 1] = False
    after = at + 1 + two
    after = after[after < n]
    start[after[~white[after]]] = True
    cut = start | white | edge
    starts = np.flatnonzero(start)
    stops = np.append(np.flatnonzero(cut), n)
    return starts, stops[np.searchsorted(stops, starts, side="right")]


def normalized_all(texts: list[str], exact) -> list[str]:
    """Texts as the word vocabulary's normalizer gives them (`exact`: the library's own), but for white space, which is dropped later.

    Below U+0250, composed text needs lower-casing alone; the capital I with a dot is the one letter there that grows.
    """
    plain = all(map(str.isascii, texts)) or np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).max(initial=0) < 0x250
    return [t.lower() if t.isascii() or plain and "İ" not in t and unicodedata.is_normalized("NFC", t) else exact(t) for t in texts]


def split_special(text: str, specials: tuple[str, ...]) -> list[tuple[str, str | None]]:
    """(plain part, special string that follows or None), as added tokens are cut out of a text: leftmost first."""
    if not any(s in text for s in specials):
        return [(text, None)]
    parts = regex.split("(" + "|".join(map(regex.escape, specials)) + ")", text)
    return [(parts[i], parts[i + 1] if i + 1 < len(parts) else None) for i in range(0, len(parts), 2)]


def byte_alphabet() -> dict[str, int]:
    """The published byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
