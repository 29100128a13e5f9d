"""Substring deduplication with suffix automata of reference shards (operator 6).

A reference shard is a bounded set of distinct passages of the corpus with, for each, the smallest document that has it. Its
suffix automaton marks every state with the smallest document of its occurrences, and passages streamed through it
get matching statistics: where the match is at least a window long, the state of that window tells whether
a smaller document has it. Sending every shard to every task would cost shards times corpus, so a passage
meets the one shard that can match it: the passages around one *anchor* go to one shard.

Anchors: of the 20-word hashes inside each 50-word window the smallest is picked, so that equal windows pick equal
anchors wherever they stand. An anchor that occurs in one document only needs no work. The *passage* of an anchor
is all words that a window around it can touch. If all documents have the same passage around an anchor, the smallest of them
has all its windows. Else the anchor's distinct passages go to a shard; an anchor with more of them than a small part of a shard has no
automaton: its passages are cut into their windows once, at most window - width + 1 each, and the smallest document of equal windows
is an aggregate. Hashes of words only pick anchors: automata run over the words themselves, and passages and windows are equal by
their BLAKE2b digests of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm import spans
from gaugeflow.llm.shared import release, stored

WINDOW, ANCHOR = 50, 20
#: Passages of one automaton, twice the usual number; the windows of an anchor with over an eighth of that meet by their own digests instead.
SHARD_PASSAGES = 2_000
#: A longer word stands in passages as its digest.
LONG_WORD = 256


def anchors(words: np.ndarray, first: np.ndarray, window: int = WINDOW, width: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(word positions of the anchors, their hashes) over the texts words[first[i]:first[i + 1]]."""
    gram = spans.windows(words, width)
    span = window - width + 1
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(owner[:n] == owner[window - 1 :])
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Leftmost least gram of each window, by doubling: best[i] is the least place of a run of grams from i on.
    best, run = np.arange(len(gram)), 1
    while run * 2 <= span:
        a, b = best[: len(best) - run], best[run:]
        best, run = np.where(gram[b] < gram[a], b, a), run * 2
    a, b = best[inside], best[inside + span - run]
    at = np.unique(np.where(gram[b] < gram[a], b, a))
    return at, gram[at]


def passage_bounds(at: np.ndarray, low: np.ndarray, high: np.ndarray, window: int = WINDOW, width: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Words that windows around the anchors at `at` can touch, inside texts low..high."""
    return np.maximum(at - (window - width), low), np.minimum(at + window, high)


def compact(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """(the words joined by one space, start and end of each); a word over LONG_WORD bytes is a line feed and its digest, which no word is."""
    size = ends - starts
    if len(size) and size.max() > LONG_WORD:
        raw = data.tobytes()
        words = [raw[a:b] if b - a <= LONG_WORD else b"\n" + blake2b(raw[a:b], digest_size=32).hexdigest().encode() for a, b in zip(starts.tolist(), ends.tolist())]
        size = np.array([len(w) for w in words], np.int64)
        joined = b" ".join(words)
    else:
        keep = np.zeros(len(data) + 1, np.int8)
        keep[starts] += 1
        # The byte after a word stays too, as the space.
        after = np.minimum(ends + 1, len(data))
        keep[after] -= 1
        inside = np.cumsum(keep[:-1], dtype=np.int8) > 0
        joined = np.where(spans._IS_SPACE[data], np.uint8(32), data)[inside]
        joined = joined.tobytes()
    first = np.cumsum(size + 1) - size - 1
    return joined, first.tolist(), (first + size).tolist()


def _anchor_rows(window: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in spans.chunks(batch, "text"):
                starts, ends, first = spans.words(data, offsets)
                at, gram = anchors(spans.word_hashes(data, starts, ends), first, window, width)
                owner = np.searchsorted(first, at, side="right") - 1
                low, high = passage_bounds(at, first[owner], first[owner + 1], window, width)
                # Texts end without a space, so that two texts' words may touch: each is joined on its own.
                digests, place = [], np.searchsorted(owner, np.arange(rows.num_rows + 1))
                for i in np.unique(owner).tolist():
                    a, b = first[i], first[i + 1]
                    joined, left, right = compact(data[offsets[i] : offsets[i + 1]], starts[a:b] - offsets[i], ends[a:b] - offsets[i])
                    part = slice(place[i], place[i + 1])
                    for x, y, z in zip((low[part] - a).tolist(), (high[part] - a).tolist(), (at[part] - low[part]).tolist()):
                        digests.append(blake2b(b"%d %s" % (z, joined[left[x] : right[y - 1]]), digest_size=16).digest())
                passage = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                keys = [rows.column(c).take(pa.array(owner)) for c in ("doc_id", "row_key")]
                own = [(at - first[owner]).astype(np.int32), (high - low).astype(np.int32), gram.view(np.int64), passage[:, 0], passage[:, 1]]
                yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, own)], names=["doc_id", "row_key", "pos", "size", "anchor", "p1", "p2"])

    return run


def _passage_words(window: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("least", pa.int64()), ("words", pa.binary())])
        for batch in batches:
            for rows, data, offsets in spans.chunks(batch, "text"):
                starts, ends, first = spans.words(data, offsets)
                out = {n: [] for n in schema.names}
                for i, (doc, wanted) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("wanted").to_pylist())):
                    a, b = int(first[i]), int(first[i + 1])
                    joined, left, right = compact(data[offsets[i] : offsets[i + 1]], starts[a:b] - offsets[i], ends[a:b] - offsets[i])
                    for w in wanted:
                        low, high = max(w["pos"] - (window - width), 0), min(w["pos"] + window, b - a)
                        for n in ("anchor", "p1", "p2"):
                            out[n].append(w[n])
                        out["least"].append(doc)
                        out["words"].append(joined[left[low] : right[high - 1]])
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


class SuffixAutomaton:
    """Suffix automaton of several word sequences; each state knows the smallest document of its occurrences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 63]

    def _new(self, length: int, to: dict[int, int], link: int) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        self.least.append(1 << 63)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A state for the longest string of p followed by word, cut off q."""
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], doc: int) -> None:
        last = 0
        for word in words:
            p, q = last, self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            else:
                last = self._new(self.length[p] + 1, {}, 0)
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            if doc < self.least[last]:
                self.least[last] = doc

    def finish(self) -> None:
        """Passes the smallest documents down the suffix links, longest states first."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            if self.least[s] < self.least[p]:
                self.least[p] = self.least[s]

    def least_documents(self, words: list[int], window: int) -> list[int]:
        """For each window of the sequence, the smallest document with it (2^63 - 1: none), by matching statistics."""
        state = matched = 0
        out = []
        for k, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            to = self.next[state].get(word)
            if to is not None:
                state, matched = to, matched + 1
            if k + 1 >= window:
                if matched < window:
                    out.append((1 << 63) - 1)
                else:
                    while self.length[self.link[state]] >= window:
                        state = self.link[state]
                        matched = self.length[state]
                    out.append(self.least[state])
        return out


def _search(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        automaton, known = SuffixAutomaton(), {}
        words = [[known.setdefault(x, len(known)) for x in w.split(b" ")] for w in pdf["words"]]
        for own, doc in zip(words, pdf["least"]):
            automaton.add(own, doc)
        automaton.finish()
        pdf = pdf[["anchor", "p1", "p2"]]
        return pdf.assign(least=[automaton.least_documents(w, window) for w in words])

    return run


def _window_rows(window: int):
    """The windows of each passage: their place in it, digest and the passage's smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, digests = [], [], []
            for i, words in enumerate(batch.column("words").to_pylist()):
                spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
                left, right = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(words)]
                n = max(len(left) - window + 1, 0)
                owner += [i] * n
                place += range(n)
                digests += [blake2b(words[left[k] : right[k + window - 1]], digest_size=16).digest() for k in range(n)]
            hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            names = ["anchor", "p1", "p2", "least"]
            keys = [batch.column(c).take(pa.array(owner, pa.int64())) for c in names]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(place, pa.int32()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], names=[*names, "place", "h1", "h2"])

    return run


def _keep(window: int):
    """Rows with the words that no covered window touches."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in spans.chunks(batch, "text"):
                starts, ends, first = spans.words(data, offsets)
                raw = data.tobytes()
                removed, kept = [], []
                for i, hits in enumerate(rows.column("starts").to_pylist()):
                    a, b = int(first[i]), int(first[i + 1])
                    stay = np.ones(b - a, bool)
                    if hits:
                        depth = np.zeros(b - a + 1, np.int64)
                        hits = np.unique(np.asarray(hits))
                        np.add.at(depth, hits, 1)
                        np.add.at(depth, hits + window, -1)
                        stay = np.cumsum(depth)[:-1] == 0
                    removed.append(int((~stay).sum()))
                    s, e = starts[a:b][stay].tolist(), ends[a:b][stay].tolist()
                    kept.append(b" ".join([raw[x:y] for x, y in zip(s, e)]))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() for k in kept], pa.string())], names=names
                )

    return run


def covered_windows(docs: DataFrame, window: int = WINDOW, width: int = ANCHOR, shard: int = SHARD_PASSAGES) -> DataFrame:
    """(doc_id, row_key, starts): word positions where a window of the row starts that a smaller doc_id also has; docs: doc_id, row_key, text."""
    passage = ["anchor", "p1", "p2"]
    ddl = "anchor bigint, p1 bigint, p2 bigint"
    places = docs.where("doc_id is not null").mapInArrow(_anchor_rows(window, width), f"doc_id bigint, row_key bigint, pos int, size int, {ddl}")
    every = stored(places, "anchors")
    shared = every.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("anchor")
    # Written down, so that a hot anchor's rows can be split over tasks in the join: an aggregate beside it would hold them together.
    shared = stored(shared, "shared")
    places = stored(every.join(shared, "anchor", "left_semi"), "places")
    release(every)  # the largest table by far
    passages = stored(places.groupBy(*passage).agg(F.min(F.struct("doc_id", "row_key", "pos")).alias("f")), "passages")
    most = max(1, shard // 8)
    counts = stored(passages.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), "counts")
    # A passage's first document has all its windows; if it is the only passage of the anchor, there is nothing else to be matched.
    alone = passages.join(counts.where((F.col("n") == 1) | (F.col("n") > most)).select("anchor"), "anchor").select(*passage, F.col("f.doc_id").alias("first"))
    several = passages.join(counts.where("n > 1"), "anchor")
    wanted = several.groupBy("f.doc_id", "f.row_key").agg(F.collect_list(F.struct(F.col("f.pos").alias("pos"), *passage)).alias("wanted"))
    texts = docs.join(wanted, ["doc_id", "row_key"]).select("doc_id", "text", "wanted").dropDuplicates(["doc_id", "wanted"])
    words = stored(texts.mapInArrow(_passage_words(window, width), f"{ddl}, least bigint, words binary"), "words")
    large = stored(counts.where(F.col("n") > most).select("anchor"), "large")
    shards = max(1, -(-2 * words.count() // shard))
    # A shard has many small anchors, whole.
    dealt = words.join(large, "anchor", "left_anti").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = dealt.select("shard", *passage, "least", "words").groupBy("shard").applyInPandas(_search(window), f"{ddl}, least array<bigint>")
    cut = words.join(large, "anchor", "left_semi").select(*passage, "least", "words")
    cut = stored(cut.mapInArrow(_window_rows(window), f"{ddl}, least bigint, place int, h1 bigint, h2 bigint"), "windows")
    # Of a large anchor's windows only those come back that another passage of a smaller document has too.
    least = stored(cut.groupBy("h1", "h2").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last").drop("last"), "least")
    earlier = cut.join(least, ["h1", "h2"]).where("first < least").groupBy(*passage).agg(F.collect_list(F.struct("place", "first")).alias("earlier"))
    found, earlier = stored(found, "found"), stored(earlier, "earlier")
    first_window = F.greatest(F.col("pos") - (window - width), F.lit(0))
    row = ["doc_id", "row_key"]
    hits = places.join(found, passage).where(F.array_min("least") < F.col("doc_id"))
    starts = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), first_window + i)), lambda x: x.isNotNull())
    hits = hits.select(*row, starts.alias("starts"))
    some = F.transform(F.filter("earlier", lambda x: x["first"] < F.col("doc_id")), lambda x: first_window + x["place"])
    hits = hits.unionByName(places.join(earlier, passage).select(*row, some.alias("starts")))
    whole = places.join(stored(alone, "alone"), passage).where((F.col("first") < F.col("doc_id")) & (F.col("size") >= window))
    whole = whole.select(*row, F.sequence(first_window, first_window + F.col("size") - window).alias("starts"))
    return hits.unionByName(whole).groupBy(*row).agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words of `text` taken out: a text that loses words becomes its kept words, joined by a space; others stay as they are.

    Needs doc_id and text; all columns, whatever their names, are returned, and n_chars, if there is one, is counted anew where words went. Null texts stay null.
    """
    names, schema = docs.columns, docs.schema
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    hits = covered_windows(keyed.select("doc_id", "row_key", "text"), window)
    joined = keyed.drop("text").join(hits, ["doc_id", "row_key"], "left").select("row", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = dict(zip(names, batch.column("row").flatten()))
            texts, sizes = out["text"].to_pylist(), out["n_chars"].to_pylist() if "n_chars" in out else None
            for i, hits in enumerate(batch.column("starts").to_pylist()):
                if hits:
                    raw = texts[i].encode()
                    a, b, _ = spans.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    depth = np.zeros(len(a) + 1, np.int64)
                    hits = np.unique(np.asarray(hits))
                    depth[hits] += 1
                    depth[hits + window] -= 1
                    stay = np.cumsum(depth)[:-1] == 0
                    texts[i] = b" ".join([raw[x:y] for x, y in zip(a[stay].tolist(), b[stay].tolist())]).decode()
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            out["text"] = pa.array(texts, pa.string())
            if sizes is not None:
                out["n_chars"] = pa.array(sizes, out["n_chars"].type)
            yield pa.RecordBatch.from_pydict(out)

    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (kept words, joined by a space) of each (doc_id, text).

    Null and empty texts have no words. A row with a null doc_id is neither smaller nor larger than another and stays whole. Rows that
    repeat a doc_id do not remove each other's words. Other columns are ignored. An empty table gives no rows.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    hits = covered_windows(keyed, window)
    return keyed.join(hits, ["doc_id", "row_key"], "left").select("doc_id", "text", "starts").mapInArrow(_keep(window), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
