"""Alignment of two tokenizers' tokens by byte spans (operator 13).

A is a byte-level BPE file of the tokenizers library, read over a space and the text; B is a SentencePiece model, which puts that
space there itself. Both libraries give spans: A's character offsets and B's spans are coarse cuts, exact where a token ends
with a character. Inside a character of several bytes (byte-level tokens share one character's offsets, byte-fallback tokens before the last
have empty spans) the bytes that the tokens decode to say where each ends. Offsets where a token of A and one of B end
together cut the text into *groups*; every pair of an A and a B token of a group is a *link*.

A text is first cut where a pretoken of A starts and the two characters around are neighbours in no piece of B: no token of either
crosses such a place, and what stands between two of them (a *segment*) has the same tokens anywhere. So the libraries see each distinct
segment once in a worker.

How many documents hold a link is counted over the corpus. Texts are read once, in blocks of several MB: a block is a row that
holds its distinct links, with the number of its documents that have each, and each document's links as numbers of
these. What is shuffled is one row for each block and distinct link, not for each document and link; the counts come back to the block
the same way. A link that every document has is one row in each block, so there is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm import pretokens as P
from gaugeflow.llm import spans
from gaugeflow.llm.piecebpe import PieceBPE
from gaugeflow.llm.shared import stored
from gaugeflow.llm.wordcache import WordTable

#: Bytes of text of one block (a longer text is a block of its own), and distinct segments that a worker keeps.
BLOCK_BYTES, KEPT_SEGMENTS = 4 << 20, 200_000

#: Segments that the libraries see at once (their tokens as objects take a kilobyte a segment), and blocks of one stored file: Spark reads
#: and writes a file's rows, of some MB each, thousands at a time.
SEGMENTS_AT_ONCE, FILE_BLOCKS = 2000, 8


#: Stands before a segment when B reads it: it is in no piece, so that the dummy prefix stays apart.
FENCE = "\n"


class SpanAligner:
    """Tokens of single segments (UTF-8) and their groups."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        back = P.byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_a[i] = bytes([back[c] for c in t])
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        model = PieceBPE(path_b)
        self.bytes_b, self.fallback = model.shown, model.is_byte.tolist()
        if FENCE in model.symbols:
            raise ValueError("B has a piece with a line end")
        self.neighbours = model.neighbours()

    def meets(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether code points may stand side by side in a piece of B."""
        key = before.astype(np.int64) << 21 | after
        return self.neighbours[np.minimum(np.searchsorted(self.neighbours, key), len(self.neighbours) - 1)] == key

    def tokens_a(self, text: str, encoding) -> tuple[list[int], list[int]]:
        """(ids, byte offsets of the ends)."""
        ids, offsets = encoding.ids, encoding.offsets
        if text.isascii():
            return ids, [end for _, end in offsets]
        coarse = [0]
        for c in text:
            coarse.append(coarse[-1] + len(c.encode()))
        ends, at = [], 0
        for k, (i, (_, end)) in enumerate(zip(ids, offsets)):
            # A character that the next token shares ends later: the token's bytes say where it ends.
            at = at + len(self.bytes_a[i]) if k + 1 < len(ids) and offsets[k + 1][0] < end else coarse[end]
            ends.append(at)
        return ids, ends

    def tokens_b(self, proto) -> tuple[list[int], list[int]]:
        """(ids, byte offsets of the ends) of what follows the dummy prefix and the fence."""
        ids, ends, at = [], [], 0
        for p in proto.pieces[2:]:
            ids.append(p.id)
            # Byte tokens of one character stand at its start, but for the last: their bytes say where they end.
            at = at + 1 if self.fallback[p.id] else p.end - 1
            ends.append(at)
        return ids, ends

    def __call__(self, segments: list[bytes]) -> list[list[int]]:
        """For each segment: number of groups, then each group's numbers of A and B tokens and their ids. No groups where the bytes of the tokens are not the segment's."""
        out = []
        for at in range(0, len(segments), SEGMENTS_AT_ONCE):
            out += self._groups(segments[at : at + SEGMENTS_AT_ONCE])
        return out

    def _groups(self, segments: list[bytes]) -> list[list[int]]:
        texts = [s.decode() for s in segments]
        found_a = self.a.encode_batch(texts, add_special_tokens=False)
        found_b = self.b.encode([FENCE + t for t in texts], return_type="proto", num_threads=1)
        bytes_a, bytes_b, out = self.bytes_a, self.bytes_b, []
        for raw, text, of_a, of_b in zip(segments, texts, found_a, found_b):
            ids_a, ends_a = self.tokens_a(text, of_a)
            ids_b, ends_b = self.tokens_b(of_b)
            if b"".join([bytes_a[i] for i in ids_a]) != raw or b"".join([bytes_b[i] for i in ids_b]) != raw:
                out.append([0])
                continue
            own, j, first, start = [0], 0, 0, 0
            for k, end in enumerate(ends_a, 1):
                while ends_b[j] < end:
                    j += 1
                if ends_b[j] == end:
                    j += 1
                    own[0] += 1
                    own += (k - first, j - start)
                    own += ids_a[first:k]
                    own += ids_b[start:j]
                    first, start = k, j
            out.append(own)
        return out


class Aligner:
    """Whole texts -> tokens, groups and links, by distinct segments."""

    def __init__(self, path_a: str, path_b: str, most: int = KEPT_SEGMENTS):
        self.pairs = SpanAligner(path_a, path_b)
        self.table = WordTable(self.pairs, most)
        self.decimal = list(map(str, range(max(len(self.pairs.bytes_a), len(self.pairs.bytes_b)))))
        self._fresh()

    def _fresh(self) -> None:
        self.generation = self.table.generation
        self.sizes = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links of each kept segment
        self.links, self.bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)  # A id << 32 | B id
        self.shown: list[bytes] = []

    def _derive(self) -> None:
        """Brings up to date what is derived from each kept segment's groups."""
        t = self.table
        if self.generation != t.generation:
            self._fresh()
        known = len(self.shown)
        flat, at = t.flat[t.bounds[known] :].tolist(), (t.bounds[known:] - t.bounds[known]).tolist()
        links, sizes, count, decimal = [], [], [], self.decimal
        for begin in at[:-1]:
            groups, i, texts, of_a, of_b, of_both = flat[begin], begin + 1, [], 0, 0, 0
            for _ in range(groups):
                na, nb = flat[i], flat[i + 1]
                i += 2
                if na == nb == 1:
                    a, b = flat[i], flat[i + 1]
                    links.append(a << 32 | b)
                    texts.append(f"{decimal[a]}|{decimal[b]}")
                else:
                    a, b = flat[i : i + na], flat[i + na : i + na + nb]
                    links += [x << 32 | y for x in a for y in b]
                    texts.append(",".join([decimal[x] for x in a]) + "|" + ",".join([decimal[y] for y in b]))
                of_a, of_b, of_both, i = of_a + na, of_b + nb, of_both + na * nb, i + na + nb
            self.shown.append(";".join(texts).encode())
            sizes.append((of_a, of_b, groups, of_both))
            count.append(of_both)
        if sizes:
            self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64)])
            self.links = np.concatenate([self.links, np.array(links, np.int64)])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(count)])

    def segments(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(places of all segments, segments before each text)."""
        spaced = [" " + t if t else "" for t in texts]
        points, offsets = P.code_points(spaced)
        start = P.byte_level_starts(points, offsets)
        starts = np.flatnonzero(start)
        edge = P.edges(offsets, len(points))[starts]
        inner = starts[~edge]
        apart = edge.copy()
        apart[~edge] = ~self.pairs.meets(points[inner - 1], points[inner])
        starts = starts[apart]
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(P.byte_widths(points), out=at[1:])
        data = np.frombuffer("".join(spaced).encode(), np.uint8)
        begins = at[starts]
        return self.table.find(data, begins, np.append(begins[1:], len(data)) if len(begins) else begins), np.searchsorted(starts, offsets)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(A tokens, B tokens, groups and links of each text, SHA-256 of its groups or '', the links of all texts, bounds of each text's)."""
        place, first = self.segments(texts)
        self._derive()
        own = self.sizes[place]
        total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(own, axis=0)])
        out = total[first[1:]] - total[first[:-1]]
        # A text with a segment whose tokens do not spell it has no tokens at all.
        broken = np.concatenate([[0], np.cumsum(own[:, 2] == 0)])
        fine = (broken[first[1:]] == broken[first[:-1]]) & (out[:, 2] > 0)
        out[~fine] = 0
        order, digests = place.tolist(), []
        for a, b, ok in zip(first[:-1].tolist(), first[1:].tolist(), fine.tolist()):
            digests.append(hashlib.sha256(b";".join([self.shown[k] for k in order[a:b]])).hexdigest() if ok else "")
        place = place[np.repeat(fine, np.diff(first))]
        size = self.bounds[place + 1] - self.bounds[place]
        stop = np.cumsum(size)
        take = np.repeat(self.bounds[place] - (stop - size), size) + np.arange(int(size.sum()))
        return out, digests, self.links[take], np.concatenate([[0], np.cumsum(out[:, 3])])


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for each Python worker and pair of files."""
    return Aligner(path_a, path_b)


_BLOCK = "block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, size array<int>, link binary, times binary, pairs array<bigint>, docs array<int>, n_pairs int"


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the fewest bytes that hold them all, after a byte that says how many: Spark carries them as they are."""
    width = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _blocks(path_a: str, path_b: str, block_bytes: int):
    """Texts -> blocks: each document's figures, its distinct links as numbers of the block's (size of them each, link, times), the block's distinct links and how many of its documents have each."""

    def row(parts: list, number: int) -> pa.RecordBatch:
        ids, sizes, digests, links, bounds = (list(x) for x in zip(*parts))
        sizes, links = np.concatenate(sizes), np.concatenate(links)
        digests = [d for part in digests for d in part]
        ids = [i for part in ids for i in part]
        owner = np.repeat(np.arange(len(sizes)), sizes[:, 3])
        pairs, link = np.unique(links, return_inverse=True)
        key, times = np.unique(owner.astype(np.int64) << 32 | link, return_counts=True)
        link = key & 0xFFFFFFFF
        own = {
            "block": number, "doc_id": ids, **{c: sizes[:, k] for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, "groups_sha256": digests,
            "size": np.bincount(key >> 32, minlength=len(sizes)), "link": _packed(link), "times": _packed(times), "pairs": pairs, "docs": np.bincount(link, minlength=len(pairs)), "n_pairs": len(pairs),
        }
        kinds = {"block": pa.int64(), "n_pairs": pa.int32(), "link": pa.binary(), "times": pa.binary(), "groups_sha256": pa.list_(pa.string()), **{c: pa.list_(pa.int32()) for c in ("size", "docs")}}
        return pa.RecordBatch.from_pydict({c: pa.array([x], kinds.get(c, pa.list_(pa.int64()))) for c, x in own.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers of blocks are unique in one run, and fixed once the blocks are stored.
        number, size, parts = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            for rows, data, _ in spans.chunks(batch, "text"):
                if parts and size + len(data) > block_bytes:
                    yield row(parts, number)
                    number, size, parts = number + 1, 0, []
                parts.append((rows.column("doc_id").to_pylist(), *aligner(path_a, path_b).texts(rows.column("text").to_pylist())))
                size += len(data)
        if parts:
            yield row(parts, number)

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the corpus-wide figures of their links -> one row for each document."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            size, link, times = np.asarray(row["size"].values), _unpacked(row["link"].as_py()), _unpacked(row["times"].as_py())
            counts, best = np.zeros((2, row["n_pairs"].as_py()), np.int64)
            if row["place"].is_valid:
                place, figure = np.asarray(row["place"].values), np.asarray(row["figure"].values)
                counts[place], best[place] = figure >> 1, figure & 1
            owner = np.repeat(np.arange(len(size)), size)
            total = np.zeros((2, len(size)), np.int64)
            np.add.at(total[0], owner, best[link] * times)
            np.add.at(total[1], owner, counts[link] * times)
            plain = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
            yield pa.RecordBatch.from_pydict({**{c: row[c].values for c in plain}, "n_best": pa.array(total[0]), "count_sum": pa.array(total[1]), "groups_sha256": row["groups_sha256"].values})


def align(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each (doc_id, text).

    n_best counts the links whose count (the documents of the corpus that have the link) is the highest of their A id's, count_sum adds up the
    counts of all links. Null and empty texts, and those whose tokens do not spell a space and the text, have zeros and ''. Rows keep
    their number; one that repeats a doc_id counts as a document of its own. Other columns are ignored.
    """
    return _scores(stored(docs.select("doc_id", "text").mapInArrow(_blocks(path_a, path_b, block_bytes), _BLOCK), "blocks", FILE_BLOCKS))


def _scores(blocks: DataFrame) -> DataFrame:
    listed = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = stored(pair_counts(listed), "counts")
    # A task gets some MB of blocks, however many there are: their rows are sorted and sent to Python together. The two lists of a block are in one order.
    tasks = max(1, blocks.count() // FILE_BLOCKS)
    known = listed.select("block", "place", "pair").join(counts, "pair").select("block", "place", (F.col("n") * 2 + F.col("best")).alias("figure"))
    known = known.repartition(tasks, "block").groupBy("block").agg(F.collect_list("place").alias("place"), F.collect_list("figure").alias("figure"))
    joined = blocks.drop("pairs", "docs").repartition(tasks, "block").join(known, "block", "left")
    ddl = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return joined.mapInArrow(_scored, ddl)


def pair_counts(listed: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents have each pair (A id << 32 | B id), and 1 where no pair of the A id has more, else 0."""
    counts = listed.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))


def translation(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """a, b, n, best: the links of the corpus between ids of A and B, and how many documents have each; `best` marks an A id's most frequent partners."""
    blocks = docs.select("doc_id", "text").mapInArrow(_blocks(path_a, path_b, block_bytes), _BLOCK)
    listed = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = pair_counts(stored(listed.groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs"))
    return counts.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "n", (F.col("best") == 1).alias("best"))
