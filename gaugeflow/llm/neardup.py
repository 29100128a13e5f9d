"""MinHash near-duplicate classes with tensored banding (operator 3).

Two small collections of m keys each are made from h minhashes per key; the table keys are all m * m pairs of a
key of the first and one of the second collection: 2 * m * h minhashes give what m * m * 2h would give untensored.
At similarity 0.8 and h = 4, m = 20, a pair meets in no table with probability 5e-5, at 0.85 with 8e-7.

Documents of equal words (BLAKE2b of the lower-cased words) are one node. Nodes that meet in a table belong to one
candidate group; links inside the groups are decided on the words themselves, no hash between. A group of bounded weight is one
piece of work. A larger one is first dealt into blocks, each with the group's first document; what is then linked through it or
inside a block is one family, and only blocks of different families are compared any further. Edges of a spanning forest come
back, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm import spans
from gaugeflow.llm.components import components
from gaugeflow.llm.shared import made, release, remove_stored, stored

WORDS, PER_KEY, KEYS, PERCENT = 5, 4, 20, 80
#: Shingles of one block of a candidate group: a task holds two blocks.
BLOCK_SHINGLES = 1 << 18

_RNG = np.random.default_rng(7_2024)
_XOR = _RNG.integers(0, 1 << 32, 2 * PER_KEY * KEYS, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 32, 2 * PER_KEY * KEYS, dtype=np.uint32) | np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text one after another, bounds of each text's) of lower-cased text."""
    starts, ends, first = spans.words(data, offsets)
    h = spans.word_hashes(data, starts, ends)
    n_texts, n_words = len(offsets) - 1, np.diff(first)
    owner = np.repeat(np.arange(n_texts), n_words)
    whole = spans.windows(h, width)
    inside = owner[: len(whole)] == owner[width - 1 :] if len(whole) else np.zeros(0, bool)
    values, owners = [whole[inside]], [owner[: len(whole)][inside]]
    for size in range(1, width):  # fewer words than a shingle: the whole sequence is one
        short = np.flatnonzero(n_words == size)
        if len(short):
            values.append(spans.mix(spans.windows(h, size)[first[short]] + np.uint64(size)))
            owners.append(short)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(n_texts + 1))


def signatures(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size of each set, its 2 * KEYS collection keys); rows of empty sets are zero."""
    n = len(bounds) - 1
    some = bounds[:-1] < bounds[1:]
    at = bounds[:-1][some]
    keys = np.zeros((n, 2 * KEYS), np.uint64)
    if len(at):
        x = (value >> np.uint64(32)).astype(np.uint32)
        for k in range(2 * KEYS):
            key = np.full(len(at), k + 1, np.uint64)
            for j in range(k * PER_KEY, (k + 1) * PER_KEY):
                y = (x ^ _XOR[j]) * _MUL[j]
                y ^= y >> np.uint32(15)
                y *= np.uint32(0x2C1B3C6D)
                key = spans.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(y, at))
            keys[some, k] = key
    return np.diff(bounds), keys


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in spans.chunks(batch, "text"):
            data = spans.lower_ascii(data)
            value, bounds = shingles(data, offsets)
            sizes, keys = signatures(value, bounds)
            keys = keys.view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (len(keys) + 1) * KEYS, KEYS), pa.int32()), pa.array(keys[:, s].ravel())) for s in (slice(0, KEYS), slice(KEYS, None))]
            raw = data.tobytes()
            same = np.frombuffer(b"".join([blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes), pa.array(same[:, 0]), pa.array(same[:, 1]), *lists], names=["doc_id", "n_shingles", "same1", "same2", "a", "b"])


def word_sets(texts: list[str], width: int = WORDS) -> list[np.ndarray]:
    """The shingle sets of texts as numbers: two shingles have one number if and only if their words are the same."""
    known: dict[bytes, int] = {}
    words = [[known.setdefault(w, len(known)) for w in t.encode().lower().split()] for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    code = np.array([i for w in words for i in w], np.int64)
    base = code
    for k in range(1, width):  # numbers of runs of k + 1 words from those of k words
        code = pd.factorize(code[:-1] * (len(known) + 1) + base[k:])[0].astype(np.int64) if len(code) > 1 else code[:0]
    short: dict[tuple[int, ...], int] = {}
    least = int(code.max(initial=-1)) + 1
    out = []
    for w, a, b in zip(words, bounds[:-1].tolist(), bounds[1:].tolist()):
        if 0 < len(w) < width:
            out.append(np.array([least + short.setdefault(tuple(w), len(short))], np.int64))
        else:
            out.append(np.unique(code[a : max(b - width + 1, a)]))
    return out


def linked(inter: np.ndarray, a: np.ndarray | int, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def forest(nodes: np.ndarray, sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges that join what is linked, of pairs that have different roots: within one side (side all 0), or across sides 0 and 1."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    nodes, size, side = nodes[order], size[order], side[order]
    root = np.unique(root[order], return_inverse=True)[1]
    ids = np.concatenate([sets[i] for i in order])
    bounds = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(ids.max(initial=0)) + 1, np.int32)
    across = side.any()
    edges = []
    for x in range(len(nodes)):
        # Sets are in order of size: partners have up to 100 / percent times as many shingles.
        last = np.searchsorted(size, size[x] * 100 // percent, side="right")
        own = np.arange(x + 1, last)
        open_ = root[own] != root[x]
        if across:
            open_ &= side[own] != side[x]
        if not open_.any():
            continue
        mark[ids[bounds[x] : bounds[x + 1]]] = 1
        inter = np.add.reduceat(mark[ids[bounds[x + 1] : bounds[last]]], bounds[x + 1 : last] - bounds[x + 1])
        mark[ids[bounds[x] : bounds[x + 1]]] = 0
        for y in own[open_ & linked(inter, size[x], size[own], percent)]:
            if root[y] != root[x]:
                edges.append((int(nodes[x]), int(nodes[y])))
                old, new = max(root[x], root[y]), min(root[x], root[y])
                root[root == old] = new
    return edges


def _links(percent: int):
    """pdf: grp, node, text, root (what is known to be linked), side. Pairs of one grp are compared."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = []
        for _, own in pdf.groupby("grp", sort=False):
            if len(own) > 1:
                edges += forest(own["node"].to_numpy(), word_sets(own["text"].tolist()), own["root"].to_numpy(), own["side"].to_numpy(), percent)
        return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")

    return run


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """(u, v): each node with the smallest node of every table bucket that it shares; nodes: node, a, b."""
    keys = nodes.select("node", F.posexplode(F.concat("a", "b")).alias("i", "key"))
    # A key that one node alone has joins nobody in any of its pairs.
    common = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    kept = keys.join(common, "key", "left_semi")
    sides = kept.groupBy("node").agg(F.collect_list(F.when(F.col("i") < KEYS, F.col("key"))).alias("a"), F.collect_list(F.when(F.col("i") >= KEYS, F.col("key"))).alias("b"))
    pairs = sides.where((F.size("a") > 0) & (F.size("b") > 0)).select("node", "b", F.explode("a").alias("x")).select("node", "x", F.explode("b").alias("y"))
    tables = stored(pairs.select("node", F.xxhash64("x", "y").alias("key")), "tables")
    leaders = tables.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("hi")).where("v <> hi").select("key", "v")
    out = tables.join(leaders, "key").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    out.tables = tables
    return out


def _family_links(texts: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame | None:
    """Links between the families (`classes`: node, component) of one group, None if no group has two; texts: node, grp, n, text of groups of several blocks.

    Families over a block's weight are cut into blocks of their own, smaller ones share blocks; all pairs of blocks are compared but those of one family.
    """
    nodes = texts.join(classes, "node", "left").withColumn("root", F.coalesce("component", "node"))
    families = stored(nodes.groupBy("grp", "root").agg(F.sum("n").alias("weight")), "families")
    split = families.groupBy("grp").agg(F.count(F.lit(1)).alias("k"), F.sum(F.when(F.col("weight") <= block, F.col("weight"))).alias("small")).where("k > 1")
    large = F.col("weight") > block
    families = families.join(split, "grp").select("grp", "root", large.alias("large"), F.ceil(F.when(large, F.col("weight")).otherwise(F.col("small")) / block).alias("parts"))
    families = stored(families, "families")
    if families.isEmpty():
        return None
    part = F.pmod(F.when(F.col("large"), F.xxhash64("node")).otherwise(F.xxhash64("root")), "parts")
    name = F.concat_ws("/", F.when(F.col("large"), F.col("root").cast("string")).otherwise("-"), part.cast("string"))
    nodes = stored(nodes.join(families, ["grp", "root"]).select("node", "grp", "root", "text", "large", name.alias("name")), "dealt")
    blocks = nodes.groupBy("grp", "name").agg(F.max("large").alias("large"), F.max("root").alias("root"))
    other = blocks.select("grp", F.col("name").alias("other"), F.col("large").alias("large2"), F.col("root").alias("root2"))
    # Numbers of blocks, not documents, are squared here; blocks of one large family are not compared.
    pairs = blocks.join(other, "grp").where("not (large and large2 and root = root2) and (name <> other or not large)").select("grp", "name", "other")
    dealt = nodes.join(pairs, ["grp", "name"]).select("grp", "node", "root", "text", F.least("name", "other").alias("i"), F.greatest("name", "other").alias("j"), (F.col("name") > F.col("other")).cast("int").alias("side"))
    more = dealt.groupBy("grp", "i", "j").applyInPandas(_links(percent), "u bigint, v bigint")
    return stored(more, "links")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each (doc_id, text).

    Documents without words have no shingles, link with nothing and are kept. Rows that share a doc_id count as one document. A row
    with a null doc_id takes part, gets the class of the other documents of its words (else null) and is never kept. Other
    columns are ignored. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    same, before = ["same1", "same2"], set(made())
    rows = stored(docs.mapInArrow(_signature_rows, "doc_id bigint, n_shingles bigint, same1 bigint, same2 bigint, a array<bigint>, b array<bigint>"), "signatures")
    full = rows.where("n_shingles > 0")
    sets = full.where("doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    sets = stored(sets, "sets")
    edges = candidate_edges(sets)
    groups = components(edges)
    release(edges.tables)  # the components have read the edges
    # Blocks of a group are dealt by hash; a group's weight, not its number of documents, decides how many.
    member = stored(groups.select("node", F.col("component").alias("grp")).join(sets.groupBy("node").agg(F.sum("n").alias("n")), "node"), "members")
    weight = stored(member.groupBy("grp").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks")), "weights")
    texts = docs.withColumnRenamed("doc_id", "node").join(member.join(weight, "grp"), "node")
    # A repeated row counts once; a doc_id's rows without words have nothing to compare.
    texts = stored(texts.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).dropDuplicates(["node", "text"]).select("node", "grp", "n", "blocks", "text"), "texts")
    shards = 1 + (texts.agg(F.sum("n")).first()[0] or 0) // block
    # Groups of one block share shards; a larger group's first document goes to each of its blocks.
    own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    place = F.when(F.col("blocks") == 1, F.array(F.pmod(F.xxhash64("grp"), F.lit(shards)).cast("int"))).when(F.col("node") == F.col("grp"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)
    dealt = texts.select("grp", "node", "text", F.col("node").alias("root"), F.lit(0).alias("side"), F.when(F.col("blocks") > 1, F.col("grp")).alias("large"), F.explode(place).alias("part"))
    links = stored(dealt.groupBy("large", "part").applyInPandas(_links(percent), "u bigint, v bigint"), "links")
    # Rows of one doc_id have one node per set of words: they belong together.
    repeated = full.where("doc_id is not null").join(sets, same).where("doc_id <> node")
    repeated = repeated.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v").select("u", "v")
    classes = stored(components(links.unionByName(repeated)), "families")
    large = texts.where("blocks > 1")
    more = None if large.isEmpty() else _family_links(large, classes, percent, block)
    if more is not None and not more.isEmpty():
        classes = components(more.unionByName(classes.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    final = stored(sets.join(classes, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id")), "classes")
    # The result reads the signatures and the classes alone.
    remove_stored(docs.sparkSession, [p for p in made() if p not in before and p not in (rows.stored_at, final.stored_at)])
    found = full.select("doc_id", "n_shingles", *same).join(final, same, "left").select("doc_id", "n_shingles", "component_id")
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs (doc_id, text and any others) with one row of each class of near-duplicate texts.

    Rows are told apart by a key of their own, so classes come from texts alone: rows of one doc_id with unlike texts are different
    documents. Of a class stays the row with the smallest doc_id (null: after all others), and of that the one with the smallest hash of
    its text; one of equal rows stays. Documents without words all stay.
    """
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), percent).select(F.col("doc_id").alias("_row"), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("hash"), "_row")
    firsts = rows.select("_row", place.alias("place")).join(found, "_row").groupBy("component_id").agg(F.min("place").alias("first"))
    return rows.join(firsts.select("first._row"), "_row", "left_semi").select(*docs.columns)
