"""Exact top-k by inner product with dual-tree search over cover trees (operator 7).

The data are dealt to groups of near vectors, so that each batch of a task is compact. A task indexes each
batch of data as a cover tree: a node's centre is one of its points, and its children's centres are a net of its points at half
its radius that holds the centre itself, so that each point lies within half the radius of a child's centre and no two of these are nearer than
that. Queries are held as such trees too. Node pairs are visited best bound first. A pair is dropped when no inner product between
its nodes, <p,q> + R_q |p| + R_p |q| + R_p R_q by the centres p, q and covering radii R, can reach the worst k-th score
of the query node's queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.llm.shared import new_folder, stored

#: Queries of one broadcast block (a fixed bound: their vectors and trees), points of one tree, points of a leaf.
QUERY_BLOCK, DATA_BLOCK, LEAF = 32_768, 4_096, 96
#: Rows that the grouping is fitted on, and groups at most. Both shape the index alone, not the results.
SAMPLE, MOST_GROUPS = 4_096, 256


class CoverTree:
    """Nodes hold a centre (a point), the radius that covers their points, and children, or points if they are leaves.

    A node of at most `leaf` points is a leaf; so is one whose net would hold over an eighth of its points, which balls do not tell
    apart. Children of at most `leaf` points are put together as one leaf of their parent's centre.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points.astype(np.float64)
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if len(points):
            away = ((self.points - self.points.mean(axis=0)) ** 2).sum(axis=1)
            self._node(np.arange(len(points)), int(away.argmin()), leaf)

    def _add(self, own: np.ndarray, centre: int) -> int:
        self.centre.append(self.points[centre])
        away = ((self.points[own] - self.points[centre]) ** 2).sum(axis=1)
        self.radius.append(float(np.sqrt(away.max())) * (1 + 1e-9))
        self.children.append([])
        self.members.append(own)
        return len(self.centre) - 1

    def _node(self, own: np.ndarray, centre: int, leaf: int) -> int:
        """A node of the points `own`, one of which is the centre."""
        number = self._add(own, centre)
        half = self.radius[number] / 2
        if len(own) <= leaf or half == 0:
            return number
        # The net, farthest points first; each other point goes to its nearest net point.
        p, net = self.points[own], [centre]
        best = np.sqrt(((p - self.points[centre]) ** 2).sum(axis=1))
        near = np.zeros(len(own), np.int64)
        while best.max() > half:
            if len(net) > max(16, len(own) // 8):
                return number
            k = int(best.argmax())
            d = np.sqrt(((p - p[k]) ** 2).sum(axis=1))
            near = np.where(d < best, len(net), near)
            best = np.minimum(best, d)
            net.append(int(own[k]))
        size = np.bincount(near, minlength=len(net))
        large = np.flatnonzero(size > leaf)
        children = [self._node(own[near == k], net[k], leaf) for k in large.tolist()]
        small = own[size[near] <= leaf]
        if len(small):
            children.append(self._add(small, centre))
        self.children[number] = children
        return number


class Best:
    """The k best (score, vec_id) of each query so far; ties go to the smaller vec_id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.row = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        """score: (len(at), m); row: the vec_ids of the m candidates; a score of the least int64 is none."""
        k = self.score.shape[1]
        s = np.hstack([self.score[at], score])
        r = np.hstack([self.row[at], np.broadcast_to(row, score.shape)])
        order = np.lexsort((r, -np.maximum(s, np.iinfo(np.int64).min + 1)), axis=1)[:, :k]
        self.score[at], self.row[at] = np.take_along_axis(s, order, 1), np.take_along_axis(r, order, 1)

    def worst(self, at: np.ndarray) -> int:
        return int(self.score[at, -1].min())


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in float64 while every partial sum stays below 2^53."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def dual_search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, best: Best, floor: np.ndarray) -> int:
    """Adds the data tree's candidates to `best`; floor: a score that each query's k-th best reaches anyway. Returns the leaf pairs compared."""
    if not queries.centre or not data.centre:
        return 0

    def bound(q: int, d: int) -> float:
        a, b = queries.centre[q], data.centre[d]
        ra, rb = queries.radius[q], data.radius[d]
        x = float(a @ b) + ra * float(np.sqrt(b @ b)) + rb * float(np.sqrt(a @ a)) + ra * rb
        return x + abs(x) * 1e-9 + 1e-6

    compared, heap = 0, [(-bound(0, 0), 0, 0)]
    while heap:
        b, q, d = heapq.heappop(heap)
        own = queries.members[q]
        need = int(np.maximum(best.score[own, -1], floor[own]).min())
        if -b < need:
            continue
        more_q, more_d = queries.children[q], data.children[d]
        if not more_q and not more_d:
            at, rows = own, data.members[d]
            score = _products(queries.points[at], data.points[rows])
            score[query_ids[at][:, None] == data_ids[rows][None, :]] = np.iinfo(np.int64).min
            best.add(at, score, data_ids[rows])
            compared += 1
            continue
        split_q = more_q and (not more_d or queries.radius[q] > data.radius[d])
        for x, y in ((c, d) for c in more_q) if split_q else ((q, c) for c in more_d):
            heapq.heappush(heap, (-bound(x, y), x, y))
    return compared


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = len(column)
    if n and len(flat) % n:
        raise ValueError("vectors of more than one length")
    return flat.reshape(n, -1)


def _farthest(sample: np.ndarray, groups: int) -> np.ndarray:
    if not len(sample):
        return sample
    net = [0]
    best = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(net) < groups and best.max() > 0:
        net.append(int(best.argmax()))
        best = np.minimum(best, ((sample - sample[net[-1]]) ** 2).sum(axis=1))
    return sample[net]


def whole_vectors(table: DataFrame, factor: int = 256) -> DataFrame:
    """(vec_id, v): components floor(factor * x) as double; rows without an id, with a null or empty vector or with null or non-finite components are left out."""
    x = F.col("embedding")
    good = x.isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0)
    good &= F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.where(good).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * factor).cast("double")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row of `queries` with the rows of `vectors` of another vec_id.

    Both have (vec_id, v array<double>) of whole numbers and one length (else: an error). Ties go to the smaller vec_id; queries
    that repeat a vec_id count once. Fewer rows than k: all of them. Empty tables give no rows. The query blocks are searched one after
    another, and each one's rows are written down before the next is broadcast.
    """
    spark: SparkSession = vectors.sparkSession
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    sample, sample_ids = (_matrix(picked.column("v").combine_chunks()), picked.column("vec_id").to_numpy()) if picked.num_rows else (np.zeros((0, 0)), np.zeros(0, np.int64))
    net = _farthest(sample, MOST_GROUPS)
    shared = spark.sparkContext.broadcast((net, sample, sample_ids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value[0]
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"))
                near = (v @ net.T - (net * net).sum(axis=1) / 2).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near)], names=["vec_id", "v", "near"])

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k-th best score of the sample, which the k-th best of all reaches."""
        _, sample, sample_ids = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                ids, best = part.column("vec_id").to_numpy(), Best(part.num_rows, k)
                score = _products(_matrix(part.column("v")), sample)
                score[ids[:, None] == sample_ids[None, :]] = np.iinfo(np.int64).min
                best.add(np.arange(part.num_rows), score, sample_ids)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(best.score[:, -1])], names=["vec_id", "v", "floor"])

    # A group of any size is spread by a part of the id's hash; a task sorts by group, so that its batches are compact.
    grouped = vectors.mapInArrow(assign, "vec_id bigint, v array<double>, near int")
    grouped = stored(grouped.repartition("near", F.pmod(F.xxhash64("vec_id"), F.lit(32))).sortWithinPartitions("near", "vec_id"), "grouped")
    queries = stored(queries.dropDuplicates(["vec_id"]).mapInArrow(floors, "vec_id bigint, v array<double>, floor bigint"), "queries")
    folder = new_folder(spark, "found")
    schema = "query_id bigint, vec_id bigint, score bigint"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/none")
    for number, block in enumerate(_query_blocks(queries)):
        trees = []
        for i in range(0, block.num_rows, DATA_BLOCK):
            part = block.slice(i, DATA_BLOCK).combine_chunks()
            trees.append((part.column("vec_id").to_numpy(), CoverTree(_matrix(part.column("v").combine_chunks())), part.column("floor").to_numpy()))
        held = spark.sparkContext.broadcast(trees)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            trees = held.value
            best = [Best(len(ids), k) for ids, _, _ in trees]
            for b in batches:
                for i in range(0, b.num_rows, DATA_BLOCK):
                    part = b.slice(i, DATA_BLOCK)
                    data, data_ids = CoverTree(_matrix(part.column("v"))), part.column("vec_id").to_numpy()
                    for (ids, tree, floor), own in zip(trees, best):
                        dual_search(tree, ids, data, data_ids, own, floor)
            for (ids, _, floor), own in zip(trees, best):
                keep = (own.score >= floor[:, None]) & (own.score > np.iinfo(np.int64).min)
                q, _ = np.nonzero(keep)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[q], pa.int64()), "vec_id": pa.array(own.row[keep], pa.int64()), "score": pa.array(own.score[keep], pa.int64())})

        grouped.mapInArrow(search, schema).write.parquet(f"{folder}/{number}")
        held.destroy()
    result = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return result.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _query_blocks(queries: DataFrame) -> Iterator[pa.Table]:
    """The query set in blocks of bounded size, by ranges of a hash; the driver holds one block at a time."""
    n = queries.count()
    blocks = max(1, -(-n * 5 // (QUERY_BLOCK * 4)))
    for k in range(blocks if n else 0):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).toArrow()
        if block.num_rows:
            yield block


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
