"""Centroid clustering with ball-tree filtering.

Vectors become integers and are packed, in the tasks that scan them, into blocks of
a few thousand. Every block is a metric tree in arrays: nodes with radius, count
and integer sum, and its vectors in the order of the leaves. A round
sends the few centroids to the blocks. A ball whose farthest point is nearer to one
centroid than its nearest point is to any other goes there whole, by its sums; other
balls pass the centroids that remain on to their children, and leaves compare exact
integers. Blocks are written once and read in every round; a round returns one row
of sums for each centroid and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.session import cut

#: Vectors of a tree, and of a leaf.
BLOCK_ROWS = 4096
LEAF_ROWS = 32
#: Integer components stay within this, so that squared distances of up to 64 fit a long.
REACH = 1 << 27
#: Relative room for rounding of the distances to balls' centres; whatever it leaves undecided descends.
ROOM = 1e-9
LONGEST = (1 << 63) - 1
_BLOCK_SCHEMA = "ids binary, known binary, vectors binary, nodes binary, sums binary, radii binary"
_NAMES = ["ids", "known", "vectors", "nodes", "sums", "radii"]


def integer_vectors(rows: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component of the vectors that have exactly ``dimensions`` finite ones.

    Components beyond REACH are drawn in to it.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(REACH))), F.lit(float(-REACH)))).cast("long"))
    kept = (F.size("embedding") == dimensions) & F.coalesce(finite, F.lit(False))
    return rows.where(kept).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """order of the rows, nodes (begin, end, left, right), component sums, radii.

    A ball is cut between two far points, each row to the nearer; equal points stay a leaf.
    """
    real = vectors.astype(float)
    order = np.arange(len(vectors))
    nodes, sums, radii, todo = [[0, len(vectors), -1, -1]], [], [], [0]
    while todo:
        later = []
        for node in todo:
            begin, end = nodes[node][:2]
            rows = order[begin:end]
            sums.append(vectors[rows].sum(0))
            away = np.sqrt(((real[rows] - sums[node] / (end - begin)) ** 2).sum(1))
            radii.append(away.max())
            if end - begin <= LEAF_ROWS or radii[node] == 0:
                continue
            first = real[rows[away.argmax()]]
            to_first = ((real[rows] - first) ** 2).sum(1)
            second = real[rows[to_first.argmax()]]
            left = to_first < ((real[rows] - second) ** 2).sum(1)
            if left.all() or not left.any():
                continue
            order[begin:end] = np.r_[rows[left], rows[~left]]
            middle = begin + int(left.sum())
            nodes[node][2:] = [len(nodes), len(nodes) + 1]
            later += [len(nodes), len(nodes) + 1]
            nodes += [[begin, middle, -1, -1], [middle, end, -1, -1]]
        todo = later
    return order, np.array(nodes, np.int32), np.array(sums, np.int64), np.array(radii)


def _blocks(dimensions: int):
    def built(ids: list, vectors: list[np.ndarray]) -> pa.RecordBatch:
        matrix = np.concatenate(vectors)
        order, nodes, sums, radii = _tree(matrix)
        known = np.array([i is not None for i in ids], bool)[order]
        numbers = np.array([0 if i is None else i for i in ids], np.int64)[order]
        values = [numbers, known, matrix[order].astype(np.int32), nodes, sums, radii]
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in values], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            at = 0
            while at < len(flat):
                take = min(BLOCK_ROWS - len(ids), len(flat) - at)
                ids += batch.column("vec_id").slice(at, take).to_pylist()
                vectors.append(flat[at : at + take])
                at += take
                if len(ids) == BLOCK_ROWS:
                    yield built(ids, vectors)
                    ids, vectors = [], []
        if ids:
            yield built(ids, vectors)

    return run


def ball_trees(vectors: DataFrame, dimensions: int) -> DataFrame:
    """One row per block of up to BLOCK_ROWS vectors(vec_id, v) of a task: a tree in arrays, as bytes."""
    return vectors.select("vec_id", "v").mapInArrow(_blocks(dimensions), _BLOCK_SCHEMA)


class _Block:
    def __init__(self, row: dict, dimensions: int):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.known = read("ids", np.int64), read("known", bool)
        self.vectors = read("vectors", np.int32).reshape(-1, dimensions)
        self.nodes = read("nodes", np.int32).reshape(-1, 4)
        self.sums, self.radii = read("sums", np.int64).reshape(-1, dimensions), read("radii", float)


def _assigned(block: _Block, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes that go whole to a centroid, that centroid, none) and (none, centroid, rows) of leaves compared row by row."""
    count = (block.nodes[:, 1] - block.nodes[:, 0])[:, None]
    centres = block.sums / count
    at, left_in = np.array([0]), np.ones((1, len(centroids)), bool)
    while len(at):
        far = np.sqrt(((centres[at][:, None, :] - centroids[None].astype(float)) ** 2).sum(2))
        far[~left_in] = np.inf
        near, radius = far.min(1), block.radii[at]
        room = ROOM * (1 + near + radius + 1e-3 * np.sqrt((centres[at] ** 2).sum(1)))
        left_in = far - radius[:, None] <= (near + radius + room)[:, None] + ROOM * np.where(np.isinf(far), 0, far)
        whole = left_in.sum(1) == 1
        if whole.any():
            yield at[whole], left_in[whole].argmax(1), np.zeros(0, np.int64)
        leaf = ~whole & (block.nodes[at, 2] < 0)
        for node, candidates in zip(at[leaf], left_in[leaf]):
            begin, end = block.nodes[node, :2]
            yield np.zeros(0, np.int64), _nearest(block.vectors[begin:end], centroids, np.flatnonzero(candidates))[0], np.arange(begin, end)
        inner = ~whole & ~leaf
        at, left_in = np.r_[block.nodes[at[inner], 2], block.nodes[at[inner], 3]], np.r_[left_in[inner], left_in[inner]]


def _nearest(vectors: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of the nearest centroid ``among`` those numbered; ties: the smaller number."""
    rows = vectors.astype(np.int64)
    distances = np.stack([((rows - centroids[c]) ** 2).sum(1) for c in among])
    best = distances.argmin(0)
    return among[best], distances[best, np.arange(len(rows))]


def _numbers(block: _Block, centroids: np.ndarray) -> np.ndarray:
    """The centroid of every vector of a block, in its order."""
    out = np.zeros(len(block.vectors), np.int32)
    for nodes, chosen, rows in _assigned(block, centroids):
        for node, c in zip(nodes, chosen):
            out[block.nodes[node, 0] : block.nodes[node, 1]] = c
        if len(rows):
            out[rows] = chosen
    return out


def _round(centroids: np.ndarray, dimensions: int):
    """A task's count and component sums for each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dimensions), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, dimensions)
                sizes = (block.nodes[:, 1] - block.nodes[:, 0]).astype(np.int64)
                for nodes, chosen, rows in _assigned(block, centroids):
                    if len(rows):
                        np.add.at(counts, chosen, 1)
                        np.add.at(sums, chosen, block.vectors[rows].astype(np.int64))
                    else:
                        np.add.at(counts, chosen, sizes[nodes])
                        np.add.at(sums, chosen, block.sums[nodes])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _totals(trees: DataFrame, centroids: np.ndarray, dimensions: int) -> list:
    found = trees.mapInArrow(_round(centroids, dimensions), "cluster int, n long, sums array<long>")
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    return found.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[wide(F.col("sums")[i]) for i in range(dimensions)]).alias("sums")).collect()  # a row a centroid


def _placed(centroids: np.ndarray, dimensions: int):
    """vec_id, cluster, distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, dimensions)
                chosen = _numbers(block, centroids)
                distance = ((block.vectors.astype(np.int64) - centroids[chosen]) ** 2).sum(1)
                ids = pa.array(block.ids, mask=~block.known)
                yield pa.RecordBatch.from_arrays([ids, pa.array(chosen), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def _spread(found: DataFrame) -> list:
    """Distance summed over each cluster, as exact decimals; one row a centroid comes to the driver."""
    return found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()


def start(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors of the smallest hashes of ``seed:vec_id``, in that order; fewer if there are fewer."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    hashed = vectors.where("vec_id IS NOT NULL").select(key.alias("key"), "v")
    return [list(row["v"]) for row in hashed.orderBy("key", "v").limit(clusters).collect()]


def cluster(rows: DataFrame, dimensions: int, clusters: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 0) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector after ``rounds`` rounds.

    Vectors without exactly ``dimensions`` components, or with a null or non-finite one,
    are left out. Components are floor(scale * x), drawn in to +-REACH; distances are
    squared and exact. The nearest centroid of equal distances is the smaller number; a
    centroid becomes the floor of its vectors' mean, one without vectors stays. Rows
    without vec_id are clustered but start no centroid; rows that repeat a vec_id count
    each, and may start several. With fewer vectors than clusters each starts one. Sums
    of distances beyond a long are given as the largest long. No vector, or none with a
    vec_id, gives an empty result; other columns are ignored.
    """
    if dimensions > 64:
        raise ValueError("squared distances of more than 64 components may not fit a long")
    vectors = integer_vectors(rows, dimensions, scale)
    found = np.array(start(vectors, clusters, seed), np.int64).reshape(-1, dimensions)
    schema = "vec_id long, cluster int, distance long"
    if not len(found):
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return rows.sparkSession.createDataFrame([], empty)
    trees = cut(ball_trees(vectors, dimensions))
    for _ in range(rounds):
        for row in _totals(trees, found, dimensions):
            found[row["cluster"]] = [int(s) // row["n"] for s in row["sums"]]
    placed = trees.mapInArrow(_placed(found, dimensions), schema)
    inertia = {row["cluster"]: row["inertia"] for row in _spread(placed)}
    total = min(sum(inertia.values(), Decimal(0)), LONGEST)
    facts = [(c, min(int(inertia.get(c, 0)), LONGEST), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(found.tolist())]
    of = rows.sparkSession.createDataFrame(facts, "of int, cluster_inertia long, centroid_sha256 string")
    out = placed.join(F.broadcast(of), F.col("cluster") == F.col("of"))  # a row a centroid
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(int(total)).alias("inertia"), "centroid_sha256")
