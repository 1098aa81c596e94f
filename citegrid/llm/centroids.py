"""Centroid clustering: exact k-means on whole numbers, filtered through kd-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
LEAF = 32
TREE_ROWS = 4096
LIMIT = 1 << 25  # sums of 64 products of differences of such components fit 63 bits


class Tree:
    """A balanced kd-tree over rows of whole numbers, level by level: node i covers points[start[i]:end[i]].

    Each node holds its count (end - start), the sum of its points and their box; children of a
    node are stored side by side at child[i] (-1 at a leaf). Nodes whose points are all equal are leaves.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        start, end, child = [0], [len(points)], []
        at = 0
        while at < len(start):
            s, e = start[at], end[at]
            own = points[order[s:e]]
            width = own.max(axis=0) - own.min(axis=0)
            axis = int(width.argmax())
            if e - s <= leaf or not width[axis]:
                child.append(-1)
            else:
                half = (e - s) // 2
                order[s:e] = order[s:e][np.argpartition(own[:, axis], half)]
                child.append(len(start))
                start += [s, s + half]
                end += [s + half, e]
            at += 1
        self.order = order
        self.points = points[order]
        self.start, self.end, self.child = np.array(start), np.array(end), np.array(child)
        self._measure()

    def _measure(self) -> None:
        sums = np.zeros((len(self.points) + 1, self.points.shape[1]), np.int64)
        np.cumsum(self.points, axis=0, out=sums[1:])
        self.sums = sums[self.end] - sums[self.start]
        self.low, self.high = np.empty_like(self.sums), np.empty_like(self.sums)
        for i in range(len(self.start) - 1, -1, -1):
            c = self.child[i]
            if c < 0:
                own = self.points[self.start[i] : self.end[i]]
                self.low[i], self.high[i] = own.min(axis=0), own.max(axis=0)
            else:
                self.low[i], self.high[i] = np.minimum(self.low[c], self.low[c + 1]), np.maximum(self.high[c], self.high[c + 1])

    def of(self, node: int) -> np.ndarray:
        return self.points[self.start[node] : self.end[node]]

    def to_row(self) -> dict[str, bytes]:
        return {k: getattr(self, k).astype("<i8" if k == "sums" else "<i4").tobytes() for k in ("points", "start", "end", "child", "sums", "low", "high")}

    @classmethod
    def of_row(cls, row: dict[str, bytes], dimensions: int) -> Tree:
        self = cls.__new__(cls)
        for k in ("points", "start", "end", "child", "sums", "low", "high"):
            setattr(self, k, np.frombuffer(row[k], "<i8" if k == "sums" else "<i4").astype(np.int64))
        for k in ("points", "sums", "low", "high"):
            setattr(self, k, getattr(self, k).reshape(-1, dimensions))
        return self


def surviving(low: np.ndarray, high: np.ndarray, alive: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """alive (nodes x centroids) without the centroids that are strictly farther than another one from every point of a node's box.

    The rival is the centroid nearest to the middle of the box. For another centroid z the point
    of the box that favours z most lies at the corner in the direction from the rival to z: if z
    loses even there, and not by a tie, it is nowhere nearest nor tied.
    """
    twice = (low + high)[:, None, :] - 2 * centroids[None, :, :]
    far = np.einsum("nkd,nkd->nk", twice, twice)
    rival = np.where(alive, far, np.iinfo(np.int64).max).argmin(axis=1)
    ahead = centroids[None, :, :] > centroids[rival][:, None, :]
    corner = np.where(ahead, high[:, None, :], low[:, None, :])
    own, other = corner - centroids[None, :, :], corner - centroids[rival][:, None, :]
    # (corner - z)^2 - (corner - rival)^2 as a product, whose sum fits
    lost = np.einsum("nkd,nkd->nk", own - other, own + other) > 0
    return alive & ~lost


def assigned(tree: Tree, centroids: np.ndarray, step: int = 64) -> Iterator[tuple[int, int | np.ndarray]]:
    """(node, cluster) for nodes that together cover the tree: a number for a whole node, an array by its points for a leaf.

    Every point goes to its nearest centroid, ties to the smaller number.
    """
    nodes = np.array([0])
    alive = np.ones((1, len(centroids)), bool)
    while len(nodes):
        left = np.concatenate([surviving(tree.low[nodes[i : i + step]], tree.high[nodes[i : i + step]], alive[i : i + step], centroids) for i in range(0, len(nodes), step)])
        one = left.sum(axis=1) == 1
        for node, cluster in zip(nodes[one].tolist(), left[one].argmax(axis=1).tolist(), strict=True):
            yield node, cluster
        leaf = ~one & (tree.child[nodes] < 0)
        for node, keep in zip(nodes[leaf].tolist(), left[leaf], strict=True):
            some = np.flatnonzero(keep)
            yield node, some[distances(tree.of(node)[:, None, :], centroids[None, some, :]).argmin(axis=1)]
        inner = ~one & ~leaf
        child = tree.child[nodes[inner]]
        nodes = np.concatenate([child, child + 1])
        alive = np.concatenate([left[inner], left[inner]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...d,...d->...", d, d)


def _rows_of(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    lists = batch.column("vector")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat.reshape(len(lists), -1) * scale)
    if (np.abs(whole) > LIMIT).any():
        raise ValueError(f"a component beyond {LIMIT // scale}: squared distances would not fit a long")
    return whole.astype(np.int64)


_TREES = "ids binary, id_null binary, points binary, start binary, end binary, child binary, sums binary, low binary, high binary"


def _planted(scale: int):
    """Kd-trees over the rows of a partition, TREE_ROWS each."""
    names = [x.split()[0] for x in _TREES.split(", ")]

    def plant(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, none, points = (np.concatenate(x) for x in zip(*held, strict=True))
        tree = Tree(points)
        row = tree.to_row() | {"ids": ids[tree.order].astype("<i8").tobytes(), "id_null": none[tree.order].tobytes()}
        return pa.RecordBatch.from_arrays([pa.array([row[n]], pa.binary()) for n in names], names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TREE_ROWS):
                part = batch.slice(at, TREE_ROWS)
                ids = part.column("vec_id")
                held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), _rows_of(part, scale)))
                n += part.num_rows
                if n >= TREE_ROWS:
                    yield plant(held)
                    held, n = [], 0
        if held:
            yield plant(held)

    return run


def _trees(batches, dimensions: int):
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            yield row, Tree.of_row(row, dimensions)


def _totals(centroids: np.ndarray):
    """A row (cluster, count, sums) for each cluster of a partition: whole nodes by their stored sums, leaves point by point."""
    k, d = centroids.shape

    def run(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for _, tree in _trees(batches, d):
            for node, cluster in assigned(tree, centroids):
                if isinstance(cluster, int):
                    count[cluster] += tree.end[node] - tree.start[node]
                    sums[cluster] += tree.sums[node]
                else:
                    np.add.at(count, cluster, 1)
                    np.add.at(sums, cluster, tree.of(node))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "count", "sums"])

    return run


def _placed(centroids: np.ndarray):
    """(vec_id, cluster, distance) of every point."""

    def run(batches):
        for row, tree in _trees(batches, centroids.shape[1]):
            cluster = np.empty(len(tree.points), np.int32)
            for node, found in assigned(tree, centroids):
                cluster[tree.start[node] : tree.end[node]] = found
            far = distances(tree.points, centroids[cluster])
            ids = pa.array(np.frombuffer(row["ids"], "<i8"), pa.int64(), mask=np.frombuffer(row["id_null"], bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(far)], ["vec_id", "cluster", "distance"])

    return run


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, vector): those with exactly `dimensions` components, none null or non-finite."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter((F.size("embedding") == dimensions) & sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, scale: int = SCALE) -> np.ndarray:
    """The k vectors with the smallest sha256 of 1:<vec_id>, in that order; null ids come last, vectors that share an id by their components."""
    rank = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = vectors.withColumn("_rank", rank).orderBy(F.col("_rank").asc_nulls_last(), "vector").limit(k).select("vector").toArrow()
    return np.concatenate([_rows_of(b, scale) for b in first.to_batches() if b.num_rows] or [np.empty((0, 0), np.int64)])


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of their vectors; those without vectors stay. k x dimensions totals reach the driver."""
    sums = trees.mapInArrow(_totals(centroids), "cluster int, count long, sums array<long>")
    sums = sums.select("cluster", F.posexplode(F.concat(F.array("count"), "sums")).alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    total = {(r.cluster, r.at): int(r.x) for r in sums.collect()}
    out = centroids.copy()
    for cluster, n in ((c, x) for (c, at), x in total.items() if at == 0):
        out[cluster] = [total[cluster, at + 1] // n for at in range(out.shape[1])]
    return out


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 after `rounds` rounds of k-means.

    Components become floor(scale * x); all that follows is exact whole-number arithmetic. Kd-trees
    of TREE_ROWS vectors are planted once in each partition and written to the shared folder; every
    round walks them, and only count and sums of each cluster leave a partition. The driver holds
    k centroids. Vectors with a null embedding, another number of components, or a null or
    non-finite one are left out. Repeated rows and ids count as often as they stand; null ids keep
    a row and come last among the starting vectors; with fewer than k vectors all of them start;
    of equal centroids the smaller number takes the vectors. Further columns are ignored, an empty table gives no rows.
    Components beyond LIMIT / scale raise, as their distances would not fit.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dimensions)
    result = "vec_id long, cluster int, distance long"
    centroids = first_centroids(kept, k, scale)
    if not len(centroids):
        return spark.createDataFrame([], result + ", cluster_inertia long, inertia long, centroid_sha256 string")
    trees = written(kept.mapInArrow(_planted(scale), _TREES), "trees")
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    placed = written(trees.mapInArrow(_placed(centroids), result), "placed")
    inertia = {r.cluster: int(r.x) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    rows = [(c, x, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, x in inertia.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(read_table(spark, sf_dir, "embeddings"))


_ROUND = """
d{n} AS MATERIALIZED (SELECT p.vec_id, p.v, c.i, CAST(list_sum([CAST((a[1] - a[2]) * (a[1] - a[2]) AS BIGINT) FOR a IN list_zip(p.v, c.v)]) AS BIGINT) AS d FROM p, c{n} c),
a{n} AS MATERIALIZED (SELECT vec_id, v, min_by(i, (d, i)) AS i, min(d) AS d FROM d{n} GROUP BY vec_id, v),
s{n} AS (SELECT i, j, sum(v[j]) AS s, count(*) AS n FROM a{n}, range(1, 65) r(j) GROUP BY i, j),
m{n} AS (SELECT i, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM s{n} GROUP BY i),
c{next} AS MATERIALIZED (SELECT i, coalesce(m{n}.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} USING (i)),"""

ORACLE = f"""
WITH p AS MATERIALIZED (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS i, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM p ORDER BY h LIMIT 16)),
{"".join(_ROUND.format(n=n, next=n + 1) for n in range(ROUNDS + 1))}
t AS (SELECT i, CAST(sum(d) AS BIGINT) AS x FROM a{ROUNDS} GROUP BY i)
SELECT vec_id, i AS cluster, d AS distance, x AS cluster_inertia, CAST((SELECT sum(x) FROM t) AS BIGINT) AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN t USING (i) JOIN c{ROUNDS} USING (i)
"""
