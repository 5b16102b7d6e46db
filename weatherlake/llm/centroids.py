"""Exact k-means over integer vectors with heap-ordered bounds.

A vector's upper bound is its distance to its centroid, its lower bound the distance to the next nearest one. When
centroids move, the gap between the two shrinks by at most the movement of its own centroid plus the largest movement
of the others. So each cluster keeps one number, the drift accumulated so far, and a heap of its vectors' gaps, each
offset by the drift at the time it was pushed: gaps that the drift has used up lie on top. A round pops those vectors
only, rescans them against all centroids and pushes them again; the rest keeps its cluster unread.

Vectors lie in blocks of ``BLOCK`` rows with their clusters and heaps, written after every round. Blocks return
per-cluster sums of what moved in and out, which Spark adds up; the driver sees k centroids and k sums, never a vector.
Distances and sums are integers, so clusters are exact: bounds are kept in floating point with a margin for rounding,
and ties go to the smaller number. A vector that ties is always rescanned.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out;
repeated rows are rows of their own; a null id hashes as the empty text; with fewer than k vectors there are as many
centroids as vectors; an empty table gives an empty result; extra columns are ignored. A component beyond
``2 ** 27`` after scaling stops the job, as distances would not fit 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherlake.llm.common import stored

BLOCK, LARGEST = 8192, 1 << 27
#: Relative room for rounding in bounds; distances themselves are exact.
MARGIN = 1e-9
STATE = "ids array<long>, vectors binary, width int, cluster binary, key binary, heap binary, sizes binary, moved array<long>"


def scaled(vectors: DataFrame, id_col: str, col: str, size: int, scale: int) -> DataFrame:
    """(id, v): whole vectors of ``size`` finite components, each as floor(scale * x)."""
    x = F.transform(F.col(col), lambda c: c.cast("double"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    whole = whole.filter((F.size("x") == size) & F.forall("x", fine))
    limit = float(LARGEST)
    return whole.select(
        "id",
        F.transform(
            "x",
            lambda c: F.when(F.abs(c * scale) <= limit, F.floor(c * scale)).otherwise(
                F.raise_error(F.lit("a vector's component is too large for exact distances")).cast("long")
            ),
        ).alias("v"),
    )


def first_centroids(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids hash lowest."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = whole.select("id", "v", mark.alias("mark")).orderBy("mark", "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def smallest_kind(x: np.ndarray) -> np.ndarray:
    """The array in the narrowest integers that hold it."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(np.int8 if top < 1 << 7 else np.int16 if top < 1 << 15 else np.int32)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every centroid, exact."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = x - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, and the gap between the distances of the second nearest and of the nearest."""
    d = distances(x, centroids)
    best = d.argmin(1)
    upper = np.sqrt(d[np.arange(len(x)), best].astype(float))
    d[np.arange(len(x)), best] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1).astype(float)) if d.shape[1] > 1 else np.full(len(x), np.inf)
    return best, lower - upper - MARGIN * (lower + upper if d.shape[1] > 1 else upper)


class Drift:
    """Centroids of a round and the drift each cluster has accumulated since the first."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.total = np.zeros(len(centroids))

    def move(self, to: np.ndarray) -> Drift:
        step = np.sqrt(((to - self.centroids).astype(float) ** 2).sum(1)) * (1 + MARGIN)
        others = np.array([np.delete(step, j).max(initial=0.0) for j in range(len(step))])
        out = Drift(to)
        out.total = self.total + step + others
        return out


class Heaps:
    """The clusters and gap heaps of one block."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, key: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.x, self.cluster, self.key, self.heaps = x, cluster, key, heaps

    @classmethod
    def start(cls, x: np.ndarray, drift: Drift) -> Heaps:
        cluster, gap = nearest(x, drift.centroids)
        heaps: list[list[tuple[float, int]]] = [[] for _ in drift.centroids]
        for i, (c, g) in enumerate(zip(cluster.tolist(), gap.tolist())):
            heaps[c].append((g, i))
        for h in heaps:
            heapq.heapify(h)
        return cls(x, cluster, gap, heaps)

    def round(self, drift: Drift) -> np.ndarray:
        """Pop, rescan and push again what the drift has used up; returns the places that were rescanned."""
        popped: list[int] = []
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift.total[c]:
                popped.append(heapq.heappop(heap)[1])
        at = np.array(popped, np.int64)
        if len(at):
            cluster, gap = nearest(self.x[at], drift.centroids)
            self.cluster[at] = cluster
            self.key[at] = gap + drift.total[cluster]
            for i, c, g in zip(popped, cluster.tolist(), self.key[at].tolist()):
                heapq.heappush(self.heaps[c], (g, i))
        return at

    def row(self, ids: list, moved: np.ndarray) -> list:
        order = np.array([i for h in self.heaps for _, i in h], np.uint16)
        sizes = np.array([len(h) for h in self.heaps], np.uint16)
        x = smallest_kind(self.x)
        cluster = self.cluster.astype(np.uint32)
        return [ids, x.tobytes(), x.itemsize, cluster.tobytes(), self.key.tobytes(), order.tobytes(), sizes.tobytes(), moved.ravel().tolist()]

    @classmethod
    def read(cls, row: list, size: int) -> Heaps:
        _, vectors, width, cluster, key, heap, sizes, _ = row
        x = np.frombuffer(vectors, f"i{width}").astype(np.int64).reshape(-1, size)
        key = np.frombuffer(key, float).copy()
        order = np.frombuffer(heap, np.uint16)
        cut = np.cumsum([0, *np.frombuffer(sizes, np.uint16).tolist()])
        heaps = [list(zip(key[order[i:j]].tolist(), order[i:j].tolist())) for i, j in zip(cut, cut[1:])]
        return cls(x, np.frombuffer(cluster, np.uint32).astype(np.int64), key, heaps)


def batch(rows: list[list]) -> pa.RecordBatch:
    names = [c.split(" ")[0] for c in STATE.split(", ")]
    kinds = [pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


def cluster_sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Per cluster: component sums and, last, the count."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    for c in np.unique(cluster).tolist():
        mine = x[cluster == c]
        out[c, :-1], out[c, -1] = mine.sum(0), len(mine)
    return out


def fit(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Blocks with the clusters after ``rounds`` rounds and a last assignment, and the final centroids."""
    spark = vectors.sparkSession
    whole = scaled(vectors, id_col, col, size, scale)
    centroids = first_centroids(whole, k, seed)
    drift = Drift(centroids if len(centroids) else np.zeros((0, size), np.int64))
    n = len(drift.centroids)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []

        def out(m: int) -> pa.RecordBatch:
            x = np.concatenate(held)
            block, held[:] = x[:m], [x[m:]]
            mine, ids[:] = ids[:m], ids[m:]
            h = Heaps.start(block, shared.value)
            return batch([h.row(mine, cluster_sums(block, h.cluster, n))])

        for b in batches:
            ids += b.column(0).to_pylist()
            held.append(b.column(1).flatten().to_numpy().reshape(-1, size))
            while len(ids) >= BLOCK:
                yield out(BLOCK)
        if ids:
            yield out(len(ids))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                h = Heaps.read(list(row), size)
                before = h.cluster.copy()
                at = h.round(shared.value)
                at = at[h.cluster[at] != before[at]]
                moved = cluster_sums(h.x[at], h.cluster[at], n) - cluster_sums(h.x[at], before[at], n)
                yield batch([h.row(row[0], moved)])

    shared = spark.sparkContext.broadcast(drift)
    blocks = stored(whole.mapInArrow(begin, STATE), "clusters")
    sums = np.zeros((n, size + 1), np.int64)
    for _ in range(rounds if n else 0):
        # k * (size + 1) sums of the blocks' changes
        change = blocks.select(F.posexplode("moved").alias("i", "m")).groupBy("i").agg(F.sum("m").alias("m")).collect()
        for r in change:
            sums.flat[r["i"]] += r["m"]
        held = sums[:, -1] > 0
        to = drift.centroids.copy()
        to[held] = sums[held, :-1] // sums[held, -1:]
        drift = drift.move(to)
        shared = spark.sparkContext.broadcast(drift)
        blocks = stored(blocks.mapInArrow(step, STATE), "clusters")
    return blocks, drift.centroids


def assign(blocks: DataFrame, centroids: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    """(id, cluster, distance) of every vector."""
    shared = blocks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, vectors, width, cluster in zip(*(c.to_pylist() for c in b.columns)):
                c = np.frombuffer(cluster, np.uint32)
                d = np.frombuffer(vectors, f"i{width}").astype(np.int64).reshape(len(ids), -1) - shared.value[c]
                values = [pa.array(ids, pa.int64()), pa.array(c.astype(np.int32)), pa.array(np.einsum("ij,ij->i", d, d))]
                yield pa.RecordBatch.from_arrays(values, names=[id_col, "cluster", "distance"])

    return blocks.select("ids", "vectors", "width", "cluster").mapInArrow(run, f"{id_col} long, cluster int, distance long")


def clusters(vectors: DataFrame, id_col: str = "vec_id", **how) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every vector; see ``fit`` for the parameters."""
    blocks, centroids = fit(vectors, id_col=id_col, **how)
    rows = stored(assign(blocks, centroids, id_col), "distances")
    each = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    facts = [(c, d, sum(each.values()), centroids[c].tolist()) for c, d in each.items()]
    of = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    # one row per cluster
    return rows.join(F.broadcast(of), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid")
