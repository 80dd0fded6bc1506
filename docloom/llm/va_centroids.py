"""Centroid clustering over a VA-file: vectors as a few bits for each component, looked up before any vector is fetched.

Components are whole numbers. Each component's range is cut into cells that hold about as many vectors; a vector is
approximated by its cells, half a byte for each. For the centroids of a round two tables say, for every component, cell and
centroid, the least and the largest squared difference; what they add up to over a vector's cells is an interval that its squared
distance lies in. A vector whose nearest interval overlaps no other is assigned by its cells alone. The rest are fetched and compared
exactly, and so are vectors that move: a centroid's sum changes by those that come and go, and by no others. So a round
scans the narrow file of cells, and joins to the wide file only what is undecided or moves.

All arithmetic is on whole numbers: sums are added as decimals, divided by Python's integers on the driver, which holds the
centroids only.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize

SCALE = 256
#: Bits of a cell; two make a byte.
BITS = 4
CELLS = 1 << BITS
#: Beyond this a squared distance might not fit a long.
LARGEST = 1 << 27
#: Rows that are compared at once.
ROWS = 8192


def whole(vector: str, dim: int) -> Column:
    """floor(256 x) of every component; null for vectors of another length or with null or non-finite components.

    A component that large that a squared distance might not fit a long fails the job.
    """
    v = F.col(vector).cast("array<double>")
    usable = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    too_large = F.exists(v, lambda x: F.abs(x) >= LARGEST // SCALE)
    fail = F.raise_error(F.lit(f"a component reaches {LARGEST // SCALE}: its squared distance may not fit a long"))
    floors = F.transform(v, lambda x: F.floor(x * SCALE).cast("int"))
    return F.when(usable, F.when(too_large, fail.cast("array<int>")).otherwise(floors))


def packed(cells: np.ndarray) -> np.ndarray:
    """Cells of vectors as half bytes."""
    if cells.shape[1] % 2:
        cells = np.column_stack([cells, np.zeros(len(cells), np.uint8)])
    return cells[:, ::2] | (cells[:, 1::2] << BITS)


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.stack([rows & (CELLS - 1), rows >> BITS], axis=2).reshape(len(rows), -1)[:, :dim]


def binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


class Intervals:
    """Least and largest squared difference between each cell of each component and each centroid."""

    def __init__(self, low: np.ndarray, high: np.ndarray, centroids: np.ndarray):
        c = centroids.T[:, None, :]
        below, above = low[:, :, None] - c, c - high[:, :, None]
        self.least = np.maximum(np.maximum(below, above), 0) ** 2
        self.largest = np.maximum(np.abs(below), np.abs(above)) ** 2

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """For each vector and centroid whether it may be the nearest: no other's interval ends before its own begins."""
        least = np.zeros((len(cells), self.least.shape[2]), np.int64)
        largest = np.zeros_like(least)
        for d in range(cells.shape[1]):
            least += self.least[d][cells[:, d]]
            largest += self.largest[d][cells[:, d]]
        return least <= largest.min(axis=1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest candidate of each vector, ties to the smaller number, and its squared distance; exact."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    cluster = np.full(len(x), -1, np.int32)
    for k in np.flatnonzero(candidates.any(axis=0)):
        at = np.flatnonzero(candidates[:, k])
        distance = ((x[at] - centroids[k]) ** 2).sum(axis=1)
        closer = distance < best[at]
        best[at[closer]], cluster[at[closer]] = distance[closer], k
    return cluster, best


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), dim).astype(np.int64)


class VAFile:
    """The two files: cells of all vectors, and their components beside them, each row with a number of its own."""

    def __init__(self, df: DataFrame, key: str, vector: str, dim: int):
        """Cells are cut at quantiles over all rows; where they lie decides how much is fetched, never a result."""
        self.dim, self.spark = dim, df.sparkSession
        usable = df.select(F.col(key).cast("long").alias("id"), whole(vector, dim).alias("q")).where("q is not null")
        shares = [k / CELLS for k in range(1, CELLS)]
        ends = [f(F.col("q")[d]) for d in range(dim) for f in (F.min, F.max)]
        found = usable.agg(*ends, *[F.percentile_approx(F.col("q")[d], shares, F.lit(1000)) for d in range(dim)]).first()
        self.empty = found[0] is None
        if self.empty:
            return
        inner = np.array([list(found[2 * dim + d]) for d in range(dim)], np.int64)
        low, high = (np.array([found[2 * d + e] for d in range(dim)], np.int64) for e in (0, 1))
        # A cell reaches from above one bound to the next; the last one, that of all above, is open.
        self.low = np.column_stack([low, inner + 1])
        self.high = np.column_stack([inner, high])

        def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches):
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dim)
                cells = np.column_stack([np.searchsorted(inner[d], x[:, d]) for d in range(dim)]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], binary(packed(cells)), binary(x)], ["at", "id", "cells", "x"])

        rows = usable.select(F.monotonically_increasing_id().alias("at"), "id", "q")
        self.rows = materialize(rows.mapInArrow(approximate, "at long, id long, cells binary, x binary"), "va-file")

    def first_centroids(self, k: int, seed: str) -> np.ndarray:
        """The vectors of the k ids of smallest hash, equal ones by their components; rows without id come last."""
        mixed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
        chosen = self.rows.select(mixed.alias("mixed"), "x").orderBy(F.asc_nulls_last("mixed"), "x").limit(k).collect()
        return np.array([np.frombuffer(r.x, np.int32) for r in chosen], np.int64)

    def bounded(self, rows: DataFrame, centroids: np.ndarray) -> DataFrame:
        """rows (at, cells, was) with `now`: the centroid that the cells alone decide for, -1 if they leave it open."""
        dim, shared = self.dim, self.spark.sparkContext.broadcast(Intervals(self.low, self.high, centroids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches):
                may = shared.value.candidates(unpacked(batch.column(1), dim))
                now = np.where(may.sum(axis=1) == 1, may.argmax(axis=1), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(now)], ["at", "cells", "was", "now"])

        return rows.select("at", "cells", "was").mapInArrow(run, "at long, cells binary, was int, now int")

    def settled(self, rows: DataFrame, centroids: np.ndarray) -> DataFrame:
        """rows (at, cells, was, now, x) with `now` decided for all and the squared distance of each."""
        dim, shared = self.dim, self.spark.sparkContext.broadcast((Intervals(self.low, self.high, centroids), centroids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            intervals, centers = shared.value
            for batch in _pieces(batches):
                now = batch.column(3).to_numpy(zero_copy_only=False)
                may = np.zeros((len(now), len(centers)), bool)
                may[np.flatnonzero(now >= 0), now[now >= 0]] = True
                may[now < 0] = intervals.candidates(unpacked(batch.column(1).filter(pa.array(now < 0)), dim))
                now, distance = nearest(_vectors(batch.column(4), dim), centers, may)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(now), batch.column(4), pa.array(distance)], names)

        names = ["at", "cells", "was", "now", "x", "distance"]
        return rows.select("at", "cells", "was", "now", "x").mapInArrow(run, "at long, cells binary, was int, now int, x binary, distance long")

    def changes(self, moved: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
        """What the moved vectors add to the count and the sums of every centroid, as Python's integers."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches):
                was, now = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                x = np.column_stack([np.ones(len(was), np.int64), _vectors(batch.column(2), dim)])
                total = np.zeros((k, dim + 1), np.int64)
                np.add.at(total, now, x)
                np.subtract.at(total, was[was >= 0], x[was >= 0])
                cluster, component = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(component.astype(np.int32)), pa.array(total[cluster, component])], ["k", "d", "v"])

        parts = moved.select("was", "now", "x").mapInArrow(run, "k int, d int, v long")
        total = np.zeros((k, dim + 1), object)
        for r in parts.groupBy("k", "d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
            total[r.k, r.d] = int(r.v)
        return total[:, 0], total[:, 1:]


def clusters(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 40, rounds: int = 5, seed: str = "2") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Usable are vectors of exactly `dim` components, none null or non-finite, as floor(256 x). Centroids start as the usable
    vectors whose ids have the smallest hashes; there are fewer if there are fewer vectors. Each round assigns every vector
    to the nearest (squared distance, ties to the smaller number) and puts every non-empty centroid at floor(sum / count);
    then all are assigned once more. Rows of one id are vectors of their own, and so are rows without id; other
    columns are not read. Without a usable vector there are no rows.
    """
    va = VAFile(df, key, vector, dim)
    if va.empty:
        return df.sparkSession.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = va.first_centroids(k, seed)
    count, total = np.zeros(len(centroids), object), np.zeros((len(centroids), dim), object)
    narrow = None
    for _ in range(rounds):
        if narrow is None:
            # All vectors come to their first centroid, so all are read, and nothing needs a join.
            fetched, decided = va.rows.select("at", "cells", F.lit(-1).alias("was"), F.lit(-1).alias("now"), "x"), None
        else:
            decided = materialize(va.bounded(narrow, centroids), "va-decided")
            fetched = decided.where("now <> was").join(va.rows.select("at", "x"), "at")
        fetched = materialize(va.settled(fetched, centroids).drop("distance"), "va-fetched")
        more, sums = va.changes(fetched.where("now <> was"), len(centroids))
        count, total = count + more, total + sums
        narrow = fetched.select("at", "cells", F.col("now").alias("was"))
        if decided is not None:
            narrow = decided.where("now = was").select("at", "cells", "was").unionByName(narrow)
        narrow = materialize(narrow, "va-assigned")
        centroids = np.array([[int(s) // int(n) for s in row] if n else old for row, n, old in zip(total, count, centroids.tolist())], np.int64)
    # Every distance is asked for at the end, so all vectors are read; cells still decide for whom they are compared.
    rows = va.rows.select(F.col("id").alias("at"), "cells", F.lit(-1).alias("was"), F.lit(-1).alias("now"), "x")
    last = va.settled(rows, centroids).select(F.col("at").alias("id"), F.col("now").alias("cluster"), "distance")
    out = materialize(last, "va-clusters")
    inertia = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return out.select(
        "id",
        "cluster",
        "distance",
        at([inertia.get(c, 0) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        at(digests).alias("centroid_sha256"),
    )
