"""Near-duplicate vectors: all pairs of at least a given cosine, by tiles in the order of principal axes.

Equal vectors are one class first. Classes are turned into the basis of principal axes, ordered along the first and packed
into tiles of some thousands. Two unit vectors of cosine t are no further apart than sqrt(2 - 2 t) along any axis, so only
tiles whose ranges on the first axis come that close are compared. Within a pair of tiles the leading coordinates are
multiplied first; what the rest can still add is at most the product of the two rest lengths, and a pair is dropped as
soon as that can't lift it to the threshold. The few that are left are decided on the given vectors in double precision.

A pair of tiles gives its rows' numbers of links and a spanning forest of the links, never the links themselves.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.vectors import by_dim, matrix, number_type, packed, principal_axes, unit
from docloom.session import materialize

TILE = 4096
#: How many leading coordinates are in after each step; all come after the last.
STEPS = (16, 32)
#: More than what rounding can take from a bound.
SLACK32, SLACK64 = 1e-4, 1e-9


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y."""
    return (unit(x) * unit(y)).sum(axis=1)


def _bounded(p: np.ndarray, k: int) -> np.ndarray:
    """The leading k coordinates and the length of the rest: the product of two such rows bounds their cosine."""
    rest = np.sqrt(np.maximum((p[:, k:] ** 2).sum(axis=1), 0.0))
    return np.column_stack([p[:, :k], rest])


def linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of x, j of y) with a cosine of at least the threshold; within one tile each pair once, i < j."""
    p, q = unit(x) @ axes, unit(y) @ axes
    steps = [k for k in STEPS if k < p.shape[1]]
    first = steps[0] if steps else p.shape[1]
    a, b = _bounded(p, first).astype(np.float32), _bounded(q, first).astype(np.float32)
    found_i, found_j = [], []
    for at in range(0, len(a), 512):
        i, j = np.nonzero(a[at : at + 512] @ b.T >= threshold - SLACK32)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        for k in steps[1:]:
            pk, qk = _bounded(p, k), _bounded(q, k)
            keep = np.einsum("ij,ij->i", pk[i], qk[j]) >= threshold - SLACK64
            i, j = i[keep], j[keep]
        found_i.append(i)
        found_j.append(j)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    good = [cosines(x[i[s : s + 65536]], y[j[s : s + 65536]]) >= threshold for s in range(0, len(i), 65536)]
    good = np.concatenate(good) if good else np.zeros(0, bool)
    return i[good], j[good]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that the links reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tiles(classes: DataFrame, axes: dict[int, np.ndarray], dtype: np.dtype) -> DataFrame:
    """(dim, lo, hi, ids, weights, xs): classes in the order of the first axis, packed."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast({dim: basis[:, 0].copy() for dim, basis in axes.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.zeros(batch.num_rows)
            for dim, rows, x in by_dim(batch, 1, dtype, 2):
                at[rows] = unit(x) @ shared.value[dim]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], ["id", "dim", "x", "n", "at"])

    placed = classes.select("id", "dim", "x", "n").mapInArrow(place, "id long, dim int, x binary, n long, at double")
    counts = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    cuts = {}
    for dim, n in counts.items():
        parts = -(-n // TILE)
        shares = [k / parts for k in range(1, parts)]
        own = placed.where(F.col("dim") == dim)
        cuts[dim] = own.agg(F.percentile_approx("at", shares, 20 * parts).alias("c")).first().c if shares else []

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, at = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            tile = np.zeros(len(at), np.int32)
            for dim in np.unique(dims):
                rows = dims == dim
                tile[rows] = np.searchsorted(np.array(cuts[dim], float), at[rows], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], [*batch.schema.names, "tile"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def flush():
            rows = pa.Table.from_batches(waiting)
            at = rows["at"].to_numpy()
            one = {
                "dim": rows["dim"][0].as_py(),
                "lo": at.min(),
                "hi": at.max(),
                "ids": rows["id"].to_numpy().tobytes(),
                "weights": rows["n"].to_numpy().tobytes(),
                "xs": b"".join(rows["x"].to_pylist()),
            }
            waiting.clear()
            return pa.RecordBatch.from_pylist([one], schema=packed_schema)

        for batch in batches:
            dims, tile = batch.column(1).to_numpy(), batch.column(5).to_numpy()
            edges = np.flatnonzero((np.diff(dims) != 0) | (np.diff(tile) != 0)) + 1
            for s, e in zip([0, *edges], [*edges, len(tile)]):
                for k in range(s, e, TILE):
                    part = batch.slice(k, min(TILE, e - k))
                    held = sum(b.num_rows for b in waiting)
                    if held and ((waiting[0].column(1)[0], waiting[0].column(5)[0]) != (part.column(1)[0], part.column(5)[0]) or held + part.num_rows > TILE + TILE // 4):
                        yield flush()
                    waiting.append(part)
        if waiting:
            yield flush()

    packed_schema = pa.schema([("dim", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.binary()), ("weights", pa.binary()), ("xs", pa.binary())])
    numbered = placed.mapInArrow(number, "id long, dim int, x binary, n long, at double, tile int")
    dealt = numbered.repartition("dim", "tile").sortWithinPartitions("dim", "tile", "id")
    return dealt.mapInArrow(pack, "dim int, lo double, hi double, ids binary, weights binary, xs binary")


def near_duplicate_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Two vectors are linked when their cosine is at least the threshold, in double precision. n_links is the number of other
    rows linked directly, equal vectors included; component_id the smallest id that links reach. Vectors that are null,
    empty, zero or have null or non-finite components are linked with nothing, and so are vectors of different lengths.
    A row without id counts as a link of others, but its own component_id is null unless it is linked. Rows that share an
    id count as rows for n_links and as one node for component_id.
    """
    dtype = number_type(df, vector)
    rows = materialize(packed(df, key, vector), "vectors")
    valid = rows.where("x is not null")
    classes = materialize(valid.groupBy("dim", "x").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    axes = principal_axes(classes, dtype)
    spark = df.sparkSession
    packs = materialize(tiles(classes, axes, dtype).withColumn("tile", F.monotonically_increasing_id()), "vector-tiles")

    # Which tiles come close enough on the first axis: in the order of their lower ends, a run after each tile.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK64
    ends = sorted(((r.dim, r.lo, r.hi, r.tile) for r in packs.select("dim", "lo", "hi", "tile").collect()))
    lows = {dim: np.array([e[1] for e in ends if e[0] == dim]) for dim in axes}
    base = {dim: next((k for k, e in enumerate(ends) if e[0] == dim), 0) for dim in axes}
    runs = [(k, tile, base[dim] + int(np.searchsorted(lows[dim], hi + reach, "right")) - 1) for k, (dim, lo, hi, tile) in enumerate(ends)]
    order = spark.createDataFrame(runs, "k long, tile long, last long")
    pairs = order.select(F.col("tile").alias("tile_a"), F.explode(F.sequence("k", "last")).alias("k"))
    pairs = pairs.join(order.select("k", F.col("tile").alias("tile_b")), "k").drop("k")
    side = lambda s: packs.select(F.col("tile").alias(f"tile_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "weights", "xs")], *(["dim"] if s == "a" else []))
    cells = pairs.join(side("a"), "tile_a").join(side("b"), "tile_b")
    shared = spark.sparkContext.broadcast(axes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {name: batch.column(name)[r].as_py() for name in batch.schema.names}
                same = cell["tile_a"] == cell["tile_b"]
                axes_here = shared.value[cell["dim"]]
                x, y = (matrix([cell[f"xs_{s}"]], dtype).reshape(-1, cell["dim"]) for s in "ab")
                ids_a, ids_b, w_a, w_b = (np.frombuffer(cell[c], np.int64) for c in ("ids_a", "ids_b", "weights_a", "weights_b"))
                i, j = linked(x, y, axes_here, threshold, same)
                j = j if same else j + len(ids_a)
                ids, weights = (ids_a, w_a) if same else (np.concatenate([ids_a, ids_b]), np.concatenate([w_a, w_b]))
                links = np.bincount(i, weights[j], len(ids)) + np.bincount(j, weights[i], len(ids))
                root = ids[forest(len(ids), i, j)]
                some = np.flatnonzero(links > 0)
                columns = [pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "links", "root"])

    found = materialize(cells.mapInArrow(compare, "id long, links long, root long"), "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = components(found, "id", "root", "vector-components")

    # Classes to their rows; the component is the smallest row id of its classes.
    sized = classes.join(links, "id", "left").join(of.withColumnRenamed("node", "id"), "id", "left")
    sized = sized.select("dim", "x", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("class"))
    least = sized.groupBy("class").agg(F.min("least").alias("component_id"))
    labelled = sized.join(least, "class").select("dim", "x", "n_links", "component_id")
    out = rows.join(labelled, (rows.x == labelled.x) & (rows.dim == labelled.dim), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
