"""Nearest neighbours by inner product, with learned partitions.

On a bounded sample the nearest neighbours are linked to a graph, the graph is cut into balanced parts that keep
neighbours together, and a softmax classifier learns to tell from a vector in which parts its neighbours lie. Every row is
indexed under its most probable part. A query goes to its most probable parts; how many, is measured on sample queries the
classifier was not fitted on, so that a given share of their true neighbours is reached. What the parts hold is scored in
double precision on the given vectors, block against block.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.vectors import by_dim, matrix, number_type, packed
from docloom.session import materialize

#: The router is fitted on at most so many rows, those of least hash.
SAMPLE = 8192
#: Rows and queries in a block.
ROWS, QUERIES = 4096, 1024
#: Share of true neighbours that sample queries must reach; above the 0.9 that is asked for.
RECALL = 0.97


@dataclass(frozen=True)
class Router:
    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        return np.argsort(-(scaled(x) @ self.weights + self.bias), axis=1, kind="stable")


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbours(x: np.ndarray, y: np.ndarray, k: int, own: bool) -> np.ndarray:
    """The k rows of y with the largest inner product for each row of x, in no order."""
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ y.T
        if own:
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def spread_rows(x: np.ndarray, parts: int, first: int) -> np.ndarray:
    """Rows far from each other: each the one whose most similar among those before is least similar."""
    chosen = [first]
    closest = x @ x[first]
    while len(chosen) < parts:
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, x @ x[chosen[-1]])
    return np.array(chosen)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Cut the neighbour graph from random seeds and from spread ones; the cut that keeps more neighbours together."""
    seeds = [rng.choice(len(x), parts, replace=False), spread_rows(x, parts, int(rng.integers(len(x))))]
    cuts = [moved_parts(np.argmax(x @ x[s].T, axis=1), near, parts, rounds) for s in seeds]
    return max(cuts, key=lambda label: (label[near] == label[:, None]).mean())


def moved_parts(label: np.ndarray, near: np.ndarray, parts: int, rounds: int) -> np.ndarray:
    """Every node moves where most of its neighbours are, as far as parts have room."""
    n = len(label)
    room = int(np.ceil(1.1 * n / parts))
    heads = np.repeat(np.arange(n), near.shape[1])
    tails = near.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (heads, label[tails]), 1.0)
        np.add.at(votes, (tails, label[heads]), 1.0)
        votes[np.arange(n), label] += 0.5
        choices = np.argsort(-votes, axis=1, kind="stable")
        best = np.take_along_axis(votes, choices[:, :2], 1)
        free, new = np.full(parts, room), np.empty(n, np.int64)
        for v in np.argsort(best[:, 1] - best[:, 0], kind="stable"):
            part = next(c for c in choices[v] if free[c])
            free[part] -= 1
            new[v] = part
        if (new == label).all():
            break
        label = new
    return label


def fit_router(x: np.ndarray, parts: int, k: int = 20, target: float = RECALL, seed: int = 7) -> Router:
    """Fit on a sample; any sample is enough for right results, a better one for fewer probes."""
    n = len(x)
    parts = min(parts, max(1, n // 8))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), 1)
    rng = np.random.default_rng(seed)
    k = min(k, n - 1)
    near = neighbours(x, x, k, True)
    u = scaled(x)
    label = balanced_parts(u, near, parts, rng)
    # Where a row's neighbours are, and the row itself.
    goal = np.zeros((n, parts))
    np.add.at(goal, (np.repeat(np.arange(n), k), label[near.ravel()]), 1.0)
    np.add.at(goal, (np.arange(n), label), k / 2)
    goal /= goal.sum(axis=1, keepdims=True)
    held = rng.permutation(n)[: n // 5]
    train = np.setdiff1d(np.arange(n), held)
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    step = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, 121):
        z = u[train] @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - goal[train]) / len(train)
        for g, value, m, v in ((u[train].T @ error + 1e-6 * w, w, *step[:2]), (error.sum(axis=0), b, *step[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12)
    router = Router(w, b, parts)
    # The part a row is indexed under, as the index will have it, and how far down a query's list its neighbours' parts are.
    own = router.ranked(x)[:, 0]
    place = np.argsort(router.ranked(x[held]), axis=1, kind="stable")
    depth = np.take_along_axis(place, own[near[held]], axis=1)
    share = [(depth < m).mean() for m in range(1, parts + 1)]
    return Router(w, b, 1 + int(np.argmax(np.array(share) >= target)))


def nearest(
    df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 20, sample: int = SAMPLE, recall: float = RECALL
) -> DataFrame:
    """(query_id, rank, id, score): for every row that is_query holds of, the k nearest of the other rows found, ties by id.

    is_query is a condition on the column `id`. Rows whose vector is null, empty, zero or has null or non-finite components,
    or whose id is null, take no part, neither do vectors of another length than the query's. An id counts once, with its
    best vector. Fewer candidates than k give fewer rows; none, no rows.
    """
    spark = df.sparkSession
    dtype = number_type(df, vector)
    rows = materialize(packed(df, key, vector).where("x is not null and id is not null"), "ann-vectors")
    routers: dict[int, Router] = {}
    for dim, n in rows.groupBy("dim").agg(F.count("*").alias("n")).collect():
        some = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id", "x"), "id").limit(sample).toPandas()
        routers[dim] = fit_router(matrix(some["x"].tolist(), dtype), int(np.clip(np.sqrt(n) / 16, 8, 256)), k, recall)
    shared = spark.sparkContext.broadcast({dim: (r.weights, r.bias, r.probes) for dim, r in routers.items()})

    def route(queries: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, at, x in by_dim(batch, 1, dtype, 2):
                    router = Router(*shared.value[dim])
                    parts = router.ranked(x)[:, : router.probes if queries else 1]
                    part = batch.take(pa.array(np.repeat(at, parts.shape[1])))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(parts.ravel().astype(np.int32))], ["id", "dim", "x", "part"])

        return run

    def blocks(routed: DataFrame, most: int, name: str) -> DataFrame:
        """Rows of one part, packed by so many at most. A large part is dealt to several tasks first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = {"dim": pa.int32(), "part": pa.int32(), "ids": pa.binary(), "xs": pa.binary()}
            held: dict[tuple[int, int], tuple[list, list]] = {}

            def packed_row(group, ids, xs):
                one = {"dim": group[0], "part": group[1], "ids": np.array(ids, np.int64).tobytes(), "xs": b"".join(xs)}
                return pa.RecordBatch.from_pylist([one], schema=pa.schema(kinds))

            for batch in batches:
                for i, dim, x, part, _ in zip(*(c.to_pylist() for c in batch.columns)):
                    ids, xs = held.setdefault((dim, part), ([], []))
                    ids.append(i)
                    xs.append(x)
                    if len(ids) == most:
                        yield packed_row((dim, part), *held.pop((dim, part)))
            for group, (ids, xs) in held.items():
                yield packed_row(group, ids, xs)

        sizes = routed.groupBy("dim", "part").agg(F.ceil(F.count("*") / (4 * most)).cast("int").alias("shares"))
        sized = routed.join(sizes, ["dim", "part"])
        sized = sized.select("id", "dim", "x", "part", F.pmod(F.xxhash64("id"), F.col("shares")).alias("share"))
        dealt = sized.repartition("dim", "part", "share").sortWithinPartitions("dim", "part", "share", "id")
        out = dealt.mapInArrow(run, "dim int, part int, ids binary, xs binary")
        return materialize(out.withColumn("block", F.monotonically_increasing_id()), name)

    schema = "id long, dim int, x binary, part int"
    held = blocks(rows.select("id", "dim", "x").mapInArrow(route(False), schema), ROWS, "ann-blocks")
    asked = blocks(rows.where(is_query).select("id", "dim", "x").mapInArrow(route(True), schema), QUERIES, "ann-queries")
    pairs = held.select("dim", "part", "block").join(asked.select("dim", "part", F.col("block").alias("q_block")), ["dim", "part"])
    cells = pairs.join(held.select("block", "ids", "xs"), "block")
    cells = cells.join(asked.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("xs").alias("q_xs")), "q_block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(nearest):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in nearest], ["query_id", "id", "score"])

        # Blocks of rows for one block of queries come one after another, and leave the k nearest of all of them.
        now, held = None, None
        for batch in batches:
            for dim, ids, xs, block, q_ids, q_xs in zip(*batch.columns):
                ids, q_ids = (np.frombuffer(c.as_buffer(), np.int64) for c in (ids, q_ids))
                x, q = (np.frombuffer(c.as_buffer(), dtype).reshape(-1, dim.as_py()).astype(np.float64) for c in (xs, q_xs))
                if held is not None and now != block.as_py():
                    yield given(held)
                    held = None
                now = block.as_py()
                parts = [best(q_ids[at : at + 128], q[at : at + 128], ids, x, k) for at in range(0, len(q), 128)]
                held = first_of([*parts, held] if held is not None else parts, k)
        if held is not None:
            yield given(held)

    found = cells.select("dim", "ids", "xs", "q_block", "q_ids", "q_xs").mapInArrow(score, "query_id long, id long, score double")
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def first_of(found: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, score) the k first of each query, highest score first, ties by id; an id counts once, at its best."""
    q, ids, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((-score, ids, q))
    q, ids, score = q[order], ids[order], score[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    q, ids, score = q[once], ids[once], score[once]
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[keep], ids[keep], score[keep]


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k nearest rows for each query; what ties with the last of them is decided exactly."""
    s = q @ x.T
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    # Rows that repeat an id take places of their own until they are counted once.
    places = k + len(ids) - len(np.unique(ids))
    if len(ids) > places:
        bar = -np.partition(-s, places - 1, axis=1)[:, places - 1 : places]
        # A product's order of summation differs from the exact one by far less than this.
        slack = 1e-9 * np.sqrt((q * q).sum(axis=1, keepdims=True) * (x * x).sum(axis=1).max())
        i, j = np.nonzero((s >= bar - slack) & (s > -np.inf))
    else:
        i, j = np.nonzero(s > -np.inf)
    exact = np.concatenate([(q[i[a : a + 65536]] * x[j[a : a + 65536]]).sum(axis=1) for a in range(0, len(i), 65536)] or [np.zeros(0)])
    return first_of([(q_ids[i], ids[j], exact)], k)
