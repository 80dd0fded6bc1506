"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index on their chunks, then confirmed exactly.

A document's set is its distinct five-word shingles. Its signature has 48 symbols of 16 bits, each the low bits of a
minimum of the set under another hash; two sets differ in a symbol with probability 1 - similarity. The 48 symbols are
12 chunks of 4. Two signatures that differ in at most 23 symbols have, by pigeonhole, a chunk with at most one error; so
each chunk is looked up under its 4 keys that leave one symbol out, and every such pair meets in a bucket. (A pair of
similarity 0.75 meets in some bucket but for one in ten million, whatever its distance.)

Equal sets are one class before anything is joined. A bucket does not emit its pairs. First every member is paired with
the bucket's smallest; confirmed pairs make components. Only buckets that still hold several components are compared
further, in tiles of bounded size: members are counted against those of other components, on full sets, and what comes out
is links that join two components. Sets are read again for the documents concerned only. Pairs within a component are
never needed, rows never more than members, and no bucket is capped.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.filters import possible_members
from docloom.llm.shingles import shingle_sets, spread
from docloom.llm.worker import freeing, gather, starts_of, text_parts
from docloom.session import materialize

SYMBOLS, CHUNK = 48, 4
#: Members of a tile, and the shingles they may have together on average.
TILE, TILE_SHINGLES = 2048, 1 << 22
_rng = np.random.default_rng(20240229)
ODD = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """48 symbols of 16 bits; hashes must not be empty."""
    least = np.full(SYMBOLS, ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        x = (hashes[at : at + 4096, None] ^ FLIP) * ODD
        np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=0), out=least)
    return (spread(least) & np.uint64(0xFFFF)).astype(np.uint16)


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature 48 keys: chunk, symbol left out, the three others. One to one, not hashed."""
    s = signatures.astype(np.int64).reshape(len(signatures), SYMBOLS // CHUNK, CHUNK)
    out = []
    for left_out in range(CHUNK):
        a, b, c = (s[:, :, k] for k in range(CHUNK) if k != left_out)
        combination = np.arange(SYMBOLS // CHUNK, dtype=np.int64) * CHUNK + left_out
        out.append((combination << 48) | (a << 32) | (b << 16) | c)
    return np.concatenate(out, axis=1)


def shingled(df: DataFrame, doc: str, text: str, words: int) -> DataFrame:
    """(id, n, set_key, signature) of every row; the last two are null for an empty set."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_parts(batches, 1):
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signatures = [signature(s).tobytes() if len(s) else None for s in sets]
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], names)

    names = ["id", "n", "set_key", "signature"]
    rows = df.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(freeing(run), "id long, n long, set_key binary, signature binary")


def buckets(classes: DataFrame) -> DataFrame:
    """(key, id) of every class, 48 rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            keys = bucket_keys(signatures)
            ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])

    return classes.select("id", "signature").mapInArrow(freeing(run), "key long, id long")


def sets_of(df: DataFrame, ids: DataFrame, doc: str, text: str, words: int) -> DataFrame:
    """(id, n, hashes) of the documents in `ids`, and of few others: their full sets. Texts are not shuffled for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_parts(batches, 1):
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "hashes"])

    rows = df.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"))
    return possible_members(rows, ids, "id").mapInArrow(freeing(run), "id long, n long, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                # The intersection is no larger than the smaller set, the union no smaller than the larger one.
                shared = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    x = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(freeing(compare), "a long, b long")


def links_across_components(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) linked, enough of them to join all components that links within buckets join.

    members: key, id, component, n, hashes, signature. A bucket with many members, or much in them, is cut into tiles, and
    each pair of tiles is a group of its own; groups are compared one by one as their rows stream by. Two members of
    different components are counted exactly, in the first bucket that they share only. What a group emits is no more than
    its members, since a link within a component is of no use.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    cells = members.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    columns = ["own", "id", "component", "signature", "hashes"]
    cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *columns)
    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            key, i, j = group[0][:3]
            own, ids, component = (np.array([r[k] for r in group], np.int64) for k in (3, 4, 5))
            signatures = np.frombuffer(b"".join(r[6] for r in group), np.uint16).reshape(-1, SYMBOLS)
            sets = [np.frombuffer(r[7], np.uint64) for r in group]
            links = linked_sets(key >> 48, signatures, sets, component, own == i, own == j, percent)
            yield pa.RecordBatch.from_arrays([pa.array(ids[[x for x, _ in links]], pa.int64()), pa.array(ids[[y for _, y in links]], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(freeing(run), "a long, b long").distinct()


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of b the first chunk and symbol left out that its signature shares with a, as numbered in keys; -1 without."""
    equal = (b == a).reshape(len(b), SYMBOLS // CHUNK, CHUNK)
    n = equal.sum(axis=2)
    chunk = (n >= CHUNK - 1).argmax(axis=1)
    rows = np.arange(len(b))
    left_out = np.where(n[rows, chunk] == CHUNK, 0, (~equal[rows, chunk]).argmax(axis=1))
    return np.where(n[rows, chunk] >= CHUNK - 1, chunk * CHUNK + left_out, -1)


def linked_sets(
    bucket: int, signatures: np.ndarray, sets: list[np.ndarray], component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """Links (x of left, y of right) between sets of different components, until none is left that joins two."""
    n = np.array([len(s) for s in sets])
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = starts_of(n)
    here = np.zeros(len(every), np.int32)
    component = component.copy()
    links = []
    for x in np.flatnonzero(left):
        # The intersection is no larger than the smaller set, the union no smaller than the larger one.
        near = right & (component != component[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        ys = np.flatnonzero(near)
        ys = ys[first_shared(signatures[x], signatures[ys]) == bucket]
        if not len(ys):
            continue
        own = place[starts[x] : starts[x] + n[x]]
        here[own] = 1
        shared = np.add.reduceat(here[place[gather(starts[ys], n[ys])]], starts_of(n[ys]))
        here[own] = 0
        for y in ys[100 * shared >= percent * (n[x] + n[ys] - shared)]:
            if component[y] != component[x]:
                links.append((int(x), int(y)))
                component[component == component[y]] = component[x]
    return links


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that are equal in the first columns, across batches."""
    run: list[tuple] = []
    for part in (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512)):
        for row in zip(*(c.to_pylist() for c in part.columns)):
            if run and row[:keys] != run[0][:keys]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: which group of near-duplicates it belongs to.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets; component_id is the smallest id
    that links reach, and kept marks it. The index is laid out for 75 percent and more. Whole texts of any length count.
    A document without words is linked with nothing. Rows of one id are one document, linked by any of its texts. A row
    without id takes no part: its component_id is null and kept is false. Other columns may have any name.
    """
    if percent < 75:
        raise ValueError("the signature index is laid out for similarities of 75 percent and more")
    rows = materialize(shingled(df, doc, text, words), "signatures")
    sets = rows.where(F.col("set_key").isNotNull() & F.col("id").isNotNull())
    members = sets.groupBy("set_key", "n", "signature").agg(F.min("id").alias("id"))
    classes = materialize(members, "shingle-classes")
    keys = buckets(classes)

    first = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    shared = materialize(keys.join(first, "key").select("key", "id", "a"), "shared-buckets")
    stars = shared.where("id > a").select("a", F.col("id").alias("b")).distinct()
    # Every member of a shared bucket is in a star, so these sets serve all pairs to come.
    hashes = materialize(sets_of(df, shared.select("id").distinct(), doc, text, words), "shingle-sets")
    links = materialize(confirmed(stars, hashes, percent), "links")

    # What the stars leave open: buckets whose other members are still of several components.
    of = components(links, name="star-components")
    rest = shared.where("id > a").join(of.withColumnRenamed("node", "id"), "id", "left")
    rest = rest.select("key", "id", F.coalesce("component", "id").alias("component"))
    open_keys = rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    more = links_across_components(rest.join(open_keys, "key").join(hashes, "id").join(classes.select("id", "signature"), "id"), percent)

    # A class is linked with all its documents, and so are classes that one id has texts in.
    same = sets.select("id", "set_key").distinct().join(classes.select("set_key", F.col("id").alias("a")), "set_key")
    same = same.where("id <> a").select("a", F.col("id").alias("b"))
    of = components(links.unionByName(more).unionByName(same), name="components")
    out = rows.join(of, rows.id == of.node, "left")
    component = F.coalesce("component", "id")
    return out.select(
        "id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
