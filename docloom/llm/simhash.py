"""Fingerprints of documents whose Hamming distance tells how alike their texts are, and the search for close ones.

The terms of a text are its distinct shingles of five words, each weighted by how often it comes: one more for every doubling.
A term's hash of 128 bits votes with its weight, for a bit that is set and against one that is not; the sign of the sum is the
fingerprint's bit. The chance that a bit differs is the angle between the weighted term vectors, as a share of a half turn.

Fingerprints within a radius are found by block tables. A fingerprint has `radius` + 2 blocks; two that differ in at most
`radius` bits agree on two blocks at least, so they meet in the table that has these two in front. Equal fingerprints are one
before. A bucket of a table is compared bit by bit, in tiles of bounded size that are groups of their own; a pair counts in the
first table that it meets in. What comes out is counts and enough links to join what is joined: never pairs.
"""

from collections.abc import Iterator
from hashlib import md5, sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.minhash import grouped
from docloom.llm.worker import freeing, text_parts
from docloom.session import materialize

HALVES = 2
WORDS = 5
RADIUS = 4
#: Members of a tile.
TILE = 2048
#: Rows of votes that fit a byte each.
LANE = 255
#: Terms that vote at once, and words whose hashes a task keeps.
VOTERS = 51 * LANE
KNOWN = 300_000
#: What is hashed before a word, by its position in a shingle.
PLACES = [b"%d:" % at for at in range(WORDS)]
WHITE = " \t\n\v\f\r"


class WordHashes(dict):
    """For a word the place of its hashes, one for each position in a shingle, of 128 bits each."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self):
        self.clear()
        self.data = bytearray()

    def table(self) -> np.ndarray:
        """The hashes by place. Not to be held while words are added."""
        return np.frombuffer(self.data, "<u8").reshape(-1, WORDS, HALVES)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        for before in PLACES:
            self.data += md5(before + word, usedforsecurity=False).digest()
        return n


def terms(known: WordHashes, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct shingles of a text and their weights.

    Words are the runs of anything but ASCII white space, A-Z lower-cased. A text of fewer words is one shingle; one
    without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(known) > KNOWN:
        known.forget()
    at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    size = min(WORDS, len(at))
    if not size:
        return np.zeros((0, HALVES), np.uint64), np.zeros(0, np.int64)
    n = len(at) - size + 1
    table = known.table()
    hashes = table[at[:n], 0]
    for k in range(1, size):
        hashes ^= table[at[k : n + k], k]
    _, first, often = np.unique(hashes[:, 0], return_index=True, return_counts=True)
    return hashes[first], np.frexp(often)[1].astype(np.int64)


def votes(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each bit of a hash the summed weight of those that have it set."""
    total = np.zeros(64 * HALVES, np.int64)
    for weight in np.unique(weights):
        own = hashes[weights == weight]
        for at in range(0, len(own), VOTERS):
            rows = own[at : at + VOTERS]
            full = len(rows) // LANE * LANE
            bits = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")
            # Eight bits' sums are added at once, each in a byte that cannot overflow.
            lanes = bits[:full].view(np.uint64).reshape(-1, LANE, 8 * HALVES).sum(axis=1, dtype=np.uint64)
            total += weight * (lanes.view(np.uint8).reshape(-1, 64 * HALVES).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.int64))
    return total


def fingerprint(known: WordHashes, text: str | None) -> tuple[int, int]:
    """The upper and the lower half of a text's fingerprint, as signed numbers; a tie leaves a bit unset, and a text without
    words has no bit set."""
    hashes, weights = terms(known, text)
    signs = 2 * votes(hashes, weights) > weights.sum()
    upper, lower = np.packbits(signs, bitorder="little").view(np.int64).tolist()
    return upper, lower


def likeness(a: tuple[int, int], b: tuple[int, int]) -> float:
    """The share of bits in which two fingerprints agree."""
    differ = sum(((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() for x, y in zip(a, b))
    return 1 - differ / (64 * HALVES)


def shown(upper: Column, lower: Column) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(upper), 16, "0"), F.lpad(F.hex(lower), 16, "0")))


def edited(text: str, following: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the beginning of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, n_terms, upper, lower) of every row. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in text_parts(batches, 1):
            texts = batch.column(1).to_pylist()
            prints = [fingerprint(known, t) for t in texts]
            has = [bool(t and t.strip(WHITE)) for t in texts]
            columns = [pa.array([len(t or "") for t in texts], pa.int64()), pa.array(has, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *(pa.array(c, pa.int64()) for c in zip(*prints))], ["id", "n_chars", "has_words", "upper", "lower"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(freeing(run), "id long, n_chars long, has_words boolean, upper long, lower long")


#: What is told of a text and its edited form; what a range of texts leaves open carries the text along.
_OUT = [
    ("id", pa.int64(), "long"),
    ("n_chars", pa.int64(), "long"),
    ("has_words", pa.bool_(), "boolean"),
    ("upper", pa.int64(), "long"),
    ("lower", pa.int64(), "long"),
    ("edited_sha256", pa.string(), "string"),
    ("edited_upper", pa.int64(), "long"),
    ("edited_lower", pa.int64(), "long"),
    ("near_edited", pa.float64(), "double"),
    ("near_next", pa.float64(), "double"),
    ("part", pa.int32(), "int"),
    ("end", pa.string(), "string"),
    ("text", pa.string(), "string"),
]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_OUT)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind, _) in zip(columns, _OUT)], [name for name, *_ in _OUT])


def _compared(known: WordHashes, row: tuple, text: str, own: tuple[int, int], following: str, other: tuple[int, int]) -> tuple:
    new = edited(text, following)
    theirs = own if new == text else fingerprint(known, new)
    digest = sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return (*row, *own, digest, *theirs, likeness(own, theirs), likeness(own, other), None, None, None)


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, has_words, upper, lower, edited_sha256, edited_upper, edited_lower, near_edited, near_next) of every row.

    The rows stand in descending order of their ids, rows without id last, rows of one id in the order of a hash of their texts; after
    the last comes the first. They are dealt out in ranges of that order with their texts, once; a range is worked through as
    it streams by. Only a range's first text and its last are joined with those of the ranges beside it.
    A null text is an empty one. An only row follows itself; an empty table gives an empty result.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mix", F.xxhash64("text"))
    order = [F.col("id").desc_nulls_last(), F.col("mix")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        known, last = WordHashes(), None
        for batch in text_parts(batches, 1):
            out = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = last[2] if last and last[1] == t else fingerprint(known, t)
                row = (i, len(t), bool(t.strip(WHITE)))
                if last is None:
                    out.append((*row, *own, *[None] * 5, part, "first", t))
                else:
                    out.append(_compared(known, *last, t, own))
                last = row, t, own
            yield _batch(out)
        if last:
            row, t, own = last
            yield _batch([(*row, *own, *[None] * 5, part, "last", t)])

    schema = ", ".join(f"`{name}` {kind}" for name, _, kind in _OUT)
    found = materialize(dealt.mapInArrow(freeing(run), schema), "fingerprints")
    # The driver gets the numbers of the ranges that have rows.
    parts = sorted(r.part for r in found.where("end = 'first'").select("part").collect())
    told = [name for name, *_ in _OUT[:-3]]
    if not parts:
        return found.select(told)
    steps = df.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], parts[0]])), "part int, next int")
    first = found.where("end = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("upper").alias("u"), F.col("lower").alias("l"))
    last = found.where("end = 'last'").select("part", "id", "n_chars", "has_words", "upper", "lower", "text")

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out = []
            for i, n, has, upper, lower, t, following, u, low in zip(*(c.to_pylist() for c in batch.columns)):
                out.append(_compared(known, (i, n, has), t, (upper, lower), following, (u, low)))
            yield _batch(out)

    ends = last.join(steps, "part").join(first, "next").select("id", "n_chars", "has_words", "upper", "lower", "text", "following", "u", "l")
    return found.where("end is null").select(told).unionByName(ends.mapInArrow(stitch, schema).select(told))


def block_bounds(blocks: int) -> list[tuple[int, int, int]]:
    """(half, first bit, bits) of blocks that cut both halves of a fingerprint as evenly as can be; each lies in one half."""
    out = []
    for half in range(HALVES):
        count = blocks // HALVES + (half < blocks % HALVES)
        cuts = [64 * k // count for k in range(count + 1)]
        out += [(half, a, b - a) for a, b in zip(cuts, cuts[1:])]
    return out


def near_fingerprints(df: DataFrame, key: str = "id", radius: int = RADIUS) -> DataFrame:
    """(id, n_near, group_id) of every different id: how many other rows have a fingerprint within the radius, and the smallest
    id that such links reach, its own included.

    df: the key, upper, lower, has_words. What has no words is linked with nothing; rows without id take no part. Of an id of
    several rows each counts, also as the others' neighbour. The radius is at least 1.
    """
    if radius < 1:
        raise ValueError("equal fingerprints need no search")
    blocks = block_bounds(radius + 2)
    tables = list(combinations(range(len(blocks)), 2))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), "upper", "lower", "has_words")
    worded = rows.where("has_words")
    classes = materialize(worded.groupBy("upper", "lower").agg(F.count("*").alias("copies"), F.min("id").alias("class")), "fingerprint-classes")

    def block(k: int) -> Column:
        half, first, bits = blocks[k]
        value = F.shiftrightunsigned(("upper", "lower")[half], first)
        return value.bitwiseAND(F.lit((1 << bits) - 1)) if bits < 64 else value

    # Two classes may have one smallest id, so a class is known by its fingerprint.
    fronts = [F.struct(F.lit(t).alias("t"), block(a).alias("x"), block(b).alias("y")) for t, (a, b) in enumerate(tables)]
    cells = classes.select(F.explode(F.array(*fronts)).alias("front"), "class", "copies", "upper", "lower").select("front.*", "class", "copies", "upper", "lower")
    bucket = ["t", "x", "y"]
    sizes = cells.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes.select(*bucket, F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "shared-blocks")
    own = F.pmod(F.xxhash64("upper", "lower"), F.col("tiles")).cast("int")
    members = cells.join(sizes, bucket).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    members = members.select(*bucket, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "copies", "upper", "lower")
    dealt = members.repartition(*bucket, "i", "j").sortWithinPartitions(*bucket, "i", "j")
    masks = np.zeros((len(blocks), HALVES), np.uint64)
    for k, (half, first, bits) in enumerate(blocks):
        masks[k, half] = ((1 << bits) - 1) << first

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 5):
            table, i, j = group[0][0], group[0][3], group[0][4]
            own, ids, copies, upper, lower = (np.array([r[k] for r in group], np.int64) for k in range(5, 10))
            prints = np.column_stack([upper, lower]).view(np.uint64)
            near, links = within(prints, copies, own == i, own == j, i == j, radius, masks, tables[table])
            some = np.flatnonzero(near)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (upper[some], lower[some], near[some])] + [pa.nulls(len(some), pa.int64())] * 2, names)
            a, b = (ids[np.array([link[k] for link in links], np.int64)] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(links), pa.int64())] * 3 + [pa.array(a), pa.array(b)], names)

    names = ["upper", "lower", "near", "a", "b"]
    found = materialize(dealt.mapInArrow(freeing(compare), ", ".join(f"{n} long" for n in names)), "near-fingerprints")
    near = found.where("near is not null").groupBy("upper", "lower").agg(F.sum("near").alias("near"))
    counted = classes.join(near, ["upper", "lower"], "left").select("upper", "lower", "class", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n"))
    each = worded.join(counted, ["upper", "lower"]).select("id", "class", "n")
    # A class is linked with all its documents, and so are classes that one id has rows in.
    links = found.where("a is not null").select("a", "b").unionByName(each.select(F.col("class").alias("a"), F.col("id").alias("b")).where("a <> b").distinct())
    of = components(links, name="near-components").select(F.col("node").alias("id"), "component")
    known = rows.select("id").distinct().join(each.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(of, "id", "left")
    return known.select("id", F.coalesce("n", F.lit(0)).alias("n_near"), F.coalesce("component", "id").alias("group_id"))


def within(
    prints: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, radius: int, masks: np.ndarray, table: tuple[int, int]
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """What the pairs (x of left, y of right) within the radius, whose first two equal blocks are the table's, add to the near of
    each, and links that join all that they join. same: both sides are one tile, each pair counts once."""
    near = np.zeros(len(prints), np.int64)
    root = np.arange(len(prints))
    links = []
    ys = np.flatnonzero(right)
    for x in np.flatnonzero(left):
        others = ys[ys > x] if same else ys
        differ = prints[others] ^ prints[x]
        others, differ = (a[np.bitwise_count(differ).sum(axis=1) <= radius] for a in (others, differ))
        if not len(others):
            continue
        equal = ((differ[:, None, :] & masks) == 0).all(axis=2)
        first = equal.argmax(axis=1)
        equal[np.arange(len(equal)), first] = False
        others = others[(first == table[0]) & (equal.argmax(axis=1) == table[1])]
        near[x] += copies[others].sum()
        near[others] += copies[x]
        for y in others[np.unique(root[others], return_index=True)[1]]:
            if root[y] != root[x]:
                links.append((x, y))
                root[root == root[y]] = root[x]
    return near, links


def simhash(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of edited_fingerprints with their n_near and group_id; of rows without id those are null."""
    rows = materialize(edited_fingerprints(df, key, text), "edited-fingerprints")
    return rows.join(near_fingerprints(rows, "id", radius), "id", "left")
