"""Toxicity: two Kneser-Ney models of characters, one of toxic and one of ordinary documents.

Texts become symbols of 32 kinds. A model of order five gives each symbol its probability after the four before it, by
absolute discounting: what a class has seen of five symbols counts for it alone, and all mass that discounting frees goes
to one lower-order model that both classes share. That is built from continuation counts, the numbers of different
symbols a sequence was seen after, down to single symbols; an expression that is rare, or unknown to both, is thereby
worth the same to either. A document is judged by how much likelier toxic makes its symbols than ordinary does, per
symbol: over the whole text, and in its most suspicious stretches. A logistic curve through these turns them into a score.

The counts cover every labelled row that may be learned from, whole texts. They are summed in Spark by sequence, of which
32^5 exist, so what is broadcast has a fixed bound: one byte for each, 32 MB. No text is shuffled for scoring. To learn,
labels meet texts in a join; a bitmap of fixed size keeps rows without a label out of its shuffle.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.filters import possible_members
from docloom.llm.worker import CHARS, starts_of, text_parts

ORDER, BITS = 5, 5
SYMBOLS = 1 << BITS
#: Log ratios are kept in sixteenths, up to 127 of them.
SCALE = 16.0
#: Symbols in a stretch, and the symbols without evidence that are added when its ratio is normalised by its length.
STRETCHES, PRIOR = (8, 40), 4
#: What a short stretch is counted as passing.
BARS = (0.3, 0.6, 1.0)
#: The curve is fitted on at most so many labelled rows, those of least hash. The counts know no bound.
FIT_ROWS = 20_000
DISCOUNT = 0.75


def _alphabet() -> np.ndarray:
    """Symbol of every code point below 0x250: 0 between words, letters without their accents, 27 for digits."""
    import unicodedata

    table = np.zeros(0x250, np.uint8)
    for cp in range(0x250):
        base = unicodedata.normalize("NFD", chr(cp).lower())[0]
        if "a" <= base <= "z":
            table[cp] = ord(base) - ord("a") + 1
        elif base.isdigit():
            table[cp] = 27
        elif base.isalpha():
            table[cp] = 28 + cp % 4
    return table


ALPHABET = _alphabet()


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, one after another, and how many each text has.

    Letters beyond the table share four symbols. Whatever stands between words is one 0, and so is a text's beginning.
    """
    joined = "\0".join(t or "" for t in texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t or "") + 1 for t in texts], np.int64)
    out = np.empty(len(cps) + 1, np.uint8)
    out[0] = 0
    low = cps < len(ALPHABET)
    out[1:] = np.where(low, ALPHABET[np.where(low, cps, 0)], 28 + (cps & 3))
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    starts = starts_of(sizes)
    # Every text keeps the 0 before its first symbol, even if the text before ends in one.
    keep[starts] = True
    ends = np.concatenate([[0], np.cumsum(keep)])
    bounds = np.concatenate([ends[starts], [ends[-1]]])
    return out[keep], np.diff(bounds)


def sequences(s: np.ndarray) -> np.ndarray:
    """At each symbol the number of the ORDER symbols that end with it, those before the first being 0."""
    g = s.astype(np.int32)
    out = g.copy()
    for k in range(1, ORDER):
        out[k:] |= g[:-k] << (BITS * k)
    return out


def _sequences_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    s, sizes = symbols(texts)
    g = sequences(s)
    # No sequence reaches back into the text before: what stands before a beginning is 0.
    starts = starts_of(sizes)
    for k in range(ORDER - 1):
        inside = starts[sizes > k] + k
        g[inside] &= (1 << (BITS * (k + 1))) - 1
    return g, sizes


def counts(labelled: DataFrame, text: str, toxic: str) -> DataFrame:
    """(seq, toxic, ordinary): how often each sequence occurs in the documents of either class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_parts(batches, 0, 4 * CHARS):
            g, sizes = _sequences_of(batch.column(0).to_pylist())
            bad = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            found, n = np.unique(g.astype(np.int64) * 2 + bad, return_counts=True)
            columns = [found >> 1, np.where(found & 1, n, 0), np.where(found & 1, 0, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["seq", "toxic", "ordinary"])

    rows = labelled.select(F.col(text).alias("text"), (F.col(toxic) > 0).cast("int").alias("toxic"))
    rows = rows.mapInArrow(run, "seq long, toxic long, ordinary long")
    return rows.groupBy("seq").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def lower_order(seen: np.ndarray) -> np.ndarray:
    """The shared model: probability of the last symbol of each four, from the sequences that either class has seen."""
    probability = np.zeros(0)
    for order in range(1, ORDER):
        types = np.zeros(1 << (BITS * (order + 1)), bool)
        types[seen & (len(types) - 1)] = True
        known = np.flatnonzero(types)
        # Continuation counts: how many different symbols a sequence was seen after.
        n = np.bincount(known & ((1 << (BITS * order)) - 1), minlength=1 << (BITS * order)).astype(np.float64)
        by_context = n.reshape(-1, SYMBOLS)
        total, kinds = by_context.sum(axis=1, keepdims=True), (by_context > 0).sum(axis=1, keepdims=True)
        rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        # The lower order knows a sequence by its last symbols: the same for all first symbols.
        below = np.tile(probability.reshape(-1, SYMBOLS), (SYMBOLS, 1)) if order > 1 else np.full((1, SYMBOLS), 1.0 / SYMBOLS)
        probability = (np.maximum(by_context - DISCOUNT, 0) / np.maximum(total, 1) + rest * below).ravel()
    return probability


def log_ratios(seq: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """For all sequences, how much likelier toxic makes the last symbol after the others, in sixteenths of a nat."""
    shared = lower_order(seq)
    contexts = 1 << (BITS * (ORDER - 1))
    out = np.zeros(1 << (BITS * ORDER), np.int8)
    total, rest, dense = [], [], []
    for n in (toxic, ordinary):
        sums = np.bincount(seq >> BITS, n, contexts)
        kinds = np.bincount(seq[n > 0] >> BITS, minlength=contexts)
        total.append(sums)
        rest.append(np.where(sums > 0, DISCOUNT * kinds / np.maximum(sums, 1), 1.0))
        dense.append(n)
    step = 1 << 15
    order = np.argsort(seq)
    seq, dense = seq[order], [n[order] for n in dense]
    for at in range(0, contexts, step):
        lo, hi = np.searchsorted(seq, [at << BITS, (at + step) << BITS])
        every = np.arange(at << BITS, (at + step) << BITS)
        below = shared[every & (contexts - 1)]
        logs = []
        for n, sums, left in zip(dense, total, rest):
            own = np.zeros(len(every))
            own[seq[lo:hi] - every[0]] = np.maximum(n[lo:hi] - DISCOUNT, 0)
            context = every >> BITS
            logs.append(np.log(own / np.maximum(sums[context], 1) + left[context] * below))
        out[every] = np.clip(np.rint((logs[0] - logs[1]) * SCALE), -127, 127).astype(np.int8)
    return out


def _features(ratios: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """For each text: the ratio per symbol; the highest of its stretches of each length; how many short stretches pass each
    bar, and how many that is of its length; the log of its length."""
    g, sizes = _sequences_of(texts)
    r = ratios[g].astype(np.float64) / SCALE
    starts, ends = starts_of(sizes), starts_of(sizes) + sizes
    sums = np.concatenate([[0.0], np.cumsum(r)])
    out = [(sums[ends] - sums[starts]) / (sizes + PRIOR)]
    at, last = np.arange(len(r)), np.repeat(ends, sizes)
    for width in STRETCHES:
        end = np.minimum(at + width, last)
        value = (sums[end] - sums[at]) / (end - at + PRIOR)
        out.append(np.maximum.reduceat(value, starts))
        if width == STRETCHES[0]:
            for bar in BARS:
                over = value > bar
                over[1:] &= ~over[:-1]
                n = np.add.reduceat(over.astype(np.float64), starts)
                out += [np.log1p(n), np.log((n + 0.5) / (sizes + 20))]
    out.append(np.log(sizes))
    return np.column_stack(out)


@dataclass(frozen=True)
class Curve:
    """Logistic regression: a constant and a weight for each feature."""

    weights: np.ndarray

    def __call__(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_curve(features: np.ndarray, label: np.ndarray, ridge: float = 1.0) -> Curve:
    """By Newton's method; each weight of a scaled feature is held by a normal prior of variance 1 / ridge, which many rows outweigh
    and few do not. With rows of one class only, that class's share; without rows, 0."""
    weights = np.zeros(features.shape[1] + 1)
    if len(set(label.tolist())) < 2:
        weights[0] = 30.0 if label.any() else -30.0
        return Curve(weights)
    x = np.column_stack([np.ones(len(features)), features])
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1.0
    x = x / scale
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (label - p) - ridge * weights * (np.arange(len(weights)) > 0)
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        weights = weights + np.linalg.solve(curve, slope)
    return Curve(weights / scale)


def scored(df: DataFrame, labels: DataFrame, learn: Column, judge: Column, doc: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(id, score, predicted) for every row of df.

    `learn` and `judge` are conditions on the column `id` that part the labelled documents: the models count the first, the
    curve is fitted on the second; labels of all others are never read. An id with several labels is toxic if one says so;
    null labels count for nothing. Null and empty texts are scored as a text of no symbols. Without labels of both classes
    there is nothing to tell them by: all rows get the one label there is, or 0.
    """
    spark = df.sparkSession
    known = labels.select(F.col(doc).cast("long").alias("id"), F.col(toxic).alias("toxic")).where("id is not null and toxic is not null")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).where(learn | judge)
    rows = df.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"))
    labelled = possible_members(rows, known, "id").join(known, "id")

    found = counts(labelled.where(learn), "text", "toxic").toPandas()
    ratios = log_ratios(*(found[c].to_numpy(np.int64) for c in ("seq", "toxic", "ordinary"))) if len(found) else np.zeros(1 << (BITS * ORDER), np.int8)
    shared = spark.sparkContext.broadcast(ratios)
    names = [f"f{k}" for k in range(len(STRETCHES) + 2 * len(BARS) + 2)]
    schema = ", ".join(f"{n} double" for n in names)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_parts(batches, 1):
            values = _features(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c) for c in values.T)], ["id", "toxic", *names])

    some = labelled.where(judge).select("id", "text", F.col("toxic").cast("int")).mapInArrow(features, f"id long, toxic int, {schema}")
    some = some.orderBy(F.xxhash64("id"), *names).limit(FIT_ROWS).toPandas()
    curve = fit_curve(some[names].to_numpy(float), (some["toxic"].to_numpy() > 0).astype(float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_parts(batches, 1):
            values = curve(_features(shared.value, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), pa.array((values >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return rows.mapInArrow(score, "id long, score double, predicted int")
