"""Vector expressions and the two embedders: hashed word counts (built in) and a user's model.

An embedder has two methods: `embed` adds a vector per text, and `similarities` scores an array of texts
against a vector in the same row. Both are given texts whose whitespace is already collapsed, which chunks,
sentences and questions are.
"""

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import lower_words
from docloom.model import EMBED_BATCH

#: Bytes of texts whose words are counted at once.
COUNT_BYTES = 8 << 20


def word_counts(texts: pa.Array, hex_digits: int) -> np.ndarray:
    """How many words of each text, which are parted by spaces, have each bucket: a row for a text. A distinct word is hashed once."""
    dim = 16**hex_digits
    words = pc.split_pattern(texts, " ")
    spelled = words.flatten().dictionary_encode()
    bytes_, odd = (hex_digits + 1) // 2, hex_digits % 2
    # Nothing between two spaces is no word.
    known = (int.from_bytes(hashlib.md5(w).digest()[:bytes_]) >> 4 * odd if w else -1 for w in spelled.dictionary.cast(pa.binary()).to_pylist())
    bucket = np.fromiter(known, np.int64, len(spelled.dictionary))[spelled.indices.to_numpy()]
    place = np.repeat(np.arange(len(texts)) * dim, pc.fill_null(words.value_lengths(), 0).to_numpy())
    return np.bincount((place + bucket)[bucket >= 0], minlength=len(texts) * dim).astype(np.float32)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def ratio(product: Column, a_sq: Column, b_sq: Column) -> Column:
    """Cosine from a dot product and two squared lengths; 0 when either vector has no length."""
    norm = F.sqrt(a_sq * b_sq)
    return F.when(norm > 0, product / norm).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), dot(a, a), dot(b, b))


@dataclass(frozen=True)
class HashedEmbedder:
    """Word counts by the first hex digits of each word's md5. Narrow: no shuffle.

    Texts are embedded by Arrow and numpy, which hash the distinct words of a few MB of text once; sentences in the JVM.

    A stand-in when no model is given: it measures shared words, not meaning.
    """

    hex_digits: int = 2

    @property
    def dim(self) -> int:
        return 16**self.hex_digits

    def _buckets(self, text: Column) -> Column:
        return F.transform(lower_words(text), lambda w: F.substring(F.md5(w.cast("binary")), 1, self.hex_digits))

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        hex_digits, dim = self.hex_digits, self.dim

        @F.arrow_udf("array<float>")
        def run(texts: pa.Array) -> pa.Array:
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(ends // COUNT_BYTES)) + 1), len(texts)]
            values = np.concatenate([word_counts(texts.slice(a, b - a), hex_digits) for a, b in zip(cuts, cuts[1:])])
            starts = pa.array(np.arange(0, len(values) + 1, dim, dtype=np.int32))
            return pa.ListArray.from_arrays(starts, pa.array(values), mask=texts.is_null())

        # Letters are lowered where all other expressions lower them.
        return df.withColumn(out, run(F.lower(text)))

    def similarities(self, df: DataFrame, texts: str, vector: str, out: str) -> DataFrame:
        """Cosine of every text in the array column `texts` with the row's vector, as an array in `out`.

        A text's vector is never built: its dot product adds up the entries its words point at, and its squared
        length grows by 2j - 1 with the j-th word of a bucket.
        """

        def one(text: Column) -> Column:
            numbers = F.transform(
                F.sort_array(self._buckets(text)), lambda b: F.conv(b, 16, 10).cast("int") + F.lit(1)
            )
            start = F.struct(
                F.lit(0.0).alias("dot"), F.lit(0.0).alias("sq"), F.lit(0).alias("last"), F.lit(0.0).alias("run")
            )

            def step(acc: Column, b: Column) -> Column:
                run = F.when(acc["last"] == b, acc["run"] + 1.0).otherwise(F.lit(1.0))
                return F.struct(
                    (acc["dot"] + F.element_at(vector, b).cast("double")).alias("dot"),
                    (acc["sq"] + 2.0 * run - 1.0).alias("sq"),
                    b.alias("last"),
                    run.alias("run"),
                )

            return F.aggregate(numbers, start, step, lambda acc: F.struct(acc["dot"], acc["sq"]))

        squared = df.withColumns({"_parts": F.transform(texts, one), "_sq": dot(F.col(vector), F.col(vector))})
        scores = F.transform("_parts", lambda p: ratio(p["dot"], p["sq"], F.col("_sq")))
        return squared.withColumn(out, scores).drop("_parts", "_sq")


@dataclass(frozen=True)
class ModelEmbedder:
    """Embeds with a user's model: `load()` runs once per Python worker and returns texts -> vectors."""

    load: Callable[[], Callable[[list[str]], list]]
    dim: int
    batch_size: int = EMBED_BATCH

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        load, batch_size, dim = self.load, self.batch_size, self.dim

        @F.pandas_udf("array<float>")
        def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in series:
                vectors: list = []
                for start in range(0, len(texts), batch_size):
                    batch = texts.iloc[start : start + batch_size].tolist()
                    embedded = list(model(batch))
                    if len(embedded) != len(batch) or any(len(v) != dim for v in embedded):
                        raise ValueError("the model must return one vector of the stated length per text")
                    vectors.extend(embedded)
                yield pd.Series(vectors, index=texts.index)

        return df.withColumn(out, run(F.col(text)))

    def similarities(self, df: DataFrame, texts: str, vector: str, out: str) -> DataFrame:
        """Cosine of every text in the array column `texts` with the row's vector, as an array in `out`."""
        load, batch_size = self.load, self.batch_size

        @F.pandas_udf("array<double>")
        def run(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for lists, vectors in rows:
                flat = [t for texts in lists for t in texts]
                embedded: list = []
                for start in range(0, len(flat), batch_size):
                    embedded.extend(model(flat[start : start + batch_size]))
                scores, at = [], 0
                for texts, vector in zip(lists, vectors):
                    a = np.asarray(embedded[at : at + len(texts)], dtype=np.float64).reshape(len(texts), -1)
                    at += len(texts)
                    b = np.asarray(vector, dtype=np.float64)
                    norms = np.sqrt((a * a).sum(axis=1) * (b * b).sum())
                    products = a @ b if len(texts) else norms
                    scores.append(np.divide(products, norms, out=np.zeros_like(norms), where=norms > 0))
                yield pd.Series(scores, index=lists.index)

        return df.withColumn(out, run(F.col(texts), F.col(vector)))


def check_embeddings(nodes: DataFrame, dim: int | None = None) -> DataFrame:
    """One row: number of nodes, missing vectors, distinct lengths, and whether the set is usable."""
    counted = nodes.select(F.size("embedding").alias("n"), F.col("embedding").isNull().alias("missing")).agg(
        F.count("*").alias("n_nodes"),
        F.count_if("missing").alias("n_missing"),
        F.min(F.when(~F.col("missing"), F.col("n"))).cast("bigint").alias("min_dim"),
        F.max(F.when(~F.col("missing"), F.col("n"))).cast("bigint").alias("max_dim"),
    )
    usable = (F.col("n_missing") == 0) & F.coalesce(F.col("min_dim") == F.col("max_dim"), F.lit(True))
    if dim is not None:
        usable = usable & F.coalesce(F.col("max_dim") == dim, F.lit(True))
    return counted.withColumn("usable", usable)
