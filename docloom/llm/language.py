"""Language identification: what a text looks like, what its markup declares and where it comes from, by Bayes' rule.

The likelihood of a text is that of its letter trigrams under each language; a flat model of its own stands for all that is
none of them. Given the language, declaration and address are independent of it. How far declarations can be trusted is
counted: a table of declared languages against what the texts say. The prior of a host is counted too, without the row's
own share, and shrunk towards the prior of its address suffix, which is shrunk towards that of all rows; a host with many
pages speaks for itself, a new one through its suffix. All counts are grouped sums of probabilities over all rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.worker import freeing, starts_of, text_parts
from docloom.session import materialize

OTHER = "und"
BITS = 14
#: Trigrams of a text depend on each other: n of them count as n / (1 + n / WEIGHT).
WEIGHT = 100.0
#: Rows that a level of the host hierarchy counts as, seen from the one below it.
SHRINK = 5.0
#: Documents below this posterior are rejected.
LEAST = 0.5


def _letters() -> np.ndarray:
    table = np.zeros(0x250, np.uint32)
    for cp in range(0x250):
        c = chr(cp).lower()
        if c[0].isalpha():
            table[cp] = ord(c[0])
    return table


LETTERS = _letters()


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, one after another, and how many each has.

    Letters are lower-cased, all else is one mark between words; trigrams without a letter are left out.
    """
    joined = "\0".join(f"\0{t or ''}\0" for t in texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t or "") + 3 for t in texts], np.int64)
    sizes[-1:] -= 1
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    low = cps < len(LETTERS)
    codes = np.where(low, LETTERS[np.where(low, cps, 0)], np.where((cps >= 0x2000) & (cps < 0x2E80), 0, cps)).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
    codes, owner = codes[keep], owner[keep]
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    good = (owner[:-2] == owner[2:]) & (codes[1:-1] != 0)
    n = np.bincount(owner[:-2][good], minlength=len(texts))
    return (mixed[good] >> np.uint32(32 - BITS)).astype(np.int32), n


def evidence(logs: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each text under each language, and how many trigrams it has."""
    bins, n = trigrams(texts)
    out = np.zeros((len(texts), logs.shape[1]))
    some = np.flatnonzero(n)
    if len(some):
        starts = starts_of(n)[some]
        for k in range(out.shape[1]):
            out[some, k] = np.add.reduceat(logs[bins, k], starts)
    return out / (1 + n / WEIGHT)[:, None], n


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities of trigrams, a column for each language; the last is the flat one."""

    languages: tuple[str, ...]
    logs: np.ndarray


def fit_text_model(df: DataFrame, text: str, language: str, languages: tuple[str, ...]) -> TextModel:
    """Trigram counts of all texts of each language, whole. The driver gets 2^BITS numbers for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) << BITS, np.int64)
        for batch in text_parts(batches, 0):
            bins, n = trigrams(batch.column(0).to_pylist())
            which = np.repeat(batch.column(1).to_numpy().astype(np.int64), n)
            total += np.bincount((which << BITS) + bins, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    which = F.array_position(F.array(*map(F.lit, languages)), F.lower(F.col(language))) - 1
    rows = df.select(F.col(text).alias("text"), which.cast("int").alias("which")).where("which >= 0 and text is not null")
    found = rows.mapInArrow(freeing(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(languages) << BITS)
    counts[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    counts = counts.reshape(len(languages), -1).T
    # A tenth of a count for every trigram; the flat model has all alike.
    logs = np.log((counts + 0.1) / (counts + 0.1).sum(axis=0))
    flat = np.full((len(logs), 1), -BITS * np.log(2.0))
    return TextModel(languages, np.column_stack([logs, flat]).astype(np.float32))


def host_of(address: Column) -> Column:
    """Host of an address; of anything else all of it."""
    host = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.lower(F.when(host != "", host).otherwise(address))


def suffix_of(host: Column) -> Column:
    """What follows the last dot; nothing without one."""
    return F.regexp_extract(host, r"\.([^.]+)$", 1)


def posterior(logs: np.ndarray) -> np.ndarray:
    """Rows of logarithms as probabilities."""
    weights = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(logs) else logs
    return weights / weights.sum(axis=1, keepdims=True)


def identified(
    df: DataFrame,
    model: TextModel,
    key: str,
    text: str,
    declared: Column | None = None,
    address: Column | None = None,
    least: float = LEAST,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, lang, confidence, rejected, text_lang, n_trigrams) of every row, and `row`, a struct of the columns to carry along.

    lang is the language of highest posterior, ties to the first in the model's order; `und` if that is the flat model. A row
    is rejected if its language is `und`, if its posterior is below `least`, or if its text has no letters: nothing else can
    make up for that. Null declarations and addresses are evidence of their own kind, like any other value. Every row is judged
    by itself, whatever its id; repeated rows are identified alike and count as often as they occur.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model.logs)
    size = len(model.languages) + 1
    names, ps = [f"l{k}" for k in range(size)], [f"p{k}" for k in range(size)]
    tongues = np.array([*model.languages, OTHER], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_parts(batches, 4):
            logs, n = evidence(shared.value, batch.column(4).to_pylist())
            said = [pa.array(c) for c in (*logs.T, *posterior(logs).T)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int64)), *said], [*columns, "n", *names, *ps])

    columns = ["id", "declared", "host", "row", "text"]
    rows = df.select(
        F.col(key).alias("id"),
        F.coalesce(F.lower(declared) if declared is not None else F.lit(None), F.lit("")).alias("declared"),
        F.coalesce(host_of(address) if address is not None else F.lit(None), F.lit("")).alias("host"),
        F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry if c != text]).alias("row"),
        F.col(text).alias("text"),
    )
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    said = rows.mapInArrow(freeing(run), schema + ", n long, " + ", ".join(f"{c} double" for c in names + ps))
    said = said.drop("text") if text not in carry else said
    said = materialize(said.withColumn("suffix", suffix_of(F.col("host"))), "language-evidence")

    # Texts without letters say nothing, so they are not counted.
    sums = [F.sum(p) for p in ps]
    spoken = said.where("n > 0")
    hosts = spoken.groupBy("host", "suffix").agg(*[s.alias(f"h{k}") for k, s in enumerate(sums)])
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"h{k}").alias(f"s{k}") for k in range(size)])
    everywhere = suffixes.agg(*[F.sum(f"s{k}") for k in range(size)]).first()
    total = np.array([x or 0.0 for x in everywhere]) + 1.0
    overall = (total / total.sum()).tolist()
    sized = lambda c: sum((F.col(f"{c}{k}") for k in range(1, size)), F.col(f"{c}0"))
    suffixes = suffixes.select("suffix", *[((F.col(f"s{k}") + SHRINK * overall[k]) / (sized("s") + SHRINK)).alias(f"q{k}") for k in range(size)])
    # Written, so that the joins know how small they are and leave the rows, and the texts they carry, where they are.
    hosts = materialize(hosts.join(suffixes, "suffix").drop("suffix"), "language-hosts")

    declarations = spoken.groupBy("declared").agg(*[s.alias(f"d{k}") for k, s in enumerate(sums)])
    trust = declarations.select("declared", *[F.log((F.col(f"d{k}") + 0.5) / (total[k] + 1.0)).alias(f"t{k}") for k in range(size)])
    trust = materialize(trust, "language-declarations")
    joined = said.join(hosts, "host", "left").join(trust, "declared", "left")
    carried = [c for c in ("row", "text") if c in said.columns]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            block = lambda c: np.column_stack([column(f"{c}{k}") for k in range(size)])  # noqa: E731, B023
            n, p = column("n"), block("p")
            q = np.where(np.isnan(block("q")), overall, block("q"))
            others = np.maximum(np.nan_to_num(block("h")) - (n > 0)[:, None] * p, 0.0)
            prior = (others + SHRINK * q) / (others.sum(axis=1, keepdims=True) + SHRINK)
            found = posterior(block("l") + np.nan_to_num(block("t")) + np.log(prior))
            lang = np.where(n > 0, tongues[found.argmax(axis=1)], OTHER)
            confidence = found.max(axis=1)
            out = [pa.array(lang, pa.string()), pa.array(confidence), pa.array((lang == OTHER) | (confidence < least))]
            out += [pa.array(np.where(n > 0, tongues[p.argmax(axis=1)], OTHER), pa.string()), batch.column("n")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *out, *(batch.column(c) for c in carried)], [*judged, *carried])

    judged = ["id", "lang", "confidence", "rejected", "text_lang", "n_trigrams"]
    kinds = [said.schema["id"].dataType.simpleString(), "string", "double", "boolean", "string", "long"]
    kinds += [said.schema[c].dataType.simpleString() for c in carried]
    needed = joined.select("id", "n", *carried, *[F.col(f"{c}{k}").cast("double").alias(f"{c}{k}") for c in "lphqt" for k in range(size)])
    out = needed.mapInArrow(freeing(judge), ", ".join(f"{c} {kind}" for c, kind in zip([*judged, *carried], kinds)))
    if text in carry:
        rest = [F.col(f"row.{c}").alias(c) for c in carry if c != text]
        return out.select(*judged, F.struct(*rest, F.col("text").alias(text)).alias("row"))
    return out.withColumn("row", F.struct(*[F.col(f"row.{c}").alias(c) for c in carry])) if carry else out.drop("row")
