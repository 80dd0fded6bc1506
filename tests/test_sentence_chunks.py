"""Chunks of whole sentences against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import documents

DOCUMENT = "org_id string, doc_id string, text string, process_date string"


def plain(pieces, size, overlap):
    """Chunks as lists of pieces."""
    counts = [len(p.split(" ")) for p in pieces]
    out, begin = [], 0
    for i in range(len(pieces) + 1):
        if i == len(pieces):
            out += [pieces[begin:]] if pieces else []
        elif sum(counts[begin : i + 1]) > size:
            out.append(pieces[begin:i])
            begin = next(j for j in range(begin + 1, i + 1) if sum(counts[j:i]) <= overlap and sum(counts[j : i + 1]) <= size)
    return out


def rejoined(chunks):
    """The pieces, from chunks that repeat the last pieces of the one before; pieces differ from each other."""
    out = []
    for c in chunks:
        out += c[next((k for k in range(len(c)) if c[k] not in out), len(c)) :]
    return out


def texts(seed, n):
    rng, serial = random.Random(seed), 0
    out = []
    for _ in range(n):
        sentences = []
        for _ in range(rng.choice([0, 1, 3, 40, 700])):
            serial += 1
            # Every piece of up to 12 words has a word of its own.
            sentences.append(" ".join([f"s{serial}"] + [f"w{serial}x{k}" for k in range(rng.choice([0, 1, 4, 9, 30]))]) + rng.choice(".!?"))
        out.append(" ".join(sentences))
    return out


@pytest.mark.parametrize(("size", "overlap"), [(12, 0), (12, 5), (12, 11), (1, 0), (200, 20)])
def test_chunks_equal_a_plain_version_and_rejoin(spark, size, overlap):
    given = [*texts(size, 12), "", " ", "...", None, "no end"]
    docs = spark.createDataFrame([("o", str(k), t, None) for k, t in enumerate(given)], DOCUMENT)
    pieces = {r.doc_id: r.p for r in docs.select("doc_id", tx.sentence_pieces(F.col("text"), size).alias("p")).collect()}
    got = {}
    for r in sorted(documents.chunk_sentences(docs, size, overlap).collect(), key=lambda r: (r.doc_id, r.chunk_idx)):
        assert r.node_id == f"{r.doc_id}#{r.chunk_idx}" and 1 <= len(r.text.split(" ")) <= size
        got.setdefault(r.doc_id, []).append(r.text)
    for doc, p in pieces.items():
        want = plain(p or [], size, overlap)
        assert got.get(doc, []) == [" ".join(c) for c in want]
        assert rejoined(want) == (p or [])
    assert " ".join(pieces["0"]).split() == given[0].split(), "no word is lost"


def test_a_very_long_text(spark):
    text = "word " * 3000 + "end. " + "A short one here. " * 60_000
    docs = spark.createDataFrame([("o", "d", text.strip(), None)], DOCUMENT)
    rows = documents.chunk_sentences(docs).select(F.size(F.split("text", " ")).alias("n")).collect()
    assert len(rows) > 240 and max(r.n for r in rows) <= 1024


def test_overlap_must_be_below_the_size():
    with pytest.raises(ValueError, match="below size"):
        tx.packed(F.col("x"), 5, 5)


def test_no_documents(spark):
    assert documents.chunk_sentences(spark.createDataFrame([], DOCUMENT)).count() == 0
