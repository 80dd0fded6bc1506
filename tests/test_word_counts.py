"""Vectors of word counts are made from distinct words, in blocks of bounded size; whitespace and markup of plain texts."""

import hashlib
import html
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import vectors
from docloom.functions.vectors import HashedEmbedder
from docloom.operators.search import lexical_overlap

TEXTS = ["a b a", "", " ", "x  y ", "Äpfel äpfel ÄPFEL", "größer weit", "emoji \U0001f600 \U0001f600", " ".join(f"w{i % 7}" for i in range(500)), "a"]


def plain(text: str, digits: int) -> list[float]:
    out = [0.0] * 16**digits
    for word in text.split(" "):
        if word:
            out[int(hashlib.md5(word.encode()).hexdigest()[:digits], 16)] += 1
    return out


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_word_counts_equal_a_plain_count(digits):
    got = vectors.word_counts(pa.array([*TEXTS, None]), digits).reshape(-1, 16**digits)
    assert got.tolist() == [plain(t, digits) for t in [*TEXTS, ""]]


def test_a_distinct_word_is_hashed_once(monkeypatch):
    hashed = []
    md5 = hashlib.md5
    monkeypatch.setattr(vectors.hashlib, "md5", lambda w: hashed.append(w) or md5(w))
    vectors.word_counts(pa.array(["a b a", "b a", "c"] * 100), 2)
    assert sorted(hashed) == [b"a", b"b", b"c"]


@pytest.mark.parametrize("block", [1, 40, 8 << 20])
def test_vectors_are_the_same_whatever_the_block(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "COUNT_BYTES", block)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string").coalesce(1)
    got = {r["i"]: r["v"] for r in HashedEmbedder(1).embed(df, "t", "v").collect()}
    assert got == {i: plain(t.lower(), 1) for i, t in enumerate(TEXTS)} | {len(TEXTS): None}
    assert HashedEmbedder().embed(df.limit(0), "t", "v").count() == 0


def test_whitespace_of_ascii_and_other_texts(spark):
    rows = ["a \t\nb", " a\x1c\x1f b ", "\x85a \u2003 b\u3000", "\u00e4\u00a0\u2028b", "a\u200bb", "", "\x0b", "a\x85b", "a\x00 \x0eb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, None])], "i int, t string")
    got = dict(map(tuple, df.select("i", tx.collapse_ws(F.col("t"))).collect()))
    space = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    assert got == {i: re.sub(space, " ", t).strip(" ") for i, t in enumerate(rows)} | {len(rows): None}


def test_pages_with_and_without_markup(spark):
    rows = ["no markup &amp; none", "a > b\x1ec", "x<b>y</b>z<br>q<p>r<!-- s --><script>t</script>u", "", "&lt;p&gt;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, None])], "i int, t string")
    got = dict(map(tuple, df.select("i", tx.html_elements(F.col("t"))).collect()))
    assert got == {0: [html.unescape(rows[0])], 1: ["a > b c"], 2: ["xyz q", "r u"], 3: [], 4: ["<p>"], 5: None}


def test_rerank_hashes_the_words_of_the_question_and_not_of_the_text(spark, capsys):
    df = spark.createDataFrame([("a B a c", "b b x a"), ("", "a"), ("q", "")], "question string, text string").coalesce(1)
    scored = df.select(lexical_overlap(F.col("question"), F.col("text")).alias("s"))
    assert [r["s"] for r in scored.collect()] == pytest.approx([2 / 3, 0.0, 0.0])
    scored.explain()
    # The second list of an intersection is the one that is held as a set.
    assert "array_intersect(array_remove(split(lower(text" in capsys.readouterr().out
