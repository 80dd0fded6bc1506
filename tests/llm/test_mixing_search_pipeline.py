"""Mixing, nearest neighbours, and the pipeline as a whole."""

import base64
import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import ann, minhash, mixing, pii
from docloom.llm.queries import BYTE_RANKS, KEY


def test_mixing_repeats_by_target_weights(spark):
    df = spark.range(30000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "b").alias("source"), F.lit("clash").alias("replica"), F.lit(1).alias("s"))
    weights = spark.createDataFrame([("hot", 1.0), ("b", 2.0), (None, 1.0)], "source string, weight double")
    out = mixing.mix(df, weights=weights, size=2.0)
    assert out.columns == ["doc_id", "source", "s", "replica", "position"]
    n = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for source, want in {"hot": 15000, "b": 30000, None: 15000}.items():
        assert abs(n[source] - want) < 6 * math.sqrt(want)
    position = [r.position for r in out.select("position").collect()]
    assert position == sorted(position) and min(position) >= 0 and max(position) < 1
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_draws_from_the_poisson_distribution(spark):
    for mean in (0.3, 4.0, 150.0):
        df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
        n = mixing.mix(df, size=mean).groupBy("doc_id").count().agg(F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
        average, square = n[0] / 20000, n[1] / 20000
        assert abs(average - mean) < 6 * math.sqrt(mean / 20000)
        assert abs(square - average**2 - mean) < 0.1 * mean


def test_mixing_is_the_same_whenever_it_runs(spark):
    df = spark.createDataFrame([(k, f"s{k % 3}") for k in range(50)] + [(None, "s0"), (7, "s1"), (8, None)], "doc_id long, source string")
    rows = [tuple(r) for r in mixing.mix(df, size=3.0).collect()]
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in mixing.mix(df.repartition(5), size=3.0).collect())
    assert rows.count((7, "s1", 0, rows[0][3])) in (0, 1)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df, weights=spark.createDataFrame([("other", 1.0)], "source string, weight double")).count() == 0


def brute(x: dict, q: int, k: int) -> list:
    scores = sorted(((-float((x[q] * v).sum()), i) for i, v in x.items() if i != q and len(v) == len(x[q])))
    return [i for _, i in scores[:k]]


def test_nearest_of_clustered_vectors_with_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 2
    x = np.float32(centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 0.3)
    x[100:130] = x[100]
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    odd = [(3020, None, 1), (3040, [0.0] * 16, 1), (3060, [float("nan")] * 16, 1), (3080, [None] * 16, 1), (3100, [1.0, 2.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, part int").repartition(6)
    found = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    assert sorted(found) == list(range(0, 3000, 20))
    vectors = {i: row.astype(float) for i, row in enumerate(x)}
    want = {q: brute(vectors, q, 20) for q in found}
    assert np.mean([len(set(found[q]) & set(want[q])) / 20 for q in found]) >= 0.9
    # Equal vectors have equal scores, and come by id.
    copies = [i for i in found[100] if 100 <= i < 130]
    assert copies == sorted(copies)


def test_nearest_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (2, [3.0, 1.0]), (20, [0.0, 1.0]), (40, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    found = [tuple(r) for r in ann.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 2, 3.0), (0, 2, 1, 2.0), (0, 3, 20, 0.0), (20, 1, 2, 1.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0)]
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_rows_that_repeat_an_id_take_one_place(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [float(k), 0.0]) for k in range(1, 40)] + [(k, [0.5 / k, 0.0]) for k in range(2, 30)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, k=5).orderBy("rank").collect()
    assert [(r.id, r.score) for r in found] == [(1, 39.0)] + [(k, 0.5 / k) for k in range(2, 6)]


def test_parts_are_balanced_and_keep_neighbours_together():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(8, 8))[rng.integers(0, 8, 800)] * 4 + rng.normal(size=(800, 8)) * 0.2
    near = ann.neighbours(x, x, 10, True)
    label = ann.balanced_parts(ann.scaled(x), near, 8, rng)
    assert np.bincount(label, minlength=8).max() <= math.ceil(1.1 * 800 / 8)
    assert (label[near] == label[:, None]).mean() > 0.6


def test_queries_outside_the_sample_find_their_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))) * rng.lognormal(0, 0.5, (3000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.nearest(df, F.col("id") % 20 == 0, k=10, sample=400).collect()
    near = x[::20] @ x.T
    near[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    best = {20 * q: set(np.argpartition(-row, 10)[:10].tolist()) for q, row in enumerate(near)}
    assert len(found) == 1500
    assert sum(r.id in best[r.query_id] for r in found) >= 0.9 * 1500


@pytest.fixture(scope="module")
def staged(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_stages_keep_the_columns_of_documents(spark, staged):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert staged[name].columns == corpus_pipeline.COLUMNS


def test_clean_documents_pass_the_language_stage(spark, staged):
    letters = staged["documents"].where(F.regexp_count("text", F.lit(r"\p{L}")) > 20).count()
    assert staged["language_id"].count() >= 0.99 * letters


def test_one_of_each_group_stays(spark, staged):
    before, after = staged["language_id"], staged["minhash_near_dedup"]
    groups = {r.id: r.component_id for r in minhash.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(groups.values()))
    assert {r.component_id == r.id for r in minhash.near_duplicates(after).collect()} == {True}


def test_texts_are_pseudonyms_of_the_stage_before(spark, staged):
    before = {r.doc_id: r.text for r in pii.pseudonymize(staged["minhash_near_dedup"], "text", KEY).collect()}
    after = {r.doc_id: r for r in staged["pii_pseudonyms"].collect()}
    assert {i: r.text for i, r in after.items()} == before
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_mixed_documents_and_their_tokens(spark, staged):
    mixed = staged["source_mixing"].collect()
    texts = {r.doc_id: r.text for r in staged["pii_pseudonyms"].collect()}
    assert all(texts[r.doc_id] == r.text for r in mixed)
    with open(BYTE_RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = staged["byte_bpe"].collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in mixed)
    for r in rows:
        assert r.ids == plain.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, sf, staged):
    out = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, out.collect())) == sorted(map(str, staged["byte_bpe"].collect()))


def test_stages_of_odd_and_empty_documents(spark):
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "the cat and the dog are here", "en", "a", 5), (3, "the cat and the dog are here", None, None, 5)] + [
        (10 + k, "the cat and the dog are not in the house today", "en", "a", 40) for k in range(5)
    ]
    for data in (rows, []):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            docs.collect()
