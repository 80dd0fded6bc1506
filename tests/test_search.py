import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docloom.functions.vectors import HashedEmbedder, ModelEmbedder, check_embeddings, cosine
from docloom.operators import search

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def brute_force(nodes, questions, k):
    out = {}
    for org, qid, q in questions:
        scored = []
        for n_org, nid, v in nodes:
            if n_org == org and v is not None:
                a, b = np.array(v, float), np.array(q, float)
                norm = np.sqrt((a @ a) * (b @ b))
                scored.append((-round(float(a @ b / norm) if norm else 0.0, 9), nid))
        out[qid] = [n for _, n in sorted(scored)[:k]]
    return out


def ranked(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["node_id"])
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    nodes = []
    for i in range(400):
        # Two of three nodes are in one organization, and many vectors are equal.
        org = "hot" if i % 3 else f"o{i % 5}"
        nodes.append((org, f"n{i:03d}", [float(x) for x in rng.integers(0, 3, 4)]))
    nodes.append(("hot", "zero", [0.0] * 4))
    questions = [("hot" if q % 2 else f"o{q % 5}", q, [float(x) for x in rng.integers(0, 3, 4)]) for q in range(60)]
    questions.append(("empty", 99, [1.0] * 4))
    questions.append(("hot", 100, [0.0] * 4))
    return nodes, questions


@pytest.mark.parametrize("options", [{}, {"node_block": 16 * 4, "question_block": 7 * 4}, {"node_block": 1}])
def test_top_k_equals_brute_force_with_ties_and_a_hot_organization(spark, data, options):
    nodes, questions = data
    n = spark.createDataFrame(nodes, "org_id string, node_id string, embedding array<float>").repartition(5)
    q = spark.createDataFrame(questions, "org_id string, qid bigint, embedding array<float>")
    want = {qid: ids for qid, ids in brute_force(nodes, questions, 7).items() if ids}
    assert ranked(search.top_k(n, q, 7, **options)) == want


def test_fewer_candidates_than_k(spark):
    n = spark.createDataFrame([("o", "a", [1.0]), ("o", "b", [1.0])], "org_id string, node_id string, embedding array<float>")
    q = spark.createDataFrame([("o", 1, [1.0])], "org_id string, qid bigint, embedding array<float>")
    assert ranked(search.top_k(n, q, 10)) == {1: ["a", "b"]}


@pytest.mark.parametrize("options", [{}, {"node_block": 1}])
@pytest.mark.parametrize("vectors", [([1.0, 2.0], [1.0, 2.0, 3.0, 4.0]), ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0])])
def test_vectors_of_other_lengths_fail_the_job(spark, vectors, options):
    rows = [("o", f"n{i}", v) for i, v in enumerate(vectors)]
    n = spark.createDataFrame(rows, "org_id string, node_id string, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([("o", 1, [1.0, 1.0])], "org_id string, qid bigint, embedding array<float>")
    with pytest.raises(Exception, match="same length|same shape|mismatch|must match"):
        search.top_k(n, q, 10, **options).collect()


def test_no_questions(spark):
    n = spark.createDataFrame([("o", "a", [1.0])], "org_id string, node_id string, embedding array<float>")
    q = spark.createDataFrame([], "org_id string, qid bigint, embedding array<float>")
    assert search.top_k(n, q).count() == 0


def test_top_k_plan_exchanges_blocks_once(spark, data, capsys):
    nodes, questions = data
    n = spark.createDataFrame(nodes, "org_id string, node_id string, embedding array<float>")
    q = spark.createDataFrame(questions, "org_id string, qid bigint, embedding array<float>")
    search.top_k(n, q).explain()
    plan = capsys.readouterr().out
    # Without known sizes nothing is broadcast: node blocks, question blocks and hits move once each.
    assert plan.count("Exchange hashpartitioning") == 3
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hashed_similarities_equal_vectors(spark):
    e = HashedEmbedder()
    df = spark.createDataFrame([("a b c a", ["a b", "x y z", "a a a c", ""])], "q string, texts array<string>")
    row = e.similarities(e.embed(df, "q", "v"), "texts", "v", "s").head()
    each = e.embed(e.embed(df, "q", "v").select("v", F.explode("texts").alias("t")), "t", "tv")
    want = [r["c"] for r in each.select(cosine(F.col("tv"), F.col("v")).alias("c")).collect()]
    assert row["s"] == pytest.approx(want)


def load_counting():
    return lambda texts: [[float(t.count("a")), float(t.count("b"))] for t in texts]


def load_short():
    return lambda texts: [[0.0, 0.0]] * (len(texts) - 1)


def test_model_embedder(spark):
    e = ModelEmbedder(load_counting, 2, batch_size=3)
    df = spark.createDataFrame([("a" * i + "b", ["a", "b", ""]) for i in range(1, 11)], "t string, texts array<string>")
    embedded = e.embed(df, "t", "v")
    assert sorted(tuple(r["v"]) for r in embedded.collect()) == [(float(i), 1.0) for i in range(1, 11)]
    first = e.similarities(embedded, "texts", "v", "s").orderBy("t").collect()[-1]
    assert first["s"] == pytest.approx([1 / 2**0.5, 1 / 2**0.5, 0.0])


def test_model_must_return_one_vector_per_text(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    with pytest.raises(Exception, match="one vector of the stated length"):
        ModelEmbedder(load_short, 2).embed(df, "t", "v").collect()


def test_embedding_check_finds_missing_and_mixed_lengths(spark):
    def check(rows):
        return check_embeddings(spark.createDataFrame([(r,) for r in rows], "embedding array<float>"), 2).head()["usable"]

    assert check([[1.0, 2.0]]) and check([])
    assert not check([[1.0, 2.0], None])
    assert not check([[1.0, 2.0], [1.0]])
    assert not check([[1.0]])


def candidate_rows(spark):
    rows = [
        (1, "n1", "alpha beta", 0.9, "alpha gamma", "01/01/2024, 00:00:00"),
        (1, "n2", "alpha gamma", 0.5, "alpha gamma", "01/03/2024, 00:00:00"),
        (1, "n3", "delta", 0.8, "alpha gamma", "12/31/2023, 00:00:00"),
        (1, "n4", "delta", 0.7, "alpha gamma", "02/01/2024, 00:00:00"),
    ]
    return spark.createDataFrame(
        rows, "qid bigint, node_id string, text string, score double, question string, process_date string"
    )


def test_rerank_then_recency(spark):
    kept = search.apply_stages(candidate_rows(spark), [search.rerank(3), search.recency(2)])
    assert [r["node_id"] for r in kept.orderBy("recency_rank").collect()] == ["n2", "n1"]


def test_rerank_takes_another_scorer(spark):
    kept = candidate_rows(spark).transform(search.rerank(1, lambda q, t: F.length(t).cast("double")))
    assert kept.head()["node_id"] == "n2"


@pytest.mark.parametrize(("n", "keep"), [(1, 1), (2, 1), (10, 7), (90, 63)])
def test_sentence_share(spark, n, keep):
    e = HashedEmbedder()
    text = " ".join(f"w{i}." for i in range(n))
    df = spark.createDataFrame([(1, "n", text, "w0.")], "qid bigint, node_id string, text string, question string")
    out = search.sentence_optimizer(e)(e.embed(df, "question", "q_embedding")).head()["text"]
    assert len(out.split()) == keep
    assert out.split()[0] == "w0."
    assert out.split() == sorted(out.split(), key=lambda s: int(s[1:-1]))


def test_answer_stays_in_budget(spark):
    df = spark.createDataFrame(
        [(1, 2, "n2", "six seven. eight nine ten."), (1, 1, "n1", "one two. three four five.")],
        "qid bigint, recency_rank bigint, node_id string, text string",
    )
    assert search.extractive_answer(df, 7).head()["response"] == "one two. three four five. six seven."
    assert search.extractive_answer(df).head()["response"] == "one two. three four five. six seven. eight nine ten."


def test_a_long_first_sentence_is_an_answer(spark):
    long = " ".join(f"w{k}" for k in range(300)) + "."
    df = spark.createDataFrame([(1, 1, "n1", long + " more.")], "qid bigint, recency_rank bigint, node_id string, text string")
    assert search.extractive_answer(df).head()["response"] == long + " more."
    assert search.extractive_answer(df, 256).head()["response"] == long


@pytest.mark.parametrize("side", ["node", "question"])
def test_a_missing_vector_fails_the_job(spark, side):
    n = spark.createDataFrame([("o", "a", [1.0]), ("o", "b", None if side == "node" else [2.0])], "org_id string, node_id string, embedding array<float>")
    q = spark.createDataFrame([("o", 1, None if side == "question" else [1.0])], "org_id string, qid bigint, embedding array<float>")
    with pytest.raises(Exception, match="has no vector"):
        search.top_k(n, q).collect()
