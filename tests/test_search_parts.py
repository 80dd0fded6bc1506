"""Top k over organizations that are dealt into many parts."""

import numpy as np
import pytest

from docloom.functions.vectors import HashedEmbedder
from docloom.operators import search

N, Q = "org_id string, node_id string, embedding array<float>", "org_id string, qid bigint, embedding array<float>"


def vectors(n, seed, dim=4):
    return [[float(x) for x in v] for v in np.random.default_rng(seed).integers(0, 4, (n, dim))]


def brute(held, asked, k):
    def cos(a, b):
        norm = np.sqrt(np.dot(a, a) * np.dot(b, b))
        return round(float(np.dot(a, b) / norm), 9) if norm else 0.0

    return {qid: [i for _, i in sorted((-cos(v, q), i) for _, i, v in held)[:k]] for _, qid, q in asked}


@pytest.mark.parametrize("options", [{}, {"node_part": 40, "question_part": 24}, {"node_part": 40, "node_block": 12, "question_block": 8}])
def test_one_organization_in_many_parts(spark, options):
    held = [("all", f"n{i:03d}", v) for i, v in enumerate(vectors(300, 1))]
    asked = [("all", i, v) for i, v in enumerate(vectors(70, 2))]
    found = search.top_k(spark.createDataFrame(held, N).repartition(3), spark.createDataFrame(asked, Q), 5, **options)
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.node_id)
    assert got == brute(held, asked, 5)


def test_one_organization_is_spread_over_tasks_of_bounded_groups(spark):
    """A task is handed at most a part of the nodes and of the questions, however many there are."""
    held = spark.createDataFrame([("all", f"n{i:04d}", v) for i, v in enumerate(vectors(2000, 3))], N)
    asked = spark.createDataFrame([("all", i, v) for i, v in enumerate(vectors(400, 4))], Q)
    parts = search._parts(held, asked, 4 * 250, 4 * 100).head()
    assert (parts.n_parts, parts.q_parts) == (8, 4)


def test_small_blocks_give_away_only_the_best_of_a_part(spark):
    """Hits that leave a part are k for each question, whatever the number of blocks in it."""
    held, asked = np.array(vectors(640, 5)), np.array(vectors(10, 6))
    q, n, scores = search._score_part(held, asked, 3, 8, 4)
    assert len(q) == 30 and sorted(set(q)) == list(range(10))
    whole = search._score_part(held, asked, 3, 1000, 1000)
    assert all((a == b).all() for a, b in zip((q, n, scores), whole))


def test_an_organization_without_nodes_or_questions_has_no_hits(spark):
    held = spark.createDataFrame([("a", "n", [1.0]), (None, "m", [1.0])], N)
    asked = spark.createDataFrame([("b", 1, [1.0]), (None, 2, [1.0])], Q)
    assert search.top_k(held, asked).count() == 0


def test_nodes_and_questions_of_one_table(spark):
    rows = spark.createDataFrame([("all", i, v) for i, v in enumerate(vectors(30, 7))], Q)
    held = rows.selectExpr("org_id", "concat('n', qid) AS node_id", "embedding")
    best = search.top_k(held, rows, 3, node_part=40, question_part=24)
    assert best.where("score > 0.999999999").select("qid").distinct().count() == 30


def test_sentences_are_sorted_natively(spark):
    embedder = HashedEmbedder()
    text = "b b. zz yy. a b. q. a b. r s t. " * 9
    rows = embedder.embed(spark.createDataFrame([(1, text.strip(), "a b.")], "qid long, text string, question string"), "question", "q_embedding")
    kept = search.sentence_optimizer(embedder, 0.5)(rows)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
    # Those that are the question itself, then those that share a word; equal ones in text order.
    assert kept.first().text == "b b. a b. a b. " * 8 + "b b. a b. a b."
