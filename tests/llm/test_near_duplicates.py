"""Near-duplicate texts and vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import components, minhash, shingles, vector_dedup


def brute(sets: dict, linked) -> dict:
    """Smallest id that links reach."""
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if linked(sets[a], sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def shingle_set(text) -> set:
    import re

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def texts(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    out = []
    for _ in range(30):
        base = [word() for _ in range(rng.choice([3, 5, 8, 30, 120, 400]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = word()
            out.append(rng.choice([" ", "\n", "\t "]).join(copy) if rng.random() < 0.7 else " ".join(copy + [word()]).upper())
    # A chain: each a neighbour of the next, the ends far apart.
    chain = [word() for _ in range(200)]
    for _ in range(12):
        out.append(" ".join(chain))
        chain = chain[18:] + [word() for _ in range(18)]
    out += ["", None, "  \n", "one", "ONE", "one two", "É é", "é É", "a\x0bb\x1cc d e", None]
    rng.shuffle(out)
    return list(enumerate(out, start=100))


@pytest.mark.parametrize("tile", [2048, 3])
def test_texts_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    rows = texts(tile)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.id: r for r in minhash.near_duplicates(df.withColumn("id", F.lit("clash")).withColumn("key", F.lit(1))).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    want = brute(sets, lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b))
    assert len(found) == len(rows)
    for i, _ in rows:
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (len(sets[i]), want[i], want[i] == i)


def test_large_groups_of_near_copies_are_whole(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(700):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, rows[3][1]) for i in range(300)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 1000 and {r.component_id for r in found} == {0}
    assert [r.id for r in found if r.kept] == [0]


def test_rows_without_id_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (7, "u v w x y z"), (9, "u v w x y z"), (8, "q")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id or 0, r.component_id or 0, r.kept) for r in found) == [(0, 0, False), (7, 7, True), (7, 7, True), (7, 7, True), (8, 8, True), (9, 7, False)]
    none = minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert none.columns == ["id", "n_shingles", "component_id", "kept"] and none.count() == 0


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2])]
    found = {r.id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].n_shingles == 59_996 and found[2].component_id == 1 and found[3].component_id == 3


def test_every_close_pair_of_signatures_shares_a_bucket():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, minhash.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for k in range(200):
        b[k, rng.choice(minhash.SYMBOLS, 23, replace=False)] ^= np.uint16(1)
    x, y = minhash.bucket_keys(a), minhash.bucket_keys(b)
    assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist()))
    assert len({k for row in x.tolist() for k in row}) == 200 * 48


def test_shingles_know_ascii_case_and_space_only():
    sets = shingles.shingle_sets(["A b\tC d e", "a B c\nD E", "a b c d é", "a b c d É", "a b c\xa0d e", None, "x"])
    assert (sets[0] == sets[1]).all() and sets[2][0] != sets[3][0]
    assert len(sets[4]) == 1 and sets[4][0] != sets[0][0] and not len(sets[5]) and len(sets[6]) == 1


def test_components_of_chains_stars_and_nulls(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(500, k) for k in range(200, 400)] + [(7, 7), (None, 3), (3, None), (900, 901), (901, 900)]
    found = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {i: 1 for i in range(1, 61)} | {k: 200 for k in [*range(200, 400), 500]} | {900: 900, 901: 900}
    assert found == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile", [4096, 16])
def test_vectors_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    rng = np.random.default_rng(tile)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base, base[:25] + rng.normal(size=(25, 24)) * 0.3, base[:10] * 3, base[:6], base[5:15] + rng.normal(size=(10, 24)) * 0.22])
    rows = [(int(i), [float(np.float32(v)) for v in row], 1) for i, row in zip(rng.permutation(len(x)) + 50, x)]
    odd = [(1, None, 1), (2, [0.0] * 24, 1), (3, [float("nan")] + [1.0] * 23, 1), (4, [float("inf")] * 24, 1), (5, [None] + [1.0] * 23, 1), (6, [], 1), (7, [1.0, 0.0], 1), (8, [1.0, 0.1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n int").repartition(4)
    found = {r.id: r for r in vector_dedup.near_duplicate_vectors(df).collect()}
    vectors = {i: np.array(v, float) for i, v, _ in rows} | {7: np.array([1.0, 0.0]), 8: np.array([1.0, np.float32(0.1)])}
    linked = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95
    want = brute(vectors, linked) | {i: i for i in range(1, 7)}
    assert len(found) == len(rows) + len(odd)
    for i, r in found.items():
        n = sum(linked(vectors[i], vectors[j]) for j in vectors if j != i) if i in vectors else 0
        assert (r.n_links, r.component_id, r.kept) == (n, want[i], want[i] == i)


def test_many_equal_and_scaled_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, [float(2**i)] * 3) for i in range(20)] + [(5000, [-1.0, 0.0, 0.0])]
    found = {r.id: r for r in vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {(found[i].n_links, found[i].component_id) for i in range(300)} == {(299, 0)}
    assert {(found[1000 + i].n_links, found[1000 + i].component_id) for i in range(20)} == {(19, 1000)}
    assert found[5000].n_links == 0
    assert vector_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
