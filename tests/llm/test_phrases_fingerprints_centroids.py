"""Phrases, fingerprints and centroids against plain versions, and their odd inputs."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import phrases, simhash, va_centroids

DOCS = "doc_id long, text string, lang string, n int, phrase string, id string, part string"


def docs(spark, rows):
    """Rows (doc_id, text, lang) with columns of names that the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


# Phrases


def plain_phrases(rows, least, inside, top):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = []
    for lang in n:
        many = {p: a for (own, p), a in f.items() if own == lang and a >= least}
        found = []
        for p, a in many.items():
            if len(p) == 1:
                continue
            longer = [b for q, b in many.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= inside * a for b in longer):
                continue
            score, _, left, right = min((2_000_000 * a // (many[p[:c]] + many[p[c:]]), c, many[p[:c]], many[p[c:]]) for c in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def prose(seed, n, words=12):
    rng = np.random.default_rng(seed)
    vocabulary = ["New", "york", "CITY", "hall", "é", "É", "ab-c", "x", "\x00", "d'or", "日本", "z"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ", "! ", "\x1f"]
    out = []
    for _ in range(n):
        size = int(rng.integers(0, words))
        picked = rng.choice(len(vocabulary), size, p=np.arange(12, 0, -1) / 78)
        out.append("".join(vocabulary[w] + marks[rng.integers(len(marks))] for w in picked))
    return out


@pytest.mark.parametrize("counters", [4, 1 << 18])
def test_phrases_match_plain_counts(spark, counters):
    texts = prose(1, 300)
    rows = [(i, t, [None, "de", "en"][i % 3]) for i, t in enumerate(texts)]
    rows += [(None, None, "en"), (5, "", "fr"), (6, texts[0], None), (6, texts[0], None), (7, "New York " * 3000, "en"), (8, "?!.,", "en")]
    found = phrases.phrases(docs(spark, rows), least=5, inside=80, top=25, counters=counters)
    assert sorted(map(tuple, found.collect())) == plain_phrases(rows, 5, 80, 25)


def test_phrases_of_no_rows(spark):
    found = phrases.phrases(docs(spark, []).limit(0))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found.count() == 0
    assert phrases.phrases(docs(spark, [(1, None, None), (2, "one two", "en")])).count() == 0


@pytest.mark.parametrize("least, counters", [(30, 64), (5, 16), (2, 8)])
def test_summaries_miss_nothing_frequent(least, counters):
    rng = np.random.default_rng(least)
    keys = np.concatenate([rng.zipf(1.3, 20_000).astype(np.uint64), rng.integers(0, 1 << 40, 20_000).astype(np.uint64)])
    rng.shuffle(keys)
    summary = phrases.Summary(least, counters)
    for at in range(0, len(keys), 701):
        summary.add(*phrases.added(keys[at : at + 701]))
        assert len(summary.keys) <= phrases.capacity(summary.mass, least, counters)
    true = Counter(keys.tolist())
    assert summary.cut < least
    kept = set(summary.frequent().tolist())
    assert {k for k, n in true.items() if n >= least} <= kept
    assert all(true[k] + summary.cut >= least for k in kept)


def test_counters_are_few_where_the_mass_is_as_planned():
    assert phrases.capacity(15 * 1000, 30, 1000) == 1000
    assert phrases.capacity(15 * 1000 + 1, 30, 1000) == 4000


# Fingerprints


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", lowered(text or "").encode())
    if not words:
        return "0" * 32
    k = min(5, len(words))
    total = [0] * 128
    for term, often in Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)).items():
        bits = 0
        for at, word in enumerate(term):
            bits ^= int.from_bytes(hashlib.md5(b"%d:%s" % (at, word)).digest(), "little")
        for b in range(128):
            total[b] += often.bit_length() * (1 if bits >> b & 1 else -1)
    value = sum((total[b] > 0) << b for b in range(128))
    return f"{value & (1 << 64) - 1:016x}{value >> 64:016x}"


def alike(a, b):
    return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128


def as_rows(found):
    shown = found.withColumn("fp", simhash.shown(F.col("upper"), F.col("lower"))).withColumn("efp", simhash.shown(F.col("edited_upper"), F.col("edited_lower")))
    return [(r.id, r.n_chars, r.edited_sha256, r.fp, r.efp, r.near_edited, r.near_next) for r in shown.collect()]


def plain_rows(ordered):
    out = []
    for k, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        a, b, c = map(plain_fingerprint, (text, new, following))
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, alike(a, b), alike(a, c)))
    return out


def test_fingerprints_match_a_plain_version(spark):
    rng = np.random.default_rng(3)
    texts = prose(2, 60, 40) + [None, "", " \n", "one", "A b C d", "日本 " * 9, "long " * 40_000 + "end"]
    ids = rng.permutation(len(texts)).tolist()
    rows = [(i, t, "en") for i, t in zip(ids, texts)]
    # Of one id the texts' hash decides; equal rows may stand in any order.
    found = simhash.edited_fingerprints(docs(spark, rows).repartition(7))
    assert sorted(as_rows(found)) == sorted(plain_rows(sorted(((i, t) for i, t, _ in rows), reverse=True)))


def test_forgotten_words_get_the_same_hashes(monkeypatch):
    monkeypatch.setattr(simhash, "KNOWN", 50)
    known, texts = simhash.WordHashes(), [" ".join(f"w{(k * 37 + j) % 3000}" for j in range(1500)) for k in range(9)]
    for text in texts:
        upper, lower = (x & (1 << 64) - 1 for x in simhash.fingerprint(known, text))
        assert f"{upper:016x}{lower:016x}" == plain_fingerprint(text)


def test_rows_without_id_come_last_and_first_follows_last(spark):
    rows = [(None, "the last of all", "en"), (3, "three", "en"), (9, "nine nine", "en"), (3, "three", "en")]
    found = sorted(as_rows(simhash.edited_fingerprints(docs(spark, rows))), key=repr)
    ordered = [(9, "nine nine"), (3, "three"), (3, "three"), (None, "the last of all")]
    assert found == sorted(plain_rows(ordered), key=repr)


def test_fingerprints_of_one_row_and_of_none(spark):
    assert as_rows(simhash.edited_fingerprints(docs(spark, [(1, "abcd", "en")]))) == plain_rows([(1, "abcd")])
    empty = simhash.simhash(docs(spark, []).limit(0))
    assert empty.count() == 0 and {"n_near", "group_id", "near_next"} <= set(empty.columns)


@pytest.mark.parametrize("tile, radius", [(2048, 4), (3, 4), (2048, 1), (5, 6)])
def test_near_fingerprints_match_all_pairs(spark, monkeypatch, tile, radius):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(tile + radius)
    prints = []
    for _ in range(6):
        centre = int.from_bytes(rng.bytes(16), "little")
        for _ in range(12):
            prints.append(centre ^ sum(1 << int(b) for b in rng.choice(128, rng.integers(0, 5), replace=False)))
    prints += prints[:5] + [int.from_bytes(rng.bytes(16), "little") for _ in range(20)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, signed(p & (1 << 64) - 1), signed(p >> 64), True) for i, p in enumerate(prints)]
    n = len(rows)
    rows += [(n, 0, 0, False), (n + 1, 0, 0, False), (None, *rows[0][1:]), (0, *rows[0][1:3], True)]
    usable = [(i, prints[0] if i == 0 else prints[i]) for i, _, _, has in rows if i is not None and has]
    group = {i: i for i, *_ in rows if i is not None}
    near = Counter()
    for a, (i, p) in enumerate(usable):
        for b, (j, q) in enumerate(usable):
            if a != b and (p ^ q).bit_count() <= radius:
                near[i] += 1
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    found = simhash.near_fingerprints(spark.createDataFrame(rows, "id long, upper long, lower long, has_words boolean"), "id", radius)
    assert {r.id: (r.n_near, r.group_id) for r in found.collect()} == {i: (near[i], group[i]) for i in group}
    assert found.count() == len(group)


def test_edited_texts_are_more_alike_than_the_next(spark, sf):
    rows = simhash.edited_fingerprints(spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")).collect()
    assert np.mean([r.near_edited > r.near_next for r in rows if r.n_chars > 200]) > 0.99


# Centroids


def plain_clusters(rows, k, rounds):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]
    mixed = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centres = [q for _, q in sorted(usable, key=lambda r: (mixed(r[0]), np.array(r[1], np.int32).tobytes()))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min(range(len(centres)), key=lambda c: (far(q, centres[c]), c)) for _, q in usable]

    for _ in range(rounds):
        own = assign()
        for c in range(len(centres)):
            mine = [q for (_, q), a in zip(usable, own) if a == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    d = [far(q, centres[c]) for (_, q), c in zip(usable, own)]
    sums = Counter()
    for c, x in zip(own, d):
        sums[c] += x
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, x, sums[c], sum(d), sha[c]) for (i, _), c, x in zip(usable, own, d)]


VECTORS = "vec_id long, embedding array<double>, id string, at string, cluster string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], VECTORS)


@pytest.mark.parametrize("spread, k", [(0.02, 7), (0.5, 4), (0.0, 5)])
def test_clusters_match_plain_arithmetic(spark, spread, k):
    rng = np.random.default_rng(k)
    rows = [(i, (rng.normal(size=3)[[0, 1, 2]] * spread + [i % 4, -(i % 3), 0.25]).tolist()) for i in range(200)]
    rows += [(300, None), (301, [1.0]), (302, [1.0, None, 2.0]), (303, [float("nan"), 0.0, 0.0]), (304, [float("inf"), 0.0, 0.0])]
    rows += [(305, [0.0, 0.0, 0.0]), (306, [0.0, 0.0, 0.0]), (306, [5.0, -300.0, 2.5]), (None, [1.0, 1.0, 1.0]), (7, rows[7][1])]
    found = va_centroids.clusters(vectors(spark, rows).repartition(3), dim=3, k=k, rounds=5)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain_clusters(rows, k, 5), key=repr)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.1, 0.2, 0.3]), (2, [0.1, 0.2, 0.3])]
    found = va_centroids.clusters(vectors(spark, rows), dim=3)
    assert sorted(map(tuple, found.collect())) == sorted(plain_clusters(rows, 40, 5))
    none = va_centroids.clusters(vectors(spark, [(1, None)]), dim=3)
    assert none.columns == found.columns and none.count() == 0


def test_components_that_no_distance_could_hold_fail(spark):
    with pytest.raises(Exception, match="may not fit a long"):
        va_centroids.clusters(vectors(spark, [(1, [1e12, 0.0, 0.0])]), dim=3)


def test_intervals_hold_the_distances():
    rng = np.random.default_rng(0)
    x, centroids = rng.integers(-200, 200, (500, 6)), rng.integers(-200, 200, (9, 6))
    inner = np.sort(rng.integers(-200, 200, (6, 15)), axis=1)
    low = np.column_stack([np.full(6, -200), inner + 1])
    high = np.column_stack([inner, np.full(6, 200)])
    cells = np.column_stack([np.searchsorted(inner[d], x[:, d]) for d in range(6)]).astype(np.uint8)
    assert (va_centroids.unpacked(va_centroids.binary(va_centroids.packed(cells)), 6) == cells).all()
    may = va_centroids.Intervals(low, high, centroids).candidates(cells)
    distance = ((x[:, None] - centroids) ** 2).sum(axis=2)
    assert may[np.arange(500), distance.argmin(axis=1)].all()
    assert 0 < (may.sum(axis=1) == 1).sum()
    cluster, best = va_centroids.nearest(x, centroids, may)
    assert (cluster == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()
