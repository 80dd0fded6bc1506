"""The transition check against a plain fold."""

import random

from docloom.operators import transitions

LOG = "org_id string, account_token string, status string, ts long, seq long, note string"
NEXT = {"SYNCING": {"INDEXING", "FAIL"}, "INDEXING": {"SUCCESS", "FAIL"}, "SUCCESS": set(), "FAIL": set()}


def plain(rows):
    """Which rows are refused, one after another."""
    state, out = {}, []
    for r in sorted(rows, key=lambda r: ((r[0] or "", r[1] or ""), r[3], r[4], r[2] or "")):
        now = state.get(r[:2], "SYNCING")
        if r[2] not in NEXT:
            out.append((*r, transitions.UNKNOWN))
        elif r[2] == "SYNCING" or r[2] in NEXT[now]:
            state[r[:2]] = r[2]
            out.append((*r, None))
        else:
            out.append((*r, transitions.MISPLACED))
    return out


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_planted_bad_logs(spark):
    steps = ["INDEXING", "SYNCING", "SUCCESS", "INDEXING", "INDEXING", "SUCCESS", "FAIL", "SYNCING", "FAIL", "INDEXING", "SUCCESS", "bad", None]
    rows = [("o", "t", s, k, k, "n") for k, s in enumerate(steps)]
    good, bad = transitions.split_log(spark.createDataFrame(rows, LOG))
    assert sorted(r.seq for r in good.collect()) == [0, 1, 3, 5, 7, 8]
    assert {r.seq: r.refused for r in bad.collect()} == {
        **dict.fromkeys([2, 4, 6, 9, 10], transitions.MISPLACED), **dict.fromkeys([11, 12], transitions.UNKNOWN)
    }


def test_equals_a_plain_fold_with_a_hot_integration_and_few_rows_in_a_task(spark):
    rng = random.Random(3)
    kinds = ["SYNCING", "INDEXING", "INDEXING", "SUCCESS", "FAIL", "FAIL", "odd"]
    keys = [("o", "hot")] * 6 + [("o", "a"), ("p", "a"), (None, "a"), ("o", None)]
    rows = [(*rng.choice(keys), rng.choice(kinds), rng.randrange(60), rng.randrange(4), "n") for _ in range(1500)]
    # A long stretch without SYNCING that spans tasks, and rows that are repeated.
    rows += [("z", "z", "SYNCING", 0, 0, "n")] + [("z", "z", rng.choice(kinds[1:]), k + 1, 0, "n") for k in range(400)] + rows[:40]
    log = spark.createDataFrame(rows, LOG)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = transitions.judged(log).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert by_text(got) == by_text(plain(rows))


def test_an_empty_log(spark):
    assert transitions.judged(spark.createDataFrame([], LOG)).count() == 0
