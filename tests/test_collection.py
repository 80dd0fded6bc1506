"""The collection as files, manifests and marks."""

import glob
import random

import pytest

from docloom.model import NODE_SCHEMA
from docloom.sources.collection import Collection


def nodes(spark, *docs, chunks=1):
    """chunks nodes for each (org_id, doc_id)."""
    rows = [(o, f"{d}#{c}", d, c, f"{d} {c}", [1.0], None) for o, d in docs for c in range(chunks)]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "org_id string, doc_id string")


def seen(df):
    return sorted((r.org_id or "", r.node_id) for r in df.select("org_id", "node_id").collect())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def data_files(path):
    return set(glob.glob(f"{path}/nodes/**/*.parquet", recursive=True))


def test_marked_rows_are_skipped_and_other_files_read_as_they_are(spark, tmp_path):
    held = Collection(str(tmp_path))
    held.publish(spark, 0, nodes=nodes(spark, *[("a", f"d{k}") for k in range(200)], ("b", "d1"), ("b", "d150"), chunks=2))
    files = data_files(tmp_path)
    assert "Join" not in plan(held.load(spark))
    held.publish(spark, 1, removed=docs(spark, ("a", "d1"), ("a", "d150"), ("a", "none"), ("c", "d1"), (None, "d1"), ("a", None)))
    want = sorted([("a", f"d{k}#{c}") for k in range(200) if k not in (1, 150) for c in (0, 1)] + [("b", f"{d}#{c}") for d in ("d1", "d150") for c in (0, 1)])
    assert seen(held.load(spark)) == want
    assert data_files(tmp_path) == files, "removing a few documents writes no node"
    assert "Join" not in plan(held.load(spark, "b")) and "Join" in plan(held.load(spark, "a"))
    # The files of a are scanned with the marks, that of b without.
    assert plan(held.load(spark)).count("Join") == 1 and "Union" in plan(held.load(spark))


def test_worn_files_are_written_anew_and_then_need_no_join(spark, tmp_path):
    held = Collection(str(tmp_path))
    held.publish(spark, 0, nodes=nodes(spark, *[("a", f"d{k:02}") for k in range(10)], ("b", "x")))
    for batch, k in enumerate(range(0, 9), start=1):
        held.publish(spark, batch, removed=docs(spark, ("a", f"d{k:02}")))
        assert seen(held.load(spark)) == [("a", f"d{j:02}#0") for j in range(k + 1, 10)] + [("b", "x#0")]
    live, marks = held._state(spark)
    assert sum(r.n_rows for r in live.collect()) <= 4 and marks.count() <= 1
    held.publish(spark, 10, removed=docs(spark, ("a", "d09"), ("b", "x")))
    assert seen(held.load(spark)) == [] and held._state(spark)[0].count() == 0
    assert len(seen(held.load(spark, before=1))) == 11, "earlier states stay"


def test_dropping_an_organization_opens_no_data_file(spark, tmp_path):
    held = Collection(str(tmp_path))
    held.publish(spark, 0, nodes=nodes(spark, ("a", "d"), ("b", "d"), (None, "d")))
    files = data_files(tmp_path)
    held.publish(spark, 1, dropped=spark.createDataFrame([("a",), (None,)], "org_id string"))
    assert seen(held.load(spark)) == [("", "d#0"), ("b", "d#0")] and data_files(tmp_path) == files


def test_many_batches_are_read_through_one_manifest(spark, tmp_path):
    held = Collection(str(tmp_path))
    for batch in range(12):
        held.publish(spark, batch, nodes=nodes(spark, ("a", f"d{batch}")))
    live, _ = held._state(spark)
    assert len({f.split("/run=")[1].split("/")[0] for f in live.inputFiles()}) == 1
    assert held.load(spark).inputFiles() and "Join" not in plan(held.load(spark))
    assert seen(held.load(spark)) == sorted(("a", f"d{b}#0") for b in range(12))
    assert seen(held.load(spark, before=3)) == [("a", f"d{b}#0") for b in range(3)]


def test_a_batch_run_again_starts_from_the_state_before_it(spark, tmp_path):
    held = Collection(str(tmp_path))
    held.publish(spark, 0, nodes=nodes(spark, ("a", "x"), ("a", "y"), ("a", "z")))
    reader = held.load(spark)
    for _ in range(2):
        held.publish(spark, 1, nodes=nodes(spark, ("a", "x")), removed=docs(spark, ("a", "x"), ("a", "x")))
        assert seen(held.load(spark)) == [("a", "x#0"), ("a", "y#0"), ("a", "z#0")]
    held.publish(spark, 1, removed=docs(spark, ("a", "y")))
    assert seen(held.load(spark)) == [("a", "x#0"), ("a", "z#0")]
    assert len(seen(reader)) == 3, "a reader that began before goes on with its files"


def test_empty_batches(spark, tmp_path):
    held = Collection(str(tmp_path))
    held.publish(spark, 0, nodes=nodes(spark))
    assert seen(held.load(spark)) == []
    held.publish(spark, 1, removed=docs(spark), dropped=spark.createDataFrame([], "org_id string"))
    assert seen(held.load(spark)) == [] and seen(held.load(spark, "a")) == []
    assert seen(held.load(spark, before=0)) == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        Collection(str(tmp_path / "none")).load(spark)


def test_random_batches_equal_a_plain_model(spark, tmp_path):
    rng = random.Random(5)
    held, want = Collection(str(tmp_path)), {}
    for batch in range(7):
        pick = [(o, f"d{k}") for o in "ab" for k in range(30)]
        gone = rng.sample(pick, rng.choice([0, 3, 20]))
        new = rng.sample(pick, rng.choice([0, 5, 25]))
        dropped = [o for o in "ab" if rng.random() < 0.15]
        want = {n: c for n, c in want.items() if n not in gone and n[0] not in dropped}
        for n in new:
            want[n] = want.get(n, 0) + 1
        held.publish(spark, batch, nodes(spark, *new, chunks=2), docs(spark, *gone), spark.createDataFrame([(o,) for o in dropped], "org_id string"))
        expected = sorted((o, f"{d}#{c}") for (o, d), n in want.items() for c in (0, 1) for _ in range(n))
        assert seen(held.load(spark)) == expected
        assert seen(held.load(spark, "a")) == [r for r in expected if r[0] == "a"]
