"""The content store: what changes read and write, and late texts of the search."""

import pytest
from pyspark.sql import functions as F

from docloom.functions.vectors import HashedEmbedder
from docloom.operators import search
from docloom.operators.filters import possible_members
from docloom.plans import changes as ch
from docloom.session import materialize
from docloom.sources.contents import FileStore

FILES = "org_id string, account_token string, id string, name string, process_date string, modified_at timestamp, content string"


def rows(spark, *given):
    return spark.createDataFrame([(o, "t", i, f"{i}.txt", "01/01/2024, 00:00:00", None, c) for o, i, c in given], FILES)


def ids(spark, *given):
    return spark.createDataFrame(list(given), "org_id string, id string")


def shown(df):
    return sorted((r.org_id, r.id, r.content) for r in df.collect())


@pytest.fixture
def many():
    return [("007" if k % 3 else "o/ä b", f"f{k}", f"text {k} " + "x" * 400) for k in range(300)]


@pytest.fixture
def store(spark, tmp_path, many):
    out = FileStore(str(tmp_path / "store"))
    out.create(rows(spark, *many, (None, "nobody", "z")), bucket_bytes=9000)
    return out


def files_read(df):
    """Files that the scans of the executed plan opened, of those with contents."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves, total = plan.collectLeaves(), 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if "content" in leaf.schema().toDDL():
            total += leaf.metrics().get("numFiles").get().value()
    return total


def test_store_gives_back_all_files_and_those_named(spark, store, many):
    assert shown(store.read(spark)) == sorted(many)
    assert shown(store.read(spark, "007")) == sorted(r for r in many if r[0] == "007")
    got = store.changed(ids(spark, ("007", "f1"), ("007", "f1"), ("007", "f0"), ("o/ä b", "f0"), ("gone", "f1"), (None, "nobody"), ("007", None)))
    assert shown(got) == sorted(r for r in many if r[1] in ("f0", "f1"))
    assert store.read(spark).columns == rows(spark).columns


def test_reading_changes_prunes_folders_before_files(spark, store):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # Executions without adaptive planning show the files of their scans.
        whole = files_read(store.read(spark))
        one = files_read(store.changed(ids(spark, ("007", "f1"))))
        five = files_read(store.changed(ids(spark, *[("007", f"f{k}") for k in (1, 2, 4, 5, 7)])))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert whole > 10
    assert one == 1 and one < five <= 5


def test_the_scan_of_contents_has_partition_filters(spark, store):
    plan = store.changed(ids(spark, ("007", "f1")))._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"dynamicpruning" in line for line in plan.splitlines() if "Filter" in line and "content" in line)
    assert plan.count("dynamicpruning") == 3


def test_put_replaces_removes_and_adds(spark, store, many):
    state = {(o, i): c for o, i, c in many}
    new = [("007", "f1", "one"), ("007", "fresh", "two"), ("late", "a", "three"), ("o/ä b", "f0", None)]
    gone = [("007", "f2"), ("007", "f1"), ("o/ä b", "f3"), ("late", "b"), ("nowhere", "c"), (None, "f4")]
    for _ in range(2):  # a batch that runs again gives the same
        store.put(1, rows(spark, *new), ids(spark, *gone))
    state = {k: c for k, c in state.items() if k not in gone} | {(o, i): c for o, i, c in new}
    want = sorted(((o, i, c) for (o, i), c in state.items()), key=repr)
    assert sorted(((r.org_id, r.id, r.content) for r in store.read(spark).collect()), key=repr) == want
    assert shown(store.read(spark, before=1)) == sorted(many)
    # All of a bucket, and then of an organization, can go.
    everyone = store.read(spark, "007").select("org_id", "id")
    store.put(2, rows(spark), materialize(everyone, "everyone"))
    assert store.read(spark, "007").count() == 0 and store.read(spark, "late").count() == 1
    store.put(3, rows(spark, ("007", "back", "again")), ids(spark))
    assert shown(store.read(spark, "007")) == [("007", "back", "again")]


def test_put_rewrites_touched_buckets_only(spark, store):
    store.put(1, rows(spark, ("007", "f1", "one")), ids(spark))
    written = spark.read.parquet(f"{store.path}/files/version=1").select("org_id", "bucket").distinct().count()
    assert written == 1


def test_a_batch_that_was_not_published_does_not_count(spark, store, many):
    FileStore._write(store, store._bucketed(rows(spark, ("007", "f1", "half"))), 5)
    assert shown(store.read(spark)) == sorted(many)


def test_an_empty_store(spark, tmp_path):
    store = FileStore(str(tmp_path / "none"))
    store.create(rows(spark))
    assert store.read(spark).count() == 0 and store.changed(ids(spark, ("o", "a"))).count() == 0
    store.put(1, rows(spark, ("o", "a", "x")), ids(spark))
    assert shown(store.read(spark)) == [("o", "a", "x")]


def test_changes_from_the_store_equal_changes_from_rows(spark, tmp_path):
    files = materialize(rows(spark, *[("o1" if k % 3 else "o2", f"f{k}", f"Text {k} of a file.") for k in range(12)]), "files")
    store = FileStore(str(tmp_path / "few"))
    store.create(files, bucket_bytes=64)
    feed = spark.createDataFrame([("o1", "f1", "UPDATED"), ("o1", "f2", "DELETED"), ("o2", "f0", "CREATED"), ("o1", "no", "CREATED")], "org_id string, file_id string, operation string")
    added = [ch.plan_changes(feed, source, HashedEmbedder()).added for source in (files, store)]
    want, got = (sorted((r.org_id, r.doc_id, r.text) for r in df.collect()) for df in added)
    assert want == got == [("o1", "f1", "Text 1 of a file."), ("o2", "f0", "Text 0 of a file.")]


def test_possible_members_lose_none_and_keep_few_others(spark):
    df = spark.range(4000).select(F.concat(F.lit("o"), (F.col("id") % 7).cast("string")).alias("org_id"), F.col("id").cast("string").alias("node_id"), F.lit("t").alias("text"))
    some = df.where("cast(node_id as int) % 40 = 0").select("org_id", "node_id").unionByName(spark.createDataFrame([(None, "1"), ("o1", None)], "org_id string, node_id string"))
    left = possible_members(df, some, ["org_id", "node_id"])
    assert left.columns == df.columns
    got = {(r.org_id, r.node_id) for r in left.collect()}
    assert {(r.org_id, r.node_id) for r in some.dropna().collect()} <= got and len(got) <= 105
    assert possible_members(df, some.limit(0), ["org_id", "node_id"]).count() == 0


def test_without_broadcasts_only_texts_of_hits_are_moved(spark):
    nodes = spark.range(3000).select(F.lit("o").alias("org_id"), F.col("id").cast("string").alias("node_id"), F.lit("d").alias("doc_id"), F.repeat(F.lit("long text "), 50).alias("text"), F.lit("01/01/2024, 00:00:00").alias("process_date"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    nodes = materialize(nodes, "nodes")
    asked = spark.createDataFrame([(1, "o", "q", [1.0, 0.0]), (2, "o", "q", [0.0, 1.0])], "qid bigint, org_id string, question string, embedding array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = search.candidates(nodes, asked, search.top_k(nodes, asked, 10))
        execution = found._jdf.queryExecution()
        assert execution.toRdd().count() == 20
        moved = []

        def walk(plan):
            if plan.nodeName() == "Exchange" and "text#" in plan.output().toString():
                moved.append(plan.metrics().get("shuffleRecordsWritten").get().value())
            for k in range(plan.children().size()):
                walk(plan.children().apply(k))

        walk(execution.executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert moved and max(moved) <= 22
