import re

import pytest
from pyspark.sql import functions as F

from docloom.functions.vectors import HashedEmbedder
from docloom.model import QUARANTINE_SCHEMA, REJECTED_SCHEMA
from docloom.operators import documents
from docloom.plans import changes as ch
from docloom.plans import directory as dr
from docloom.plans import ingest as ing
from docloom.plans import retrieve as rt
from docloom.sources.collection import Collection
from docloom.streaming import jobs

E = HashedEmbedder(1)
FILES = "org_id string, account_token string, id string, name string, file_url string, content string, process_date string, modified_at timestamp"
CHANGES = "org_id string, file_id string, operation string"


def files(spark, *rows):
    full = [(o, t, i, n, f"https://x/{i}", c, "01/01/2024, 00:00:00", None) for o, t, i, n, c in rows]
    return spark.createDataFrame(full, FILES)


@pytest.fixture
def held(spark):
    return files(
        spark,
        ("o1", "t1", "a", "a.txt", "apple one."),
        ("o1", "t1", "b", "b.html", "<p>banana two.</p>"),
        ("o1", "t2", "c", "c.csv", "cherry,three."),
        ("o2", "t3", "d", "d.txt", "date four."),
        ("o1", "t1", "e", "e.exe", "nope"),
        ("o1", "t1", "f", "f.pdf", "%PDF"),
        ("o1", "t1", "g", "g.txt", None),
        ("o1", "t1", "h", "h.txt", ""),
    )


def texts(nodes):
    return sorted((r["org_id"], r["doc_id"], r["text"]) for r in nodes.collect())


def test_good_and_quarantined_files_are_all_files(spark, held):
    good, bad = documents.load(held)
    assert sorted(r["doc_id"] for r in good.collect()) == ["a", "b", "c", "d", "h"]
    assert sorted((r["id"], r["code"]) for r in bad.collect()) == [("e", 4102), ("f", 4901), ("g", 4005)]
    plan = ing.plan_ingest(held, E)
    assert sorted(r["id"] for r in plan.file_rows.collect()) == ["a", "b", "c", "d", "h"]
    assert "content" not in plan.file_rows.columns
    assert texts(plan.nodes) == [
        ("o1", "a", "apple one."),
        ("o1", "b", "banana two."),
        ("o1", "c", "cherry,three."),
        ("o2", "d", "date four."),
    ]
    have = spark.createDataFrame([("o1", "old"), ("o1", "g")], "org_id string, file_id string")
    assert sorted(r["file_id"] for r in ing.file_list(have, plan).collect()) == ["a", "b", "c", "d", "h", "old"]


def test_failed_ingest_leaves_fail_as_last_status(spark, held, tmp_path):
    class Broken:
        def embed(self, df, text, out):
            return df.withColumn(out, F.raise_error(F.lit("no model")).cast("array<float>"))

    log = str(tmp_path / "status")
    with pytest.raises(Exception, match="no model"):
        ing.run_ingest(spark, held, Collection(str(tmp_path / "c")), Broken(), log)
    seen = spark.read.parquet(log).groupBy("status").count().collect()
    assert {r["status"] for r in seen} == {"INDEXING", "FAIL"}


def indexed(spark, held, path):
    collection = Collection(str(path))
    collection.publish(held.sparkSession, nodes=documents.nodes_of(held, E))
    return collection


FEED = [
    ("o1", "a", "UPDATED"),
    ("o1", "b", "CREATED"),
    ("o1", "b", "DELETED"),
    ("o1", "c", "DELETED"),
    ("o1", "ghost", "UPDATED"),
    ("o1", "phantom", "DELETED"),
    ("o1", "new", "CREATED"),
    ("o2", "d", "RENAMED"),
]


def test_change_batch_is_applied_once_however_often_it_runs(spark, held, tmp_path):
    collection = indexed(spark, held, tmp_path / "c")
    # The file table as it is before the batch: a has new text, and `new` has arrived.
    source = held.where("id <> 'a'").unionByName(
        files(spark, ("o1", "t1", "a", "a.txt", "apple changed."), ("o1", "t1", "new", "new.txt", "nectarine."))
    )
    feed = spark.createDataFrame(FEED, CHANGES)
    want = [
        ("o1", "a", "apple changed."),
        ("o1", "b", "banana two."),
        ("o1", "new", "nectarine."),
        ("o2", "d", "date four."),
    ]
    first = texts(ch.apply_changes(spark, collection, feed, source, E, 1))
    again = texts(ch.apply_changes(spark, collection, feed, source, E, 1))
    later = texts(ch.apply_changes(spark, collection, feed, source, E, 2))
    assert first == again == later == want
    assert texts(collection.load(spark, before=1)) != want, "the earlier state can still be read"
    change_set = ch.plan_changes(feed, source, E)
    assert texts(ch.next_snapshot(documents.nodes_of(held, E), change_set)) == want
    assert [r["operation"] for r in change_set.rejected.collect()] == ["RENAMED"]
    assert sorted(r["id"] for r in ch.next_files(source, feed).collect()) == ["a", "b", "d", "e", "f", "g", "h", "new"]
    compact = collection.compact(spark, str(tmp_path / "compact"))
    assert texts(compact.load(spark)) == want


def test_collection_reads_one_organization_by_its_partition(spark, held, tmp_path, capsys):
    collection = indexed(spark, held, tmp_path / "c")
    one = collection.load(spark, "o2")
    assert texts(one) == [("o2", "d", "date four.")]
    one.explain()
    assert re.search(r"PartitionFilters: \[[^\]]*org_id#\d+ = o2", capsys.readouterr().out)
    collection.publish(spark, 1, dropped=spark.createDataFrame([("o1",)], "org_id string"))
    assert texts(collection.load(spark)) == [("o2", "d", "date four.")]
    collection.publish(spark, 2, nodes=documents.nodes_of(held.where("id = 'a'"), E))
    assert [t[1] for t in texts(collection.load(spark))] == ["a", "d"], "an organization can come back"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        Collection(str(tmp_path / "nothing")).load(spark)


def test_odd_organization_ids_read_their_rows(spark, tmp_path):
    orgs = ["q{1}", "a b:c", "x/y", "p%41", "w*?", "[z]"]
    held = files(spark, *[(o, "t", f"f{k}", "a.txt", f"word{k}.") for k, o in enumerate(orgs)])
    collection = indexed(spark, held, tmp_path / "c")
    collection.publish(spark, 1, removed=spark.createDataFrame([("x/y", "f2")], "org_id string, doc_id string"))
    for k, o in enumerate(orgs):
        assert texts(collection.load(spark, o)) == ([] if o == "x/y" else [(o, f"f{k}", f"word{k}.")])


def test_a_batch_counts_when_it_is_published(spark, held, tmp_path):
    collection = indexed(spark, held, tmp_path / "c")
    before = texts(collection.load(spark))
    # A crash after some of its writes: nothing of the batch is seen.
    collection.write(documents.nodes_of(held.where("id = 'a'"), E), 1)
    assert texts(collection.load(spark)) == before
    collection.remove(spark.createDataFrame([("o1", "a"), ("o1", "b")], "org_id string, doc_id string"), 1)
    assert texts(collection.load(spark)) == before
    feed = spark.createDataFrame([("o1", "b", "DELETED"), ("o1", "a", "RENAMED"), ("o1", "g", "UPDATED")], CHANGES)
    after = texts(ch.apply_changes(spark, collection, feed, held, E, 1))
    assert [t[1] for t in after] == ["a", "c", "d"]
    assert [r.file_id for r in collection.recorded(spark, "rejected", REJECTED_SCHEMA).collect()] == ["a"]
    assert [r.id for r in collection.recorded(spark, "quarantine", QUARANTINE_SCHEMA).where("batch = 1").collect()] == ["g"]


def test_files_without_a_name_are_quarantined(spark):
    held = files(spark, ("o1", "t1", "a", None, "text"), ("o1", "t1", "b", "b.txt", "text"))
    good, bad = documents.load(held)
    assert [r.doc_id for r in good.collect()] == ["b"] and [(r.id, r.code) for r in bad.collect()] == [("a", 4102)]


def test_only_ready_accounts_are_indexed(spark, held, tmp_path):
    ready = spark.createDataFrame([("t2", "ready"), ("t1", "pending")], "account_token string, readiness string")
    got = ing.run_ingest(spark, held, Collection(str(tmp_path / "c")), E, ready=ready)
    assert [t[1] for t in texts(got)] == ["c"]


def test_a_vector_of_another_length_fails_the_job(spark, held):
    class Short(HashedEmbedder):
        def embed(self, df, text, out):
            return df.withColumn(out, F.array(F.lit(1.0).cast("float")))

    with pytest.raises(Exception, match="no usable vector"):
        documents.nodes_of(held, Short(1)).collect()


def test_integration_removal_checks_the_admin_first(spark, held, tmp_path):
    orgs = spark.createDataFrame([("o1", "boss"), ("o2", "chief")], "id string, admin_id string")
    requests = spark.createDataFrame([("o1", "t1", "boss"), ("o2", "t3", "boss")], "org_id string, account_token string, admin_id string")
    links = spark.createDataFrame([("o1", "t1"), ("o1", "t2"), ("o2", "t3")], "org_id string, account_token string")
    done = ch.remove_integrations(requests, orgs, held, links)
    collection = indexed(spark, held, tmp_path / "c")
    done.write(spark, collection, 1)
    assert sorted(r["id"] for r in done.files.collect()) == ["c", "d"]
    assert [t[1] for t in texts(collection.load(spark))] == ["c", "d"]
    assert sorted(r["account_token"] for r in done.others["integrations"].collect()) == ["t2", "t3"]


def test_directory_changes_are_applied_to_tables(spark):
    tables = {"users": spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), "members": spark.createDataFrame([("o", "a")], "org_id string, user_id string")}
    puts = {"users": spark.createDataFrame([("b", 3), ("c", None)], "id string, n int"), "links": tables["members"]}
    deletes = {"users": spark.createDataFrame([("a",)], "id string"), "members": tables["members"]}
    after = dr.apply(tables, dr.Changes(tables["users"], puts, deletes))
    assert sorted(map(tuple, after["users"].collect())) == [("b", 3), ("c", None)] and after["members"].count() == 0


def test_directory_requests(spark):
    orgs = spark.createDataFrame([("o", "Org", "o@x", "boss", "boss@x")], "id string, name string, email string, admin_id string, admin_email string")
    invites = spark.createDataFrame([("i1", "o", "Org", "i1@x")], "id string, org_id string, org_name string, org_user_email string")
    users = spark.createDataFrame([("boss", "o"), ("u1", "o"), ("lost", "gone")], "id string, organization_id string")
    members = spark.createDataFrame([("o", "boss"), ("o", "u1"), ("o", "u1")], "org_id string, user_id string")

    def codes(done):
        return [r["code"] for r in done.outcomes.orderBy("request_id").collect()]

    invite = spark.createDataFrame(
        [(1, "o", "Org", "n@x", "boss", "t"), (2, "o", "Org", "n@x", "boss", "t"), (3, "o", "Org", "m@x", "u1", "t"),
         (4, "x", "X", "m@x", "boss", "t"), (5, "o", "", "m@x", "boss", "t")],
        "request_id bigint, org_id string, org_name string, user_email string, admin_id string, ts string",
    )
    done = dr.invite_users(invite, orgs, invites)
    assert codes(done) == [None, 4102, 4201, 4006, 400]
    assert [r["org_user_email"] for r in done.puts["invites"].collect()] == ["n@x"]
    again = dr.invite_users(invite, orgs, invites.unionByName(done.puts["invites"].select(*invites.columns)))
    assert codes(again)[:2] == [4102, 4102]

    cancel = spark.createDataFrame(
        [(1, "o", "Org", "i1", "boss"), (2, "o", "Org", "i1", "boss"), (3, "o", "Org", "i9", "boss")],
        "request_id bigint, org_id string, org_name string, user_id string, admin_id string",
    )
    assert codes(dr.cancel_invites(cancel, orgs, invites)) == [None, 4101, 4101]

    register = spark.createDataFrame(
        [(1, "i1", "a@x", "Ann", "Lee", "t"), (2, "i2", "b@x", "Bo", "Ek", "t"), (3, "i1", "a@x", "", "Lee", "t")],
        "request_id bigint, id string, email string, first_name string, last_name string, ts string",
    )
    done = dr.register_users(register, invites)
    assert codes(done) == [None, 4006, 400]
    assert done.puts["users"].select("id", "name", "organization_id").head() == ("i1", "Ann Lee", "o")
    assert [r["id"] for r in done.deletes["invites"].collect()] == ["i1"]

    remove = spark.createDataFrame(
        [(1, "u1", "boss"), (2, "boss", "boss"), (3, "lost", "boss"), (4, "ghost", "boss"), (5, "u1", "u9")],
        "request_id bigint, user_id string, admin_id string",
    )
    assert codes(dr.remove_users(remove, users, orgs, members)) == [None, 400, 4006, 4006, 4201]

    new_orgs = spark.createDataFrame([(1, "New", "n@x", "a@x", "t"), (2, "New", "n@x", "a@x", "t"), (3, "", "n@x", "a@x", "t")],
                                     "request_id bigint, name string, email string, admin_email string, ts string")
    done = dr.register_organizations(new_orgs, orgs)
    assert codes(done) == [None, 4501, 400]
    org, seat = done.puts["orgs"].head(), done.puts["invites"].head()
    assert org["id"].startswith("p_") and "-" not in org["id"]
    assert org["admin_id"] == seat["id"] and seat["org_id"] == org["id"]

    admin = spark.createDataFrame([(1, "o", "u1", "z", "z@x"), (2, "o", "boss", "n1", "n1@x"), (3, "o", "boss", "n2", "n2@x")],
                                  "request_id bigint, org_id string, admin_id string, new_admin_id string, new_admin_email string")
    done = dr.change_admins(admin, orgs)
    assert codes(done) == [4201, None, 4201]
    assert done.puts["orgs"].head()["admin_id"] == "n1"


def test_questions_without_answer_get_the_fallback(spark, held):
    members = spark.createDataFrame([("o1", "u"), ("o3", "u")], "org_id string, user_id string")
    asked = spark.createDataFrame(
        [(1, "o1", "u", "apple?"), (2, "o3", "u", "anything"), (3, "o2", "u", "date")], "qid bigint, org_id string, user_id string, text string"
    )
    got = {r["qid"]: r["payload"] for r in rt.retrieve(documents.nodes_of(held, E), held, asked, members, E).collect()}
    assert got[2] == '{"response":"Please try again later","sources":[]}'
    assert "apple one." in got[1] and "https://x/a" in got[1]
    assert 3 not in got, "not a member"


def test_stages_can_be_chosen(spark, held):
    members = spark.createDataFrame([("o1", "u")], "org_id string, user_id string")
    asked = spark.createDataFrame([(1, "o1", "u", "cherry,three.")], "qid bigint, org_id string, user_id string, text string")
    plain = rt.retrieve(documents.nodes_of(held, E), held, asked, members, E, stages=[]).head()["payload"]
    assert plain.startswith('{"response":"cherry,three.')
    assert plain.count('"url"') == 3


def test_stream_of_changes_equals_the_batch(spark, held, tmp_path):
    collection = indexed(spark, held, tmp_path / "c")
    feed = tmp_path / "feed"
    log = str(tmp_path / "log")

    def run():
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).json(str(feed))
        jobs.sync_collection(stream, lambda: held, collection, E, log, available_now=True).awaitTermination()
        return texts(collection.load(spark))

    def send(*rows):
        spark.createDataFrame(list(rows), CHANGES).coalesce(1).write.mode("append").json(str(feed))

    send(("o1", "a", "DELETED"))
    assert [t[1] for t in run()] == ["b", "c", "d"]
    send(("o1", "a", "CREATED"))
    send(("o1", "c", "DELETED"))
    assert [t[1] for t in run()] == ["a", "b", "d"]
    assert [t[1] for t in run()] == ["a", "b", "d"], "a restart without new input changes nothing"


def test_stream_of_metrics_drops_late_samples(spark, tmp_path):
    src = tmp_path / "src"
    schema = "ts timestamp, series bigint, value double"

    def send(*rows):
        df = spark.createDataFrame(list(rows), "ts string, series bigint, value double")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").json(str(src))

    def run():
        stream = spark.readStream.schema(schema).json(str(src))
        jobs.rolling_metrics(stream, str(tmp_path / "out"), str(tmp_path / "log"), available_now=True).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r["window_start"].strftime("%H:%M"), r["sum_value"], r["n_series"]) for r in rows)

    send(("2024-01-01 00:01:00", 1, 2.0), ("2024-01-01 00:02:00", 1, 4.0), ("2024-01-01 00:02:00", 2, 5.0), ("2024-01-01 01:00:00", 1, 1.0))
    assert run() == [("00:00", 8.0, 2)]
    send(("2024-01-01 00:03:00", 1, 99.0), ("2024-01-01 02:00:00", 1, 1.0))
    assert run() == [("00:00", 8.0, 2), ("01:00", 1.0, 1)]
