import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import checks, documents, keyed, rollup, sets
from docloom.sources import catalog


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_get_reports_missing_keys(spark):
    table = spark.createDataFrame([("a", 1)], "id string, v int")
    keys = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    rows = {r["id"]: (r["v"], r["code"], r["reason"]) for r in keyed.get(table, keys).collect()}
    assert rows == {"a": (1, None, None), "b": (None, 4006, "Item does not exist")}


def test_upsert_keeps_the_last_of_duplicate_keys(spark):
    table = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "id string, v int, seq int")
    new = spark.createDataFrame([("a", 7, 2), ("a", 6, 1), ("c", 3, 1)], "id string, v int, seq int")
    got = sorted((r["id"], r["v"]) for r in keyed.upsert(table, new, order="seq").collect())
    assert got == [("a", 7), ("b", 2), ("c", 3)]


def test_delete_ignores_absent_keys_and_returning_reports_them(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    keys = spark.createDataFrame([("a",), ("z",)], "id string")
    assert ids(keyed.delete(table, keys)) == ["b"]
    old, rest = keyed.delete_returning(table, keys)
    assert sorted((r["id"], r["v"], r["code"]) for r in old.collect()) == [("a", 1, None), ("z", None, 4006)]
    assert ids(rest) == ["b"]


def test_lookup_filter_reaches_the_scan(spark, sf, capsys):
    keyed.lookup(spark.read.parquet(f"{sf}/customer.parquet"), "c_mktsegment", "BUILDING", "c_custkey").explain()
    plan = capsys.readouterr().out
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


@pytest.mark.parametrize("n", [0, 1, 49, 50, 51, 500])
def test_batches_of_fifty_with_a_hot_group(spark, n):
    rows = [("hot", f"{i:05d}") for i in range(n)] + [("cold", "x")]
    df = spark.createDataFrame(rows, "org_id string, file_id string").repartition(3)
    got = {(r["org_id"], r["batch_no"]): r["file_ids"] for r in sets.id_batches(df).collect()}
    want = {("hot", i // 50): [f"{j:05d}" for j in range(i, min(i + 50, n))] for i in range(0, n, 50)}
    assert got == want | {("cold", 0): ["x"]}


@settings(max_examples=15, deadline=None)
@given(a=st.lists(st.sampled_from("abcdef")), b=st.lists(st.sampled_from("abcdef")))
def test_set_laws_hold_in_both_forms(spark, a, b):
    x = spark.createDataFrame([("o", i) for i in a], "org_id string, file_id string")
    y = spark.createDataFrame([("o", i) for i in b], "org_id string, file_id string")
    assert ids(sets.union_ids(x, y), "file_id") == sorted(set(a) | set(b))
    assert set(ids(sets.except_ids(x, y), "file_id")) == set(a) - set(b)
    nested = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    row = nested.select(sets.add_ids(F.col("a"), F.col("b")).alias("u"), sets.remove_ids(F.col("a"), F.col("b")).alias("d")).head()
    assert row["u"] == sorted(set(a) | set(b)) and row["d"] == sorted(set(a) - set(b))


def test_readiness_cases(spark):
    accounts = spark.createDataFrame([("none",), ("done",), ("failed",), ("wait",)], "account_token string")
    statuses = spark.createDataFrame(
        [("done", "DONE"), ("failed", "DONE"), ("failed", "FAILED"), ("failed", "SYNCING"), ("wait", "DONE"), ("wait", "SYNCING")],
        "account_token string, status string",
    )
    got = {r["account_token"]: r["readiness"] for r in rollup.sync_readiness(accounts, statuses).collect()}
    assert got == {"none": "ready", "done": "ready", "failed": "failed", "wait": "pending"}


def test_every_operation_is_present(spark):
    feed = spark.createDataFrame([("o", "a", "UPDATED")], "org_id string, file_id string, operation string")
    got = {r["operation"]: r["n_ids"] for r in sets.grouped_operations(feed).collect()}
    assert got == {"CREATED": 0, "UPDATED": 1, "DELETED": 0}


def test_required_fields_names_what_is_missing(spark):
    df = spark.createDataFrame([("a", "x"), ("", "x"), (None, None)], "p string, q string")
    accepted, rejected = checks.split(checks.required_fields(df, ["p", "q"]))
    assert accepted.count() == 1
    assert sorted(r["missing"] for r in rejected.collect()) == [["p"], ["p", "q"]]


def test_null_operation_is_refused(spark):
    df = spark.createDataFrame([("CREATED",), ("created",), (None,)], "operation string")
    assert [r["code"] for r in checks.valid_operation(df).collect()] == [None, 4501, 4501]


def test_is_admin_is_true_for_the_admin(spark):
    orgs = spark.createDataFrame([("o", "u1")], "id string, admin_id string")
    pairs = spark.createDataFrame([("u1", "o"), ("u2", "o")], "user_id string, org_id string")
    assert {r["user_id"]: r["is_admin"] for r in checks.is_admin(pairs, orgs).collect()} == {"u1": True, "u2": False}
    claims = spark.createDataFrame([("o", "u1"), ("o", "u2"), ("x", "u1")], "org_id string, admin_id string")
    got = {(r["org_id"], r["admin_id"]): (r["allowed"], r["code"]) for r in checks.admin_check(claims, orgs).collect()}
    assert got == {("o", "u1"): (True, None), ("o", "u2"): (False, 4201), ("x", "u1"): (False, 4006)}


def test_nobody_deletes_themselves(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "user_id string, admin_id string")
    assert ids(checks.not_self(df), "user_id") == ["b"]


def test_folders_need_an_id(spark):
    df = spark.createDataFrame([("f1", "p", "d1"), ("f2", "p", "d2")], "id string, parent_id string, drive_id string")
    assert ids(catalog.list_folders(df, folder_id="p")) == ["f1", "f2"]
    assert ids(catalog.list_folders(df, folder_id="p", drive_id="d2")) == ["f2"]
    with pytest.raises(ValueError):
        catalog.list_folders(df)


def test_folder_scan_does_not_read_content(spark, tmp_path, capsys):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "sub" / "b.c.html").write_bytes(b"<p>x</p>")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    files = catalog.list_folder_files(spark, str(tmp_path))
    assert ids(files, "name") == ["a.txt", "b.c.html", "bad.txt"]
    assert {r["name"]: r["size"] for r in files.select("name", "size").collect()}["a.txt"] == 5
    rows = catalog.as_text(files).select("name", "content", "unreadable").collect()
    assert sorted((r["name"], r["content"], r["unreadable"]) for r in rows) == [
        ("a.txt", "hello", False), ("b.c.html", "<p>x</p>", False), ("bad.txt", "", True)
    ]
    files.select("name", "size").explain()
    assert "content" not in capsys.readouterr().out


def test_parallel_write_cuts_slices(spark, tmp_path):
    keyed.write_in_batches(spark.range(1050), str(tmp_path / "w"), tasks=2, rows_per_file=100)
    back = spark.read.parquet(str(tmp_path / "w"))
    assert back.count() == 1050
    per_file = back.groupBy(F.input_file_name()).count().agg(F.max("count")).head()[0]
    assert per_file <= 100


def zipped(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)


def test_office_files_and_broken_ones(spark, tmp_path):
    w = 'xmlns:w="urn:w"'
    zipped(tmp_path / "a.docx", {"word/document.xml": f"<w:d {w}><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:t>three</w:t></w:p></w:d>"})
    slide = '<s xmlns:a="urn:a"><a:p><a:t>slide {}</a:t></a:p></s>'
    zipped(tmp_path / "b.pptx", {f"ppt/slides/slide{i}.xml": slide.format(i) for i in (10, 2, 1)})
    zipped(
        tmp_path / "c.xlsx",
        {
            "xl/sharedStrings.xml": '<x xmlns="urn:x"><si><t>name</t></si><si><t>pear</t></si></x>',
            "xl/worksheets/sheet1.xml": '<x xmlns="urn:x"><row><c t="s"><v>0</v></c><c><v>7</v></c></row><row><c t="s"><v>1</v></c></row></x>',
        },
    )
    (tmp_path / "d.docx").write_bytes(b"not a zip")
    (tmp_path / "e.rtf").write_text(r"{\rtf1 plain\par}")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    files = catalog.as_text(catalog.list_folder_files(spark, str(tmp_path)))
    good, bad = documents.load(files.withColumn("org_id", F.lit("o")).withColumn("process_date", F.lit("")))
    text = {r["doc_id"].split("/")[-1]: r["text"] for r in good.collect()}
    assert text == {"a.docx": "One two three", "b.pptx": "slide 1 slide 2 slide 10", "c.xlsx": "name 7 pear", "e.rtf": "plain"}
    assert sorted((r["name"], r["code"]) for r in bad.collect()) == [("d.docx", 4902), ("f.pdf", 4901)]
