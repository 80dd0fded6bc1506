import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import values as v
from docloom.model import ACCESS_DEFAULTS, FILE_DEFAULTS, INVITATION_DEFAULTS, ORGANIZATION_DEFAULTS, USER_DEFAULTS
from docloom.operators import documents


def one(spark, column, **row):
    return spark.createDataFrame([row]).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("name", "ext"), [("a.b.PDF", "PDF"), ("txt", "txt"), ("x.", ""), ("x.tar.gz", "gz"), ("a.txt", "txt")]
)
def test_extension_is_the_part_after_the_last_dot(spark, name, ext):
    assert one(spark, tx.extension(F.col("n")), n=name) == ext


@pytest.mark.parametrize(
    ("elements", "text"),
    [([""], ""), (["\n\n"], " "), (["\tlead"], " lead"), (["a    b", "c"], "a b c"), (["a ", " b"], "a b")],
)
def test_clean_text_joins_and_compresses_but_does_not_trim(spark, elements, text):
    assert one(spark, tx.clean_text(F.col("e")), e=elements) == text


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab \t\n\r\x0b\x0c\x1c\x1e\x85\xa0  　é."), max_size=30), min_size=1, max_size=30))
def test_whitespace_equals_pythons_split(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["x"] for r in df.select(tx.collapse_ws(F.col("t")).alias("x")).collect()]
    assert got == [" ".join(t.split()) for t in texts]


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab \t\n\r<>p/&;\x1e"), max_size=40), min_size=1, max_size=30))
def test_whole_text_equals_cleaned_elements(spark, texts):
    df = spark.createDataFrame([(t, e) for t in texts for e in ("html", "txt", "csv")], "t string, e string")
    c, e = F.col("t"), F.col("e")
    rows = df.select(
        documents.whole_text(e, c).alias("a"), tx.clean_text(documents.elements(e, c)).alias("b")
    ).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_html_elements(spark):
    html = (
        "<html><head><title>T &amp; U</title><style>p{}</style></head><body><!-- x <p>no</p> -->"
        "<SCRIPT type='a'>var t='</p>';</SCRIPT><p>one <b>bo</b>ld<br>two</p><ul><li>a</li><li> </li><li>5 &lt; 6</li></ul></body>"
    )
    assert one(spark, tx.html_elements(F.col("h")), h=html) == ["T & U", "one bold two", "a", "5 < 6"]


def test_rtf_elements(spark):
    rtf = r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0\fs24 First \b bold\b0  line\par Second\tab cell \{x\}\par}"
    assert one(spark, tx.rtf_elements(F.col("r")), r=rtf) == ["First bold line", "Second cell {x}"]


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (1, [1]), (10, [10]), (11, [10, 3]), (18, [10, 10]), (19, [10, 10, 3])])
def test_chunk_windows(spark, n, sizes):
    text = " ".join(f"w{i}" for i in range(n))
    words = tx.spaced_words(F.col("t"))
    got = one(spark, tx.chunks(words, 10, 2), t=text)
    assert [len(c.split()) for c in got] == sizes


@settings(max_examples=15, deadline=None)
@given(n=st.integers(0, 200), size=st.integers(1, 40), data=st.data())
def test_chunks_rejoin_to_the_text(spark, n, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    words = [f"w{i}" for i in range(n)]
    got = one(spark, tx.chunks(tx.spaced_words(F.col("t")), size, overlap), t=" ".join(words))
    joined = []
    for i, c in enumerate(got):
        joined += c.split() if i == 0 else c.split()[overlap:]
    assert joined == words


def test_chunk_overlap_must_be_below_size():
    with pytest.raises(ValueError):
        tx.chunks(F.array(), 5, 5)


def test_sentences_without_marks_are_one(spark):
    assert one(spark, tx.sentences(F.col("t")), t="no mark here") == ["no mark here"]
    assert one(spark, tx.sentences(F.col("t")), t="A b. C? D!! ") == ["A b.", "C?", "D!!"]


def test_epoch_text_and_back(spark):
    df = spark.sql("select timestamp'2023-11-14 22:13:20' a, timestamp'2023-11-14 22:13:20.25' b, cast(null as timestamp) c")
    row = df.select(*[v.epoch_string(F.col(c)).alias(c) for c in "abc"]).head()
    assert tuple(row) == ("1700000000.0", "1700000000.25", "")
    back = df.select((v.parse_epoch(v.epoch_string(F.col("b"))) == F.col("b")).alias("x")).head()["x"]
    assert back


def test_process_date_and_back(spark):
    df = spark.createDataFrame([("01/31/2024, 23:59:58",), ("",), ("2024-01-31",), (None,)], "t string")
    got = [r["x"] for r in df.select(v.process_date(v.parse_process_date(F.col("t"))).alias("x")).collect()]
    assert got == ["01/31/2024, 23:59:58", None, None, None]


def test_array_batches(spark):
    assert one(spark, v.array_batches(F.col("a"), 2), a=[1, 2, 3, 4, 5]) == [[1, 2], [3, 4], [5]]
    assert spark.sql("select array() a").select(v.array_batches(F.col("a").cast("array<int>"), 2).alias("x")).head()["x"] == []


def test_typed_records_with_maps(spark):
    fields = {"id": "S", "n": "N", "l": "L", "m": "M"}
    df = spark.createDataFrame([("a", 3, ["x", "y"], {"k": "v"})], "id string, n bigint, l array<string>, m map<string,string>")
    rec = df.select(v.to_typed(fields).alias("r"))
    assert rec.head()["r"] == '{"id":{"S":"a"},"n":{"N":"3"},"l":{"L":[{"S":"x"},{"S":"y"}]},"m":{"M":{"k":{"S":"v"}}}}'
    assert rec.select(*v.from_typed(F.col("r"), fields)).head() == df.head()


def test_defaults_fill_missing_and_null_fields(spark):
    df = spark.createDataFrame([("o", None)], "id string, name string")
    for defaults in (FILE_DEFAULTS, ORGANIZATION_DEFAULTS, USER_DEFAULTS, INVITATION_DEFAULTS, ACCESS_DEFAULTS):
        assert v.with_defaults(df, defaults).head().asDict() == defaults | {"id": "o"}
