"""Character references are decoded without Python, as Python's own `html.unescape` decodes them."""

import re
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import documents
from docloom.queries import texts

ODD = [0, 9, 10, 13, 30, 31, 32, 38, 65, 0x7F, 0x80, 0x81, 0x9F, 0xA0, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFEFF, 0xFFFD, 0xFFFE, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 9999999]


def expected(text):
    return re.sub(tx.REFERENCE, lambda m: unescape(m.group()).replace("\x1e", " "), text)


def test_references_equal_unescape(spark):
    names = [n.rstrip(";") for n in html5] + ["notit", "ampx", "ltgt", "unknown", "notin", "gtreqless", "x", "a" * 32, "a" * 33]
    rows = [f"&{n};" for n in names] + [f"a&#{i};b" for i in (*range(0x200), *ODD)] + [f"&#x{i:x};&#X{i:X};" for i in ODD]
    rows += ["", "no", "&", "&;", "& amp;", "&amp", "&amp;amp;", "&&lt;&gt;;&#38;lt;", "x &copy; y\n&#0065; &#x; &#12345678; &#xfffffff;", "é&eacute;😀&#128512;" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, None])], "i int, t string")
    got = dict(map(tuple, df.select("i", tx.decode_references(F.col("t"))).collect()))
    assert {i: got[i] for i, t in enumerate(rows) if got[i] != expected(t)} == {}
    assert got[len(rows)] is None


def test_parsing_needs_no_python(spark, capsys):
    row = ("o", "a", "a.html", "", "<p>x &amp; y</p>")
    files = spark.createDataFrame([row], "org_id string, id string, name string, process_date string, content string")
    good, _ = documents.load(files)
    for df in (good, documents.split_documents(files)):
        df.explain()
        assert df.head()["text"] == "x & y"
    assert "Python" not in capsys.readouterr().out


def test_chunks_leave_before_the_batch_is_done():
    """Ten thousand texts are no longer split and held at once."""
    text = " ".join(["word"] * 2000)
    batch = pa.RecordBatch.from_pydict({"doc_id": [f"d{i}" for i in range(300)] + ["none"], "text": [text] * 300 + [None]})
    out = list(texts.chunk_rows(iter([batch])))
    assert len(out) > 1 and max(sum(map(len, b.column("text").to_pylist())) for b in out) < texts.CHUNK_CHARS + 10 * 1024
    rows = [r for b in out for r in zip(*(c.to_pylist() for c in b.columns))]
    words = text.split(" ")
    assert rows == [(f"d{i}", k, " ".join(words[at : at + 1024])) for i in range(300) for k, at in enumerate((0, 1004))]
