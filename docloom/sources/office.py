"""Text of zipped XML office files, as lines. A per-row helper for the raw file scan."""

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

OFFICE_EXTENSIONS = ["docx", "pptx", "xlsx"]


def _parts(names: list[str], pattern: str) -> list[str]:
    """Numbered parts in their order, such as slide2 before slide10."""
    return sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))


def _blocks(xml: bytes, block: str) -> list[str]:
    """Text of every block element; `t` elements hold the text, whatever the namespace."""
    found = (e for e in ElementTree.fromstring(xml).iter() if e.tag.endswith("}" + block))
    return ["".join(t.text or "" for t in e.iter() if t.tag.endswith("}t")) for e in found]


def _sheet_rows(xml: bytes, shared: list[str]) -> list[str]:
    lines = []
    for row in (e for e in ElementTree.fromstring(xml).iter() if e.tag.endswith("}row")):
        cells = []
        for c in row:
            values = [e.text or "" for e in c.iter() if e.tag.endswith(("}v", "}t"))]
            cells.append(shared[int(values[0])] if c.get("t") == "s" and values else "".join(values))
        lines.append(" ".join(cells))
    return lines


def office_lines(content: bytes, ext: str) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if ext == "docx":
            return _blocks(z.read("word/document.xml"), "p")
        if ext == "pptx":
            return [line for n in _parts(names, r"ppt/slides/slide\d+\.xml") for line in _blocks(z.read(n), "p")]
        shared = _blocks(z.read("xl/sharedStrings.xml"), "si") if "xl/sharedStrings.xml" in names else []
        return [line for n in _parts(names, r"xl/worksheets/sheet\d+\.xml") for line in _sheet_rows(z.read(n), shared)]


def _text(content: bytes | None, ext: str) -> str | None:
    if content is None:
        return None
    try:
        return "\n".join(office_lines(content, ext))
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError):
        return None


@F.pandas_udf(T.StringType())
def office_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for contents, exts in batches:
        yield pd.Series([_text(c, e) for c, e in zip(contents, exts)], dtype=object)
