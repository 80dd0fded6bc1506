"""Text expressions: whitespace, elements, chunks, sentences. All are built-in functions."""

import json
from collections.abc import Callable
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.model import CHUNK_OVERLAP, CHUNK_SIZE

# The characters that count as whitespace when text is split into words: all Unicode separators,
# and the controls tab to carriage return, file to unit separator, and next line.
WHITESPACE = r"[\pZ\x{09}-\x{0d}\x{1c}-\x{1f}\x{85}]+"
# The same of a text of ASCII characters only, for which Java looks up bits and no categories.
ASCII_WHITESPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}]+"

# Html tags that end a text element.
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|caption|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|"
    "footer|form|h[1-6]|head|header|hr|html|legend|li|main|nav|ol|option|p|pre|section|summary|table|tbody|"
    "td|tfoot|th|thead|title|tr|ul"
)
# Fixed form: a character reference, by number or by name.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_HIDDEN = r"(?is)<(script|style)(\s[^>]*)?>.*?</(script|style)\s*>"
HTML_BLOCK = rf"(?i)</?({BLOCK_TAGS})(\s[^>]*)?/?>"
HTML_BREAK = r"(?i)<br(\s[^>]*)?/?>"
HTML_TAG = r"</?[a-zA-Z!][^>]*>"
SENTENCE = r"[^.!?]+[.!?]*"
SEPARATOR = "\x1e"
#: Sentences whose running word counts are built together.
SUM_BLOCK = 256


def _once(text: Column, function: Callable[[Column], Column]) -> Column:
    """The function of a text that it names several times: inside a list of one, so that the text is computed once."""
    return F.get(F.transform(F.array(text), function), F.lit(0))


def _collapsed(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.length(text)
    return F.trim(F.when(ascii_only, F.regexp_replace(text, ASCII_WHITESPACE, " ")).otherwise(F.regexp_replace(text, WHITESPACE, " ")))


def collapse_ws(text: Column) -> Column:
    """Runs of whitespace become one space, and the ends are stripped."""
    return _once(text, _collapsed)


# What is cleaned from joined elements, and by what.
CLEAN_UP = ((r"[\t\n]", " "), (" +", " "))


def clean_text(elements: Column) -> Column:
    """Elements as one text: joined by newline, then tabs and newlines to spaces, then single spaces."""
    text = F.array_join(elements, "\n")
    for pattern, to in CLEAN_UP:
        text = F.regexp_replace(text, pattern, to)
    return text


def extension(name: Column) -> Column:
    """The part after the last dot, case kept. A name without a dot is its own extension."""
    return F.element_at(F.split(name, "[.]", -1), -1)


def _non_empty(parts: Column) -> Column:
    return F.filter(F.transform(parts, _collapsed), lambda e: e != "")


def line_elements(text: Column) -> Column:
    return _non_empty(F.split(text, "\n", -1))


# Names that count without a semicolon too, so that a longer unknown name may begin with one; the longest wins.
OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
# Numbers that do not stand for the character of that number.
ODD_NUMBERS = [*range(0xA0), *range(0xFDD0, 0xFDF0), *(p << 16 | low for p in range(17) for low in (0xFFFE, 0xFFFF))]
# The names seen most come first, since a map is searched from its beginning.
FREQUENT_NAMES = ["amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;"]
REFERRED = json.dumps(
    {n: html5[n] for n in (*FREQUENT_NAMES, *sorted(html5)) if n.endswith(";")} | {f"#{i}": unescape(f"&#{i};") for i in ODD_NUMBERS}
)
# Characters that hold any reference.
LONGEST_REFERENCE = 40


def decode_references(text: Column) -> Column:
    """All character references of html, each decoded once, as `html.unescape` does; what is none stays."""
    referred = F.from_json(F.lit(REFERRED), "map<string,string>")

    def numbered(body: Column) -> Column:
        hexed = F.lower(F.substring(body, 3, 1)) == "x"
        digits = F.when(hexed, F.conv(F.substring(body, 4, 8), 16, 10)).otherwise(F.substring(body, 3, 8))
        number = digits.cast("int")
        # The mark of the byte order is said, so that it is not taken out of the text.
        utf32 = F.concat(F.lit("0000FEFF"), F.lpad(F.hex(number), 8, "0"))
        char = F.coalesce(F.try_element_at(referred, F.concat(F.lit("#"), number.cast("string"))), F.decode(F.unhex(utf32), "UTF-32"))
        return F.when(number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "\ufffd").otherwise(char)

    def named(body: Column) -> Column:
        name = F.substring(body, 2, LONGEST_REFERENCE)
        begin = F.regexp_extract(name, f"^({OPEN_NAMES})", 1)
        rest = name.substr(F.length(begin) + 1, F.length(name))
        longer = F.concat(F.try_element_at(referred, F.concat(begin, F.lit(";"))), rest, F.lit(";"))
        return F.coalesce(F.try_element_at(referred, F.concat(name, F.lit(";"))), longer, F.concat(body, F.lit(";")))

    def decoded(piece: Column) -> Column:
        head = F.substring(piece, 1, LONGEST_REFERENCE)
        body = F.substring_index(head, ";", 1)
        char = F.when(body.startswith("&#"), numbered(body)).otherwise(named(body))
        rest = piece.substr(F.length(body) + 2, F.length(piece))
        return F.when(head.rlike(f"^{REFERENCE}"), F.concat(char, rest)).otherwise(piece)

    def whole(t: Column) -> Column:
        pieces = F.transform(F.split(t, f"(?={REFERENCE})", -1), decoded)
        return F.when(t.contains("&"), F.array_join(pieces, "")).otherwise(t)

    return _once(text, whole)


def html_blocks(html: Column) -> Column:
    """Visible text of a page, with a separator between blocks."""
    plain = F.replace(html, F.lit(SEPARATOR), F.lit(" "))
    t = F.regexp_replace(plain, HTML_COMMENT, " ")
    t = F.regexp_replace(t, HTML_HIDDEN, " ")
    t = F.regexp_replace(t, HTML_BLOCK, SEPARATOR)
    t = F.regexp_replace(t, HTML_BREAK, " ")
    t = F.regexp_replace(t, HTML_TAG, "")
    # All patterns begin with the same character.
    return decode_references(F.when(html.contains("<"), t).otherwise(plain))


def html_elements(html: Column) -> Column:
    return _non_empty(F.split(html_blocks(html), SEPARATOR, -1))


# Possessive, so that the pattern needs no stack: a picture of any size is one run.
RTF_HIDDEN = r"(?s)\{\\(?:\*|fonttbl|colortbl|stylesheet|info|pict)(?:[^{}]++|\{[^{}]*+\})*+\}"


def rtf_blocks(rtf: Column) -> Column:
    """Plain text of an rtf document: separators between paragraphs, control words and groups removed."""
    t = F.regexp_replace(rtf, RTF_HIDDEN, "")
    t = F.regexp_replace(t, r"[\r\n]", "")
    t = F.regexp_replace(t, r"\\(par|line|row|sect|page)(-?[0-9]+)?(?![a-z])[ ]?", SEPARATOR)
    t = F.regexp_replace(t, r"\\(tab|cell)(?![a-z])[ ]?", " ")
    t = F.regexp_replace(t, r"\\[a-z]+(-?[0-9]+)?[ ]?", "")
    t = F.regexp_replace(t, r"(?<!\\)[{}]", "")
    return F.regexp_replace(t, r"\\([\\{}])", "$1")


def rtf_elements(rtf: Column) -> Column:
    return _non_empty(F.split(rtf_blocks(rtf), SEPARATOR, -1))


def spaced_words(text: Column) -> Column:
    """Words of a text whose whitespace is already collapsed."""
    return F.array_remove(F.split(text, " ", -1), "")


def words(text: Column) -> Column:
    """Lower-case words of any text."""
    return F.array_remove(F.split(F.lower(text), WHITESPACE, -1), "")


def lower_words(text: Column) -> Column:
    """Lower-case words of a text whose whitespace is already collapsed: a plain split, no pattern."""
    return spaced_words(F.lower(text))


def chunk_count(n_words: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    step = size - overlap
    more = F.ceil(F.greatest(n_words - size, F.lit(0)) / step)
    return F.when(n_words == 0, 0).otherwise(1 + more).cast("int")


def chunks(word_list: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Word windows of `size` that share `overlap` words with the window before. [] for no words.

    The windows are cut inside the row, so the word list is never copied per window.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    n = chunk_count(F.size(word_list), size, overlap)
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: F.array_join(F.slice(word_list, i * step + 1, F.lit(size)), " "),
    )
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(windows)


def _bounded(sentence: Column, size: int) -> Column:
    """A sentence as pieces of at most `size` words: itself, but for very long ones."""
    split = spaced_words(sentence)
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(split) - 1) / size).cast("int")),
        lambda i: F.array_join(F.slice(split, i * size + 1, F.lit(size)), " "),
    )
    return F.when(F.size(split) <= size, F.array(sentence)).otherwise(cut)


def sentence_pieces(text: Column, size: int = CHUNK_SIZE) -> Column:
    """The sentences of a text whose whitespace is collapsed, those of more than `size` words cut into pieces."""
    return F.flatten(F.transform(sentences(text), lambda s: _bounded(s, size)))


def words_before(pieces: Column) -> Column:
    """Words before each piece, and of all pieces as the last entry: [0, n1, n1 + n2, ...]."""
    # The running sums are built by joining lists of sums, so that no list is copied once for each piece.
    count = F.transform(pieces, lambda p: F.size(spaced_words(p)))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(count) / SUM_BLOCK).cast("int")),
        lambda i: F.slice(count, i * SUM_BLOCK + 1, F.lit(SUM_BLOCK)),
    )
    none = F.array().cast("array<int>")

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def run(xs: Column, start: Column) -> Column:
        """The running sums of a block, after what stands before it."""
        grown = F.aggregate(xs, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.slice(grown, F.lit(2), F.size(xs))

    start = F.struct(F.lit(0).alias("sum"), F.array(none).alias("runs"))
    merged = F.aggregate(
        blocks,
        start,
        lambda a, xs: F.struct((a["sum"] + total(xs)).alias("sum"), F.concat(a["runs"], F.array(run(xs, a["sum"]))).alias("runs")),
    )
    return F.concat(F.array(F.lit(0)), F.flatten(merged["runs"]))


def packed(before: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks as ranges [begin, end) of pieces, from the words before each piece; [] for no pieces.

    A chunk takes whole pieces while they are at most `size` words. The next begins with the last pieces of it that are at most
    `overlap` words and leave room for the piece that did not fit, or with that piece.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    n = F.size(before) - 1

    def step(a: Column, i: Column) -> Column:
        """Piece i (from 0) goes into the open chunk, or closes it."""
        upto, after = F.get(before, i), F.get(before, i + 1)
        full = after > a["words"] + size
        # Pieces of the open chunk that are too far back to be repeated.
        far = F.greatest(upto - overlap, after - size)
        inside = F.slice(before, a["begin"] + 1, i - a["begin"])
        begin = a["begin"] + F.size(F.filter(inside, lambda w: w < far))
        ranges = F.concat(a["ranges"], F.array(F.struct(a["begin"].alias("begin"), i.alias("end"))))
        closed = F.struct(begin.alias("begin"), F.get(before, begin).alias("words"), ranges.alias("ranges"))
        return F.when(full, closed).otherwise(a)

    none = F.array().cast("array<struct<begin:int,end:int>>")
    start = F.struct(F.lit(0).alias("begin"), F.lit(0).alias("words"), none.alias("ranges"))
    places = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    done = F.aggregate(places, start, step, lambda a: F.concat(a["ranges"], F.array(F.struct(a["begin"].alias("begin"), n.alias("end")))))
    return F.when(n > 0, done).otherwise(none)


def sentences(text: Column) -> Column:
    return _non_empty(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)))
