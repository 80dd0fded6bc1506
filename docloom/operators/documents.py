"""Files to documents to chunks to embedded nodes. Every step but a user's model is a column expression."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.values import outcome
from docloom.model import CHUNK_OVERLAP, CHUNK_SIZE, SUPPORTED_EXTENSIONS

# Extensions whose content is marked up, with the functions to elements and to one text.
MARKUP = {"html": (tx.html_elements, tx.html_blocks), "rtf": (tx.rtf_elements, tx.rtf_blocks)}
# Extensions whose content is lines; the raw file scan has turned office files into lines.
LINES = ["txt", "csv", "docx", "pptx", "xlsx"]
PARSERS = [*MARKUP, *LINES]


def elements(ext: Column, content: Column) -> Column:
    """Text elements of a file's content by its extension; null where no parser exists."""
    out = F.when(ext.isin(LINES), tx.line_elements(content))
    for name, (parse, _) in MARKUP.items():
        # Null for all other files, whatever the order in which Spark computes them.
        out = out.when(ext == name, parse(F.when(ext == name, content)))
    return out


def whole_text(ext: Column, content: Column) -> Column:
    """The clean text of all elements together; null where no parser exists.

    Collapsing whitespace once over the whole content equals collapsing each element, dropping empty ones,
    joining and cleaning, and never builds the elements.
    """
    out = F.when(ext.isin(LINES), content)
    for name, (_, flat) in MARKUP.items():
        out = out.when(ext == name, flat(F.when(ext == name, content)))
    return tx.collapse_ws(out)


def _name_rules() -> list[tuple[Column, str]]:
    # A file without a name has no extension that could be supported.
    ext = F.coalesce(tx.extension(F.col("name")), F.lit(""))
    return [
        (~ext.isin(SUPPORTED_EXTENSIONS), "FILE_TYPE_NOT_SUPPORTED"),
        (~ext.isin(PARSERS), "PARSER_NOT_AVAILABLE"),
    ]


def _parseable() -> Column:
    return tx.extension(F.col("name")).isin([e for e in SUPPORTED_EXTENSIONS if e in PARSERS])


def without_content(files: DataFrame) -> DataFrame:
    """Parseable files whose content is missing or unreadable, with (code, reason).

    The null test is pushed to the scan, where the statistics of a row group without nulls skip it unread.
    """
    parseable = files.where(_parseable())
    if "unreadable" in files.columns:
        bad = parseable.where(F.col("content").isNull() | F.col("unreadable"))
        rules = [(F.col("content").isNull(), "COULD_NOT_DOWNLOAD_FILE"), (F.col("unreadable"), "PARSE_FAILED")]
    else:
        bad = parseable.where(F.col("content").isNull())
        rules = [(F.lit(True), "COULD_NOT_DOWNLOAD_FILE")]
    code, reason = outcome(*rules)
    return bad.withColumns({"code": code, "reason": reason}).drop("content")


def quarantine(files: DataFrame) -> DataFrame:
    """Files that cannot be loaded, with (code, reason). Names are judged without reading any content."""
    code, reason = outcome(*_name_rules())
    by_name = files.drop("content").withColumns({"code": code, "reason": reason}).where("code is not null")
    return by_name.unionByName(without_content(files).select(*by_name.columns))


def loadable(files: DataFrame) -> DataFrame:
    """The rows, without content, of the files that can be loaded."""
    bad = without_content(files).select("org_id", "id")
    return files.drop("content").where(_parseable()).join(bad, ["org_id", "id"], "left_anti")


def load(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine). Together they hold every file once; only the documents read whole contents."""
    return parse(_readable(files)), quarantine(files)


def _readable(files: DataFrame) -> DataFrame:
    good = files.where(_parseable() & F.col("content").isNotNull())
    return good.where(~F.col("unreadable")) if "unreadable" in files.columns else good


def parse(files: DataFrame) -> DataFrame:
    """One document per file: doc_id, org_id, text, process_date."""
    text = whole_text(tx.extension(F.col("name")), F.col("content"))
    return files.select("org_id", F.col("id").alias("doc_id"), text.alias("text"), "process_date")


def split_documents(files: DataFrame) -> DataFrame:
    """One document per text element instead of one per file."""
    parsed = elements(tx.extension(F.col("name")), F.col("content"))
    return _readable(files).select(
        "org_id", F.col("id").alias("doc_id"), F.posexplode(parsed).alias("element_idx", "text"), "process_date"
    ).withColumn("element_idx", F.col("element_idx").cast("bigint"))


def chunk(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Ordered chunks linked to their document; a document without words has none."""
    worded = documents.withColumn("_words", tx.spaced_words(F.col("text")))
    cut = worded.select(
        "org_id",
        "doc_id",
        "process_date",
        F.posexplode(tx.chunks(F.col("_words"), size, overlap)).alias("chunk_idx", "text"),
    )
    return cut.select(
        "org_id",
        F.concat_ws("#", "doc_id", F.col("chunk_idx").cast("string")).alias("node_id"),
        "doc_id",
        F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
        "text",
        "process_date",
    )


def chunk_sentences(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Like `chunk`, but chunks hold whole sentences: at most `size` words, the last sentences of up to `overlap` words repeated.

    Only a sentence of more than `size` words is cut. A document without sentences has no chunk. Everything happens inside the
    document's row, in steps, so that each list is computed once.
    """
    split = documents.withColumn("_pieces", tx.sentence_pieces(F.col("text"), size))
    counted = split.withColumn("_before", tx.words_before(F.col("_pieces")))
    cut = counted.select(
        "org_id", "doc_id", "process_date", "_pieces", F.posexplode(tx.packed(F.col("_before"), size, overlap)).alias("chunk_idx", "_range")
    )
    text = F.array_join(F.slice("_pieces", F.col("_range.begin") + 1, F.col("_range.end") - F.col("_range.begin")), " ")
    return cut.select(
        "org_id",
        F.concat_ws("#", "doc_id", F.col("chunk_idx").cast("string")).alias("node_id"),
        "doc_id",
        F.col("chunk_idx").cast("bigint").alias("chunk_idx"),
        text.alias("text"),
        "process_date",
    )


def embed(nodes: DataFrame, embedder) -> DataFrame:
    """Adds `embedding`. A vector that is missing or has another length than the embedder's fails the job."""
    embedded = embedder.embed(nodes, "text", "embedding")
    dim = getattr(embedder, "dim", None)
    if dim is None:
        return embedded
    wrong = F.raise_error(F.concat(F.lit("no usable vector for node "), F.col("node_id"))).cast(embedded.schema["embedding"].dataType)
    return embedded.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(wrong))


def nodes_of(files: DataFrame, embedder, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, chunker=chunk) -> DataFrame:
    """Files to embedded nodes in one narrow stage: no shuffle between scan and result. `chunker` may be `chunk_sentences`."""
    documents, _ = load(files)
    return embed(chunker(documents, size, overlap), embedder)
