"""Queries over parsing, loading, chunking, embedding and search."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.vectors import HashedEmbedder, ModelEmbedder, check_embeddings
from docloom.model import CHUNK_OVERLAP, CHUNK_SIZE
from docloom.operators import documents, search
from docloom.plans import retrieve as rt
from docloom.plans.changes import delete_nodes
from docloom.queries import fixtures as fx
from docloom.queries.fixtures import table, with_ctes
from docloom.queries.registry import query
from docloom.queries.text_sql import sentence_chunks, sql_html, sql_lines
from docloom.session import materialize
from docloom.sources.catalog import as_text

EMBEDDER = HashedEmbedder()


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Embedded nodes of every loadable file, written once so that later steps read only the columns they need."""
    return materialize(documents.nodes_of(fx.files(spark, d), EMBEDDER), "nodes")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return rt.ask(fx.questions(spark, d), fx.members(spark, d), EMBEDDER)


@query(
    "parse_html",
    f"""SELECT page_id, CAST(i AS BIGINT) AS element_idx, e[i+1] AS text
        FROM (SELECT page_id, e, unnest(range(len(e))) AS i FROM (SELECT page_id, {sql_html('html')} AS e FROM pages))""",
)
def parse_html(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "pages").select("page_id", F.posexplode(tx.html_elements(F.col("html"))).alias("i", "text"))
    return found.select("page_id", F.col("i").cast("bigint").alias("element_idx"), "text")


@query(
    "split_elements",
    with_ctes(
        """SELECT org_id, doc_id, CAST(i AS BIGINT) AS element_idx, els[i+1] AS text, process_date
           FROM (SELECT *, unnest(range(len(els))) AS i FROM parsed)""",
        "parsed",
    ),
)
def split_elements(spark: SparkSession, d: str) -> DataFrame:
    return documents.split_documents(fx.files(spark, d))


@query(
    "load_quarantine",
    with_ctes(
        """SELECT c.id, code, reason, d.text, d.process_date FROM checked c LEFT JOIN document d ON d.doc_id = c.id""",
        "checked",
        "document",
    ),
)
def load_quarantine(spark: SparkSession, d: str) -> DataFrame:
    good, bad = documents.load(fx.files(spark, d))
    nothing = F.lit(None).cast("string")
    return good.select(
        F.col("doc_id").alias("id"), F.lit(None).cast("bigint").alias("code"), nothing.alias("reason"), "text", "process_date"
    ).unionByName(bad.select("id", "code", "reason", nothing.alias("text"), nothing.alias("process_date")))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return documents.chunk(documents.load(fx.files(spark, d))[0])


@query("chunk_documents", with_ctes("SELECT org_id, node_id, doc_id, chunk_idx, text, process_date FROM chunk", "chunk"))
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d)


@query("chunk_sentences", with_ctes(sentence_chunks(128, 20), "document"))
def chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of whole sentences, of at most 128 words so that the given texts have several."""
    return documents.chunk_sentences(documents.load(fx.files(spark, d))[0], 128, 20)


#: Characters of chunks that are given away together.
CHUNK_CHARS = 1 << 20


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows-to-rows form of the chunker, for callers that bring their own splitting: Arrow batches (doc_id, text).

    One text at a time is split, and chunks leave as soon as they have so many characters.
    """
    step = CHUNK_SIZE - CHUNK_OVERLAP
    names, kinds = ["doc_id", "chunk_idx", "text"], (pa.string(), pa.int64(), pa.string())
    for batch in batches:
        held, chars = ([], [], []), 0
        for doc_id, text in zip(*batch.columns):
            words = [w for w in (text.as_py() or "").split(" ") if w]
            for place, at in enumerate(range(0, max(len(words) - CHUNK_OVERLAP, min(len(words), 1)), step)):
                chunk = " ".join(words[at : at + CHUNK_SIZE])
                for column, value in zip(held, (doc_id.as_py(), place, chunk)):
                    column.append(value)
                chars += len(chunk)
                if chars >= CHUNK_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, kinds)], names)
                    held, chars = ([], [], []), 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, kinds)], names)


@query("udtf_chunker", with_ctes("SELECT doc_id, chunk_idx, text FROM chunk", "chunk"))
def udtf_chunker(spark: SparkSession, d: str) -> DataFrame:
    docs = documents.load(fx.files(spark, d))[0].select("doc_id", "text")
    return docs.mapInArrow(chunk_rows, "doc_id string, chunk_idx bigint, text string")


@query(
    "parse_rtf",
    f"""SELECT doc_id, CAST(i AS BIGINT) AS element_idx, e[i+1] AS text
        FROM (SELECT doc_id, e, unnest(range(len(e))) AS i FROM (SELECT doc_id, {sql_lines('text')} AS e FROM documents))""",
)
def parse_rtf(spark: SparkSession, d: str) -> DataFrame:
    """Every document written as rtf and parsed again: its lines come back."""
    rtf = table(spark, d, "documents").select("doc_id", fx.as_rtf(F.col("text")).alias("rtf"))
    found = rtf.select("doc_id", F.posexplode(tx.rtf_elements(F.col("rtf"))).alias("i", "text"))
    return found.select("doc_id", F.col("i").cast("bigint").alias("element_idx"), "text")


@query(
    "raw_files",
    f"""SELECT 'd'||doc_id AS id, coalesce(array_to_string({sql_lines('text')}, ' '), '') AS text, NULL AS code FROM documents WHERE doc_id % 7 <> 0
        UNION ALL SELECT 'd'||doc_id, NULL, 4902 FROM documents WHERE doc_id % 7 = 0""",
)
def raw_files(spark: SparkSession, d: str) -> DataFrame:
    """Every document as the bytes of a raw file, read to text and parsed; every seventh is no UTF-8."""
    broken = F.col("doc_id") % 7 == 0
    raw = table(spark, d, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("f."), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".rtf")).alias("name"),
        F.when(broken, F.concat(F.unhex(F.lit("fffe")), F.col("text").cast("binary")))
        .otherwise(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(fx.as_rtf(F.col("text"))).cast("binary"))
        .alias("content"),
        F.lit("o").alias("org_id"),
        F.lit("").alias("process_date"),
    )
    good, bad = documents.load(as_text(raw))
    none = F.lit(None)
    return good.select(F.col("doc_id").alias("id"), "text", none.cast("bigint").alias("code")).unionByName(
        bad.select("id", none.cast("string").alias("text"), "code")
    )


@query(
    "embed_hashed",
    with_ctes(
        "SELECT node_id, CAST(('0x'||b)::INT AS BIGINT) AS bucket, CAST(c AS BIGINT) AS n FROM node_count", "node_count"
    ),
)
def embed_hashed(spark: SparkSession, d: str) -> DataFrame:
    """The set entries of each vector."""
    embedded = documents.embed(chunks(spark, d), EMBEDDER)
    entries = embedded.select("node_id", F.posexplode("embedding").alias("bucket", "n")).where("n > 0")
    return entries.select("node_id", F.col("bucket").cast("bigint").alias("bucket"), F.col("n").cast("bigint").alias("n"))


def load_length_model() -> Callable[[list[str]], list]:
    """Stands for a user's model: a vector of characters and spaces."""
    return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]


@query(
    "embed_udf",
    with_ctes(
        """SELECT node_id, CAST(length(text) AS BIGINT) AS n_chars,
                  CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS n_spaces FROM chunk""",
        "chunk",
    ),
)
def embed_udf(spark: SparkSession, d: str) -> DataFrame:
    embedded = documents.embed(chunks(spark, d), ModelEmbedder(load_length_model, 2))
    return embedded.select(
        "node_id",
        F.element_at("embedding", 1).cast("bigint").alias("n_chars"),
        F.element_at("embedding", 2).cast("bigint").alias("n_spaces"),
    )


@query(
    "embedding_check",
    with_ctes(
        """SELECT count(*) AS n_nodes, CAST(0 AS BIGINT) AS n_missing, CAST(256 AS BIGINT) AS min_dim,
                  CAST(256 AS BIGINT) AS max_dim, true AS usable FROM chunk""",
        "chunk",
    ),
)
def embedding_check(spark: SparkSession, d: str) -> DataFrame:
    return check_embeddings(documents.embed(chunks(spark, d), EMBEDDER), EMBEDDER.dim)


@query(
    "delete_nodes_anti",
    with_ctes(
        """SELECT org_id, node_id FROM chunk
           WHERE (org_id, doc_id) NOT IN (SELECT org_id, file_id FROM change WHERE operation IN ('UPDATED','DELETED'))""",
        "chunk",
        "change",
    ),
)
def delete_nodes_anti(spark: SparkSession, d: str) -> DataFrame:
    gone = fx.changes(spark, d).where(F.col("operation").isin("UPDATED", "DELETED"))
    return delete_nodes(chunks(spark, d), gone.withColumnRenamed("file_id", "doc_id")).select("org_id", "node_id")


@query("vector_topk", with_ctes("SELECT qid, org_id, node_id, score, rank FROM topk", "topk"))
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.top_k(nodes(spark, d), asked(spark, d)).select("qid", "org_id", "node_id", "score", "rank")


@query("vector_topk_blocked", with_ctes("SELECT qid, org_id, node_id, score, rank FROM topk", "topk"))
def vector_topk_blocked(spark: SparkSession, d: str) -> DataFrame:
    """The same in small blocks, so that every organization has several of each kind."""
    found = search.top_k(nodes(spark, d), asked(spark, d), node_block=64 * EMBEDDER.dim, question_block=64 * EMBEDDER.dim)
    return found.select("qid", "org_id", "node_id", "score", "rank")


@query(
    "vector_topk_dense",
    """
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS rank
      FROM (SELECT q.vec_id AS qid, 'v'||n.vec_id AS node_id,
                   round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(n.embedding AS DOUBLE[])), 9) AS score
            FROM embeddings q, embeddings n)) WHERE rank <= 10""",
)
def vector_topk_dense(spark: SparkSession, d: str) -> DataFrame:
    """Every given vector asks for its nearest vectors in one collection."""
    vectors = table(spark, d, "embeddings").withColumn("org_id", F.lit("all"))
    held = vectors.select("org_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("node_id"), "embedding")
    questions = vectors.select("org_id", F.col("vec_id").alias("qid"), "embedding")
    return search.top_k(held, questions).select("qid", "node_id", "score", "rank")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    held, q = nodes(spark, d), asked(spark, d)
    return search.candidates(held, q, search.top_k(held, q))


@query("rerank_topn", with_ctes("SELECT qid, node_id, rerank_score, rerank_rank FROM reranked", "reranked"))
def rerank_topn(spark: SparkSession, d: str) -> DataFrame:
    kept = _candidates(spark, d).transform(search.rerank())
    return kept.select("qid", "node_id", "rerank_score", "rerank_rank")


@query("recency_topk", with_ctes("SELECT qid, node_id, process_date, recency_rank FROM recent", "recent"))
def recency_topk(spark: SparkSession, d: str) -> DataFrame:
    kept = search.apply_stages(_candidates(spark, d), [search.rerank(), search.recency()])
    return kept.select("qid", "node_id", "process_date", "recency_rank")


@query("sentence_optimizer", with_ctes("SELECT qid, node_id, recency_rank, doc_id, text FROM optimized", "optimized"))
def sentence_optimizer(spark: SparkSession, d: str) -> DataFrame:
    kept = search.apply_stages(_candidates(spark, d), rt.default_stages(EMBEDDER))
    return kept.select("qid", "node_id", "recency_rank", "doc_id", "text")


def _context(spark: SparkSession, d: str) -> DataFrame:
    return rt.context(nodes(spark, d), asked(spark, d), EMBEDDER)


@query("source_lookup", with_ctes("SELECT qid, name, url FROM src", "src"))
def source_lookup(spark: SparkSession, d: str) -> DataFrame:
    return search.sources(_context(spark, d), fx.files(spark, d))


@query("extractive_answer", with_ctes("SELECT qid, response FROM answer", "answer"))
def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    return search.extractive_answer(_context(spark, d))


@query(
    "answer_payload",
    """
    SELECT qid, CAST(to_json({'response': coalesce(response, 'Please try again later'),
                         'sources': CASE WHEN response IS NULL THEN [] ELSE coalesce(l, []) END}) AS VARCHAR) AS payload
    FROM (SELECT conv_id*100+turn AS qid, CASE WHEN role <> 'system' THEN text END AS response, conv_id FROM conversations)
    LEFT JOIN (SELECT item_id, list({'name': text, 'url': url} ORDER BY text, url) AS l
               FROM benchmark JOIN pages ON page_id = item_id GROUP BY item_id) ON item_id = conv_id""",
)
def answer_payload(spark: SparkSession, d: str) -> DataFrame:
    """Turns as answers, where a system turn stands for a failed one; sources by the conversation's number."""
    turns = table(spark, d, "conversations").withColumn("qid", F.col("conv_id") * 100 + F.col("turn"))
    answers = turns.where("role <> 'system'").select("qid", F.col("text").alias("response"))
    items = table(spark, d, "benchmark").join(table(spark, d, "pages"), F.col("item_id") == F.col("page_id"))
    found = turns.join(items.select("item_id", F.col("text").alias("name"), "url"), F.col("conv_id") == F.col("item_id"))
    return rt.payloads(turns, answers, found.select("qid", "name", "url"))


@query("retrieve", with_ctes("SELECT qid, payload FROM payload", "payload"))
def retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Questions to JSON answers over the whole collection."""
    return rt.retrieve(nodes(spark, d), fx.files(spark, d), fx.questions(spark, d), fx.members(spark, d), EMBEDDER)
