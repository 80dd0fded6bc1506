"""One registered query per operator, over whole tables; each derives the agreed columns from its operator's output."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import ann, bpe, html_text, language, minhash, mixing, phrases, pii, simhash, sql, token_count, toxicity, va_centroids, vector_dedup

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LANGUAGES = ("de", "en", "es", "fr")
#: The key of the pseudonyms in these queries; a real one comes from the user.
KEY = "example key"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_vector_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(table(spark, d, "embeddings")).withColumnRenamed("id", "vec_id")


def op2_pii_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    out = pii.pseudonymize(table(spark, d, "documents").select("doc_id", "text"), "text", KEY)
    count = F.aggregate(F.map_values("pii"), F.lit(0), lambda a, n: a + n)
    kinds = F.array_join(F.array_sort(F.transform(F.map_entries("pii"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return out.select("doc_id", "text", count.alias("n_replaced"), kinds.alias("kinds"))


def op3_html_main_text(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    out = html_text.extract(pages, "html")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return mixing.mix(documents.select("doc_id", "text", "lang", "source")).select("doc_id", "source", "lang", "replica", "position", F.md5("text").alias("text_md5"))


def op5_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def op6_language_id(spark: SparkSession, d: str) -> DataFrame:
    model = language.fit_text_model(table(spark, d, "documents"), "text", "lang", LANGUAGES)
    pages = table(spark, d, "pages")
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    said = html_text.extract(pages.select("page_id", "url", declared.alias("declared"), "html"), "html")
    return language.identified(said, model, "page_id", "text", F.col("declared"), F.col("url")).withColumnRenamed("id", "page_id")


def op7_token_counts(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    return token_count.token_counts(documents, "text", token_count.Vocabulary.read(PIECES)).select("doc_id", "n_tokens")


def op8_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    ranks = bpe.read_ranks(BYTE_RANKS)
    ids = bpe.encode(table(spark, d, "documents").select("doc_id", "text"), "text", ranks, public_tokenizers.PATTERN)
    return bpe.decode(ids.drop("text"), "ids", ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op9_nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    return ann.nearest(table(spark, d, "embeddings"), F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")


def fold(doc: str = "id"):
    """Fifths of the documents by the hash of their id; the first is held out."""
    return F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(5))


def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    scores = toxicity.scored(table(spark, d, "documents"), table(spark, d, "labels"), fold().between(1, 3), fold() == 4)
    return scores.select(F.col("id").alias("doc_id"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_phrase_collocations(spark: SparkSession, d: str) -> DataFrame:
    return phrases.phrases(table(spark, d, "documents"))


def op12_simhash_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    rows = simhash.simhash(table(spark, d, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        simhash.shown(F.col("upper"), F.col("lower")).alias("fingerprint"),
        simhash.shown(F.col("edited_upper"), F.col("edited_lower")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "n_near",
        "group_id",
    )


def op13_centroid_clusters(spark: SparkSession, d: str) -> DataFrame:
    return va_centroids.clusters(table(spark, d, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_vector_near_dedup,
        op2_pii_pseudonyms,
        op3_html_main_text,
        op4_source_mixing,
        op5_minhash_near_dedup,
        op6_language_id,
        op7_token_counts,
        op8_byte_bpe,
        op9_nearest_vectors,
        op10_toxicity,
        op11_phrase_collocations,
        op12_simhash_fingerprints,
        op13_centroid_clusters,
    )
}
SQL: dict[str, str] = {
    "op1_vector_near_dedup": sql.VECTOR_DEDUP,
    "op4_source_mixing": sql.MIXING,
    "op5_minhash_near_dedup": sql.MINHASH,
    "op11_phrase_collocations": sql.PHRASES,
    "op12_simhash_fingerprints": sql.simhash(),
    "op13_centroid_clusters": sql.centroids(),
}
