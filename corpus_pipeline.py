"""From raw documents to token ids: the stages of a training-data pipeline, in order.

Each stage gets the documents that the one before kept, as written to Parquet, and all but the last return the columns of
documents. Null texts and texts without letters leave with the first stage; an empty table passes through all.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, language, minhash, mixing, pii
from docloom.llm.filters import exact_members, members
from docloom.llm.queries import BYTE_RANKS, KEY, LANGUAGES
from docloom.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those to be known; `lang` becomes the language found. Each row is judged by itself."""
    model = language.fit_text_model(docs, "text", "lang", LANGUAGES)
    found = language.identified(docs, model, "doc_id", "text", F.col("lang"), F.col("source"), carry=("doc_id", "text", "source", "n_chars"))
    kept = found.where("not rejected").select("row.*", "lang")
    return kept.select(COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates, once; of one id the text of smallest hash.

    A row is known by its id, or by a new number for id and text where rows share an id: so different texts of one id each have a
    group of their own, and equal rows have one. A row without id is in no group and stays.
    """
    known = docs.where("doc_id is not null").select(*COLUMNS, F.xxhash64("text").alias("mix"))
    most = known.agg(F.max("doc_id").alias("m")).first().m or 0
    shared = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    # Written, so that the joins below know how small it is, and leave the texts where they are.
    shared = materialize(shared, "shared-ids")
    number = F.monotonically_increasing_id() + (most + 1)
    shared = known.select("doc_id", "mix").join(shared, "doc_id").distinct().select(F.col("doc_id").alias("d"), F.col("mix").alias("m"), number.alias("number"))
    shared = materialize(shared, "shared-id-rows")
    known = known.join(shared, (F.col("doc_id") == F.col("d")) & (F.col("mix") == F.col("m")), "left")
    known = known.select(*COLUMNS, "number", F.coalesce("number", "doc_id").alias("row"))
    groups = minhash.near_duplicates(known, "row").select(F.col("id").alias("row"), "component_id")
    told = groups.join(shared, F.col("row") == F.col("number"), "left").select("component_id", F.struct(F.coalesce("d", "row").alias("d"), "m", "row").alias("told"))
    first = told.groupBy("component_id").agg(F.min("told").alias("told")).select("told.row")
    one = members(known, materialize(exact_members(first, "row"), "kept-documents"), "row")
    again = one.where("number is not null").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    again = again.select("doc_id", "text", "rest.*").select(COLUMNS)
    return one.where("number is null").select(COLUMNS).unionByName(again).unionByName(docs.where("doc_id is null").select(COLUMNS))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced within its format."""
    out = pii.pseudonymize(docs, "text", KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their target weights, globally shuffled: a document comes as often as it draws."""
    return mixing.mix(docs).select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of what they decode to."""
    ranks = bpe.read_ranks(BYTE_RANKS)
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), "text", ranks, public_tokenizers.PATTERN)
    out = bpe.decode(ids.drop("text"), "ids", ranks)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("minhash_near_dedup", one_of_near_duplicates),
    ("pii_pseudonyms", pseudonyms),
    ("source_mixing", mixed_sources),
    ("byte_bpe", token_ids),
]
#: SQL cannot express the language and tokenizer stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
