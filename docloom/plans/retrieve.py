"""Question to answer: membership, search, stages, answer, sources, payload."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import collapse_ws
from docloom.model import FALLBACK_ANSWER
from docloom.operators import search
from docloom.operators.checks import members_only
from docloom.session import materialize


def ask(questions: DataFrame, members: DataFrame, embedder) -> DataFrame:
    """Questions (qid, org_id, user_id, text) of members, with their vector."""
    admitted = members_only(questions, members).withColumn("question", collapse_ws(F.col("text")))
    return embedder.embed(admitted.select("qid", "org_id", "question"), "question", "embedding")


def default_stages(embedder) -> list[Callable[[DataFrame], DataFrame]]:
    return [search.rerank(), search.recency(), search.sentence_optimizer(embedder)]


def context(nodes: DataFrame, asked: DataFrame, embedder, stages=None, k: int = search.SIMILARITY_TOP_K) -> DataFrame:
    """Retained candidates of every question after all stages."""
    found = search.candidates(nodes, asked, search.top_k(nodes, asked, k))
    return search.apply_stages(found, default_stages(embedder) if stages is None else stages)


def payloads(asked: DataFrame, answers: DataFrame, sources: DataFrame) -> DataFrame:
    """One JSON answer per question; a question without an answer gets the fallback text and no sources."""
    listed = sources.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("name", "url"))).alias("sources"))
    none = F.array().cast("array<struct<name:string,url:string>>")
    return (
        asked.select("qid")
        .join(answers, "qid", "left")
        .join(listed, "qid", "left")
        .select(
            "qid",
            F.to_json(
                F.struct(
                    F.coalesce("response", F.lit(FALLBACK_ANSWER)).alias("response"),
                    F.when(F.col("response").isNull(), none).otherwise(F.coalesce("sources", none)).alias("sources"),
                )
            ).alias("payload"),
        )
    )


def retrieve(
    nodes: DataFrame, files: DataFrame, questions: DataFrame, members: DataFrame, embedder, stages=None
) -> DataFrame:
    # Read by the search, for the candidates and for the payloads.
    asked = materialize(ask(questions, members, embedder), "asked")
    # A few rows per question, needed for the answer and for the sources: the collection is scanned once.
    kept = materialize(context(nodes, asked, embedder, stages).drop("question", "q_embedding"), "context")
    # The last stage that ranked decides the order of the answer.
    order = next(c for c in ("recency_rank", "rerank_rank", "rank") if c in kept.columns)
    return payloads(asked, search.extractive_answer(kept, order=order), search.sources(kept, files))
