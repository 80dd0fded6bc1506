"""Similarity search over node collections and the stages after it.

`top_k` never forms the join of questions and nodes. An organization's nodes and questions are dealt into parts of bounded size,
as many as its counts ask for, and each pair of parts is one group of a cogroup: an organization that holds all nodes is spread
over as many tasks as it has pairs, and a task holds one pair whatever the size of the tables. A pair is scored block by block as
matrix products, and only the best k per question leave it. The plan is the same at every size, and the top k is exact.
"""

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions.values import parse_process_date
from docloom.model import RECENCY_TOP_K, RERANK_TOP_N, SENTENCE_CUTOFF, SIMILARITY_TOP_K
from docloom.operators.filters import possible_members
from docloom.session import materialize

#: Numbers in the matrix of a block, and in that of a part of an organization: 16 MB of nodes, 4 MB of questions in single precision.
NODE_BLOCK, QUESTION_BLOCK = 4 << 20, 1 << 20
NODE_PART, QUESTION_PART = 4 << 20, 1 << 20
#: Rows of a block that are scored at once, and numbers of the pairs scored exactly at once.
NODE_ROWS, QUESTION_ROWS, EXACT_NUMBERS = 4096, 512, 1 << 20
HIT_SCHEMA = "org_id string, qid bigint, node_id string, score double"
# Similarities are compared at this many digits, so that the order of summation cannot decide a rank.
SCORE_DIGITS = 9


# Slack of the single-precision pass; what it lets through is scored again in double precision.
SLACK = 1e-4


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0).astype(np.float32)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of row pairs, rounded half away from zero."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
    cos = np.divide(np.einsum("ij,ij->i", a, b), norms, out=np.zeros_like(norms), where=norms > 0)
    unit = 10.0**SCORE_DIGITS
    return np.copysign(np.floor(np.abs(cos) * unit + 0.5) / unit, cos) + 0.0


def _first(k: int, rows: np.ndarray, nodes: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each row, best first; equal scores go to the smaller node."""
    order = np.lexsort((nodes, -scores, rows))
    rows = rows[order]
    at = np.arange(len(rows))
    place = at - np.maximum.accumulate(np.where(np.r_[True, rows[1:] != rows[:-1]], at, 0)) if len(rows) else at
    kept = place < k
    return rows[kept], nodes[order][kept], scores[order][kept]


def _score_part(nodes: np.ndarray, questions: np.ndarray, k: int, node_rows: int, question_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k nodes for each question, as rows (question, node, score) of positions.

    A single-precision product finds every node that can be among the best k of what was seen so far, ties included; only those
    are scored exactly. The best k of a question are carried from block to block.
    """
    units, q_units = _unit(nodes), _unit(questions)
    step = max(1, EXACT_NUMBERS // max(nodes.shape[1], 1))
    done = []
    for start in range(0, len(questions), question_rows):
        some = q_units[start : start + question_rows]
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        bar = np.full((len(some), 1), -np.inf, dtype=np.float32)
        for at in range(0, len(nodes), node_rows):
            approx = some @ units[at : at + node_rows].T
            possible = approx >= bar
            if approx.shape[1] > k and np.count_nonzero(possible) > 4 * k * len(some):
                kth = approx.shape[1] - k
                possible = approx >= np.maximum(bar, np.partition(approx, kth, axis=1)[:, kth : kth + 1] - np.float32(SLACK))
            q, n = np.divmod(np.flatnonzero(possible), approx.shape[1])
            # Many ties may pass, so the exact scores are taken in bounded pieces.
            for piece in range(0, len(q), step):
                qs, ns = q[piece : piece + step], n[piece : piece + step] + at
                found = (qs, ns, _exact(nodes[ns], questions[start + qs]))
                best = _first(k, *(np.concatenate(both) for both in zip(best, found)))
            if len(q):
                rows, counts = np.unique(best[0], return_counts=True)
                full = counts == k
                bar[rows[full], 0] = best[2][np.cumsum(counts)[full] - 1] - SLACK
        done.append((best[0] + start, *best[1:]))
    return tuple(np.concatenate(parts) for parts in zip(*done))


def _matrix(rows: pa.Table) -> np.ndarray:
    vectors = pa.concat_arrays(rows["embedding"].chunks)
    lengths = pc.list_value_length(vectors).to_numpy()
    if lengths.min() != lengths.max():
        raise ValueError("all vectors must have the same length")
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64 if values.dtype == np.float64 else np.float32, copy=False).reshape(len(lengths), -1)


def _vectors(df: DataFrame, key: str) -> DataFrame:
    """(org_id, key, embedding) of what has an organization. A row without a vector fails the job."""
    missing = F.raise_error(F.concat(F.lit(f"{key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" has no vector")))
    none = F.col("embedding").isNull() | F.exists("embedding", lambda x: x.isNull())
    whole = F.when(none, missing.cast(df.schema["embedding"].dataType)).otherwise(F.col("embedding"))
    return df.where("org_id is not null").select("org_id", key, whole.alias("embedding"))


def _parts(nodes: DataFrame, questions: DataFrame, node_part: int, question_part: int) -> DataFrame:
    """In how many parts the nodes and the questions of each organization are dealt: a row for each that has both."""
    held = nodes.groupBy("org_id").agg(F.count("*").alias("n"), F.sum(F.size("embedding")).alias("numbers"))
    asked = questions.groupBy("org_id").agg(F.count("*").alias("q"))
    dim = F.col("numbers") / F.col("n")
    counted = held.join(asked, "org_id").select(
        "org_id",
        F.greatest(F.ceil(F.col("numbers") / node_part), F.lit(1)).cast("int").alias("n_parts"),
        F.greatest(F.ceil(F.col("q") * dim / question_part), F.lit(1)).cast("int").alias("q_parts"),
    )
    return materialize(counted, "parts")


def top_k(
    nodes: DataFrame,
    questions: DataFrame,
    k: int = SIMILARITY_TOP_K,
    node_block: int = NODE_BLOCK,
    question_block: int = QUESTION_BLOCK,
    node_part: int = NODE_PART,
    question_part: int = QUESTION_PART,
) -> DataFrame:
    """Best k nodes by cosine per question (org_id, qid, embedding) inside its own organization, with `rank`.

    Vectors of several lengths, from different embedders, fail, and so does a node or question without a vector. What has
    no organization is in none. Parts are what a task holds of an organization, blocks what it multiplies at once; both are given
    in numbers. The counts of the organizations are taken first, in a job of their own.
    """
    parts = _parts(nodes, questions, node_part, question_part)

    def places(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def dealt(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    held = _vectors(nodes, "node_id").join(parts, "org_id")
    held = held.select("org_id", dealt("node_id", "n_parts").alias("_n"), places("q_parts").alias("_q"), "node_id", "embedding")
    asked = _vectors(questions, "qid").join(parts, "org_id")
    # The key is a column of its own, since nodes and questions may be of one table.
    asked = asked.select(F.col("org_id").alias("org_id"), places("n_parts").alias("_n"), dealt("qid", "q_parts").alias("_q"), "qid", "embedding")

    def score(key: tuple, n: pa.Table, q: pa.Table) -> pa.Table:
        rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if n.num_rows and q.num_rows:
            # In the order of the ids, so that of equal scores the smaller position wins.
            n = n.take(pc.sort_indices(n["node_id"], null_placement="at_start"))
            vectors, q_vectors = _matrix(n), _matrix(q)
            if vectors.shape[1] != q_vectors.shape[1]:
                raise ValueError("all vectors must have the same length")
            dim = max(vectors.shape[1], 1)
            n_rows, q_rows = min(NODE_ROWS, node_block // dim), min(QUESTION_ROWS, question_block // dim)
            rows = _score_part(vectors, q_vectors, k, max(n_rows, 1), max(q_rows, 1))
        at, found, scores = rows
        org = pa.array([key[0].as_py()] * len(at), pa.string())
        hits = {"org_id": org, "qid": q["qid"].take(pa.array(at)), "node_id": n["node_id"].take(pa.array(found)), "score": scores}
        return pa.table(hits, schema=pa.schema({"org_id": pa.string(), "qid": pa.int64(), "node_id": pa.string(), "score": pa.float64()}))

    # A pair is much work on little data, so tasks are not merged by their bytes: the number of partitions is given.
    pair = ["org_id", "_n", "_q"]
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held, asked = (df.repartition(tasks, *pair).groupBy(*pair) for df in (held, asked))
    hits = held.cogroup(asked).applyInArrow(score, HIT_SCHEMA)
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "node_id")
    return hits.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def candidates(nodes: DataFrame, questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with the text of their node and question.

    Hits are written, k rows for each question; node texts are dropped where they are scanned unless a hit may name them, so the
    join moves the texts of hits and not of the collection, whether or not the hits are few enough to be broadcast.
    """
    hits = materialize(hits, "hits")
    asked = questions.select("qid", "question", F.col("embedding").alias("q_embedding"))
    texts = nodes.select("org_id", "node_id", "doc_id", "text", "process_date")
    texts = possible_members(texts, hits, ["org_id", "node_id"])
    # The question's words and vector are joined last, onto k rows per question.
    return texts.join(hits, ["org_id", "node_id"]).join(asked, "qid")


def lexical_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct words that the text contains."""
    wanted = F.array_distinct(tx.lower_words(question))
    # The second list is the one that is hashed: the question's few words, and not the text's.
    shared = F.size(F.array_intersect(tx.lower_words(text), wanted))
    return F.when(F.size(wanted) > 0, shared / F.size(wanted)).otherwise(F.lit(0.0))


def rerank(top_n: int = RERANK_TOP_N, scorer: Callable[[Column, Column], Column] = lexical_overlap):
    """Stage: keep the best n candidates by a second scorer (a column function, or a pandas UDF of a model)."""

    def stage(df: DataFrame) -> DataFrame:
        scored = df.withColumn("rerank_score", scorer(F.col("question"), F.col("text")))
        order = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), F.col("score").desc(), "node_id")
        ranked = scored.withColumn("rerank_rank", F.row_number().over(order).cast("bigint"))
        return ranked.where(F.col("rerank_rank") <= top_n)

    return stage


def recency(top_k: int = RECENCY_TOP_K):
    """Stage: newest process date first, at most top_k."""

    def stage(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("qid").orderBy(
            parse_process_date(F.col("process_date")).desc(), F.col("score").desc(), "node_id"
        )
        ranked = df.withColumn("recency_rank", F.row_number().over(order).cast("bigint"))
        return ranked.where(F.col("recency_rank") <= top_k)

    return stage


def sentence_optimizer(embedder, cutoff: float = SENTENCE_CUTOFF):
    """Stage: shorten each text to its best floor(cutoff * n) sentences by similarity, at least one, in text order.

    A candidate's sentences are scored and picked inside its own row: nothing is exploded or shuffled.
    """
    # The share is a decimal, so that 0.7 of 90 sentences is 63 and not 62.
    share = F.lit(Decimal(str(cutoff)))

    def stage(df: DataFrame) -> DataFrame:
        split = df.withColumn("_s", tx.sentences(F.col("text")))
        scored = embedder.similarities(split, "_s", "q_embedding", "_scores")
        numbered = F.transform(
            F.arrays_zip("_s", "_scores"),
            lambda x, i: F.struct(
                (-F.round(x["_scores"], SCORE_DIGITS)).alias("key"), i.alias("pos"), x["_s"].alias("sentence")
            ),
        )
        keep = F.greatest(F.floor(F.size("_s") * share).cast("int"), F.lit(1))
        # sort_array compares natively, array_sort by an interpreted function.
        best = F.slice(F.sort_array(numbered), F.lit(1), keep)
        in_order = F.sort_array(F.transform(best, lambda x: F.struct(x["pos"], x["sentence"])))
        text = F.array_join(F.transform(in_order, lambda x: x["sentence"]), " ")
        return scored.withColumn("text", text).drop("_s", "_scores")

    return stage


def apply_stages(df: DataFrame, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for stage in stages:
        df = df.transform(stage)
    return df


def extractive_answer(df: DataFrame, budget: int | None = None, order: str = "recency_rank") -> DataFrame:
    """Answer per question: its retained sentences in rank and text order.

    With a budget, sentences are taken until that many words are used; the one that reaches it is the last and is kept
    whole, so a question with a sentence always has an answer.
    """
    each = df.select("qid", order, "node_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    if budget is not None:
        before = Window.partitionBy("qid").orderBy(order, "pos").rowsBetween(Window.unboundedPreceding, -1)
        used = F.coalesce(F.sum(F.size(tx.lower_words(F.col("sentence")))).over(before), F.lit(0))
        each = each.withColumn("_used", used).where(F.col("_used") < budget)
    parts = each.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(order, "pos", "sentence"))).alias("_s"))
    text = F.array_join(F.transform("_s", lambda x: x.getField("sentence")), " ")
    return parts.select("qid", text.alias("response"))


def sources(df: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct source files per question as (qid, name, url)."""
    distinct = df.select("qid", "doc_id").distinct()
    named = files.select(F.col("id").alias("doc_id"), "name", F.col("file_url").alias("url"))
    return named.join(distinct, "doc_id").select("qid", "name", "url")
