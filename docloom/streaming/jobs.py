"""Continuous inputs: change batches, questions, metric samples."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from docloom.operators.rollup import metric_rollup
from docloom.plans.changes import write_changes
from docloom.plans.retrieve import retrieve
from docloom.sources.collection import Collection


def _start(writer: DataStreamWriter, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def sync_collection(
    changes: DataFrame,
    files: Callable[[], DataFrame],
    collection: Collection,
    embedder,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Apply each micro-batch of changes (org_id, file_id, operation) to the collection.

    Batch n of the stream is batch n + 1 of the collection (0 is the first load), so a batch that Spark
    runs again after a failure overwrites what it wrote; readers see it when it is published. `files` gives the file snapshot of the batch.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        write_changes(batch.sparkSession, collection, batch, files(), embedder, batch_id + 1)

    return _start(changes.writeStream.foreachBatch(apply), checkpoint, available_now)


def answer_questions(
    questions: DataFrame,
    nodes: Callable[[], DataFrame],
    files: DataFrame,
    members: DataFrame,
    embedder,
    out: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Answer each micro-batch of questions (qid, org_id, user_id, text); answers go to out/batch=<n>."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        answers = retrieve(nodes(), files, batch, members, embedder)
        answers.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(questions.writeStream.foreachBatch(answer), checkpoint, available_now)


def rolling_metrics(
    samples: DataFrame,
    out: str,
    checkpoint: str,
    width: str = "5 minutes",
    lateness: str = "10 minutes",
    available_now: bool = False,
) -> StreamingQuery:
    """Rolled-up windows (ts, series, value) once the watermark has passed them; later samples are dropped."""
    timed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    rolled = metric_rollup(timed, width)
    return _start(rolled.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint, available_now)
