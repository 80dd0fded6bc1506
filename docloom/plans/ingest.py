"""Files of an integration to an indexed collection."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.values import epoch_string
from docloom.model import FILE_DROPPED_FIELDS, QUARANTINE_SCHEMA, STATUSES
from docloom.operators import documents
from docloom.operators.sets import except_ids, union_ids
from docloom.session import materialize
from docloom.sources.collection import Collection


def stored_rows(files: DataFrame) -> DataFrame:
    """Listed files as rows of the file table: fewer fields, and the change time as epoch text."""
    dropped = [c for c in (*FILE_DROPPED_FIELDS, "content") if c in files.columns]
    return files.drop(*dropped).withColumn("modified_at", epoch_string(F.col("modified_at")))


@dataclass(frozen=True)
class Ingest:
    """What an ingest adds and rejects; nothing is computed until a part is written."""

    file_rows: DataFrame
    quarantine: DataFrame
    documents: DataFrame
    nodes: DataFrame


def plan_ingest(files: DataFrame, embedder, chunker=documents.chunk) -> Ingest:
    """Files that fail to load are in `quarantine` and not in the file table. `chunker` makes chunks of documents."""
    docs, bad = documents.load(files)
    return Ingest(stored_rows(documents.loadable(files)), bad, docs, documents.embed(chunker(docs), embedder))


def file_list(have: DataFrame, ingest: Ingest) -> DataFrame:
    """The organizations' file ids (org_id, file_id) after the ingest: listed ones join, quarantined ones leave."""
    ids = F.col("id").alias("file_id")
    return except_ids(union_ids(have, ingest.file_rows.select("org_id", ids)), ingest.quarantine.select("org_id", ids))


def status_rows(integrations: DataFrame, status: str, seq: int) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    return integrations.select(
        "org_id", "account_token", F.lit(status).alias("status"), F.current_timestamp().alias("ts"), F.lit(seq).alias("seq")
    )


def run_ingest(
    spark: SparkSession,
    files: DataFrame,
    collection: Collection,
    embedder,
    status_path: str | None = None,
    batch: int = 0,
    ready: DataFrame | None = None,
    chunker=documents.chunk,
) -> DataFrame:
    """Index the files and return the collection. Statuses go INDEXING, then SUCCESS or FAIL, to an append-only log.

    With `ready` (account_token, readiness; see `sync_readiness`), only files of accounts that are ready are indexed; the others wait for a later
    run. Nodes, file rows and quarantined files are published together. The integrations are listed once.
    """
    if ready is not None:
        files = files.join(ready.where("readiness = 'ready'").select("account_token").distinct(), "account_token", "left_semi").select(*files.columns)
    integrations = materialize(files.select("org_id", "account_token").distinct(), "integrations")

    def log(status: str, seq: int) -> None:
        if status_path:
            status_rows(integrations, status, seq).write.mode("append").parquet(status_path)

    log("INDEXING", 1)
    try:
        plan = plan_ingest(files, embedder, chunker)
        collection.record(plan.file_rows, "file_rows", batch)
        collection.record(plan.quarantine.select(*QUARANTINE_SCHEMA.fieldNames()), "quarantine", batch)
        collection.publish(spark, batch, nodes=plan.nodes)
    except Exception:
        log("FAIL", 2)
        raise
    log("SUCCESS", 2)
    return collection.load(spark)


def counts(file_rows: DataFrame, quarantine: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per organization: files kept, files quarantined, nodes indexed."""
    parts = [
        file_rows.select("org_id", F.lit("n_files").alias("what")),
        quarantine.select("org_id", F.lit("n_quarantined").alias("what")),
        nodes.select("org_id", F.lit("n_nodes").alias("what")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = ["n_files", "n_quarantined", "n_nodes"]
    return rows.groupBy("org_id").agg(*[F.count_if(F.col("what") == n).alias(n) for n in names])
