"""Keep a collection in step with its files: change batches and removals."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.model import QUARANTINE_SCHEMA, REJECTED_SCHEMA
from docloom.operators import documents
from docloom.operators.checks import admin_check, split, valid_operation
from docloom.operators.sets import load_rows
from docloom.plans.ingest import stored_rows
from docloom.session import materialize
from docloom.sources.collection import Collection
from docloom.sources.contents import FileStore


def delete_nodes(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Nodes without those of the given documents (org_id, doc_id)."""
    return nodes.join(docs.select("org_id", "doc_id").distinct(), ["org_id", "doc_id"], "left_anti").select(*nodes.columns)


@dataclass(frozen=True)
class ChangeSet:
    """What a change batch removes, adds and refuses."""

    removed: DataFrame
    added: DataFrame
    reloaded: DataFrame
    quarantine: DataFrame
    rejected: DataFrame


def plan_changes(changes: DataFrame, files: DataFrame | FileStore, embedder, chunker=documents.chunk) -> ChangeSet:
    """Changes (org_id, file_id, operation) against a snapshot of the files taken before any delete.

    Of a FileStore only the folders are read that hold named files; of a DataFrame all rows.

    Every named file loses its nodes first, created ones too, so that a repeated batch adds nothing twice.
    Then created and updated files are loaded from the snapshot; unknown ids load nothing.
    """
    valid, rejected = split(valid_operation(changes))
    removed = valid.select("org_id", F.col("file_id").alias("doc_id")).distinct()
    wanted = load_rows(valid).select("org_id", F.col("file_id").alias("id")).distinct()
    reloaded = files.changed(wanted) if isinstance(files, FileStore) else files.join(wanted, ["org_id", "id"], "left_semi")
    docs, bad = documents.load(reloaded)
    added = documents.embed(chunker(docs), embedder)
    return ChangeSet(removed, added, reloaded, bad, rejected)


def next_snapshot(nodes: DataFrame, change_set: ChangeSet) -> DataFrame:
    """The collection after the batch, as one DataFrame."""
    return delete_nodes(nodes, change_set.removed).unionByName(change_set.added.select(*nodes.columns))


def next_files(files: DataFrame, changes: DataFrame) -> DataFrame:
    """The file table after the batch: deleted and failed files are gone, reloaded ones stay.

    One row per named file says whether it is loaded again, so the table is joined once with the changes, and
    once with the few files that have no content.
    """
    valid, _ = split(valid_operation(changes))
    keys = ["org_id", "id"]
    named = valid.groupBy("org_id", F.col("file_id").alias("id")).agg(
        F.bool_or(F.col("operation") != "DELETED").alias("_loaded")
    )
    bad = documents.quarantine(files).select(*keys, F.lit(True).alias("_bad"))
    state = files.join(named, keys, "left").join(bad, keys, "left")
    return state.where("_loaded is null or (_loaded and _bad is null)").select(*files.columns)


def write_changes(spark: SparkSession, collection: Collection, changes: DataFrame, files: DataFrame | FileStore, embedder, batch: int, chunker=documents.chunk) -> None:
    """Append the batch to the collection as a unit. Running the same batch again gives the same collection.

    Besides nodes and removals it leaves a record of the file rows that were loaded again, of the files that could not be
    loaded, and of the changes that were refused; none counts before the batch is published, and all do after.

    The changes are read for each of these, so they are written down first; from their size the planner can tell whether
    to broadcast them against the files.
    """
    change_set = plan_changes(materialize(changes, "changes"), files, embedder, chunker)
    collection.record(stored_rows(documents.loadable(change_set.reloaded)), "file_rows", batch)
    collection.record(change_set.quarantine.select(*QUARANTINE_SCHEMA.fieldNames()), "quarantine", batch)
    collection.record(change_set.rejected.select(*REJECTED_SCHEMA.fieldNames()), "rejected", batch)
    collection.publish(spark, batch, nodes=change_set.added, removed=change_set.removed)


def apply_changes(
    spark: SparkSession, collection: Collection, changes: DataFrame, files: DataFrame | FileStore, embedder, batch: int, chunker=documents.chunk
) -> DataFrame:
    """Append the batch and return the collection after it."""
    write_changes(spark, collection, changes, files, embedder, batch, chunker)
    return collection.load(spark)


@dataclass(frozen=True)
class Removal:
    """Remaining tables after a removal, each request's outcome, and what the collection loses: documents or organizations."""

    outcomes: DataFrame
    files: DataFrame
    others: dict[str, DataFrame]
    removed: DataFrame | None = None
    dropped: DataFrame | None = None

    def write(self, spark: SparkSession, collection: Collection, batch: int) -> None:
        """Take it out of the collection, as one batch of the size of the removal."""
        collection.publish(spark, batch, removed=self.removed, dropped=self.dropped)


def remove_integrations(requests: DataFrame, orgs: DataFrame, files: DataFrame, integrations: DataFrame) -> Removal:
    """Requests (org_id, account_token, admin_id): files of the token, their nodes, and the integration go.

    The admin is checked before anything is removed.
    """
    outcomes = materialize(admin_check(requests, orgs), "removals")
    keys = ["org_id", "account_token"]
    allowed = outcomes.where("allowed").select(*keys).distinct()
    docs = files.select(*keys, F.col("id").alias("doc_id")).join(allowed, keys, "left_semi").select("org_id", "doc_id")
    return Removal(
        outcomes,
        files.join(allowed, keys, "left_anti"),
        {"integrations": integrations.join(allowed, keys, "left_anti")},
        removed=docs,
    )


def remove_organizations(
    requests: DataFrame,
    orgs: DataFrame,
    files: DataFrame,
    users: DataFrame,
    members: DataFrame,
    integrations: DataFrame,
) -> Removal:
    """Requests (org_id, admin_id): the organization and everything it holds goes, after the admin check."""
    outcomes = materialize(admin_check(requests, orgs), "removals")
    gone = outcomes.where("allowed").select("org_id").distinct()

    def without(df: DataFrame, org: str = "org_id") -> DataFrame:
        return df.join(gone, df[org] == gone["org_id"], "left_anti")

    return Removal(
        outcomes,
        without(files),
        {
            "orgs": without(orgs, "id"),
            "users": without(users, "organization_id"),
            "members": without(members),
            "integrations": without(integrations),
        },
        dropped=gone,
    )
