"""Vector collections on plain parquet.

Data files are written once and never changed. What a batch publishes is a manifest, one row for each live file with its rows
and how many of them are gone, and marks: for a file with removed rows the positions of those, as words of 64 bits. The last
thing a batch writes is the marker that names both. Until then readers see the collection as it was and all of the batch at
once after that; a batch that runs again starts from the state before it, writes new files, and moves its own marker.

Reading opens one marker and one manifest, however many batches there were, and only live files. Files without marks are read
as they are, with no join; the others skip their marked positions. Dropping an organization touches no data file. Removing
documents scans `doc_id` in the files of their organizations. A file of which half or more is gone is written anew by the batch
that finds it so, whose removals have then paid for it. `compact` writes what is visible as a new collection.
"""

import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.model import NODE_SCHEMA
from docloom.session import materialize

BATCH = T.StructField("batch", T.LongType())
NODE_FILES = T.StructType([*NODE_SCHEMA.fields, BATCH, T.StructField("run", T.StringType())])
MARKER = "run string, number bigint"
MANIFEST = "path string, org_id string, n_rows bigint, n_gone bigint"
#: A row for 64 rows of a file: `word` has a bit for each that is gone, row 64 * at being the lowest.
MARKS = "path string, at bigint, word bigint"
#: A file is written anew when this share of its rows is gone.
WORN = 0.5


@dataclass(frozen=True)
class Collection:
    """Node collections of all organizations below one path in shared storage."""

    path: str

    def publish(
        self, spark: SparkSession, batch: int = 0, nodes: DataFrame | None = None, removed: DataFrame | None = None, dropped: DataFrame | None = None
    ) -> None:
        """Write one batch as a unit: what it adds, the documents (org_id, doc_id) it removes, the organizations it drops.

        Removals concern what earlier batches wrote, not the batch's own nodes. Rows without an organization are never removed.
        """
        run = uuid.uuid4().hex
        live, marks = self._state(spark, batch)
        if dropped is not None:
            live = live.join(self.drop(dropped, batch), "org_id", "left_anti")
        if removed is not None:
            live, marks = self._mark(spark, live, marks, self.remove(removed, batch))
            worn = live.where(F.col("n_gone") >= WORN * F.col("n_rows"))
            live = live.where(F.col("n_gone") < WORN * F.col("n_rows"))
            rest = worn.where("n_gone < n_rows").collect()
            if rest:
                kept = self._visible(spark, rest, marks)
                nodes = kept if nodes is None else nodes.select(*kept.columns).unionByName(kept)
        if nodes is not None:
            live = live.select("path", "org_id", "n_rows", "n_gone").unionByName(self._described(spark, self.write(nodes, batch)))
        live.write.parquet(f"{self.path}/manifests/run={run}")
        held = marks.join(live.where("n_gone > 0").select("path"), "path", "left_semi")
        held.write.parquet(f"{self.path}/marks/run={run}")
        spark.range(1).coalesce(1).select(F.lit(run).alias("run")).write.mode("overwrite").parquet(f"{self.path}/published/number={batch}")

    def write(self, nodes: DataFrame, batch: int) -> str:
        """Stage the nodes of a batch, from the executors, and return their folder, which is new each time.

        Rebalancing by org keeps a small organization in one file, and adaptive execution splits an
        organization that holds a third of all nodes over many writer tasks.
        """
        folder = f"{self.path}/nodes/batch={batch}/run={uuid.uuid4().hex}"
        nodes.select(*NODE_SCHEMA.fieldNames()).hint("rebalance", F.col("org_id")).write.partitionBy("org_id").parquet(folder)
        return folder

    def remove(self, docs: DataFrame, batch: int) -> DataFrame:
        """Write down the documents (org_id, doc_id) that the batch removes, and read them back."""
        return self._noted(docs.select("org_id", "doc_id").distinct(), "removed", batch)

    def drop(self, orgs: DataFrame, batch: int) -> DataFrame:
        """Write down the organizations that the batch drops, and read them back."""
        return self._noted(orgs.select("org_id").distinct(), "dropped", batch)

    def _noted(self, rows: DataFrame, part: str, batch: int) -> DataFrame:
        self.record(rows, part, batch)
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{self.path}/{part}/batch={batch}")

    def record(self, rows: DataFrame, part: str, batch: int) -> None:
        """Stage other rows that belong to the batch, such as what it refused."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{part}/batch={batch}")

    def recorded(self, spark: SparkSession, part: str, schema: T.StructType) -> DataFrame:
        """The rows recorded by published batches, with their batch."""
        full = T.StructType([*schema.fields, BATCH])
        try:
            rows = spark.read.schema(full).option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            # The collection is there, but no batch had anything of this kind.
            if e.getCondition() == "PATH_NOT_FOUND":
                return spark.createDataFrame([], full)
            raise
        return rows.join(self._markers(spark).where("run is not null").select(F.col("number").alias("batch")), "batch", "left_semi").select(full.fieldNames())

    def _markers(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(MARKER).parquet(f"{self.path}/published")

    def last(self, spark: SparkSession, before: int | None = None) -> int | None:
        """The number of the last published batch, before a given one. The folder is listed, no file is opened."""
        numbers = {int(re.findall(r"/number=(-?\d+)/", f)[-1]) for f in self._markers(spark).inputFiles()}
        return max((n for n in numbers if before is None or n < before), default=None)

    def _state(self, spark: SparkSession, before: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Live files and marks as of the last batch before the given one; empty if there is none."""
        try:
            number = self.last(spark, before)
        except AnalysisException as e:
            # The first batch of a new collection. Without `before` someone reads what is not there.
            if before is None or e.getCondition() != "PATH_NOT_FOUND":
                raise
            number = None
        if number is None:
            return spark.createDataFrame([], MANIFEST), spark.createDataFrame([], MARKS)
        run = spark.read.schema("run string").parquet(f"{self.path}/published/number={number}").first().run
        manifest, marks = (f"{self.path}/{part}/run={run}" for part in ("manifests", "marks"))
        return spark.read.schema(MANIFEST).parquet(manifest), spark.read.schema(MARKS).parquet(marks)

    def _described(self, spark: SparkSession, folder: str) -> DataFrame:
        """The files of a folder as rows of a manifest, counted from their footers."""
        rows = spark.read.schema(NODE_FILES).parquet(folder).select(F.col("_metadata.file_path").alias("path"), "org_id")
        return rows.groupBy("path", "org_id").agg(F.count("*").alias("n_rows")).withColumn("n_gone", F.lit(0).cast("bigint"))

    def _scan(self, spark: SparkSession, files: Iterable[Row]) -> DataFrame:
        """The nodes of these files. Their names are what the driver holds, as the scan itself does."""
        # Spark gives the names of files encoded, and takes them plain.
        paths = [unquote(r.path) for r in files]
        if not paths:
            return spark.createDataFrame([], NODE_SCHEMA)
        return spark.read.schema(NODE_FILES).option("basePath", f"{self.path}/nodes").parquet(*paths)

    def _mark(self, spark: SparkSession, live: DataFrame, marks: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Live files and marks after the documents are gone. Of the files of their organizations only `doc_id` is read."""
        touched = live.join(docs.select("org_id").distinct(), "org_id", "left_semi").select("path").collect()
        if touched:
            place = ["org_id", "doc_id", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")]
            gone = self._scan(spark, touched).select(*place).join(docs, ["org_id", "doc_id"], "left_semi")
            bits = gone.select("path", F.shiftright("row", 6).alias("at"), F.expr("shiftleft(1L, cast(row & 63 as int))").alias("word"))
            both = marks.unionByName(bits).groupBy("path", "at").agg(F.bit_or("word").alias("word"))
            marks = materialize(both, "marks")
        counts = marks.groupBy("path").agg(F.sum(F.bit_count("word")).alias("n_gone"))
        live = live.drop("n_gone").join(counts, "path", "left").select("path", "org_id", "n_rows", F.coalesce("n_gone", F.lit(0).cast("bigint")).alias("n_gone"))
        return materialize(live, "live-files"), marks

    def _visible(self, spark: SparkSession, files: list[Row], marks: DataFrame) -> DataFrame:
        """The nodes of these files whose position is not marked."""
        columns = NODE_SCHEMA.fieldNames()
        whole = self._scan(spark, [r for r in files if not r.n_gone]).select(*columns)
        holed = [r for r in files if r.n_gone]
        if not holed:
            return whole
        held = self._scan(spark, holed).select(*columns, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
        found = held.withColumn("at", F.shiftright("row", 6)).join(marks, ["path", "at"], "left")
        left = found.where("coalesce(word, 0L) & shiftleft(1L, cast(row & 63 as int)) = 0").select(*columns)
        return left if len(holed) == len(files) else whole.unionByName(left)

    def load(self, spark: SparkSession, org_id: str | None = None, before: int | None = None) -> DataFrame:
        """Visible nodes, of one organization or of all; `before` reads the state before a batch.

        Only live files are opened, and of one organization only its own. A path without a collection fails; one that has no
        batch before the given one is empty.
        """
        self._markers(spark)
        live, marks = self._state(spark, before)
        if org_id is not None:
            live = live.where(F.col("org_id") == org_id)
        nodes = self._visible(spark, live.collect(), marks)
        return nodes if org_id is None else nodes.where(F.col("org_id") == org_id)

    def compact(self, spark: SparkSession, target: str) -> "Collection":
        """Rewrite the visible nodes as a new collection with a single batch, published when it is whole.

        Its number is that of the last batch, so that a stream which goes on at the new path goes on counting.
        """
        new = Collection(target)
        new.publish(spark, self.last(spark) or 0, nodes=self.load(spark))
        return new
