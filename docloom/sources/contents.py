"""File contents in shared storage, laid out so that a change reads and writes what it names and little else.

Rows are partitioned by the batch that wrote them, their organization and a bucket of their id. An organization has as many
buckets as its contents need at a given size, counted once in a small layout table, so a small one is a folder and a large one
many. Which batch's folder of a bucket counts is told by the versions that batches publish, and publishing is the last thing a
batch does: readers see all of it or nothing, and a batch that runs again replaces only what it wrote.

Named ids are turned into buckets, and those into the folders that hold them: the join is on partition columns, which prunes
the scan of contents before a file is opened.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import materialize

#: Bytes of a bucket, as text: a few files' splits.
BUCKET_BYTES = 128 << 20
PLACE = ["version", "org_id", "bucket"]
PLACE_TYPES = [T.StructField("version", T.LongType()), T.StructField("org_id", T.StringType()), T.StructField("bucket", T.IntegerType())]


@dataclass(frozen=True)
class FileStore:
    """Files (org_id, id, ..., content) of all organizations below one path. Files without an organization are not kept."""

    path: str

    def create(self, files: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> None:
        """Lay out the first state. Rows are dealt once, by bucket, and sorted by id within."""
        rows = files.where("org_id is not null")
        size = F.sum(F.coalesce(F.octet_length("content"), F.lit(0)) + 1)
        layout = rows.groupBy("org_id").agg(F.greatest(F.ceil(size / bucket_bytes), F.lit(1)).cast("int").alias("buckets"))
        layout.write.mode("overwrite").parquet(f"{self.path}/layout")
        files.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema")
        spark = files.sparkSession
        placed = self._bucketed(rows)
        self._write(placed, 0)
        found = spark.read.schema(self._schema(spark)).parquet(f"{self.path}/files").where("version = 0")
        self._publish(found.select("org_id", "bucket").distinct(), 0)

    def _schema(self, spark: SparkSession) -> T.StructType:
        given = spark.read.parquet(f"{self.path}/schema").schema
        return T.StructType([f for f in given if f.name != "org_id"] + PLACE_TYPES)

    def columns(self, spark: SparkSession) -> list[str]:
        return spark.read.parquet(f"{self.path}/schema").columns

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        """rows (org_id, id, ...) with the bucket of each; an organization that came later has one bucket."""
        layout = rows.sparkSession.read.parquet(f"{self.path}/layout")
        buckets: Column = F.coalesce("buckets", F.lit(1))
        return rows.join(layout, "org_id", "left").withColumn("bucket", F.pmod(F.xxhash64("id"), buckets).cast("int")).drop("buckets")

    def _write(self, rows: DataFrame, batch: int) -> None:
        dealt = rows.hint("rebalance", F.col("org_id"), F.col("bucket")).sortWithinPartitions("org_id", "bucket", "id")
        dealt.write.mode("overwrite").partitionBy("org_id", "bucket").parquet(f"{self.path}/files/version={batch}")

    def _publish(self, places: DataFrame, batch: int) -> None:
        places.select("org_id", "bucket", F.lit(batch).cast("bigint").alias("version")).write.mode("overwrite").parquet(f"{self.path}/versions/number={batch}")

    def _live(self, spark: SparkSession, before: int | None) -> DataFrame:
        """(org_id, bucket, version) of the folders that count; one row for a bucket."""
        told = spark.read.schema(T.StructType([*PLACE_TYPES[1:], PLACE_TYPES[0], T.StructField("number", T.LongType())])).parquet(f"{self.path}/versions")
        if before is not None:
            told = told.where(F.col("number") < before)
        return told.groupBy("org_id", "bucket").agg(F.max("version").alias("version"))

    def _files(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self._schema(spark)).parquet(f"{self.path}/files")

    def read(self, spark: SparkSession, org_id: str | None = None, before: int | None = None) -> DataFrame:
        """All files, or those of one organization; `before` reads the state before a batch."""
        held, live = self._files(spark), self._live(spark, before)
        if org_id is not None:
            held, live = (df.where(F.col("org_id") == org_id) for df in (held, live))
        # The comparison is always true; it tells the planner that this side chooses, so that folders are pruned by it.
        return held.join(live.where("version >= 0"), PLACE, "left_semi").select(self.columns(spark))

    def places(self, named: DataFrame, before: int | None = None) -> DataFrame:
        """(org_id, id, bucket, version) of the named ids, once each, whose bucket is there."""
        spark = named.sparkSession
        wanted = self._bucketed(named.where("org_id is not null").select("org_id", "id").distinct())
        return wanted.join(self._live(spark, before), ["org_id", "bucket"])

    def changed(self, named: DataFrame, before: int | None = None) -> DataFrame:
        """The files (org_id, id) names. Only the folders of their buckets are read: its cost grows with the change."""
        spark = named.sparkSession
        # Written, so that its true size decides on the broadcast by which the scan is pruned.
        wanted = materialize(self.places(named, before), "wanted-files")
        return self._files(spark).join(wanted.where("version >= 0"), [*PLACE, "id"], "left_semi").select(self.columns(spark))

    def put(self, batch: int, rows: DataFrame, removed: DataFrame) -> None:
        """Write files anew and take out those that `removed` (org_id, id) names, as batch 1, 2, ...; a file in both is written.

        The buckets of both are rewritten, no others. Running a batch again gives the same state.
        """
        spark = rows.sparkSession
        rows = materialize(self._bucketed(rows.where("org_id is not null").select(self.columns(spark))), "new-files")
        gone = self._bucketed(removed.where("org_id is not null").select("org_id", "id"))
        named = materialize(rows.select("org_id", "id", "bucket").unionByName(gone.select("org_id", "id", "bucket")).distinct(), "named-files")
        touched = materialize(named.select("org_id", "bucket").distinct(), "touched-buckets")
        live = materialize(touched.join(self._live(spark, batch), ["org_id", "bucket"]), "live-buckets")
        held = self._files(spark).join(live.where("version >= 0"), PLACE, "left_semi")
        stay = held.join(named, ["org_id", "bucket", "id"], "left_anti")
        self._write(stay.select(*self.columns(spark), "bucket").unionByName(rows.select(*self.columns(spark), "bucket")), batch)
        self._publish(touched, batch)
