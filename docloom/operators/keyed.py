"""Keyed table operations: reads by key, upserts, deletes, batches. The key column is `id` unless given."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.values import outcome
from docloom.session import materialize


def _distinct(keys: DataFrame, key: str) -> DataFrame:
    """Requested keys once each, combined before the shuffle: a key asked for a billion times is one row."""
    return keys.select(key).distinct()


def get(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Every requested key with its row; a key without a row carries a reason."""
    found = table.withColumn("_found", F.lit(True))
    joined = _distinct(keys, key).join(found, key, "left")
    code, reason = outcome((F.col("_found").isNull(), "ITEM_DOES_NOT_EXIST"))
    return joined.withColumns({"code": code, "reason": reason}).drop("_found")


def batch_get(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the requested keys; a key absent from the table is absent from the result."""
    return table.join(_distinct(keys, key), key, "left_semi")


def lookup(table: DataFrame, field: str, value: str, *columns: str) -> DataFrame:
    """Secondary-index read: the equality reaches the scan as a pushed filter."""
    return table.where(F.col(field) == value).select(*(columns or ("id",)))


def last_per_key(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: the last by `order`, and of equals the greatest by its other columns, in their order.

    The aggregate combines before the shuffle, so a hot key is cheap.
    """
    rest = [c for c in rows.columns if c != key]
    if not rest:
        return rows.distinct()
    first = [order] if order is not None else []
    # Maps have no order of their own; their entries have.
    by = [F.array_sort(F.map_entries(c)) if rows.schema[c].dataType.typeName() == "map" else F.col(c) for c in [*first, *rest]]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*[c.alias(f"_{k}") for k, c in enumerate(by)])).alias("_row"))
    return picked.select(key, *[F.col("_row").getField(c).alias(c) for c in rest])


def upsert(table: DataFrame, rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Whole-row replacement by key. Several rows for a key leave one, the last by `order` (see `last_per_key`)."""
    rows = last_per_key(rows, key, order).select(*table.columns)
    return table.join(_distinct(rows, key), key, "left_anti").select(*table.columns).unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Remaining rows; absent keys are ignored."""
    return table.join(_distinct(keys, key), key, "left_anti").select(*table.columns)


def delete_returning(table: DataFrame, keys: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(requested keys with their old row or a reason, remaining rows)."""
    return get(table, keys, key), delete(table, keys, key)


def batches(rows: DataFrame, size: int, group: str, order: str) -> DataFrame:
    """Number the rows of every group into batches of `size` in the given order, as column `batch_no`.

    Rows are laid out and sorted in ranges of (group, order), so a hot group spans many tasks and none holds all
    of it. A row's place in its range plus the counts of the ranges before give its place in the group: only
    those counts are joined, and there is one per group and range. The ranges are written once because the
    places and the counts must see the same ones.
    """
    laid_out = (
        rows.repartitionByRange(F.col(group), F.col(order))
        .sortWithinPartitions(group, order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # The id counts rows below bit 33 and partitions above it.
    placed = materialize(laid_out, "ranges").withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.col("_start") + F.col("_at") - F.col("_first")
    return (
        placed.join(starts, [group, "_range"])
        .withColumn("batch_no", F.floor(place / size).cast("bigint"))
        .drop("_range", "_at", "_first", "_start")
    )


def write_in_batches(rows: DataFrame, path: str, tasks: int | None = None, rows_per_file: int = 0) -> None:
    """Parallel sliced write by the executors; `rows_per_file` cuts the slices, 0 leaves them whole."""
    spread = rows if tasks is None else rows.repartition(tasks)
    spread.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
