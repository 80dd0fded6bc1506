"""Which rows of a status log are allowed to follow each other.

An integration is SYNCING from the start. SYNCING may always be logged again, as a restart; it is followed by INDEXING or FAIL, and
INDEXING by SUCCESS or FAIL. A row that breaks this is refused and changes nothing for the rows after it.

So a stretch from one SYNCING to the next is settled by a few firsts: its first INDEXING, unless a FAIL came before, and the first
end after that. These are plain aggregates, of any size. The stretch that a row belongs to is found over ranges of the sorted log:
within a range by a window, and from the ranges before it by the last SYNCING of each, so that an integration with most of the rows
spans many tasks.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.model import STATUSES
from docloom.session import materialize

KEYS = ["org_id", "account_token"]
UNKNOWN, MISPLACED = "unknown status", "not allowed here"


def _stretches(log: DataFrame) -> DataFrame:
    """The log with `_at`, the place of each row in its order, and `_start`, the place of the last SYNCING up to it (-1: none)."""
    order = [*KEYS, "ts", "seq", "status"]
    sorted_log = log.repartitionByRange(*order).sortWithinPartitions(*order)
    # The places name the ranges, so they must not change between the readers.
    rows = materialize(sorted_log.withColumn("_at", F.monotonically_increasing_id()), "status-log")
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    starts = F.when(F.col("status") == "SYNCING", F.col("_at"))
    own = F.max(starts).over(Window.partitionBy("_range", *KEYS).orderBy("_at"))
    # One row for each range: of its last SYNCING, and then of the last one in any range before.
    last = rows.groupBy("_range").agg(F.max_by(F.struct(*KEYS, "_at"), starts).alias("_last"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    same = F.col("org_id").eqNullSafe(F.col("_carried.org_id")) & F.col("account_token").eqNullSafe(F.col("_carried.account_token"))
    start = F.coalesce("_own", F.when(same, F.col("_carried._at")), F.lit(-1).cast("bigint"))
    found = rows.withColumn("_own", own).join(carried, "_range").withColumn("_start", start)
    return materialize(found.drop("_range", "_own", "_carried"), "status-stretches")


def judged(log: DataFrame) -> DataFrame:
    """The log (org_id, account_token, status, ts, seq, ...) with `refused`: why a row is refused, null if it is not.

    Rows of an integration are ordered by (ts, seq), equal ones by status, and of repeated rows the first can be accepted. Null
    organizations and tokens are keys like others; nulls in ts and seq come first.
    """
    rows = _stretches(log)
    stretch = [*KEYS, "_start"]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.toDF(*[f"_r{c}" if c in stretch else c for c in right.columns])
        match = [left[c].eqNullSafe(other[f"_r{c}"]) for c in stretch]
        return left.join(other, match, "left").drop(*[f"_r{c}" for c in stretch])

    def first(status: str):
        return F.min(F.when(F.col("status") == status, F.col("_at")))

    rows = joined(rows, rows.groupBy(*stretch).agg(first("INDEXING").alias("_indexing"), first("FAIL").alias("_fail")))
    # Without a FAIL before it, the first INDEXING counts; otherwise that FAIL does.
    indexed = F.col("_indexing").isNotNull() & (F.col("_fail").isNull() | (F.col("_indexing") < F.col("_fail")))
    ends = rows.where(indexed & F.col("status").isin("SUCCESS", "FAIL") & (F.col("_at") > F.col("_indexing")))
    rows = joined(rows, ends.groupBy(*stretch).agg(F.min("_at").alias("_end")))
    accepted = (
        (F.col("status") == "SYNCING")
        | F.when(indexed, F.col("_at").eqNullSafe(F.col("_indexing")) | F.col("_at").eqNullSafe(F.col("_end"))).otherwise(F.col("_at").eqNullSafe(F.col("_fail")))
    )
    known = F.coalesce(F.col("status").isin(STATUSES), F.lit(False))
    refused = F.when(~known, UNKNOWN).when(~accepted, MISPLACED)
    return rows.select(*log.columns, refused.alias("refused"))


def split_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, refused rows with `refused`), judged once."""
    rows = materialize(judged(log), "judged-log")
    return rows.where("refused is null").drop("refused"), rows.where("refused is not null")
