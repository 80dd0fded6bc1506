"""List and map fields of an organization: the nested form, and the normalized form that scales."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.values import outcome
from docloom.model import LOOKUP_BATCH, OPERATIONS
from docloom.operators.keyed import batches


# Nested form, for one organization row.
def add_ids(have: Column, ids: Column) -> Column:
    return F.array_sort(F.array_union(have, ids))


def remove_ids(have: Column, ids: Column) -> Column:
    return F.array_sort(F.array_except(have, ids))


def invite(invited: Column, user: Column) -> tuple[Column, Column, Column]:
    """(new list, code, reason): appends the user, or reports that the invitation exists."""
    there = F.array_contains(invited, user)
    code, reason = outcome((there, "USER_ALREADY_INVITED"))
    return F.when(there, invited).otherwise(F.array_append(invited, user)), code, reason


def cancel_invite(invited: Column, user: Column) -> tuple[Column, Column, Column]:
    there = F.array_contains(invited, user)
    code, reason = outcome((~there, "USER_NOT_INVITED"))
    return F.when(there, F.array_remove(invited, user)).otherwise(invited), code, reason


def map_put(entries: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(entries, lambda k, _: k != key), F.create_map(key, value))


def map_remove(entries: Column, key: Column) -> Column:
    return F.map_filter(entries, lambda k, _: k != key)


def map_set_field(entries: Column, key: Column, field: str, value: Column) -> Column:
    return F.transform_values(entries, lambda k, v: F.when(k == key, v.withField(field, value)).otherwise(v))


# Normalized form: one row per member, so an organization's list is never one row.
def union_ids(have: DataFrame, ids: DataFrame) -> DataFrame:
    return have.unionByName(ids.select(*have.columns)).distinct()


def except_ids(have: DataFrame, ids: DataFrame) -> DataFrame:
    return have.join(ids.select(*have.columns), have.columns, "left_anti")


def grouped_operations(changes: DataFrame) -> DataFrame:
    """Number of change ids per organization and operation; every operation is present, also when empty.

    The ids themselves stay rows (`removal_rows`, `load_rows`), cut into bounded lists by `id_batches`.
    """
    counts = [F.count_if(F.col("operation") == op).alias(op) for op in OPERATIONS]
    wide = changes.groupBy("org_id").agg(*counts)
    return wide.unpivot("org_id", OPERATIONS, "operation", "n_ids")


def id_batches(ids: DataFrame, size: int = LOOKUP_BATCH) -> DataFrame:
    """Ids of each organization as sorted lists of at most `size`."""
    numbered = batches(ids.select("org_id", "file_id"), size, "org_id", "file_id")
    return numbered.groupBy("org_id", "batch_no").agg(F.array_sort(F.collect_list("file_id")).alias("file_ids"))


def removal_rows(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("operation").isin("UPDATED", "DELETED"))


def load_rows(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("operation").isin("CREATED", "UPDATED"))
