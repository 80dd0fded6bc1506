"""Request checks. Each adds (code, reason) columns; null means the request passes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.values import outcome
from docloom.model import OPERATIONS


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def missing_fields(names: list[str]) -> Column:
    """Names of the mandatory fields that are null or empty."""
    return F.array_compact(F.array(*[F.when(is_blank(F.col(n)), F.lit(n)) for n in names]))


def required_fields(requests: DataFrame, names: list[str]) -> DataFrame:
    checked = requests.withColumn("missing", missing_fields(names))
    code, reason = outcome((F.size("missing") > 0, "BAD_REQUEST"))
    return checked.withColumns({"code": code, "reason": reason})


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected)"""
    return checked.where("code is null").drop("code", "reason"), checked.where("code is not null")


def valid_operation(changes: DataFrame) -> DataFrame:
    bad = ~F.coalesce(F.col("operation").isin(OPERATIONS), F.lit(False))
    code, reason = outcome((bad, "INVALID_ARGUMENT"))
    return changes.withColumns({"code": code, "reason": reason})


def admin_check(requests: DataFrame, orgs: DataFrame) -> DataFrame:
    """Requests (org_id, admin_id) allowed only when admin_id is the organization's admin."""
    admins = orgs.select(F.col("id").alias("org_id"), F.col("admin_id").alias("_admin"))
    joined = requests.join(admins, "org_id", "left")
    allowed = F.coalesce(F.col("_admin") == F.col("admin_id"), F.lit(False))
    code, reason = outcome(
        (F.col("_admin").isNull(), "ITEM_DOES_NOT_EXIST"),
        (~allowed, "NOT_ENOUGH_PERMISSION"),
    )
    return joined.withColumns({"allowed": allowed, "code": code, "reason": reason}).drop("_admin")


def is_admin(pairs: DataFrame, orgs: DataFrame) -> DataFrame:
    """Flag per (user_id, org_id): true when the user is the organization's admin."""
    admins = orgs.select(F.col("id").alias("org_id"), F.col("admin_id").alias("_admin"))
    return pairs.join(admins, "org_id").withColumn("is_admin", F.col("_admin") == F.col("user_id")).drop("_admin")


def members_only(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Requests (org_id, user_id) of users who belong to the organization."""
    return requests.join(members.select("org_id", "user_id"), ["org_id", "user_id"], "left_semi")


def not_self(requests: DataFrame) -> DataFrame:
    """Drops requests of an admin to delete their own account."""
    return requests.where(F.col("user_id") != F.col("admin_id"))
