"""Aggregations: readiness, status, tokens, metrics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import words


def sync_readiness(accounts: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per account: ready when all its syncs are DONE (or it has none), failed when any FAILED, else pending."""
    flags = statuses.groupBy("account_token").agg(
        F.bool_and(F.col("status") == "DONE").alias("_all_done"),
        F.bool_or(F.col("status") == "FAILED").alias("_any_failed"),
    )
    readiness = (
        F.when(F.coalesce(F.col("_all_done"), F.lit(True)), "ready")
        .when(F.col("_any_failed"), "failed")
        .otherwise("pending")
    )
    return accounts.join(flags, "account_token", "left").select("account_token", readiness.alias("readiness"))


def latest_status(log: DataFrame) -> DataFrame:
    """Current status per integration of an append-only log; equal times are settled by the log's sequence."""
    return log.groupBy("org_id", "account_token").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("updated_at")
    )


def token_usage(texts: DataFrame, group: str, text: str = "text") -> DataFrame:
    return (
        texts.select(group, F.size(words(F.col(text))).cast("bigint").alias("_n"))
        .groupBy(group)
        .agg(F.sum("_n").alias("tokens"), F.count("*").alias("texts"))
    )


def metric_rollup(samples: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Two levels: the average of each series in each window, then sum, average and maximum over the series."""
    per_series = samples.groupBy(F.window("ts", width), "series").agg(F.avg("value").alias("_v"))
    return (
        per_series.groupBy("window")
        .agg(
            F.round(F.sum("_v"), 6).alias("sum_value"),
            F.round(F.avg("_v"), 6).alias("avg_value"),
            F.round(F.max("_v"), 6).alias("max_value"),
            F.count("*").alias("n_series"),
        )
        .select(F.col("window.start").alias("window_start"), "sum_value", "avg_value", "max_value", "n_series")
    )


def member_list(members: DataFrame, joined: DataFrame, left: DataFrame) -> DataFrame:
    """Members after a batch of joins and leaves, one distinct row each (an organization may be huge)."""
    keys = ["org_id", "user_id"]
    return members.select(*keys).unionByName(joined.select(*keys)).distinct().join(left.select(*keys), keys, "left_anti")


def account_owners(users: DataFrame) -> DataFrame:
    """Owner per account: the first user row, by id, that says it is the account's own."""
    return users.where("is_me").groupBy("account_token").agg(F.min_by("email", "id").alias("account_id"))


def first_owner(users: DataFrame, limit: int = 1) -> DataFrame:
    return users.where("is_me").orderBy("id").limit(limit)
