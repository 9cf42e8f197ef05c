"""Accounting over the request log: roll-ups, failures, savings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ["cache_hit", "not_modified", "unchanged", "changed", "renormalized", "created", "archive", "error"]


def since(log: DataFrame, days: int = 30) -> DataFrame:
    """Rows of the trailing window that ends with the newest request."""
    newest = log.agg(F.max("requested_at").alias("as_of"))
    return log.join(F.broadcast(newest), F.col("requested_at") >= F.col("as_of") - F.expr(f"INTERVAL {days} DAYS")).drop("as_of")


def by_outcome(log: DataFrame) -> DataFrame:
    return log.groupBy("outcome").agg(F.count("*").alias("requests"), F.sum(F.coalesce("bytes_down", F.lit(0))).alias("bytes_down"))


def buckets(log: DataFrame) -> DataFrame:
    """One row: requests, each outcome's count, and the share of hits and 304s, 0 for an empty log."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    one = log.agg(F.count("*").alias("requests"), *counts)
    rate = F.when(F.col("requests") > 0, F.round((F.col("cache_hit") + F.col("not_modified")) / F.col("requests"), 4)).otherwise(0.0)
    return one.withColumn("hit_rate", rate)


def error_breakdown(log: DataFrame) -> DataFrame:
    """Errors by kind and by status in one pass; unknown ones under ``unrecorded`` and ``none``."""
    errors = log.filter("outcome = 'error'").select(
        F.coalesce("error_kind", F.lit("unrecorded")).alias("kind"), F.coalesce(F.col("http_status").cast("string"), F.lit("none")).alias("status")
    )
    long = errors.select(F.explode(F.array(F.struct(F.lit("kind").alias("facet"), F.col("kind").alias("label")), F.struct(F.lit("status").alias("facet"), F.col("status").alias("label")))).alias("x"))
    return long.groupBy("x.facet", "x.label").agg(F.count("*").alias("errors"))


def recent_failures(log: DataFrame, limit: int = 50) -> DataFrame:
    """The newest failed requests with a URL, and whether there are more than are shown."""
    failed = log.filter("outcome = 'error' and url is not null")
    order = [F.desc("requested_at"), F.desc("seq")]
    top = failed.orderBy(*order).limit(limit + 1).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    more = top.agg(F.max("place").alias("m")).select((F.col("m") > limit).alias("truncated"))
    return top.filter(F.col("place") <= limit).join(F.broadcast(more)).select("place", "seq", "url", "error_kind", "http_status", "requested_at", "truncated")


def bytes_saved(log: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """One row: the sizes that hits and 304s didn't move, of the current version, else of the last observed one, else 0. Requests without a document drop out."""
    last = versions.groupBy("document_id").agg(F.max_by("byte_size", F.struct("last_observed_seq", "version_id")).alias("last_size"))
    hits = log.filter("outcome in ('cache_hit', 'not_modified')").groupBy("document_id").agg(F.count("*").alias("hits"))
    served = documents.select("document_id", F.col("current_version").alias("version_id")).join(versions.select("version_id", "byte_size"), "version_id", "left")
    sized = hits.join(served, "document_id").join(last, "document_id", "left")
    size = F.coalesce("byte_size", "last_size", F.lit(0))
    return sized.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.col("hits") * size), F.lit(0)).cast("bigint").alias("bytes_saved"))


def daily(log: DataFrame) -> DataFrame:
    """Requests, errors and bytes by day."""
    return log.groupBy(F.date_trunc("day", "requested_at").cast("date").alias("day")).agg(
        F.count("*").alias("requests"), F.count_if(F.col("outcome") == "error").alias("errors"), F.sum(F.coalesce("bytes_down", F.lit(0))).alias("bytes_down")
    )
