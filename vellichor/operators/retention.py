"""What can be reclaimed without breaking a citation, and what must stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reclaimable(versions: DataFrame, documents: DataFrame, anchors: DataFrame, keep: int = 3) -> DataFrame:
    """Versions beyond the newest ``keep`` of their document that no anchor cites and no document serves."""
    if keep < 1:
        raise ValueError("keep must be 1 or more")
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("captured_at"), F.desc("version_id")))
    old = versions.select("version_id", "document_id", "captured_at", "byte_size").withColumn("place", rank).filter(F.col("place") > keep)
    cited = anchors.select(F.col("created_version").alias("version_id")).distinct()
    served = documents.select(F.col("current_version").alias("version_id")).distinct()
    return old.join(cited, "version_id", "left_anti").join(served, "version_id", "left_anti")


def surviving(versions: DataFrame, documents: DataFrame, anchors: DataFrame, keep: int = 3) -> DataFrame:
    return versions.join(reclaimable(versions, documents, anchors, keep).select("version_id"), "version_id", "left_anti")


def prunable_verifications(verifications: DataFrame, before) -> DataFrame:
    """Verifications older than ``before`` that aren't their anchor's latest."""
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("checked_at"), F.desc("verification_seq")))
    return verifications.withColumn("place", rank).filter((F.col("place") > 1) & (F.col("checked_at") < before)).drop("place")


def older_than(df: DataFrame, column: str, before) -> DataFrame:
    """Rows strictly older than a moment; rows without a time stay out."""
    return df.filter(F.col(column) < before)


def dereferenced(verifications: DataFrame, versions: DataFrame) -> DataFrame:
    """Verifications whose checked version is no longer held point nowhere."""
    held = versions.select(F.col("version_id").alias("checked_version"), F.lit(True).alias("held"))
    return verifications.join(held, "checked_version", "left").withColumn("checked_version", F.when(F.col("held"), F.col("checked_version"))).drop("held")


def plan(versions: DataFrame, documents: DataFrame, anchors: DataFrame, verifications: DataFrame, log: DataFrame, keep: int, before) -> DataFrame:
    """One row per kind of what a collection would remove: rows and bytes."""
    v = reclaimable(versions, documents, anchors, keep).agg(F.count("*").alias("rows"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes")).select(F.lit("versions").alias("kind"), "rows", "bytes")
    p = prunable_verifications(verifications, before).agg(F.count("*").alias("rows")).select(F.lit("verifications").alias("kind"), "rows", F.lit(0).cast("bigint").alias("bytes"))
    f = older_than(log, "requested_at", before).agg(F.count("*").alias("rows")).select(F.lit("fetch_log").alias("kind"), "rows", F.lit(0).cast("bigint").alias("bytes"))
    return v.union(p).union(f)
