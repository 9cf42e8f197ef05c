"""Observation log to versions: outcome classification, version folds and identity merges as windows over one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellichor.session import cut_lineage


def classify(observations: DataFrame) -> DataFrame:
    """Outcome, version key and ``raw_changed`` of each observation.

    ``observations`` has ``document_id, seq, observed_at, kind`` (``rep`` bytes,
    ``nm`` not modified, ``arch`` archive), ``text_hash, raw_hash,
    pipeline_version, source``. A 304 inherits the version before it; one before
    any body drops out. All windows share one partitioning by document.
    """
    w = Window.partitionBy("document_id").orderBy("observed_at", "seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = observations.withColumn("vkey", F.last(F.when(F.col("text_hash").isNotNull(), F.concat("text_hash", F.lit("|"), "source")), ignorenulls=True).over(so_far)).filter("vkey is not null")
    wv = Window.partitionBy("document_id", "vkey").orderBy("observed_at", "seq")
    up_to, ahead = wv.rowsBetween(Window.unboundedPreceding, 0), wv.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "v_raw": F.first("raw_hash", ignorenulls=True).over(up_to),
            "v_pipe": F.first("pipeline_version", ignorenulls=True).over(up_to),
            "prior_raw": F.last("raw_hash", ignorenulls=True).over(ahead),
        }
    )
    rows = rows.withColumns({"pv": F.lag("vkey").over(w), "pr": F.lag("v_raw").over(w), "pp": F.lag("v_pipe").over(w)})
    same_text = F.substring_index("pv", "|", 1) == F.substring_index("vkey", "|", 1)
    outcome = (
        F.when(F.col("kind") == "nm", "not_modified")
        .when(F.col("kind") == "arch", "archive")
        .when(F.col("pv").isNull(), "created")
        .when(F.col("pv") == F.col("vkey"), "unchanged")
        .when(same_text, "changed")
        .when((F.col("raw_hash") == F.col("pr")) & (F.col("pipeline_version") != F.col("pp")), "renormalized")
        .otherwise("changed")
    )
    rows = rows.withColumn("outcome", outcome)
    raw_changed = (F.col("outcome") == "unchanged") & F.coalesce(F.col("raw_hash") != F.col("prior_raw"), F.lit(False))
    return rows.select("document_id", "seq", "observed_at", "kind", "vkey", "outcome", raw_changed.alias("raw_changed"), "raw_hash", "pipeline_version")


def fold_versions(classified: DataFrame) -> DataFrame:
    """One row per document and version key: first and last observation, creating and last bytes, and whether it is current."""
    w = Window.partitionBy("document_id").orderBy("observed_at", "seq")
    ordered = classified.withColumn("order_", F.row_number().over(w))
    folded = ordered.groupBy("document_id", "vkey").agg(
        F.min("observed_at").alias("captured_at"),
        F.max("observed_at").alias("last_observed_at"),
        F.max("order_").alias("last_observed_seq"),
        F.min_by("raw_hash", F.when(F.col("raw_hash").isNotNull(), F.col("order_"))).alias("raw_hash"),
        F.max_by("raw_hash", F.when(F.col("raw_hash").isNotNull(), F.col("order_"))).alias("last_observed_raw_hash"),
        F.count("*").alias("observations"),
    )
    newest = F.max("last_observed_seq").over(Window.partitionBy("document_id"))
    return folded.withColumn("is_current", F.col("last_observed_seq") == newest)


def duplicate_bodies(versions: DataFrame) -> DataFrame:
    """Bodies held by more than one document: documents, versions, and the earliest holder (ties by id)."""
    held = versions.filter("text_hash is not null")
    return (
        held.groupBy("text_hash", "source")
        .agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("held"), F.min_by("document_id", F.struct("captured_at", "version_id")).alias("first_document"))
        .filter("documents > 1")
    )


def merge_documents(versions: DataFrame, moves: DataFrame) -> DataFrame:
    """Versions after documents are merged: ``moves`` maps ``source_id`` to ``target_id``.

    Of equal bodies the earlier capture stays, a tie keeps the target's; the
    newest observation time is kept, and sequence numbers follow observation
    order in the merged document.
    """
    moved = versions.join(moves.select(F.col("source_id").alias("document_id"), "target_id"), "document_id", "left")
    moved = moved.withColumns({"is_source": F.col("target_id").isNotNull(), "document_id": F.coalesce("target_id", "document_id")})
    key = Window.partitionBy("document_id", "text_hash", "source")
    rank = F.row_number().over(key.orderBy("captured_at", "is_source", "version_id"))
    newest = F.max("last_observed_at").over(key)
    kept = moved.withColumns({"rank_": rank, "last_observed_at": newest}).filter("rank_ = 1 or text_hash is null")
    seq = F.row_number().over(Window.partitionBy("document_id").orderBy("last_observed_at", "last_observed_seq", "version_id"))
    return kept.withColumn("last_observed_seq", seq).drop("rank_", "is_source", "target_id")


def terminal_urls(redirects: DataFrame) -> DataFrame:
    """``(url, target)`` at the end of chains of permanent redirects ``(url, target)``, by pointer jumping until nothing moves.

    A URL whose chain runs in a circle has a null target. Of several targets of one
    URL the least counts.
    """
    links = redirects.filter("url <> target").groupBy("url").agg(F.min("target").alias("target"))
    total = links.count()
    jumps, moved = 1, total > 0
    while moved and jumps <= 2 * total:
        step = links.select(F.col("url").alias("target"), F.col("target").alias("further"))
        links = cut_lineage(links.join(step, "target", "left").select("url", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")))
        moved = not links.filter("moved").isEmpty()
        links, jumps = links.select("url", "target"), 2 * jumps
    known = redirects.filter("url <> target").select(F.col("url").alias("target"), F.lit(True).alias("goes_on")).distinct()
    ends = links.join(known, "target", "left")
    return ends.select("url", F.when(F.col("goes_on").isNull(), F.col("target")).alias("target"))
