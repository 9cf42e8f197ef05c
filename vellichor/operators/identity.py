"""Who is who: references to documents and versions, merges in full, and the collection applied."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.functions import urls
from vellichor.operators import inventory, observe, retention

_LATEST = re.compile(r"latest(?:~([0-9]+))?", re.ASCII)


def version_reference(versions: DataFrame, reference: str) -> DataFrame:
    """``(document_id, version_id)`` that ``latest``, ``latest~N`` or a version's id names; anything else is an error."""
    if match := _LATEST.fullmatch(reference):
        return inventory.nth_latest(versions, int(match[1] or 0))
    if not reference or reference.startswith("latest"):
        raise ValueError(f"not a version reference: {reference!r}")
    return versions.filter(F.col("version_id") == reference).select("document_id", "version_id")


def resolve_documents(references: DataFrame, documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(reference, document_id)``: an id as it is, a URL in canonical form by the documents' own URLs, else by alias; null where neither knows it."""
    named = references.withColumn("url", F.when(F.col("reference").rlike("(?i)^https?://"), urls.plain_canonical("reference")))
    known = documents.select(F.col("document_id").alias("reference"), F.col("document_id").alias("by_id"))
    own = documents.select(urls.plain_canonical("url").alias("url"), "document_id").groupBy("url").agg(F.min("document_id").alias("own_id"))
    other = aliases.select(urls.plain_canonical("url").alias("url"), "document_id").groupBy("url").agg(F.min("document_id").alias("alias_id"))
    out = named.join(known, "reference", "left").join(own, "url", "left").join(other, "url", "left")
    return out.select("reference", F.coalesce("by_id", "own_id", "alias_id").alias("document_id"))


def merge_anchors(anchors: DataFrame, documents: DataFrame, moves: DataFrame) -> DataFrame:
    """Anchors after documents are merged; what was cited stays pinned, as the source's first URL where none was."""
    moved = anchors.join(moves.select(F.col("source_id").alias("document_id"), "target_id"), "document_id", "left")
    moved = moved.join(documents.select("document_id", "original_url"), "document_id", "left")
    pinned = F.when(F.col("target_id").isNotNull(), F.coalesce(F.nullif("cited_url", F.lit("")), "original_url")).otherwise(F.col("cited_url"))
    return moved.withColumns({"cited_url": pinned, "document_id": F.coalesce("target_id", "document_id")}).drop("target_id", "original_url")


def merge_aliases(aliases: DataFrame, documents: DataFrame, moves: DataFrame) -> DataFrame:
    """Aliases after documents are merged: the sources' URLs become aliases of the targets, and none is a document's own URL."""
    step = moves.select(F.col("source_id").alias("document_id"), "target_id")
    old = aliases.join(step, "document_id", "left").select("url", F.coalesce("target_id", "document_id").alias("document_id"))
    gone = documents.join(step, "document_id").select("url", F.col("target_id").alias("document_id"))
    left = documents.join(step, "document_id", "left_anti").select("url")
    return gone.unionByName(old.join(gone.select("url"), "url", "left_anti")).join(left, "url", "left_anti")


def merge_log(log: DataFrame, moves: DataFrame) -> DataFrame:
    """The log after documents are merged."""
    return log.join(moves.select(F.col("source_id").alias("document_id"), "target_id"), "document_id", "left").withColumn("document_id", F.coalesce("target_id", "document_id")).drop("target_id")


def rename_urls(documents: DataFrame, redirects: DataFrame) -> DataFrame:
    """``(document_id, url, renamed, refused)``: each document at the end of its redirects, unless another document is or goes there."""
    ends = observe.terminal_urls(redirects).withColumnRenamed("target", "wanted")
    rows = documents.select("document_id", "url").join(ends, "url", "left").withColumn("place", F.coalesce("wanted", "url"))
    claims = rows.groupBy("place").agg(F.count("*").alias("claims"))
    taken = documents.select(F.col("url").alias("place"), F.lit(True).alias("taken"))
    out = rows.join(claims, "place").join(taken, "place", "left")
    moves = F.col("place") != F.col("url")
    refused = moves & ((F.col("claims") > 1) | F.coalesce("taken", F.lit(False)))
    return out.select("document_id", F.when(refused, F.col("url")).otherwise(F.col("place")).alias("url"), (moves & ~refused).alias("renamed"), refused.alias("refused"))


def collect(versions: DataFrame, documents: DataFrame, anchors: DataFrame, verifications: DataFrame, keep: int, before) -> tuple[DataFrame, DataFrame]:
    """Versions and verifications that survive a collection: verifications are pruned first, and then versions reclaimed; verifications of reclaimed ones point nowhere."""
    kept = verifications.join(retention.prunable_verifications(verifications, before).select("verification_seq"), "verification_seq", "left_anti")
    left = retention.surviving(versions, documents, anchors, keep)
    return left, retention.dereferenced(kept, left)


def batches(df: DataFrame, key: str, size: int = 400) -> DataFrame:
    """Rows to delete with the number of their batch: each batch has ``size`` rows at most and is one transaction of a store.

    Numbered inside ranges of the key, so that no task sees all rows.
    """
    ranged = df.repartitionByRange(key).withColumn("range_", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("range_").orderBy(key))
    return ranged.withColumn("batch", F.concat_ws("-", "range_", F.floor((place - 1) / size))).drop("range_")


def stable_id(*keys: str) -> Column:
    """An id that the same key always gets."""
    return F.sha2(F.concat_ws("\u0001", *keys), 256)
