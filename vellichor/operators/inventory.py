"""Listings of documents and anchors, references resolved, and what awaits verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ["live", "gone", "forbidden", "paywalled"]
STATES = ["INTACT", "MOVED", "ALTERED", "MISSING", "GONE", "UNREACHABLE", "UNRESOLVED"]


def checked(value: str | None, allowed: list[str], what: str) -> str | None:
    """A filter value in its canonical case; an unknown one is an error, never an empty result."""
    if value is None:
        return None
    for a in allowed:
        if a.lower() == value.strip().lower():
            return a
    raise ValueError(f"unknown {what} {value!r}; one of {', '.join(allowed)}")


def latest_verifications(verifications: DataFrame) -> DataFrame:
    """The newest verification of each anchor by time, then sequence."""
    newest = F.max_by(F.struct("checked_version", "checked_at", "state", "match_score", "verification_seq"), F.struct("checked_at", "verification_seq"))
    return verifications.groupBy("anchor_id").agg(newest.alias("v")).select("anchor_id", "v.*")


def host(url: str = "url") -> F.Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def pending_documents(documents: DataFrame, anchors: DataFrame, verifications: DataFrame) -> DataFrame:
    """Documents with an anchor whose latest verification isn't of the current version; without a current version none is pending."""
    latest = anchors.select("anchor_id", "document_id").join(latest_verifications(verifications), "anchor_id", "left")
    current = documents.filter("current_version is not null").select("document_id", "current_version")
    behind = current.join(latest, "document_id").filter("checked_version is null or checked_version <> current_version")
    return behind.groupBy("document_id").agg(F.count("*").alias("pending_anchors"))


def listing(documents: DataFrame, anchors: DataFrame, verifications: DataFrame, status: str | None = None, host_is: str | None = None, has_anchors: bool | None = None) -> DataFrame:
    """Every document with its host, anchors and pending anchors, narrowed by the filters given."""
    counts = anchors.groupBy("document_id").agg(F.count("*").alias("anchor_count"))
    out = documents.select("document_id", "url", "status", "last_checked_at", host().alias("host"))
    if wanted := checked(status, STATUSES, "status"):
        out = out.filter(F.col("status") == wanted)
    if host_is is not None:
        out = out.filter(F.col("host") == host_is.lower())
    out = out.join(counts, "document_id", "left").join(pending_documents(documents, anchors, verifications), "document_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("anchor_count", "pending_anchors")})
    if has_anchors is not None:
        out = out.filter((F.col("anchor_count") > 0) == has_anchors)
    return out


def page(df: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page in a total order, with the total and whether rows follow. A report: ``limit`` rows at most leave."""
    total = df.agg(F.count("*").alias("total"))
    shown = df.orderBy(*order).offset(offset).limit(limit)
    return shown.join(F.broadcast(total)).withColumn("truncated", F.col("total") > F.lit(offset + limit))


def after(df: DataFrame, key: str, cursor: str | None, limit: int = 50) -> DataFrame:
    """Keyset page: the next ``limit`` rows behind a cursor."""
    return (df if cursor is None else df.filter(F.col(key) > cursor)).orderBy(key).limit(limit)


def anchors_with_state(anchors: DataFrame, documents: DataFrame, verifications: DataFrame, state: str | None = None) -> DataFrame:
    """Anchors with their document's URL and latest state; null means never verified."""
    latest = latest_verifications(verifications).select("anchor_id", "state", "checked_at", "match_score")
    out = anchors.select("anchor_id", "document_id", "created_at", "quality").join(documents.select("document_id", "url"), "document_id").join(latest, "anchor_id", "left")
    wanted = checked(state, STATES, "state")
    return out.filter(F.col("state") == wanted) if wanted else out


def not_verified_since(anchors: DataFrame, verifications: DataFrame, moment) -> DataFrame:
    """Anchors without a verification newer than ``moment`` (a timestamp column or literal); those never verified belong."""
    newer = verifications.filter(F.col("checked_at") > moment).select("anchor_id").distinct()
    return anchors.select("anchor_id", "document_id").join(newer, "anchor_id", "left_anti")


def members(df: DataFrame, key: str, values: list | None) -> DataFrame:
    """Rows with a key of the list; null means all, an empty list none."""
    if values is None:
        return df
    return df.filter(F.col(key).isin(values)) if values else df.filter(F.lit(False))


def resolve(references: DataFrame, documents: DataFrame, aliases: DataFrame, reference: str = "url") -> DataFrame:
    """``document_id`` of each URL by the documents' own URLs, else by alias; unmatched ones stay with null."""
    own = documents.select(F.col("url").alias(reference), F.col("document_id").alias("own_id"))
    alias = aliases.select(F.col("url").alias(reference), F.col("document_id").alias("alias_id"))
    return references.join(own, reference, "left").join(alias, reference, "left").withColumn("document_id", F.coalesce("own_id", "alias_id")).drop("own_id", "alias_id")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.union(one)
    return out


def current_versions(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Each document's version by its pointer, else the newest captured."""
    newest = versions.groupBy("document_id").agg(F.max_by("version_id", F.struct("captured_at", "version_id")).alias("newest"))
    held = versions.select(F.col("version_id").alias("current_version"), F.lit(True).alias("held"))
    out = documents.select("document_id", "current_version").join(held, "current_version", "left").join(newest, "document_id", "left")
    return out.select("document_id", F.coalesce(F.when(F.col("held"), F.col("current_version")), F.col("newest")).alias("version_id"))


def nth_latest(versions: DataFrame, n: int = 0) -> DataFrame:
    """``latest~n``: the version at place ``n`` from the end in observation order, per document."""
    if n < 0:
        raise ValueError("a version reference counts back from the latest, so it can't be negative")
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("last_observed_seq"), F.desc("version_id")))
    return versions.withColumn("place", rank).filter(F.col("place") == n + 1).select("document_id", "version_id")


def as_of(versions: DataFrame, moments: DataFrame) -> DataFrame:
    """The version last captured at or before each ``(document_id, moment)``; an as-of join by one union and window.

    Moments before the first capture have a null version.
    """
    left = versions.select("document_id", F.col("captured_at").alias("at"), "version_id", F.lit(0).alias("kind"))
    right = moments.select("document_id", F.col("moment").alias("at"), F.lit(None).cast("string").alias("version_id"), F.lit(1).alias("kind"))
    w = Window.partitionBy("document_id").orderBy("at", "kind", "version_id").rowsBetween(Window.unboundedPreceding, 0)
    return left.union(right).withColumn("served", F.last("version_id", ignorenulls=True).over(w)).filter("kind = 1").select("document_id", F.col("at").alias("moment"), F.col("served").alias("version_id"))
