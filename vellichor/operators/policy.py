"""What a request's result means: columns over the request log, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPRESENTATIONS = [200, 203]
ARCHIVE_STATUSES = [402, 403, 404, 410, 429]
#: Seconds: first wait, least wait, and the wait from which a request isn't tried again.
BACKOFF, FLOOR, LONGEST_WAIT = 1.0, 1.0, 60.0


def is_representation(status: str = "http_status") -> Column:
    """Whether a response carries the page itself."""
    return F.coalesce(F.col(status).isin(REPRESENTATIONS), F.lit(False))


def status_label(status: str = "http_status") -> Column:
    """The document status that an HTTP status says, or null when it says none."""
    code = F.col(status)
    return F.when(code == 402, "paywalled").when(code == 403, "forbidden").when(code.isin(404, 410), "gone")


def may_ask_archive(status: str = "http_status", kind: str = "error_kind") -> Column:
    """Whether an archived copy may stand in: the page can't be had, or its host or rules couldn't be reached."""
    return F.coalesce(F.col(status).isin(ARCHIVE_STATUSES), F.lit(False)) | F.coalesce(F.col(kind).isin("network", "timeout", "robots_unavailable"), F.lit(False))


def may_retry(status: str = "http_status", wait: Column | None = None) -> Column:
    """Whether a request may be tried again: 429 always, 403 only with a known wait."""
    known = F.lit(False) if wait is None else wait.isNotNull()
    return F.coalesce((F.col(status) == 429) | ((F.col(status) == 403) & known), F.lit(False))


def retry_wait(attempt: Column, server: Column) -> Column:
    """Seconds to wait before an attempt (from 0): the server's wish or a doubling one, no less than the floor; null when longer than is worth it."""
    wait = F.greatest(F.coalesce(server, F.lit(BACKOFF) * F.pow(F.lit(2.0), attempt)), F.lit(FLOOR))
    return F.when(wait <= LONGEST_WAIT, wait)


def error_label(status: str = "http_status", kind: str = "error_kind") -> Column:
    """A failed request's kind; an unrecorded one is derived from its status."""
    code = F.col(status)
    return F.coalesce(F.col(kind), F.when(code >= 400, "http_status").when(~is_representation(status), "not_a_representation"), F.lit("unrecorded"))


def decisions(log: DataFrame) -> DataFrame:
    """Every request with what follows from it."""
    failed = F.col("outcome") == "error"
    return log.select(
        "seq", is_representation().alias("is_representation"), status_label().alias("status_label"), (failed & may_ask_archive()).alias("may_ask_archive"),
        (failed & may_retry()).alias("may_retry"), F.when(failed, error_label()).alias("error_label"),
    )


def checked_metadata(documents: DataFrame, log: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Documents after the log is applied: last check, status by the newest answer, validators cleared where the page is no longer live.

    ``titles`` is ``(document_id, checked_at, title)``; a null title keeps the old one.
    Pre-aggregated per document, so that a hot one is no burden.
    """
    at = F.struct("requested_at", "seq")
    answer = F.when(F.col("outcome") == "error", status_label()).otherwise("live")
    news = log.groupBy("document_id").agg(F.max("requested_at").alias("newest"), F.max_by(answer, F.when(answer.isNotNull(), at)).alias("answer"))
    out = documents.join(news, "document_id", "left")
    if titles is not None:
        said = titles.filter("title is not null").groupBy("document_id").agg(F.max_by("title", "checked_at").alias("new_title"))
        out = out.join(said, "document_id", "left").withColumn("title", F.coalesce("new_title", "title")).drop("new_title")
    status = F.coalesce("answer", "status")
    kept = {c: F.when(status == "live", F.col(c)) for c in ("etag", "last_modified") if c in documents.columns}
    return out.withColumns({"last_checked_at": F.greatest("last_checked_at", "newest"), "status": status, **kept}).drop("newest", "answer")


def latest_verified_versions(verifications: DataFrame) -> DataFrame:
    """The version that each anchor was last checked against, of checks that had one."""
    newest = F.max_by("checked_version", F.struct("checked_at", "verification_seq"))
    return verifications.filter("checked_version is not null").groupBy("anchor_id").agg(newest.alias("version_id"))


def tally(verdicts: DataFrame, anchors: DataFrame, versions: DataFrame, documents: DataFrame, states: list[str]) -> DataFrame:
    """One row over verdicts ``(anchor_id, state)``: each state's count, and the checked anchors' ambiguous quotes, changed pipelines, low coverage, archive sources and documents."""
    low = (F.col("coverage.basis") == "html-prose") & (F.col("coverage.captured_chars") * 3 < F.col("coverage.prose_chars"))
    side = versions.select("version_id", "pipeline_version", "source", low.alias("low"))
    rows = verdicts.join(anchors.select("anchor_id", "document_id", F.col("created_version").alias("origin"), "occurrences"), "anchor_id")
    rows = rows.join(documents.select("document_id", "current_version"), "document_id", "left")
    rows = rows.join(side.select(F.col("version_id").alias("origin"), F.col("pipeline_version").alias("old_pipeline")), "origin", "left").join(side.withColumnRenamed("version_id", "current_version"), "current_version", "left")
    total = documents.agg(F.count("*").alias("documents_held"))
    return rows.agg(
        F.count("*").alias("checked"), *[F.count_if(F.col("state") == s).alias(s.lower()) for s in states], F.count_if(F.col("occurrences") > 1).alias("ambiguous"),
        F.count_if(F.col("pipeline_version") != F.col("old_pipeline")).alias("pipeline_changed"), F.count_if("low").alias("low_coverage"),
        F.count_if(F.col("source") == "archive").alias("from_archive"), F.count_if(F.col("source") == "live").alias("from_live"), F.countDistinct("document_id").alias("documents_checked"),
    ).crossJoin(F.broadcast(total))


def with_failures(verdicts: DataFrame, anchors: DataFrame, documents: DataFrame, log: DataFrame) -> DataFrame:
    """Verdicts in which quotes of pages that couldn't be fetched are GONE or UNREACHABLE, by the newest request of their document."""
    newest = log.groupBy("document_id").agg(F.max_by(F.struct("outcome", "http_status"), F.struct("requested_at", "seq")).alias("r")).select("document_id", "r.*").filter("outcome = 'error'")
    failed = newest.select("document_id", F.when(F.col("http_status").isin(404, 410), "GONE").otherwise("UNREACHABLE").alias("failure"))
    rows = verdicts.join(anchors.select("anchor_id", "document_id"), "anchor_id").join(failed, "document_id", "left")
    return rows.select("anchor_id", F.coalesce("failure", "state", F.lit("UNRESOLVED")).alias("state"))


def stats(log: DataFrame, as_of, saved: DataFrame, days: int = 30) -> DataFrame:
    """One row: requests, outcomes, hit rate and bytes of the window that ends at a literal ``as_of``, and what was saved."""
    from vellichor.operators import ledger

    recent = log.filter((F.col("requested_at") >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("requested_at") <= as_of))
    one = ledger.buckets(recent).crossJoin(recent.agg(F.coalesce(F.sum("bytes_down"), F.lit(0)).alias("bytes_down")))
    named = sum((F.col(o) for o in ledger.OUTCOMES), F.lit(0))
    return one.crossJoin(saved.select("bytes_saved")).withColumn("whole", named == F.col("requests"))


def ranked_breakdown(breakdown: DataFrame) -> DataFrame:
    """A breakdown ``(facet, label, errors)`` with each label's place: most errors first, then by label."""
    return breakdown.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("errors"), "label")))
