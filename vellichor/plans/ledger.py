"""Queries over the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellichor.operators import ledger, stateful
from vellichor.operators.inventory import host
from vellichor.sources.tables import load

LOG = "log AS (SELECT DISTINCT seq, document_id, url, requested_at, outcome, error_kind, http_status, bytes_down FROM fetch_log)"
RECENT = f"{LOG}, recent AS (SELECT * FROM log WHERE requested_at >= (SELECT max(requested_at) FROM log) - INTERVAL 30 DAY)"


def _log(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return load(spark, folder, "fetch_log", ["requested_at", *columns])


def ledger_by_outcome(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.by_outcome(ledger.since(_log(spark, folder, "outcome", "bytes_down")))


def ledger_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.buckets(_log(spark, folder, "outcome"))


def ledger_daily(spark: SparkSession, folder: str) -> DataFrame:
    daily = ledger.daily(_log(spark, folder, "outcome", "bytes_down"))
    return daily.withColumn("day", F.col("day").cast("string"))


def error_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.error_breakdown(_log(spark, folder, "outcome", "error_kind", "http_status"))


def recent_failures(spark: SparkSession, folder: str) -> DataFrame:
    top = ledger.recent_failures(_log(spark, folder, "outcome", "url", "error_kind", "http_status"))
    return top.withColumn("requested_at", F.unix_timestamp("requested_at"))


def bytes_saved(spark: SparkSession, folder: str) -> DataFrame:
    versions = load(spark, folder, "versions", ["document_id", "byte_size", "last_observed_seq"])
    return ledger.bytes_saved(_log(spark, folder, "document_id", "outcome"), load(spark, folder, "documents", ["current_version"]), versions)


def cache_hit_fold(spark: SparkSession, folder: str) -> DataFrame:
    folded = stateful.cache_hits(_log(spark, folder, "document_id"), 86_400.0)
    return folded.groupBy("would_hit").agg(F.count("*").alias("requests"))


def rate_violations(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder, "url").filter("url is not null").withColumn("host", host())
    return stateful.rate_violations(log, "host", rate=1 / 3600, burst=3.0)


QUERIES = [ledger_by_outcome, ledger_buckets, ledger_daily, error_breakdown, recent_failures, bytes_saved, cache_hit_fold, rate_violations]
ORACLE = {
    "ledger_by_outcome": f"WITH {RECENT} SELECT outcome, count(*) AS requests, CAST(sum(coalesce(bytes_down, 0)) AS BIGINT) AS bytes_down FROM recent GROUP BY outcome",
    "ledger_buckets": f"""WITH {LOG} SELECT count(*) AS requests, {", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ledger.OUTCOMES)},
        round(count(*) FILTER (outcome IN ('cache_hit', 'not_modified')) / count(*), 4) AS hit_rate FROM log""",
    "ledger_daily": f"""WITH {LOG} SELECT strftime(requested_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS requests, count(*) FILTER (outcome = 'error') AS errors,
        CAST(sum(coalesce(bytes_down, 0)) AS BIGINT) AS bytes_down FROM log GROUP BY 1""",
    "error_breakdown": f"""WITH {LOG}, e AS (SELECT * FROM log WHERE outcome = 'error')
        SELECT 'kind' AS facet, coalesce(error_kind, 'unrecorded') AS label, count(*) AS errors FROM e GROUP BY 2
        UNION ALL SELECT 'status', coalesce(CAST(http_status AS VARCHAR), 'none'), count(*) FROM e GROUP BY 2""",
    "recent_failures": f"""WITH {LOG}, f AS (SELECT *, row_number() OVER (ORDER BY requested_at DESC, seq DESC) AS place FROM log WHERE outcome = 'error' AND url IS NOT NULL)
        SELECT CAST(place AS INTEGER) AS place, seq, url, error_kind, http_status, CAST(epoch(requested_at) AS BIGINT) AS requested_at, (SELECT count(*) FROM f) > 50 AS truncated FROM f WHERE place <= 50""",
    "bytes_saved": f"""WITH {LOG}, v AS (SELECT DISTINCT version_id, document_id, byte_size, last_observed_seq FROM versions),
        last AS (SELECT document_id, byte_size AS last_size FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY last_observed_seq DESC NULLS LAST, version_id DESC) AS r FROM v) WHERE r = 1)
        SELECT count(*) AS hits, CAST(coalesce(sum(coalesce(s.byte_size, last_size, 0)), 0) AS BIGINT) AS bytes_saved
        FROM log JOIN documents d USING (document_id) LEFT JOIN v s ON s.version_id = d.current_version LEFT JOIN last ON last.document_id = d.document_id WHERE outcome IN ('cache_hit', 'not_modified')""",
}
