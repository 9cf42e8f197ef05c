"""Queries over documents, anchors and verifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellichor.operators import inventory, retention
from vellichor.sources.tables import load

V = "v AS (SELECT DISTINCT version_id, document_id, text_hash, captured_at, last_observed_seq, byte_size, source FROM versions)"
A = "a AS (SELECT DISTINCT anchor_id, document_id, created_version, created_at, quality FROM anchors)"
X = "x AS (SELECT DISTINCT verification_seq, anchor_id, checked_version, checked_at, state, match_score FROM verifications)"
LATEST = f"{X}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY checked_at DESC, verification_seq DESC) AS r FROM x) WHERE r = 1)"
PENDING = f"""{A}, {LATEST}, pending AS (SELECT d.document_id, count(*) AS pending_anchors FROM documents d JOIN a USING (document_id) LEFT JOIN latest l USING (anchor_id)
    WHERE d.current_version IS NOT NULL AND (l.checked_version IS NULL OR l.checked_version <> d.current_version) GROUP BY 1)"""
MOMENT = "2024-06-01 00:00:00"
RECLAIM = f"""{V}, {A}, ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY captured_at DESC, version_id DESC) AS place FROM v),
    reclaim AS (SELECT * FROM ranked r WHERE place > 3 AND NOT EXISTS (SELECT 1 FROM a WHERE a.created_version = r.version_id) AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.current_version = r.version_id))"""
PRUNE = f"""{X}, ranked_x AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY checked_at DESC, verification_seq DESC) AS place FROM x),
    prune AS (SELECT * FROM ranked_x WHERE place > 1 AND checked_at < TIMESTAMPTZ '{MOMENT}+00')"""


def _documents(spark, folder, *columns: str) -> DataFrame:
    return load(spark, folder, "documents", ["url", "status", "last_checked_at", "current_version", *columns])


def _versions(spark, folder) -> DataFrame:
    return load(spark, folder, "versions", ["document_id", "text_hash", "captured_at", "last_observed_seq", "byte_size", "source"])


def _anchors(spark, folder) -> DataFrame:
    return load(spark, folder, "anchors", ["document_id", "created_version", "created_at", "quality"])


def _verifications(spark, folder) -> DataFrame:
    return load(spark, folder, "verifications", ["anchor_id", "checked_version", "checked_at", "state", "match_score"])


def _moment():
    return F.to_timestamp(F.lit(MOMENT))


def documents_listing(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.listing(_documents(spark, folder), _anchors(spark, folder), _verifications(spark, folder)).drop("last_checked_at")


def documents_page(spark: SparkSession, folder: str) -> DataFrame:
    live = inventory.listing(_documents(spark, folder), _anchors(spark, folder), _verifications(spark, folder), status="live", has_anchors=True)
    return inventory.page(live, [F.desc("last_checked_at"), F.asc("document_id")], limit=50, offset=50).select("document_id", "anchor_count", "total", "truncated")


def pending_documents(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.pending_documents(_documents(spark, folder), _anchors(spark, folder), _verifications(spark, folder))


def anchors_latest_state(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.anchors_with_state(_anchors(spark, folder), _documents(spark, folder), _verifications(spark, folder)).select("anchor_id", "document_id", "url", "state", "match_score")


def anchors_by_state(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.anchors_with_state(_anchors(spark, folder), _documents(spark, folder), _verifications(spark, folder)).groupBy("state").agg(F.count("*").alias("anchors"))


def not_verified_since(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.not_verified_since(_anchors(spark, folder), _verifications(spark, folder), _moment())


def resolved_log_urls(spark: SparkSession, folder: str) -> DataFrame:
    urls = load(spark, folder, "fetch_log", ["url"]).select("url").filter("url is not null").distinct()
    return inventory.resolve(urls, _documents(spark, folder), load(spark, folder, "aliases"))


def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.row_counts({name: load(spark, folder, name, []) for name in ("documents", "versions", "anchors", "verifications", "fetch_log")})


def current_version(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.current_versions(_documents(spark, folder), _versions(spark, folder))


def version_latest_1(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.nth_latest(_versions(spark, folder), 1)


def served_at_check(spark: SparkSession, folder: str) -> DataFrame:
    moments = _documents(spark, folder).select("document_id", F.col("last_checked_at").alias("moment")).filter("moment is not null")
    return inventory.as_of(_versions(spark, folder), moments).select("document_id", "version_id")


def reclaimable_versions(spark: SparkSession, folder: str) -> DataFrame:
    return retention.reclaimable(_versions(spark, folder), _documents(spark, folder), _anchors(spark, folder)).select("version_id", "document_id", "place", "byte_size")


def surviving_versions(spark: SparkSession, folder: str) -> DataFrame:
    left = retention.surviving(_versions(spark, folder), _documents(spark, folder), _anchors(spark, folder))
    return left.groupBy("document_id").agg(F.count("*").alias("versions"), F.sum("byte_size").alias("bytes"))


def pruned_verifications(spark: SparkSession, folder: str) -> DataFrame:
    return retention.prunable_verifications(_verifications(spark, folder), _moment()).select("verification_seq", "anchor_id")


def collection_plan(spark: SparkSession, folder: str) -> DataFrame:
    log = load(spark, folder, "fetch_log", ["requested_at"])
    return retention.plan(_versions(spark, folder), _documents(spark, folder), _anchors(spark, folder), _verifications(spark, folder), log, 3, _moment())


QUERIES = [
    documents_listing, documents_page, pending_documents, anchors_latest_state, anchors_by_state, not_verified_since, resolved_log_urls, row_counts,
    current_version, version_latest_1, served_at_check, reclaimable_versions, surviving_versions, pruned_verifications, collection_plan,
]
HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1))"
ORACLE = {
    "documents_listing": f"""WITH {PENDING}, n AS (SELECT document_id, count(*) AS anchor_count FROM a GROUP BY 1)
        SELECT document_id, url, status, {HOST} AS host, coalesce(anchor_count, 0) AS anchor_count, coalesce(pending_anchors, 0) AS pending_anchors
        FROM documents LEFT JOIN n USING (document_id) LEFT JOIN pending USING (document_id)""",
    "documents_page": f"""WITH {A}, n AS (SELECT document_id, count(*) AS anchor_count FROM a GROUP BY 1), l AS (SELECT d.document_id, anchor_count, last_checked_at FROM documents d JOIN n USING (document_id) WHERE status = 'live')
        SELECT document_id, anchor_count, (SELECT count(*) FROM l) AS total, (SELECT count(*) FROM l) > 100 AS truncated FROM l ORDER BY last_checked_at DESC NULLS LAST, document_id LIMIT 50 OFFSET 50""",
    "pending_documents": f"WITH {PENDING} SELECT document_id, pending_anchors FROM pending",
    "anchors_latest_state": f"WITH {A}, {LATEST} SELECT anchor_id, document_id, url, state, match_score FROM a JOIN documents USING (document_id) LEFT JOIN (SELECT anchor_id, state, match_score FROM latest) USING (anchor_id)".replace(", url, state", ", documents.url, state"),
    "anchors_by_state": f"WITH {A}, {LATEST} SELECT state, count(*) AS anchors FROM a JOIN documents USING (document_id) LEFT JOIN (SELECT anchor_id, state FROM latest) USING (anchor_id) GROUP BY state",
    "not_verified_since": f"WITH {A}, {X} SELECT anchor_id, document_id FROM a WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.anchor_id = a.anchor_id AND x.checked_at > TIMESTAMPTZ '{MOMENT}+00')",
    "resolved_log_urls": "SELECT u.url, coalesce(d.document_id, s.document_id) AS document_id FROM (SELECT DISTINCT url FROM fetch_log WHERE url IS NOT NULL) u LEFT JOIN documents d ON d.url = u.url LEFT JOIN aliases s ON s.url = u.url",
    "row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(DISTINCT {k}) AS rows FROM {t}" for t, k in (("documents", "document_id"), ("versions", "version_id"), ("anchors", "anchor_id"), ("verifications", "verification_seq"), ("fetch_log", "seq"))),
    "current_version": f"""WITH {V}, n AS (SELECT document_id, version_id AS newest FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY captured_at DESC NULLS LAST, version_id DESC) AS r FROM v) WHERE r = 1)
        SELECT d.document_id, coalesce(h.version_id, newest) AS version_id FROM documents d LEFT JOIN v h ON h.version_id = d.current_version LEFT JOIN n ON n.document_id = d.document_id""",
    "version_latest_1": f"WITH {V} SELECT document_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY last_observed_seq DESC NULLS LAST, version_id DESC) AS r FROM v) WHERE r = 2",
    "served_at_check": f"""WITH {V} SELECT d.document_id, (SELECT max_by(version_id, (captured_at, version_id)) FROM v WHERE v.document_id = d.document_id AND captured_at <= d.last_checked_at) AS version_id
        FROM documents d WHERE last_checked_at IS NOT NULL""",
    "reclaimable_versions": f"WITH {RECLAIM} SELECT version_id, document_id, CAST(place AS INTEGER) AS place, byte_size FROM reclaim",
    "surviving_versions": f"WITH {RECLAIM} SELECT document_id, count(*) AS versions, CAST(sum(byte_size) AS BIGINT) AS bytes FROM v WHERE version_id NOT IN (SELECT version_id FROM reclaim) GROUP BY 1",
    "pruned_verifications": f"WITH {PRUNE} SELECT verification_seq, anchor_id FROM prune",
    "collection_plan": f"""WITH {RECLAIM}, {PRUNE} SELECT 'versions' AS kind, count(*) AS rows, CAST(coalesce(sum(byte_size), 0) AS BIGINT) AS bytes FROM reclaim
        UNION ALL SELECT 'verifications', count(*), 0 FROM prune UNION ALL SELECT 'fetch_log', count(DISTINCT seq), 0 FROM fetch_log WHERE requested_at < TIMESTAMPTZ '{MOMENT}+00'""",
}
