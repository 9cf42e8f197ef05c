"""Queries on what requests mean, who is who, and what a collection leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellichor.functions import formats, text, urls
from vellichor.operators import coverage, export, identity, inventory, ledger, observe, policy, retention, verify
from vellichor.plans import evidence
from vellichor.plans.inventory import LATEST, MOMENT, PRUNE, RECLAIM, A, V, X
from vellichor.plans.ledger import LOG
from vellichor.sources.tables import load

AS_OF = "2025-09-02 00:00:00"


def _log(spark, folder) -> DataFrame:
    return load(spark, folder, "fetch_log", ["document_id", "url", "requested_at", "outcome", "error_kind", "http_status", "bytes_down"])


def _documents(spark, folder) -> DataFrame:
    return load(spark, folder, "documents", ["url", "original_url", "title", "status", "last_checked_at", "etag", "last_modified", "current_version"])


def _versions(spark, folder) -> DataFrame:
    return load(spark, folder, "versions", ["document_id", "text_hash", "captured_at", "last_observed_at", "last_observed_seq", "byte_size", "source", "source_uri", "pipeline_version", "coverage"])


def _anchors(spark, folder) -> DataFrame:
    return load(spark, folder, "anchors", ["document_id", "created_version", "created_at", "cited_url", "occurrences", "quality"])


def _verifications(spark, folder) -> DataFrame:
    return load(spark, folder, "verifications", ["anchor_id", "checked_version", "checked_at", "state", "match_score"])


def _moment(text: str) -> F.Column:
    return F.lit(text).cast("timestamp")


def fetch_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return policy.decisions(_log(spark, folder))


def retry_waits(spark: SparkSession, folder: str) -> DataFrame:
    """The waits before the first attempts at each failed request that may be tried again."""
    failed = _log(spark, folder).filter((F.col("outcome") == "error") & policy.may_retry())
    rows = failed.select("seq", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("attempt"))
    return rows.withColumn("wait", policy.retry_wait(F.col("attempt"), F.lit(None).cast("double")))


def checked_documents(spark: SparkSession, folder: str) -> DataFrame:
    out = policy.checked_metadata(_documents(spark, folder), _log(spark, folder))
    return out.select("document_id", "status", "etag", "last_modified", F.unix_timestamp("last_checked_at").alias("last_checked_at"))


def latest_verified_versions(spark: SparkSession, folder: str) -> DataFrame:
    return policy.latest_verified_versions(_verifications(spark, folder))


def verify_tally(spark: SparkSession, folder: str) -> DataFrame:
    """Over the newest recorded verdicts, failures of the newest requests included."""
    anchors, documents = _anchors(spark, folder), _documents(spark, folder)
    recorded = anchors.select("anchor_id").join(inventory.latest_verifications(_verifications(spark, folder)).select("anchor_id", "state"), "anchor_id", "left")
    verdicts = policy.with_failures(recorded, anchors, documents, _log(spark, folder))
    return policy.tally(verdicts, anchors, _versions(spark, folder), documents, inventory.STATES)


def verify_failures(spark: SparkSession, folder: str) -> DataFrame:
    anchors = _anchors(spark, folder)
    none = anchors.select("anchor_id", F.lit(None).cast("string").alias("state"))
    return policy.with_failures(none, anchors, _documents(spark, folder), _log(spark, folder))


def cache_stats(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    moment = _moment(AS_OF)
    recent = log.filter((F.col("requested_at") >= moment - F.expr("INTERVAL 30 DAYS")) & (F.col("requested_at") <= moment))
    return policy.stats(log, moment, ledger.bytes_saved(recent, _documents(spark, folder), _versions(spark, folder)))


def error_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return policy.ranked_breakdown(ledger.error_breakdown(_log(spark, folder)))


def anchors_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = inventory.anchors_with_state(_anchors(spark, folder), _documents(spark, folder), _verifications(spark, folder))
    return inventory.page(rows, ["created_at", "anchor_id"], 50, 25).select("anchor_id", "document_id", "state", "total", "truncated")


def anchors_intact(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.anchors_with_state(_anchors(spark, folder), _documents(spark, folder), _verifications(spark, folder), "intact").select("anchor_id", "url")


def documents_behind_cursor(spark: SparkSession, folder: str) -> DataFrame:
    documents = _documents(spark, folder).select("document_id", "status")
    return inventory.after(documents, "document_id", "0190", 50)


def documents_of_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the host that has most of them, ties by name."""
    rows = _documents(spark, folder).select("document_id", inventory.host().alias("host"))
    top = rows.groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(1)
    return rows.join(F.broadcast(top.select("host")), "host")


def members_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.members(_documents(spark, folder).select("document_id", "status"), "status", ["gone", "forbidden"])


def content_windows(spark: SparkSession, folder: str) -> DataFrame:
    piece, more, onward = text.content_window("content_blob", 100, 200)
    rows = load(spark, folder, "versions", ["content_blob", "text_hash"]).select("version_id", F.sha2(piece, 256).alias("piece"), more.alias("truncated"), onward.alias("next_start"))
    return rows


def url_origins(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("document_id", urls.origin("url").alias("origin"))


def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _versions(spark, folder).filter("text_hash is not null").select("version_id", identity.stable_id("document_id", "text_hash", "source").alias("id"))


def robots_valid(spark: SparkSession, folder: str) -> DataFrame:
    ttl = F.when(F.col("fetch_status") >= 500, F.expr("INTERVAL 300 SECONDS")).otherwise(F.expr("INTERVAL 24 HOURS"))
    return load(spark, folder, "robots", ["fetch_status", "fetched_at"]).select("origin", (F.col("fetched_at") >= _moment(AS_OF) - ttl).alias("valid"))


def robots_pruned(spark: SparkSession, folder: str) -> DataFrame:
    return retention.older_than(load(spark, folder, "robots", ["fetched_at"]), "fetched_at", _moment("2025-08-20 00:00:00")).select("origin")


def collected_verifications(spark: SparkSession, folder: str) -> DataFrame:
    """Verifications after a collection: pruned first, pointing nowhere where their version was reclaimed."""
    kept = identity.collect(_versions(spark, folder), _documents(spark, folder), _anchors(spark, folder), _verifications(spark, folder), 3, _moment(MOMENT))[1]
    return kept.select("verification_seq", "anchor_id", "checked_version")


def delete_batches(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows old requests are, and whether any batch of their deletion is too large."""
    old = retention.older_than(_log(spark, folder).select("seq", "requested_at"), "requested_at", _moment("2025-06-01 00:00:00"))
    sizes = identity.batches(old, "seq").groupBy("batch").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n") <= 400, F.lit(True)).alias("bounded"))


def _moves(spark, folder) -> DataFrame:
    versions = _versions(spark, folder)
    twins = observe.duplicate_bodies(versions).filter("source = 'live'")
    holders = versions.join(twins.select("text_hash", "source", "first_document"), ["text_hash", "source"]).filter("document_id <> first_document")
    moves = holders.groupBy(F.col("document_id").alias("source_id")).agg(F.min("first_document").alias("target_id"))
    return moves.join(moves.select(F.col("source_id").alias("target_id")), "target_id", "left_anti")


def merged_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return identity.merge_anchors(_anchors(spark, folder), _documents(spark, folder), _moves(spark, folder)).select("anchor_id", "document_id", "cited_url")


def merged_aliases(spark: SparkSession, folder: str) -> DataFrame:
    return identity.merge_aliases(load(spark, folder, "aliases", ["document_id"]), _documents(spark, folder), _moves(spark, folder)).select("url", "document_id")


def merged_log(spark: SparkSession, folder: str) -> DataFrame:
    return identity.merge_log(_log(spark, folder), _moves(spark, folder)).groupBy("document_id").agg(F.count("*").alias("requests"))


def merged_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every version's place in its merged document."""
    return observe.merge_documents(_versions(spark, folder).drop("coverage"), _moves(spark, folder)).select("version_id", "document_id", "last_observed_seq")


def version_references(spark: SparkSession, folder: str) -> DataFrame:
    versions = _versions(spark, folder)
    named = [identity.version_reference(versions, r).withColumn("reference", F.lit(r)) for r in ("latest", "latest~2")]
    return named[0].unionByName(named[1])


def resolved_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every alias spelling and every id, resolved."""
    documents, aliases = _documents(spark, folder), load(spark, folder, "aliases", ["document_id"])
    references = aliases.select(F.concat("url", F.lit("#top")).alias("reference")).union(documents.select("document_id"))
    return identity.resolve_documents(references.filter("reference is not null").distinct(), documents, aliases)


def bibtex_notes(spark: SparkSession, folder: str) -> DataFrame:
    return export.bibtex_notes(_anchors(spark, folder), _documents(spark, folder), _versions(spark, folder))


def coverage_percents(spark: SparkSession, folder: str) -> DataFrame:
    rows = _versions(spark, folder).withColumn("ratio", coverage.ratio()).filter("ratio is not null")
    return rows.groupBy(formats.percent(F.col("ratio")).alias("percent")).agg(F.count("*").alias("versions"))


def cite_notes(spark: SparkSession, folder: str) -> DataFrame:
    """What a reader of a quote should know: short, repeated, stale page, low coverage of what it was taken from."""
    stale = F.col("last_checked_at") < _moment(AS_OF) - F.expr("INTERVAL 1 DAY")
    low = (F.col("coverage.basis") == "html-prose") & (F.col("coverage.captured_chars") * 3 < F.col("coverage.prose_chars"))
    rows = _anchors(spark, folder).join(_documents(spark, folder).select("document_id", "last_checked_at"), "document_id")
    rows = rows.join(_versions(spark, folder).select(F.col("version_id").alias("created_version"), "coverage"), "created_version", "left")
    notes = F.array_join(F.array_compact(F.array(F.when(F.col("quality") == "short", "short"), F.when(F.col("occurrences") >= 2, "repeated"), F.when(stale, "stale"), F.when(low, "low_coverage"))), ",")
    return rows.select("anchor_id", notes.alias("notes"))


def exact_report(spark: SparkSession, folder: str) -> DataFrame:
    """The exact stages alone, by state."""
    staged = evidence.verify_exact(spark, folder)
    return staged.groupBy(F.coalesce("state", F.lit("open")).alias("state")).agg(F.count("*").alias("anchors"))


QUERIES = [
    fetch_decisions, retry_waits, checked_documents, latest_verified_versions, verify_tally, verify_failures, cache_stats, error_ranking, anchors_page, anchors_intact, documents_behind_cursor,
    documents_of_hosts, members_by_key, content_windows, url_origins, stable_ids, robots_valid, robots_pruned, collected_verifications, delete_batches, merged_anchors, merged_aliases, merged_log,
    merged_order, version_references, resolved_documents, bibtex_notes, coverage_percents, cite_notes, exact_report,
]

_T = f"TIMESTAMPTZ '{AS_OF}+00'"
_AN = "an AS (SELECT DISTINCT anchor_id, document_id, created_version, created_at, cited_url, occurrences, quality FROM anchors)"
_VN = "vn AS (SELECT version_id, any_value(document_id) AS document_id, any_value(text_hash) AS text_hash, any_value(captured_at) AS captured_at, any_value(last_observed_at) AS last_observed_at, any_value(last_observed_seq) AS last_observed_seq, any_value(byte_size) AS byte_size, any_value(source) AS source, any_value(source_uri) AS source_uri, any_value(pipeline_version) AS pipeline_version, any_value(coverage) AS coverage FROM versions GROUP BY 1)"
_NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY requested_at DESC, seq DESC) AS r FROM log) WHERE r = 1)"
_FAIL = "fail AS (SELECT document_id, CASE WHEN http_status IN (404, 410) THEN 'GONE' ELSE 'UNREACHABLE' END AS failure FROM newest WHERE outcome = 'error')"
_LOW = "coverage.basis = 'html-prose' AND coverage.captured_chars * 3 < coverage.prose_chars"
_MOVES = f"""{_VN}, first_holder AS (SELECT text_hash, min_by(document_id, (captured_at, version_id)) AS first_document FROM vn WHERE text_hash IS NOT NULL AND source = 'live' GROUP BY 1 HAVING count(DISTINCT document_id) > 1),
    m0 AS (SELECT document_id AS source_id, min(first_document) AS target_id FROM vn JOIN first_holder USING (text_hash) WHERE source = 'live' AND document_id <> first_document GROUP BY 1),
    moves AS (SELECT * FROM m0 WHERE target_id NOT IN (SELECT source_id FROM m0))"""
_STATES = ", ".join(f"count(*) FILTER (state = '{s}') AS {s.lower()}" for s in inventory.STATES)
_LABEL = "CASE WHEN http_status = 402 THEN 'paywalled' WHEN http_status = 403 THEN 'forbidden' WHEN http_status IN (404, 410) THEN 'gone' END"



def _canonical(rows: str) -> str:
    """The canonical form of each ``(document_id, url)`` in SQL."""
    return evidence.ORACLE["canonical_urls_plain"].replace("trim(original_url)", "trim(url)").replace("AS u FROM documents)", f"AS u FROM ({rows}))")


ORACLE = {
    "fetch_decisions": f"""WITH {LOG} SELECT seq, coalesce(http_status IN (200, 203), false) AS is_representation, {_LABEL} AS status_label,
        outcome = 'error' AND (coalesce(http_status IN (402, 403, 404, 410, 429), false) OR coalesce(error_kind IN ('network', 'timeout', 'robots_unavailable'), false)) AS may_ask_archive,
        outcome = 'error' AND coalesce(http_status = 429, false) AS may_retry,
        CASE WHEN outcome = 'error' THEN coalesce(error_kind, CASE WHEN http_status >= 400 THEN 'http_status' WHEN coalesce(http_status NOT IN (200, 203), true) THEN 'not_a_representation' END, 'unrecorded') END AS error_label FROM log""",
    "retry_waits": f"""WITH {LOG} SELECT seq, CAST(n AS INTEGER) AS attempt, CASE WHEN pow(2.0, n) <= 60 THEN pow(2.0, n) END AS wait FROM log, range(8) t(n) WHERE outcome = 'error' AND http_status = 429""",
    "checked_documents": f"""WITH {LOG}, s AS (SELECT *, CASE WHEN outcome = 'error' THEN {_LABEL} ELSE 'live' END AS answer FROM log),
        n AS (SELECT document_id, max(requested_at) AS newest FROM log GROUP BY 1),
        t AS (SELECT document_id, answer FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY requested_at DESC, seq DESC) AS r FROM s WHERE answer IS NOT NULL) WHERE r = 1),
        j AS (SELECT d.document_id, coalesce(t.answer, d.status) AS status, etag, last_modified, greatest(last_checked_at, newest) AS moment FROM documents d LEFT JOIN n USING (document_id) LEFT JOIN t USING (document_id))
        SELECT document_id, status, CASE WHEN status = 'live' THEN etag END AS etag, CASE WHEN status = 'live' THEN last_modified END AS last_modified, CAST(epoch(moment) AS BIGINT) AS last_checked_at FROM j""",
    "latest_verified_versions": f"""WITH {X} SELECT anchor_id, checked_version AS version_id FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY checked_at DESC, verification_seq DESC) AS r FROM x WHERE checked_version IS NOT NULL) WHERE r = 1""",
    "verify_tally": f"""WITH {LOG}, {_AN}, {_VN}, {LATEST}, {_NEWEST}, {_FAIL},
        j AS (SELECT an.document_id, coalesce(failure, l.state, 'UNRESOLVED') AS state, occurrences, o.pipeline_version AS old_pipeline, c.pipeline_version, c.source, coalesce(c.coverage.basis = 'html-prose' AND c.coverage.captured_chars * 3 < c.coverage.prose_chars, false) AS low
            FROM an LEFT JOIN latest l USING (anchor_id) LEFT JOIN fail ON fail.document_id = an.document_id LEFT JOIN documents d ON d.document_id = an.document_id LEFT JOIN vn o ON o.version_id = an.created_version LEFT JOIN vn c ON c.version_id = d.current_version)
        SELECT count(*) AS checked, {_STATES}, count(*) FILTER (occurrences > 1) AS ambiguous, count(*) FILTER (pipeline_version <> old_pipeline) AS pipeline_changed, count(*) FILTER (low) AS low_coverage,
            count(*) FILTER (source = 'archive') AS from_archive, count(*) FILTER (source = 'live') AS from_live, count(DISTINCT document_id) AS documents_checked, (SELECT count(*) FROM documents) AS documents_held FROM j""",
    "verify_failures": f"WITH {LOG}, {_AN}, {_NEWEST}, {_FAIL} SELECT anchor_id, coalesce(failure, 'UNRESOLVED') AS state FROM an LEFT JOIN fail USING (document_id)",
    "cache_stats": f"""WITH {LOG}, r AS (SELECT * FROM log WHERE requested_at BETWEEN {_T} - INTERVAL 30 DAY AND {_T}), v AS (SELECT DISTINCT version_id, document_id, byte_size, last_observed_seq FROM versions),
        last AS (SELECT document_id, max_by(byte_size, (last_observed_seq, version_id)) AS last_size FROM v GROUP BY 1),
        saved AS (SELECT CAST(coalesce(sum(coalesce(s.byte_size, last_size, 0)), 0) AS BIGINT) AS bytes_saved FROM r JOIN documents d USING (document_id) LEFT JOIN v s ON s.version_id = d.current_version LEFT JOIN last ON last.document_id = d.document_id WHERE outcome IN ('cache_hit', 'not_modified'))
        SELECT count(*) AS requests, {", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ledger.OUTCOMES)}, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (outcome IN ('cache_hit', 'not_modified')) / count(*), 4) ELSE 0.0 END AS hit_rate,
            CAST(coalesce(sum(bytes_down), 0) AS BIGINT) AS bytes_down, (SELECT bytes_saved FROM saved) AS bytes_saved, true AS whole FROM r""",
    "error_ranking": f"""WITH {LOG}, e AS (SELECT * FROM log WHERE outcome = 'error'), b AS (SELECT 'kind' AS facet, coalesce(error_kind, 'unrecorded') AS label, count(*) AS errors FROM e GROUP BY 2
        UNION ALL SELECT 'status', coalesce(CAST(http_status AS VARCHAR), 'none'), count(*) FROM e GROUP BY 2) SELECT *, CAST(row_number() OVER (PARTITION BY facet ORDER BY errors DESC, label) AS INTEGER) AS place FROM b""",
    "anchors_page": f"""WITH {_AN}, {LATEST}, j AS (SELECT an.anchor_id, an.document_id, l.state, an.created_at FROM an JOIN documents d USING (document_id) LEFT JOIN latest l USING (anchor_id))
        SELECT anchor_id, document_id, state, (SELECT count(*) FROM j) AS total, (SELECT count(*) FROM j) > 75 AS truncated FROM j ORDER BY created_at, anchor_id LIMIT 50 OFFSET 25""",
    "anchors_intact": f"WITH {_AN}, {LATEST} SELECT an.anchor_id, d.url FROM an JOIN documents d USING (document_id) JOIN latest l USING (anchor_id) WHERE l.state = 'INTACT'",
    "documents_behind_cursor": "SELECT document_id, status FROM documents WHERE document_id > '0190' ORDER BY document_id LIMIT 50",
    "documents_of_hosts": r"""WITH h AS (SELECT document_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM documents), t AS (SELECT host FROM h GROUP BY host ORDER BY count(*) DESC, host LIMIT 1) SELECT host, document_id FROM h JOIN t USING (host)""",
    "members_by_key": "SELECT document_id, status FROM documents WHERE status IN ('gone', 'forbidden')",
    "content_windows": """WITH t AS (SELECT DISTINCT version_id, content_blob FROM versions) SELECT version_id, sha256(substring(content_blob, 101, 200)) AS piece, coalesce(length(content_blob), 0) > 300 AS truncated,
        CASE WHEN length(content_blob) > 300 THEN 300 END AS next_start FROM t""",
    "url_origins": r"SELECT document_id, lower(regexp_extract(url, '^([hH][tT][tT][pP][sS]?://[^/?#]+)', 1)) AS origin FROM documents",
    "stable_ids": f"WITH {_VN} SELECT version_id, sha256(document_id || chr(1) || text_hash || chr(1) || source) AS id FROM vn WHERE text_hash IS NOT NULL",
    "robots_valid": f"SELECT origin, fetched_at >= {_T} - CASE WHEN fetch_status >= 500 THEN INTERVAL 300 SECOND ELSE INTERVAL 24 HOUR END AS valid FROM robots",
    "robots_pruned": "SELECT origin FROM robots WHERE fetched_at < TIMESTAMPTZ '2025-08-20 00:00:00+00'",
    "collected_verifications": f"""WITH {RECLAIM}, {PRUNE} SELECT verification_seq, anchor_id, CASE WHEN checked_version IN (SELECT version_id FROM v) AND checked_version NOT IN (SELECT version_id FROM reclaim) THEN checked_version END AS checked_version
        FROM x WHERE verification_seq NOT IN (SELECT verification_seq FROM prune)""",
    "delete_batches": f"WITH {LOG} SELECT count(*) AS rows, true AS bounded FROM log WHERE requested_at < TIMESTAMPTZ '2025-06-01 00:00:00+00'",
    "merged_anchors": f"""WITH {_MOVES}, {_AN} SELECT anchor_id, coalesce(target_id, an.document_id) AS document_id, CASE WHEN target_id IS NOT NULL THEN coalesce(nullif(cited_url, ''), original_url) ELSE cited_url END AS cited_url
        FROM an LEFT JOIN moves ON source_id = an.document_id LEFT JOIN documents d ON d.document_id = an.document_id""",
    "merged_aliases": f"""WITH {_MOVES}, gone AS (SELECT url, target_id AS document_id FROM documents JOIN moves ON source_id = document_id),
        old AS (SELECT url, coalesce(target_id, document_id) AS document_id FROM aliases LEFT JOIN moves ON source_id = document_id WHERE url NOT IN (SELECT url FROM gone WHERE url IS NOT NULL))
        SELECT * FROM (SELECT * FROM gone UNION ALL SELECT * FROM old) z WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.url = z.url AND d.document_id NOT IN (SELECT source_id FROM moves))""",
    "merged_log": f"WITH {_MOVES}, {LOG} SELECT coalesce(target_id, document_id) AS document_id, count(*) AS requests FROM log LEFT JOIN moves ON source_id = document_id GROUP BY 1",
    "merged_order": f"""WITH {_MOVES}, s AS (SELECT vn.*, target_id IS NOT NULL AS moved, coalesce(target_id, document_id) AS doc FROM vn LEFT JOIN moves ON source_id = document_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc, text_hash, source ORDER BY captured_at, moved, version_id) AS place, max(last_observed_at) OVER (PARTITION BY doc, text_hash, source) AS seen FROM s),
        kept AS (SELECT * FROM k WHERE place = 1 OR text_hash IS NULL)
        SELECT version_id, doc AS document_id, CAST((SELECT count(*) FROM kept b WHERE b.doc = a.doc AND (b.seen < a.seen OR (b.seen = a.seen AND (b.last_observed_seq < a.last_observed_seq OR (b.last_observed_seq = a.last_observed_seq AND b.version_id <= a.version_id))))) AS INTEGER) AS last_observed_seq FROM kept a""",
    "version_references": f"""WITH {V}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY last_observed_seq DESC NULLS LAST, version_id DESC) AS n FROM v)
        SELECT document_id, version_id, CASE n WHEN 1 THEN 'latest' ELSE 'latest~2' END AS reference FROM r WHERE n IN (1, 3)""",
    "bibtex_notes": rf"""WITH {_AN}, {_VN}, l AS (SELECT anchor_id, coalesce(nullif(cited_url, ''), original_url, '') AS href, strftime(captured_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day,
            CASE WHEN vn.source = 'archive' AND source_uri IS NOT NULL THEN source_uri ELSE 'evidence://' || an.document_id || '/' || version_id END AS uri
            FROM an JOIN documents d ON d.document_id = an.document_id JOIN vn ON vn.version_id = an.created_version)
        SELECT anchor_id, 'note = {{\url{{' || regexp_replace(href, '([%#&_{{}}$])', '\\\1', 'g') || '}}, archived at \url{{' || regexp_replace(uri, '([%#&_{{}}$])', '\\\1', 'g') || '}} on ' || day || '}}' AS note FROM l""",
    "coverage_percents": f"""WITH {_VN}, r AS (SELECT {evidence._RATIO} AS ratio FROM vn) SELECT CASE WHEN ratio <= 0 THEN '0%' ELSE CAST(CAST(round(ratio * 100) AS BIGINT) AS VARCHAR) || '%' END AS percent, count(*) AS versions FROM r WHERE ratio IS NOT NULL GROUP BY 1""",
    "exact_report": f"SELECT coalesce(state, 'open') AS state, count(*) AS anchors FROM ({evidence.ORACLE['verify_exact']}) GROUP BY 1",
    "resolved_documents": f"""WITH refs AS (SELECT url || '#top' AS reference FROM aliases WHERE url IS NOT NULL UNION SELECT document_id FROM documents),
        rc AS ({_canonical("SELECT reference AS document_id, reference AS url FROM refs WHERE starts_with(lower(reference), 'http')")}),
        oc AS (SELECT canonical, min(document_id) AS own FROM ({_canonical("SELECT document_id, url FROM documents")}) GROUP BY 1), ac AS (SELECT canonical, min(document_id) AS other FROM ({_canonical("SELECT document_id, url FROM aliases")}) GROUP BY 1)
        SELECT reference, coalesce(d.document_id, own, other) AS document_id FROM refs LEFT JOIN documents d ON d.document_id = reference LEFT JOIN rc ON rc.document_id = reference
        LEFT JOIN oc ON oc.canonical = rc.canonical LEFT JOIN ac ON ac.canonical = rc.canonical""",
    "cite_notes": f"""WITH {_AN}, {_VN} SELECT anchor_id, concat_ws(',', CASE WHEN quality = 'short' THEN 'short' END, CASE WHEN occurrences >= 2 THEN 'repeated' END, CASE WHEN last_checked_at < {_T} - INTERVAL 1 DAY THEN 'stale' END,
        CASE WHEN {_LOW} THEN 'low_coverage' END) AS notes FROM an JOIN documents d ON d.document_id = an.document_id LEFT JOIN vn ON vn.version_id = an.created_version""",
}
