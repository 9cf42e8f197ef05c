"""Queries on observations, versions, quotes, coverage and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellichor.functions import text, urls
from vellichor.operators import cite, coverage, export, observe, verify
from vellichor.session import read_table
from vellichor.sources.tables import load

#: The stream table read as observations of pages: one user is one document, one type one body.
OBSERVATIONS = """
    SELECT CAST(user_id AS VARCHAR) AS document_id, event_id AS seq, ts AS observed_at,
        CASE WHEN k % 7 = 0 THEN 'nm' WHEN k % 13 = 0 THEN 'arch' ELSE 'rep' END AS kind,
        CASE WHEN k % 7 <> 0 THEN event_type END AS text_hash,
        CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'Z' ELSE event_type || '#' || (k % 3) END END AS raw_hash,
        CASE WHEN k % 7 <> 0 THEN 'p' || (k % 2) END AS pipeline_version,
        CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 13 = 0 THEN 'archive' ELSE 'live' END END AS source
    FROM (SELECT *, CAST({json} AS INTEGER) AS k FROM events)"""


def _observations(spark: SparkSession, folder: str) -> DataFrame:
    sql = OBSERVATIONS.format(json="get_json_object(props, '$.k')").replace("VARCHAR", "STRING").replace("FROM events)", "FROM {events})")
    return spark.sql(sql, events=read_table(spark, folder, "events"))


def _documents(spark, folder, *columns):
    return load(spark, folder, "documents", ["original_url", "current_version", *columns])


def _current_texts(spark: SparkSession, folder: str) -> DataFrame:
    bodies = load(spark, folder, "versions", ["content_blob"])
    return load(spark, folder, "documents", ["current_version"]).select("document_id", F.col("current_version").alias("version_id")).join(bodies, "version_id").select("document_id", "version_id", F.col("content_blob").alias("body"))


def _anchors(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "anchors", ["document_id", "created_version", "exact", "prefix", "suffix", "position_hint", "cited_url"])


def classify_observations(spark: SparkSession, folder: str) -> DataFrame:
    return observe.classify(_observations(spark, folder)).select("document_id", "seq", "outcome", "raw_changed")


def outcome_counts(spark: SparkSession, folder: str) -> DataFrame:
    return classify_observations(spark, folder).groupBy("outcome").agg(F.count("*").alias("n"), F.count_if("raw_changed").alias("raw_changed"))


def folded_versions(spark: SparkSession, folder: str) -> DataFrame:
    folded = observe.fold_versions(observe.classify(_observations(spark, folder)))
    return folded.select("document_id", "vkey", "last_observed_seq", "observations", "is_current", "raw_hash", "last_observed_raw_hash")


def duplicate_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return observe.duplicate_bodies(load(spark, folder, "versions", ["document_id", "text_hash", "source", "captured_at"]))


def merged_mirrors(spark: SparkSession, folder: str) -> DataFrame:
    versions = load(spark, folder, "versions", ["document_id", "text_hash", "source", "captured_at", "last_observed_at", "last_observed_seq"])
    twins = observe.duplicate_bodies(versions).filter("source = 'live'")
    holders = versions.join(twins.select("text_hash", "source", "first_document"), ["text_hash", "source"]).filter("document_id <> first_document")
    moves = holders.groupBy(F.col("document_id").alias("source_id")).agg(F.min("first_document").alias("target_id"))
    moves = moves.join(moves.select(F.col("source_id").alias("target_id")), "target_id", "left_anti")
    merged = observe.merge_documents(versions, moves)
    return merged.groupBy("document_id").agg(F.count("*").alias("versions"), F.max("last_observed_seq").alias("last_seq"))


def verify_exact(spark: SparkSession, folder: str) -> DataFrame:
    staged = verify.exact_stages(verify.with_texts(_anchors(spark, folder), _current_texts(spark, folder)))
    return staged.select("anchor_id", "state", "found_offset")


def verify_full(spark: SparkSession, folder: str) -> DataFrame:
    return verify.verify(_anchors(spark, folder), _current_texts(spark, folder))


def verify_report(spark: SparkSession, folder: str) -> DataFrame:
    return verify.report(verify_full(spark, folder))


def attention(spark: SparkSession, folder: str) -> DataFrame:
    return verify.attention(verify_full(spark, folder)).select("anchor_id", "state", "edit_distance")


def cite_quotes(spark: SparkSession, folder: str) -> DataFrame:
    quotes = load(spark, folder, "anchors", ["document_id", "exact"]).select(F.col("anchor_id").alias("quote_id"), "document_id", F.col("exact").alias("quote"))
    return cite.warnings(cite.cite(quotes, _current_texts(spark, folder)))


def coverage_ratios(spark: SparkSession, folder: str) -> DataFrame:
    versions = load(spark, folder, "versions", ["coverage"])
    ratio = F.round(coverage.ratio(), 6).alias("ratio")
    return versions.select("version_id", ratio, F.array_join(coverage.notes(), ",").alias("notes"))


def dropped_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.dropped_blocks(load(spark, folder, "versions", ["coverage"]))


def timemap_link(spark: SparkSession, folder: str) -> DataFrame:
    return export.timemap_link(_documents(spark, folder), load(spark, folder, "versions", ["document_id", "captured_at", "source", "source_uri", "last_observed_seq"]))


def timemap_json(spark: SparkSession, folder: str) -> DataFrame:
    return export.timemap_json(_documents(spark, folder), load(spark, folder, "versions", ["document_id", "captured_at", "source", "source_uri", "last_observed_seq"]))


def robust_links(spark: SparkSession, folder: str) -> DataFrame:
    return export.robust_links(_anchors(spark, folder), _documents(spark, folder), load(spark, folder, "versions", ["captured_at", "source", "source_uri"]))


def version_diffs(spark: SparkSession, folder: str) -> DataFrame:
    return export.version_diffs(export.consecutive(load(spark, folder, "versions", ["document_id", "last_observed_seq", "content_blob"])))


def canonical_urls(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("document_id", urls.canonical_url_column("original_url").alias("canonical"))


def canonical_urls_plain(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("document_id", urls.plain_canonical("original_url").alias("canonical"))


def script_density(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").filter("text <> ''").select("document_id", F.round(text.script_density("text"), 6).alias("density")).dropDuplicates(["document_id"])


def normalized_texts(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents", ["text"]).select("document_id", text.normalize_column("text").alias("body"))


def text_hashes(spark: SparkSession, folder: str) -> DataFrame:
    checked = read_table(spark, folder, "versions").select("version_id", (text.text_hash("content_blob") == F.col("text_hash")).alias("agrees"))
    return checked.dropDuplicates(["version_id"]).groupBy("agrees").agg(F.count("*").alias("versions"))


QUERIES = [
    classify_observations, outcome_counts, folded_versions, duplicate_bodies, merged_mirrors, verify_exact, verify_full, verify_report, attention, cite_quotes, coverage_ratios,
    dropped_blocks, timemap_link, timemap_json, robust_links, version_diffs, canonical_urls, canonical_urls_plain, script_density, normalized_texts, text_hashes,
]

_SQL_OBS = OBSERVATIONS.format(json="json_extract_string(props, '$.k')")
_CLASSIFY = f"""
    o AS ({_SQL_OBS}),
    k AS (SELECT *, last_value(text_hash || '|' || source IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY observed_at, seq ROWS UNBOUNDED PRECEDING) AS vkey FROM o),
    f AS (SELECT *, first_value(raw_hash IGNORE NULLS) OVER w AS v_raw, first_value(pipeline_version IGNORE NULLS) OVER w AS v_pipe,
        last_value(raw_hash IGNORE NULLS) OVER (PARTITION BY document_id, vkey ORDER BY observed_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_raw
        FROM k WHERE vkey IS NOT NULL WINDOW w AS (PARTITION BY document_id, vkey ORDER BY observed_at, seq ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT *, lag(vkey) OVER w AS pv, lag(v_raw) OVER w AS pr, lag(v_pipe) OVER w AS pp, row_number() OVER w AS place FROM f WINDOW w AS (PARTITION BY document_id ORDER BY observed_at, seq)),
    c AS (SELECT *, CASE WHEN kind = 'nm' THEN 'not_modified' WHEN kind = 'arch' THEN 'archive' WHEN pv IS NULL THEN 'created' WHEN pv = vkey THEN 'unchanged'
        WHEN split_part(pv, '|', 1) = split_part(vkey, '|', 1) THEN 'changed' WHEN raw_hash = pr AND pipeline_version <> pp THEN 'renormalized' ELSE 'changed' END AS outcome FROM g),
    r AS (SELECT *, outcome = 'unchanged' AND coalesce(raw_hash <> prior_raw, false) AS raw_changed FROM c)"""
_V = "v AS (SELECT DISTINCT version_id, document_id, text_hash, captured_at, last_observed_at, last_observed_seq, source, source_uri FROM versions)"
_TWINS = f"""{_V}, twins AS (SELECT text_hash, source, count(DISTINCT document_id) AS documents, count(*) AS held, min_by(document_id, (captured_at, version_id)) AS first_document
    FROM v WHERE text_hash IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT document_id) > 1)"""
_URI = "CASE WHEN source = 'archive' AND source_uri IS NOT NULL THEN source_uri ELSE 'evidence://' || document_id || '/' || version_id END"
_WORDLESS = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3001}-\x{301F}]"
_RATIO = "CASE WHEN coverage.basis = 'whole-document' THEN 1.0 WHEN coverage.basis = 'html-prose' AND coverage.prose_chars > 0 THEN coverage.captured_chars / coverage.prose_chars END"


def _escaped(column: str) -> str:
    """The SQL form of a column safe in HTML."""
    return f"""replace(replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


ORACLE = {
    "classify_observations": f"WITH {_CLASSIFY} SELECT document_id, seq, outcome, raw_changed FROM r",
    "outcome_counts": f"WITH {_CLASSIFY} SELECT outcome, count(*) AS n, count(*) FILTER (raw_changed) AS raw_changed FROM r GROUP BY outcome",
    "folded_versions": f"""WITH {_CLASSIFY}, z AS (SELECT document_id, vkey, CAST(max(place) AS INTEGER) AS last_observed_seq, count(*) AS observations,
        arg_min(raw_hash, place) FILTER (raw_hash IS NOT NULL) AS raw_hash, arg_max(raw_hash, place) FILTER (raw_hash IS NOT NULL) AS last_observed_raw_hash FROM r GROUP BY 1, 2)
        SELECT *, last_observed_seq = max(last_observed_seq) OVER (PARTITION BY document_id) AS is_current FROM z""",
    "duplicate_bodies": f"WITH {_TWINS} SELECT text_hash, source, documents, held, first_document FROM twins",
    "merged_mirrors": f"""WITH {_TWINS}, m0 AS (SELECT document_id AS source_id, min(first_document) AS target_id FROM v JOIN twins USING (text_hash, source) WHERE twins.source = 'live' AND document_id <> first_document GROUP BY 1),
        m AS (SELECT * FROM m0 WHERE target_id NOT IN (SELECT source_id FROM m0)),
        moved AS (SELECT v.*, m.target_id IS NOT NULL AS is_source, coalesce(m.target_id, v.document_id) AS doc FROM v LEFT JOIN m ON m.source_id = v.document_id),
        kept AS (SELECT *, row_number() OVER (PARTITION BY doc, text_hash, source ORDER BY captured_at, is_source, version_id) AS k FROM moved)
        SELECT doc AS document_id, count(*) AS versions, CAST(count(*) AS INTEGER) AS last_seq FROM kept WHERE k = 1 OR text_hash IS NULL GROUP BY 1""",
    "verify_exact": """WITH a AS (SELECT DISTINCT anchor_id, document_id, exact, position_hint FROM anchors), b AS (SELECT DISTINCT version_id, content_blob AS body FROM versions),
        t AS (SELECT d.document_id, b.body FROM documents d JOIN b ON b.version_id = d.current_version),
        p AS (SELECT *, greatest(position_hint - 500, 0) AS low FROM a LEFT JOIN t USING (document_id)),
        q AS (SELECT *, CASE WHEN exact <> '' AND body IS NOT NULL THEN instr(substring(body, low + 1, 1000 + length(exact) - greatest(500 - position_hint, 0)), exact) END AS near,
            CASE WHEN exact <> '' AND body IS NOT NULL THEN instr(body, exact) END AS anywhere FROM p)
        SELECT anchor_id, CASE WHEN near > 0 THEN 'INTACT' WHEN anywhere > 0 THEN CASE WHEN position_hint IS NULL THEN 'INTACT' ELSE 'MOVED' END END AS state,
            CAST(CASE WHEN near > 0 THEN low + near - 1 WHEN anywhere > 0 THEN anywhere - 1 END AS INTEGER) AS found_offset FROM q""",
    "coverage_ratios": f"""WITH c AS (SELECT version_id, any_value(coverage) AS coverage FROM versions GROUP BY 1), r AS (SELECT version_id, {_RATIO} AS ratio FROM c)
        SELECT version_id, round(ratio, 6) AS ratio, CASE WHEN ratio IS NULL THEN 'coverage_unknown' WHEN ratio < 1.0 / 3 THEN 'low_coverage' ELSE '' END AS notes FROM r""",
    "dropped_blocks": """WITH c AS (SELECT version_id, any_value(coverage) AS coverage FROM versions GROUP BY 1), e AS (SELECT unnest(map_entries(coverage.dropped)) AS x FROM c)
        SELECT x.key AS structure, CAST(sum(x.value) AS BIGINT) AS blocks, count(*) AS versions FROM e GROUP BY 1""",
    "timemap_link": f"""WITH {_V}, m AS (SELECT v.*, original_url, current_version, row_number() OVER (PARTITION BY document_id ORDER BY captured_at, version_id) AS place,
            max(CAST(version_id = current_version AS INTEGER)) OVER (PARTITION BY document_id) AS pointed,
            first_value(version_id) OVER (PARTITION BY document_id ORDER BY last_observed_seq DESC NULLS LAST, version_id DESC) AS newest FROM v JOIN documents USING (document_id)),
        l AS (SELECT document_id, original_url, place, '<' || {_URI} || '>; rel="' || CASE WHEN place = 1 THEN 'first ' ELSE '' END
            || CASE WHEN version_id = CASE WHEN pointed = 1 THEN current_version ELSE newest END THEN 'last ' ELSE '' END || 'memento"; datetime="'
            || strftime(captured_at AT TIME ZONE 'UTC', '%a, %d %b %Y %H:%M:%S GMT') || '"' AS line FROM m)
        SELECT document_id, '<' || coalesce(any_value(original_url), '') || '>; rel="original",' || chr(10) || '<evidence://' || document_id || '/timemap>; rel="self"; type="application/link-format",' || chr(10)
            || string_agg(line, ',' || chr(10) ORDER BY place) AS timemap FROM l GROUP BY document_id""",
    "timemap_json": f"""WITH {_V}, m AS (SELECT document_id, original_url, row_number() OVER (PARTITION BY document_id ORDER BY captured_at, version_id) AS place,
            strftime(captured_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS stamp, {_URI} AS uri FROM v JOIN (SELECT document_id, original_url FROM documents) d USING (document_id))
        SELECT document_id, CAST(to_json({{'original_uri': any_value(original_url), 'mementos': {{'list': list({{'datetime': stamp, 'uri': uri}} ORDER BY place)}}}}) AS VARCHAR) AS timemap FROM m GROUP BY document_id""",
    "robust_links": rf"""WITH a AS (SELECT DISTINCT anchor_id, document_id, created_version, exact, cited_url FROM anchors), {_V},
        l AS (SELECT a.anchor_id, coalesce(nullif(cited_url, ''), original_url, '') AS href, strftime(captured_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, coalesce(exact, '') AS quote,
            CASE WHEN v.source = 'archive' AND source_uri IS NOT NULL THEN source_uri ELSE 'evidence://' || a.document_id || '/' || version_id END AS uri
            FROM a JOIN documents d ON d.document_id = a.document_id JOIN v ON v.version_id = a.created_version)
        SELECT anchor_id, '<a href="' || {_escaped("href")} || '" data-versionurl="' || {_escaped("uri")} || '" data-versiondate="' || day || '">' || {_escaped("quote")} || '</a>' AS html,
            '[' || regexp_replace(quote, '([\\\[\]*_`])', '\\\1', 'g') || '](' || href || ') ([archived](' || uri || '), ' || day || ')' AS markdown FROM l""",
    "canonical_urls_plain": r"""WITH u AS (SELECT document_id, regexp_replace(trim(original_url), '#.*$', '') AS u FROM documents),
        p AS (SELECT document_id, lower(regexp_extract(u, '(?i)^(https?)://', 1)) AS s, lower(regexp_extract(u, '(?i)^https?://([^/:?]+)', 1)) AS h, regexp_extract(u, '(?i)^https?://[^/:?]+(:[0-9]+)', 1) AS port,
            regexp_extract(u, '(?i)^https?://[^/?]+(/[^?]*)', 1) AS path, regexp_extract(u, '\?(.*)$', 1) AS q FROM u),
        k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND regexp_extract(x, '^([^=]*)', 1) NOT IN ('fbclid', 'gclid', 'dclid', 'msclkid', 'twclid', 'yclid', 'igshid', 'mc_eid'))) AS kept FROM p)
        SELECT document_id, CASE WHEN s <> '' AND h <> '' THEN s || '://' || h || CASE WHEN (s = 'http' AND port = ':80') OR (s = 'https' AND port = ':443') THEN '' ELSE port END
            || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END END AS canonical FROM k""",
    "script_density": rf"""SELECT document_id, round(CASE WHEN length(regexp_replace(text, '[ \t\n\x0b\f\r]', '', 'g')) > 0
        THEN len(regexp_extract_all(text, '{_WORDLESS}')) / length(regexp_replace(text, '[ \t\n\x0b\f\r]', '', 'g')) ELSE 0 END, 6) AS density FROM documents WHERE text <> ''""",
    "text_hashes": "WITH t AS (SELECT DISTINCT version_id, text_hash, content_blob FROM versions) SELECT sha256(content_blob) = text_hash AS agrees, count(*) AS versions FROM t GROUP BY 1",
}
