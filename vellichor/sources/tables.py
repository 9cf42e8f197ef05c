"""The evidence tables: schemas, and readers that count each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellichor.session import read_table

#: Columns that identify a row of each table; rows written again are equal in all columns.
KEYS = {
    "documents": ["document_id"],
    "versions": ["version_id"],
    "anchors": ["anchor_id"],
    "verifications": ["verification_seq"],
    "fetch_log": ["seq"],
    "aliases": ["url"],
    "robots": ["origin"],
}

SCHEMAS = {
    "documents": "document_id string, url string, original_url string, title string, first_seen_at timestamp, last_checked_at timestamp, status string, etag string, last_modified string, robots_allowed boolean, current_version string",
    "versions": "version_id string, document_id string, text_hash string, raw_hash string, last_observed_raw_hash string, pipeline_version string, captured_at timestamp, last_observed_at timestamp, last_observed_seq bigint, byte_size bigint, char_count int, content_blob string, http_status int, source string, source_uri string, coverage struct<basis:string,prose_chars:int,captured_chars:int,dropped:map<string,int>>",
    "anchors": "anchor_id string, document_id string, created_version string, exact string, prefix string, suffix string, position_hint int, exact_hash string, quality string, note string, created_at timestamp, occurrences int, cited_url string",
    "verifications": "verification_seq bigint, anchor_id string, checked_version string, checked_at timestamp, state string, match_score double, edit_distance int, found_offset int, found_text string, elapsed_ms int",
    "fetch_log": "seq bigint, document_id string, url string, requested_at timestamp, outcome string, error_kind string, http_status int, bytes_down bigint, elapsed_ms int",
    "aliases": "url string, document_id string",
    "robots": "origin string, body string, fetch_status int, fetched_at timestamp",
}


def load(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table with each key once, narrowed to ``columns`` before the rows meet, so that wide texts don't travel."""
    df = read_table(spark, folder, name)
    keys = KEYS[name]
    if columns:
        df = df.select(*dict.fromkeys([*keys, *columns]))
    return df.dropDuplicates(keys)


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A table without rows, in its declared schema."""
    return spark.createDataFrame([], SCHEMAS[name])


def append(df: DataFrame, folder: str, name: str, parents: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Append rows whose references exist; returns the rows that were refused.

    ``parents`` maps a column to the table and column it must occur in.
    """
    good, refused = df, None
    for column, (parent, key) in (parents or {}).items():
        known = parent.select(parent[key].alias(column)).distinct()
        bad = good.join(known, column, "left_anti")
        refused = bad if refused is None else refused.unionByName(bad)
        good = good.join(known, column, "left_semi")
    good.write.mode("append").parquet(f"{folder}/{name}.parquet")
    return refused if refused is not None else df.limit(0)


def upsert_first(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Insert-or-keep: rows of ``existing`` stay, of ``incoming`` the first per key in ``order`` joins when the key is new."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    fresh = incoming.withColumn("rank_", rank).filter("rank_ = 1").drop("rank_").join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh)
