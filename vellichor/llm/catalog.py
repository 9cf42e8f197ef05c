"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellichor.llm import boilerplate, bpe, canonical, encoding, mixing, neardup, pii, residue
from vellichor.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.furniture(read_table(spark, folder, "versions"))


def p1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.main_text(read_table(spark, folder, "versions")).dropDuplicates(["version_id"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.disguised_quotes(read_table(spark, folder, "anchors"), read_table(spark, folder, "versions"))


def p2_anchor_forms(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.canonical_columns(read_table(spark, folder, "anchors"), ["anchor_id"], ["exact"]).distinct()


def p2_version_forms(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.canonical_columns(read_table(spark, folder, "versions"), ["version_id"], ["content_blob"]).dropDuplicates(["version_id"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.garbled_records(read_table(spark, folder, "documents"), read_table(spark, folder, "versions"))


def p3_regained(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.regained_records(read_table(spark, folder, "documents"), read_table(spark, folder, "versions"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_versions(read_table(spark, folder, "versions"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, folder, "versions"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_members(read_table(spark, folder, "versions"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_texts(read_table(spark, folder, "documents"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"), whole=True)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"), whole=True)[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal(read_table(spark, folder, "documents"))


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redact_texts(read_table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_main_text, p2_found, p2_anchor_forms, p2_version_forms, p3_found, p3_regained, p4_found, p5_found, p5_classes, p6_ids, p7_mix, p7_shares, p8_found, p8_redacted)}


def oracle_sql() -> dict[str, str]:
    form = canonical.canonical_sql
    return {
        "p2_found": f"""
            WITH bodies AS (SELECT DISTINCT version_id, content_blob FROM versions WHERE content_blob <> ''),
                 quotes AS (SELECT DISTINCT anchor_id, created_version, exact FROM anchors WHERE exact <> ''),
                 apart AS (SELECT * FROM quotes JOIN bodies ON created_version = version_id WHERE NOT contains(content_blob, exact))
            SELECT DISTINCT anchor_id, created_version FROM apart WHERE {form("exact")} <> '' AND contains({form("content_blob")}, {form("exact")})""",
        "p2_anchor_forms": f"SELECT DISTINCT anchor_id, {form('exact')} AS exact FROM anchors",
        "p2_version_forms": f"SELECT DISTINCT version_id, {form('content_blob')} AS content_blob FROM versions",
    }
