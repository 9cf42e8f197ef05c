"""Payloads of web archive indexes as rows: CDX tables and Memento aggregator answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_cdx(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``(key, captured_at, original)`` of the newest capture with status 200 in a CDX JSON table.

    The first inner array names the columns. Captures need a 14-digit timestamp;
    payloads without the needed columns, without such a row, or null give no row.
    """
    rows = df.select(key, F.posexplode(F.from_json(payload, "array<array<string>>")).alias("at", "cells"))
    heads = rows.filter("at = 0").select(key, F.col("cells").alias("head"))
    cells = rows.filter("at > 0").join(heads, key)
    named = cells.withColumn("cell", F.map_from_arrays("head", F.slice("cells", 1, F.size("head")))).filter(F.size("cells") >= F.size("head"))
    good = named.filter((F.col("cell")["statuscode"] == "200") & F.col("cell")["timestamp"].rlike("^[0-9]{14}$"))
    stamp = F.try_to_timestamp(F.col("cell")["timestamp"], F.lit("yyyyMMddHHmmss"))
    parsed = good.select(key, stamp.alias("captured_at"), F.col("cell")["original"].alias("original"), "at").filter("captured_at is not null")
    best = parsed.groupBy(key).agg(F.max_by(F.struct("captured_at", "original"), F.struct("captured_at", "at")).alias("best"))
    return best.select(key, "best.captured_at", "best.original")


def last_memento(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``(key, uri, captured_at)`` of the last memento in an aggregator's JSON answer; answers without one give no row."""
    shape = "struct<mementos:struct<list:array<struct<datetime:string,uri:string>>>>"
    found = df.select(key, F.try_element_at(F.from_json(payload, shape)["mementos"]["list"], F.lit(-1)).alias("m"))
    return found.filter("m.uri is not null").select(key, F.col("m.uri").alias("uri"), F.to_timestamp("m.datetime").alias("captured_at"))
