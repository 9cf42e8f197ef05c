"""Exports as text columns: time maps, robust links and unified diffs."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.functions.text import http_date
from vellichor.session import spread


def memento_uri(document: str = "document_id", version: str = "version_id") -> Column:
    """The archive's address of an archive version, else a local one."""
    return F.when((F.col("source") == "archive") & F.col("source_uri").isNotNull(), F.col("source_uri")).otherwise(F.concat(F.lit("evidence://"), F.col(document), F.lit("/"), F.col(version)))


def _mementos(documents: DataFrame, versions: DataFrame) -> DataFrame:
    order = Window.partitionBy("document_id").orderBy("captured_at", "version_id")
    whole = Window.partitionBy("document_id")
    rows = versions.select("document_id", "version_id", "captured_at", "source", "source_uri", "last_observed_seq").join(documents.select("document_id", "original_url", "current_version"), "document_id")
    newest = F.max(F.struct("last_observed_seq", "version_id")).over(whole)["version_id"]
    has_pointer = F.max((F.col("version_id") == F.col("current_version")).cast("int")).over(whole) == 1
    last = F.when(has_pointer, F.col("version_id") == F.col("current_version")).otherwise(F.col("version_id") == newest)
    return rows.withColumns({"place": F.row_number().over(order), "is_last": F.coalesce(last, F.lit(False)), "uri": memento_uri()})


def timemap_link(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """``(document_id, timemap)`` in link format: the original, the map itself, and mementos by capture."""
    rows = _mementos(documents, versions)
    rel = F.concat(F.when(F.col("place") == 1, "first ").otherwise(""), F.when(F.col("is_last"), "last ").otherwise(""), F.lit("memento"))
    line = F.concat(F.lit("<"), "uri", F.lit('>; rel="'), rel, F.lit('"; datetime="'), http_date("captured_at"), F.lit('"'))
    lines = rows.withColumn("line", line).groupBy("document_id", "original_url").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("x"))
    body = F.array_join(F.transform("x", lambda e: e["line"]), ",\n")
    head = F.concat(F.lit("<"), F.coalesce("original_url", F.lit("")), F.lit('>; rel="original",\n<evidence://'), "document_id", F.lit('/timemap>; rel="self"; type="application/link-format",\n'))
    return lines.select("document_id", F.concat(head, body).alias("timemap"))


def timemap_json(documents: DataFrame, versions: DataFrame) -> DataFrame:
    rows = _mementos(documents, versions)
    stamp = F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lists = rows.groupBy("document_id", "original_url").agg(F.array_sort(F.collect_list(F.struct("place", stamp.alias("datetime"), F.col("uri")))).alias("x"))
    listed = F.transform("x", lambda e: F.struct(e["datetime"].alias("datetime"), e["uri"].alias("uri")))
    return lists.select("document_id", F.to_json(F.struct(F.col("original_url").alias("original_uri"), F.struct(listed.alias("list")).alias("mementos"))).alias("timemap"))


def _html(column: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        column = F.replace(column, F.lit(plain), F.lit(safe))
    return column


def robust_links(anchors: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """``(anchor_id, html, markdown)``: the quote linked to what was cited, with its version's address and date."""
    rows = anchors.select("anchor_id", "document_id", F.col("created_version").alias("version_id"), "exact", "cited_url")
    rows = rows.join(documents.select("document_id", "original_url"), "document_id").join(versions.select("version_id", "captured_at", "source", "source_uri"), "version_id")
    href = F.coalesce(F.nullif("cited_url", F.lit("")), "original_url", F.lit(""))
    day, uri, quote = F.date_format("captured_at", "yyyy-MM-dd"), memento_uri(), F.coalesce("exact", F.lit(""))
    html = F.concat(F.lit('<a href="'), _html(href), F.lit('" data-versionurl="'), _html(uri), F.lit('" data-versiondate="'), day, F.lit('">'), _html(quote), F.lit("</a>"))
    label = F.regexp_replace(quote, r"([\\\[\]*_`])", r"\\$1")
    markdown = F.concat(F.lit("["), label, F.lit("]("), href, F.lit(") ("), F.lit("[archived]("), uri, F.lit("), "), day, F.lit(")"))
    return rows.select("anchor_id", html.alias("html"), markdown.alias("markdown"))


def bibtex_notes(anchors: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """``(anchor_id, note)``: a note field that names what was cited, its archived address and its day; signs that TeX reads are escaped once."""
    rows = anchors.select("anchor_id", "document_id", F.col("created_version").alias("version_id"), "cited_url")
    rows = rows.join(documents.select("document_id", "original_url"), "document_id").join(versions.select("version_id", "captured_at", "source", "source_uri"), "version_id")
    href = F.coalesce(F.nullif("cited_url", F.lit("")), "original_url", F.lit(""))
    escaped = lambda c: F.regexp_replace(c, r"([%#&_{}$])", r"\\$1")
    note = F.concat(F.lit("note = {\\url{"), escaped(href), F.lit("}, archived at \\url{"), escaped(memento_uri()), F.lit("} on "), F.date_format("captured_at", "yyyy-MM-dd"), F.lit("}"))
    return rows.select("anchor_id", note.alias("note"))


def unified_diff(old: str | None, new: str | None, old_name: str, new_name: str, context: int = 3) -> str:
    """A unified diff that notes a missing newline at either end."""
    if context < 0:
        raise ValueError("context lines can't be negative")
    a, b = (old or "").splitlines(keepends=True), (new or "").splitlines(keepends=True)
    out = []
    for line in difflib.unified_diff(a, b, old_name, new_name, n=context):
        out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
    return "".join(out)


def version_diffs(pairs: DataFrame, context: int = 3) -> DataFrame:
    """``(old_id, new_id, diff)`` of ``pairs (old_id, new_id, old_body, new_body)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p = p.assign(diff=[unified_diff(o, n, i, j, context) for o, n, i, j in zip(p.old_body, p.new_body, p.old_id, p.new_id)])
            yield p[["old_id", "new_id", "diff"]]

    return spread(pairs.select("old_id", "new_id", "old_body", "new_body"), "new_id").mapInPandas(run, "old_id string, new_id string, diff string")


def consecutive(versions: DataFrame) -> DataFrame:
    """Each version beside the one observed before it in its document; the windows see ids, bodies join by id."""
    w = Window.partitionBy("document_id").orderBy("last_observed_seq", "version_id")
    pairs = versions.select("document_id", F.lag("version_id").over(w).alias("old_id"), F.col("version_id").alias("new_id")).filter("old_id is not null")
    bodies = versions.select("version_id", "content_blob")
    pairs = pairs.join(bodies.withColumnsRenamed({"version_id": "old_id", "content_blob": "old_body"}), "old_id")
    return pairs.join(bodies.withColumnsRenamed({"version_id": "new_id", "content_blob": "new_body"}), "new_id").select("document_id", "old_id", "new_id", "old_body", "new_body")
