"""How much of a page was captured: ratios, notes and what was dropped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellichor.functions import html


def ratio(coverage: str = "coverage") -> Column:
    """1 for whole documents, captured over prose for measured pages, else null."""
    c = F.col(coverage)
    return F.when(c["basis"] == "whole-document", 1.0).when((c["basis"] == "html-prose") & (c["prose_chars"] > 0), c["captured_chars"] / c["prose_chars"])


def notes(coverage: str = "coverage", raw_changed: Column | None = None) -> Column:
    """What a reader should know about a capture."""
    r = ratio(coverage)
    low = F.when(r < 1 / 3, "low_coverage")
    drift = F.when((raw_changed if raw_changed is not None else F.lit(False)) & (r < 2 / 3), "unseen_change_possible")
    unknown = F.when(r.isNull(), "coverage_unknown")
    return F.array_compact(F.array(low, drift, unknown))


def dropped_blocks(versions: DataFrame) -> DataFrame:
    """Blocks dropped by structure over all versions."""
    return versions.select(F.explode("coverage.dropped").alias("structure", "n")).groupBy("structure").agg(F.sum("n").alias("blocks"), F.count("*").alias("versions"))


def encode_dropped(column: str) -> Column:
    """``aside:13 p:1``, most first; null stays unknown, an empty map becomes an empty text."""
    pairs = F.array_sort(F.transform(F.map_entries(column), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("name"))))
    return F.when(F.col(column).isNotNull(), F.array_join(F.transform(pairs, lambda e: F.concat(e["name"], F.lit(":"), (-e["k"]).cast("string"))), " "))


def decode_dropped(column: str) -> Column:
    entries = F.transform(F.filter(F.split(column, " "), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("key"), F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("value")))
    return F.when(F.col(column).isNotNull(), F.map_from_entries(entries))


_EXTRACTED = T.StructType([T.StructField(n, T.IntegerType() if n.endswith("chars") else T.StringType()) for n in ("title", "body", "basis", "prose_chars", "captured_chars", "dropped")])


@F.pandas_udf(_EXTRACTED)
def extract(pages: pd.Series) -> pd.DataFrame:
    """Title, body and coverage of HTML pages; ``dropped`` encoded as text."""
    rows = []
    for page in pages:
        title, body = html.to_markdown(page)
        m = html.measure(page, body)
        order = sorted(m["dropped"].items(), key=lambda kv: (-kv[1], kv[0]))
        rows.append((title, body, m["basis"], m["prose_chars"], m["captured_chars"], " ".join(f"{k}:{v}" for k, v in order)))
    out = pd.DataFrame(rows, columns=["title", "body", "basis", "prose_chars", "captured_chars", "dropped"])
    return out.astype({"prose_chars": "Int32", "captured_chars": "Int32"})
