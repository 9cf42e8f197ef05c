"""Verification of quotes against current texts: exact stages natively, the rest through one Arrow kernel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellichor.functions import matching
from vellichor.operators.inventory import STATES
from vellichor.session import spread

VERDICT = "anchor_id string, state string, match_score double, edit_distance int, found_offset int, found_text string, truncated boolean"


#: Quotes that travel with one copy of their text.
QUOTES_A_TEXT = 256


def beside_texts(rows: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Rows with ``document_id`` beside the texts of their documents, ``texts`` being ``(document_id, ..., body)``.

    A document's rows are parted by the hash of ``key``, about ``QUOTES_A_TEXT`` to a
    part, and a text is sent once to each part that needs it: neither a document with
    most of the rows nor its text, copied for each of them, ends in one task.
    """
    parts = rows.groupBy("document_id").agg(F.ceil(F.count("*") / QUOTES_A_TEXT).cast("int").alias("parts_"))
    wanted = texts.join(parts, "document_id").withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1))).drop("parts_")
    own = rows.join(parts, "document_id").withColumn("part_", F.pmod(F.xxhash64(key), F.col("parts_")).cast("int")).drop("parts_")
    return spread(own, "document_id", "part_").join(spread(wanted, "document_id", "part_").hint("merge"), ["document_id", "part_"], "left").drop("part_")


def with_texts(anchors: DataFrame, texts: DataFrame) -> DataFrame:
    """Anchors beside the text of their document; ``texts`` is ``(document_id, version_id, body)``. Pairs meet by key, never by content."""
    return beside_texts(anchors.select("anchor_id", "document_id", "exact", "prefix", "suffix", "position_hint"), texts, "anchor_id")


def exact_stages(pairs: DataFrame) -> DataFrame:
    """``state`` INTACT within the hint's radius, MOVED elsewhere, null when the quote doesn't stand as written; ``found_offset`` from 0."""
    radius = matching.HINT_RADIUS
    low = F.greatest(F.col("position_hint") - radius, F.lit(0))
    near = F.instr(F.substring(F.col("body"), low + 1, F.lit(2 * radius) + F.length("exact") - F.greatest(radius - F.col("position_hint"), F.lit(0))), F.col("exact"))
    anywhere = F.instr("body", F.col("exact"))
    usable = (F.col("exact") != "") & F.col("body").isNotNull()
    state = F.when(usable & (near > 0), "INTACT").when(usable & (anywhere > 0), F.when(F.col("position_hint").isNull(), "INTACT").otherwise("MOVED"))
    offset = F.when(usable & (near > 0), low + near - 1).when(usable & (anywhere > 0), anywhere - 1)
    return pairs.withColumns({"state": state, "found_offset": offset.cast("int")})


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            hint = None if pd.isna(r.position_hint) else int(r.position_hint)
            v = matching.judge(r.body, r.exact or "", r.prefix or "", r.suffix or "", hint)
            rows.append((r.anchor_id, v.state, v.score, v.distance, v.offset, v.found, v.truncated))
        out = pd.DataFrame(rows, columns=["anchor_id", "state", "match_score", "edit_distance", "found_offset", "found_text", "truncated"])
        yield out.astype({"match_score": "float64", "edit_distance": "Int32", "found_offset": "Int32"})


def verify(anchors: DataFrame, texts: DataFrame) -> DataFrame:
    """A verdict per anchor. Only quotes that don't stand as written enter the kernel, where their texts lie."""
    staged = exact_stages(with_texts(anchors, texts))
    done = staged.filter("state is not null").select(
        "anchor_id", "state", F.lit(1.0).alias("match_score"), F.lit(0).alias("edit_distance"), "found_offset", F.col("exact").alias("found_text"), F.lit(False).alias("truncated")
    )
    open_ = staged.filter("state is null").select("anchor_id", "exact", "prefix", "suffix", "position_hint", "body")
    return done.unionByName(open_.mapInPandas(_judge, VERDICT))


def report(verdicts: DataFrame) -> DataFrame:
    """One row: anchors checked and the count of each of the seven states."""
    return verdicts.agg(F.count("*").alias("checked"), *[F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES])


def attention(verdicts: DataFrame) -> DataFrame:
    """Verdicts someone should look at."""
    return verdicts.filter(F.col("state").isin("ALTERED", "MISSING", "UNRESOLVED", "GONE", "UNREACHABLE"))


def failure_state(status: str = "http_status", outcome: str = "outcome"):
    """The state of an anchor whose page couldn't be fetched: gone for 404 and 410, else unreachable."""
    return F.when(F.col(status).isin(404, 410), "GONE").when(F.col(outcome) == "error", "UNREACHABLE")
