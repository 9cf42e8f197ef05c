"""Folds over a key's requests in time order: cache decisions and rate limits.

Each decision depends on the ones before it, so no window frame expresses it. A
key's rows are sorted by the shuffle and folded as they stream by; a hot key
passes through one task in constant memory, its rows are never held together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(df: DataFrame, key: str, time: str, seq: str, step: Callable[[dict, float], tuple[dict, object]], start: Callable[[], dict], out: str, kind: str) -> DataFrame:
    """``(key, seq, out)``: the result of ``step(state, seconds)`` over each key's rows by time and sequence; rows without a key or time drop out."""
    slim = df.select(F.col(key).alias("k"), F.col(seq).alias("s"), F.unix_micros(time).alias("t")).filter("k is not null and t is not null")
    ordered = slim.repartition("k").sortWithinPartitions("k", "t", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start()
        for batch in batches:
            results = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != last:
                    last, state = k, start()
                state, value = step(state, t / 1e6)
                results.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(results)], ["k", "s", out])

    key_type, seq_type = df.schema[key].dataType.simpleString(), df.schema[seq].dataType.simpleString()
    return ordered.mapInArrow(run, f"k {key_type}, s {seq_type}, {out} {kind}").withColumnsRenamed({"k": key, "s": seq})


def cache_hits(log: DataFrame, max_age_seconds: float = 3600.0) -> DataFrame:
    """Whether a request would be served from cache: the last check over the network is at most ``max_age_seconds`` old."""

    def step(state: dict, now: float) -> tuple[dict, bool]:
        hit = max_age_seconds > 0 and state["checked"] is not None and now - state["checked"] <= max_age_seconds
        return (state if hit else {"checked": now}), hit

    return fold(log, "document_id", "requested_at", "seq", step, lambda: {"checked": None}, "would_hit", "boolean")


def rate_violations(log: DataFrame, key: str = "document_id", rate: float = 1.0, burst: float = 3.0) -> DataFrame:
    """Whether a request comes sooner than a token bucket allows."""

    def step(state: dict, now: float) -> tuple[dict, bool]:
        tokens = burst if state["at"] is None else min(burst, state["tokens"] + max(0.0, now - state["at"]) * rate)
        over = tokens < 1.0
        return {"tokens": tokens if over else tokens - 1.0, "at": now}, over

    return fold(log, key, "requested_at", "seq", step, lambda: {"tokens": burst, "at": None}, "over_limit", "boolean")


def robots_valid(robots: DataFrame, as_of) -> DataFrame:
    """Cached robots files still valid at a moment: a day, five minutes for server errors."""
    ttl = F.when(F.col("fetch_status") >= 500, F.expr("INTERVAL 300 SECONDS")).otherwise(F.expr("INTERVAL 24 HOURS"))
    return robots.withColumn("valid", F.col("fetched_at") >= as_of - ttl)
