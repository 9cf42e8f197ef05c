"""Mixing sources to target token shares by nested hash thresholds.

Every row gets a 60-bit hash of its key. A histogram of tokens by source and
leading hash digit locates the digit at which a source's budget runs out; only
that boundary digit is refined by the next one, down to a single hash. A row is
then taken by comparing its hash with its source's threshold: nothing is sorted
and no row moves. The driver sees at most ``2**DIGIT_BITS`` sums per source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellichor.llm.bpe import DEFAULT_VOCABULARY, count_tokens
from vellichor.session import cut_lineage

HASH_BITS = 60
DIGIT_BITS = 10
MAX_TARGETS = 10_000


@dataclass
class SourcePlan:
    """What one source contributes: ``copies`` whole passes and the rows below ``threshold`` once more."""

    source: str
    target_share: float
    max_repeats: int
    available: int = 0
    wanted: float = 0.0
    copies: int = 0
    threshold: int = 0
    reached: int = 0


def row_hash(key: str) -> F.Column:
    """A uniform hash in [0, 2**60); rows of one key share it, so they are taken together."""
    return F.xxhash64(F.lit("mix"), F.col(key).cast("string")).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def _targets(targets: DataFrame) -> list[SourcePlan]:
    rows = targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"]).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    return [SourcePlan(r.source, max(0.0, r.target_share or 0.0), max(0, r.max_repeats if r.max_repeats is not None else 1)) for r in sorted(rows, key=lambda r: r.source or "") if r.source is not None]


def plan_mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, whole: bool = False) -> list[SourcePlan]:
    """Thresholds per source for rows ``(source, h, n_tokens)``.

    ``total_tokens`` is the size of the mix. By default it is the largest size at
    which every source that has tokens reaches its share within its repeats.
    With a larger given size a source that is too small gives all its repeats
    and falls short; the report shows it. ``whole`` takes all tokens of the target
    sources as the size.
    """
    plans = _targets(targets)
    sums = {r.source: r.n or 0 for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").collect()}
    for p in plans:
        p.available = int(sums.get(p.source, 0))
    if whole:
        total_tokens = sum(p.available for p in plans)
    if total_tokens is None:
        limits = [p.available * p.max_repeats / p.target_share for p in plans if p.available and p.target_share and p.max_repeats]
        total_tokens = min(limits, default=0.0)
    open_at: dict[str, tuple[int, float]] = {}
    for p in plans:
        p.wanted = p.target_share * total_tokens
        if not p.available:
            continue
        need = min(p.wanted, float(p.available * p.max_repeats))
        p.copies = min(p.max_repeats, int(need / p.available + 1e-9))
        p.reached = p.copies * p.available
        rest = need - p.reached
        if rest > 0.5 and p.copies < p.max_repeats:
            open_at[p.source] = (0, rest)
    by_source = {p.source: p for p in plans}
    for level in range(HASH_BITS // DIGIT_BITS):
        if not open_at:
            break
        shift = HASH_BITS - DIGIT_BITS * (level + 1)
        spark = sized.sparkSession
        edges = spark.createDataFrame([(source, prefix) for source, (prefix, _) in open_at.items()], "source string, prefix bigint")  # one row a target
        inside = sized.withColumn("prefix", F.shiftright("h", shift + DIGIT_BITS).cast("bigint")).join(F.broadcast(edges), ["source", "prefix"])
        digits: dict[str, dict[int, tuple[int, bool]]] = {}
        counted = inside.groupBy("source", F.shiftright("h", shift).alias("digit")).agg(F.sum("n_tokens").alias("n"), (F.min("h") != F.max("h")).alias("several"))
        for r in counted.collect():
            digits.setdefault(r.source, {})[r.digit] = (int(r.n or 0), r.several)
        still: dict[str, tuple[int, float]] = {}
        for source, (prefix, rest) in open_at.items():
            p = by_source[source]
            p.threshold = (prefix << DIGIT_BITS) << shift
            for digit in sorted(digits.get(source, {})):
                tokens, several = digits[source][digit]
                if tokens <= rest:
                    rest -= tokens
                    p.reached += tokens
                    p.threshold = (digit + 1) << shift
                    continue
                if shift and several:
                    p.threshold = digit << shift
                    still[source] = (digit, rest)
                elif tokens - rest < rest:  # the boundary is one key: take it when that ends nearer to the budget
                    p.reached += tokens
                    p.threshold = (digit + 1) << shift
                else:
                    p.threshold = digit << shift
                break
        open_at = still
    return plans


def size_rows(documents: DataFrame, key: str = "doc_id", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(source, h, n_tokens)`` of every row, cut from the texts so that they are encoded once."""
    slim = documents.select(F.col("source"), row_hash(key).alias("h"), F.col("text"))
    return cut_lineage(count_tokens(slim, vocabulary=vocabulary))


def apply_mix(documents: DataFrame, plans: list[SourcePlan], key: str = "doc_id") -> DataFrame:
    """``(key, source, copy_no, text)`` of the mix: a filter and an explode, without a shuffle.

    Rows of sources without a target are left out. ``copy_no`` counts from 0.
    Null and empty texts have no tokens and take part by their hash. Repeated
    rows of one key are taken together.
    """
    spark = documents.sparkSession
    schema = "mix_source string, mix_copies int, mix_threshold bigint"
    bounds = spark.createDataFrame([(p.source, p.copies, p.threshold) for p in plans], schema)
    h = row_hash(key)
    extra = F.when(h < F.col("mix_threshold"), 1).otherwise(0)
    slim = documents.select(key, "source", "text")
    mixed = slim.join(F.broadcast(bounds), slim.source == F.col("mix_source"))
    times = mixed.withColumn("mix_times", F.col("mix_copies") + extra).filter("mix_times > 0")
    return times.select(key, "source", F.explode(F.sequence(F.lit(0), F.col("mix_times") - 1)).alias("copy_no"), "text")


def mix_report(documents: DataFrame, plans: list[SourcePlan]) -> DataFrame:
    """One row per target: tokens available, wanted and reached, and the share of the mix that was reached."""
    total = sum(p.reached for p in plans)
    rows = [(p.source, p.target_share, p.max_repeats, p.available, float(p.wanted), p.copies, p.reached, p.reached / total if total else 0.0) for p in plans]
    schema = "source string, target_share double, max_repeats int, available_tokens bigint, wanted_tokens double, whole_copies int, reached_tokens bigint, reached_share double"
    return documents.sparkSession.createDataFrame(rows, schema)


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = DEFAULT_VOCABULARY, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mix and its report. Empty tables give an empty mix; sources without documents reach a share of 0."""
    plans = plan_mix(size_rows(documents, vocabulary=vocabulary), targets, total_tokens, whole)
    return apply_mix(documents, plans), mix_report(documents, plans)
