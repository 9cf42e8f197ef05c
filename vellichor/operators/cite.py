"""Binding quotes to texts: search form, selectors with context, and their gates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellichor.functions.text import WORDLESS, normalize, wordless_share
from vellichor.operators.verify import beside_texts

CONTEXT = 48
LEAST_CHARS = 12
SHORT_CHARS = 32
COUNT_LIMIT = 8

_MARK = re.compile(r"\s*(?:#{1,6}\s+|>\s?|[-*+•]\s+|\d{1,2}[.)]\s+)")
_WORDLESS = re.compile(f"[{WORDLESS}]")

SELECTOR = "quote_id string, document_id string, exact string, prefix string, suffix string, position_hint int, quality string, occurrences int, error string"


def search_form(text: str) -> tuple[str, list[int]]:
    """The text with runs of white space as one space, line marks skipped and no space between wordless letters, and the origin of each character."""
    chars: list[str] = []
    origin: list[int] = []
    i, line_start = 0, True
    while i < len(text):
        if line_start:
            while m := _MARK.match(text, i):
                if m.end() == i:
                    break
                i = m.end()
            line_start = False
            continue
        ch = text[i]
        if ch.isspace():
            line_start = ch == "\n"
            if chars and chars[-1] != " ":
                chars.append(" ")
                origin.append(i)
        else:
            if len(chars) > 1 and chars[-1] == " " and _WORDLESS.match(ch) and _WORDLESS.match(chars[-2]):
                chars.pop()
                origin.pop()
            chars.append(ch)
            origin.append(i)
        i += 1
    if chars and chars[-1] == " ":
        chars.pop()
        origin.pop()
    return "".join(chars), origin


def occurrences(form: str, quote: str, limit: int = COUNT_LIMIT) -> int:
    """Overlapping occurrences, counted up to ``limit``."""
    n, at = 0, form.find(quote)
    while at >= 0 and n < limit:
        n, at = n + 1, form.find(quote, at + 1)
    return n


def scaled(limit: int, text: str) -> int:
    """A length gate, smaller where a character says more."""
    return max(4, round(limit / 2.5)) if wordless_share(text) >= 0.5 else limit


def select(text: str | None, quote: str | None, form: tuple[str, list[int]] | None = None) -> dict:
    """Selector fields, or ``error`` (``too_short``, ``not_found``); never raises."""
    blank = dict.fromkeys(("exact", "prefix", "suffix", "position_hint", "quality", "occurrences", "error"))
    needle, _ = search_form(normalize(quote or ""))
    if len(needle) < scaled(LEAST_CHARS, needle):
        return blank | {"error": "too_short"}
    if text is None:
        return blank | {"error": "not_found"}
    hay, origin = form or search_form(text)
    at = hay.find(needle)
    if at < 0:
        return blank | {"error": "not_found"}
    a, b = origin[at], origin[at + len(needle) - 1] + 1
    quality = "short" if len(needle) < scaled(SHORT_CHARS, needle) else "ok"
    return blank | {"exact": text[a:b], "prefix": text[max(0, a - CONTEXT) : a], "suffix": text[b : b + CONTEXT], "position_hint": a, "quality": quality, "occurrences": occurrences(hay, needle)}


def _bind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: tuple[str, tuple[str, list[int]]] | None = None
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            if r.body is not None and (known is None or known[0] != r.body):
                known = (r.body, search_form(r.body))
            s = select(r.body, r.quote, known[1] if r.body is not None else None)
            rows.append((r.quote_id, r.document_id, *(s[k] for k in ("exact", "prefix", "suffix", "position_hint", "quality", "occurrences", "error"))))
        out = pd.DataFrame(rows, columns=["quote_id", "document_id", "exact", "prefix", "suffix", "position_hint", "quality", "occurrences", "error"])
        yield out.astype({"position_hint": "Int32", "occurrences": "Int32"})


def cite(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Selectors of ``quotes (quote_id, document_id, quote)`` in ``texts (document_id, body)``; rejected quotes carry ``error``."""
    pairs = beside_texts(quotes.select(F.col("quote_id").cast("string").alias("quote_id"), "document_id", "quote"), texts.select("document_id", "body"), "quote_id")
    # the join leaves quotes of one document one behind the other, so that a task reduces its text once
    return pairs.select("quote_id", "document_id", "quote", "body").mapInPandas(_bind, SELECTOR)


def warnings(selectors: DataFrame) -> DataFrame:
    """Selectors with what a reader should know: short, repeated."""
    notes = F.array_compact(F.array(F.when(F.col("quality") == "short", "short"), F.when(F.col("occurrences") >= 2, "repeated"), F.when(F.col("occurrences") >= COUNT_LIMIT, "count_capped")))
    return selectors.withColumn("warnings", notes)
