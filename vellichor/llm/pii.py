"""Personal data in free text: found by the character tagger, settled by exact forms, replaced by typed placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellichor.llm import pii_rules, tagger

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}
#: Mean lead over 'O' from which a name is one without a telling phrase beside it.
SURE = 1.0
#: Rows read and characters tagged at a time.
ROWS = 1024
HELD_CHARS = 1_500_000
_TITLE = re.compile(r"^(?:Dr|Prof|Mr|Mrs|Ms|Frau|Herr|Mme|Contact|Kontakt|Dear|Invoice)\b[.:]? ?(?=\S+[ ,])|^M\. (?=\S+,? \S)")
_TITLED = re.compile(r"(?:Dr|Prof|Mr|Mrs|Ms|Frau|Herr|Mme|pani|pan|señora?|доктор)\.? $")
_MARKED = re.compile(r"[A-Za-zÀ-ɏЀ-ӿ]")
_EAST = re.compile(r"[가-힣一-鿿぀-ヿ]")
#: What stands before or after a name in East Asian text.
_EAST_BEFORE = re.compile(r"(?:담당자?|担当[者はの]?|係の|联系人?|由|致|寄给|받는 사람:?)\s?$")
_EAST_AFTER = re.compile(r"\s?(?:씨|님|앞|さん|様|氏|先生|女士|签字|老师|\(ID)")
_LONE = re.compile(r"(?<![\w.])[^\W\d_](?![\w.’'-])")

Span = tuple[int, int, str]


@lru_cache(maxsize=1)
def _model() -> tagger.Tagger:
    return tagger.Tagger.load()


_CAP = r"[A-ZÀ-ÖØ-ÞЀ-Я]"
#: Signs without which no text can hold what the exact check lets pass: of five digits or more, of two parts of a name, of letters without known forms, and of an address that begins with a number.
_SIGNS = [
    re.compile(r"\+\d|\d(?:[\s().+/（）-]{0,3}[\dA-D]){4}"),
    re.compile(rf"{_CAP}[\w’'ʼ-]*\.?,? (?:(?:van|von|de|del|da|di|der|den|du|la|le|ten|bin|al) )*{_CAP}"),
    re.compile(r"[^\W\d_A-Za-zÀ-ɏЀ-ӿ가-힣一-鿿぀-ヿ]"),
    re.compile(r"\d[A-Za-z]? [A-ZÀ-ÞЀ-Я]"),
]
#: Further signs, sought only where a text has one of the words they need: of mail, and of other addresses.
_WORDED = [
    (("@", "＠", "(at", "[at", "{at", "dot"), re.compile(r"[@＠]|[(\[{]at[)\]}]|\bdot\b|[\[(]dot")),
    (
        ("straße", "strasse", "str.", "weg ", "gasse", "platz", "allee", "ufer ", "damm ", "Am ", "An der ", "Auf der ", "Im ", "Zum ", "Zur "),
        re.compile(r"(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|damm) \d|\b(?:Am|An der|Auf der|Im|Zum|Zur) [A-ZÀ-ÞЀ-Я]"),
    ),
    (
        ("rue", "chemin", "quai", "avenue", "place", "allée", "boulevard", "impasse", "cours", "route"),
        re.compile(r"\d(?: (?:bis|ter))?,? (?:rue|chemin|quai|avenue|place|allée|boulevard|impasse|cours|route)\b"),
    ),
    (("Box", "calle", "Calle", "venida", "laza", "ul. ", "al. ", "pl. ", "ул.", "пр.", "пер."), re.compile(r"P\. ?O\. ?Box|[Cc]alle |[Aa]venida |[Pp]laza |\b(?:ul|al|pl)\. |(?:ул|пр|пер)\.")),
]
_EAST_SIGN = re.compile(r"씨|님|앞|さん|様|氏|先生|女士|签字|老师|담당|担当|係の|联系|由|致|寄给|받는 사람|[가-힣一-鿿぀-ヿ]\s?\(ID|[로길동] ?\d|\d-\d{1,3}-\d|[路街巷道弄]\d")


def signs(text: str) -> list[tuple[int, int]]:
    """Where a text may hold a mention, by signs that every mention that passes the exact check has."""
    found = [m.span() for sign in _SIGNS for m in sign.finditer(text)]
    for words, sign in _WORDED:
        if any(w in text for w in words):
            found += [m.span() for m in sign.finditer(text)]
    if _EAST.search(text):
        found += [m.span() for m in _EAST_SIGN.finditer(text)]
    return sorted(found)


def _whole_name(text: str, a: int, b: int, lead: float, named: list[Span]) -> tuple[int, int] | None:
    """The name a tagged run is, or none: the exact check of names.

    A telling phrase around it gives its ends. Else it must have at least two parts
    with capitals, as names have in text that marks them, and be tagged surely or
    stand behind a title; in East Asian text a word for persons must stand beside it.
    """
    around = [(x, y) for x, y, _ in named if x < b and y > a]
    if around:
        x, y = max(around, key=lambda s: min(s[1], b) - max(s[0], a))
        if m := _TITLE.match(text[x:y]):
            x += m.end()
        return x, y
    while a < b and not text[a].isalnum():
        a += 1
    while a < b and not (text[b - 1].isalnum() or text[b - 1] == "." and re.search(r"\b\w\.$", text[a:b])):
        b -= 1
    if m := _TITLE.match(text[a:b]):
        a += m.end()
    part = text[a:b]
    if _EAST.search(part):
        return (a, b) if len(part) > 1 and (_EAST_BEFORE.search(text, max(0, a - 8), a) or _EAST_AFTER.match(text, b)) else None
    if not _MARKED.search(part):  # a script of which no forms are known here
        return (a, b) if len(part.split()) > 1 else None
    if not pii_rules.LATIN_NAME.fullmatch(part) or _LONE.search(part):
        return None
    return (a, b) if lead >= SURE or _TITLED.search(text[max(0, a - 9) : a]) else None


def settle(text: str, tagged: list[tuple[int, int, str, float]]) -> list[Span]:
    """The exact check: each tagged run becomes the whole mention it lies in, or is no mention.

    Forms are sought in the paragraph around a run, whatever its length, and give a
    mention's ends and type; a run of digits that the tagger calls a phone or an
    identity number needs no listed form. Runs that hold a part of a mention merge into it.
    """
    out: dict[Span, None] = {}
    seen: dict[int, tuple[list[Span], list[Span]]] = {}
    for a, b, kind, lead in tagged:
        before = text.rfind("\n\n", 0, a)
        left = before + 2 if before >= 0 else 0
        if left not in seen:
            end = text.find("\n\n", b)
            part = text[left : end if end >= 0 else len(text)]
            seen[left] = [(x + left, y + left, k) for x, y, k in pii_rules.forms(part)], [(x + left, y + left, k) for x, y, k in pii_rules.named(part)]
        forms, named = seen[left]
        hits = [h for h in forms if h[0] < b and h[1] > a]
        if hits and (kind != "person" or any(y - x >= (b - a) / 2 for x, y, _ in hits)):
            out.update(dict.fromkeys(hits))
        elif kind == "person":
            if name := _whole_name(text, a, b, lead, named):
                out[(*name, "person")] = None
        elif kind in ("phone", "id_number") and lead >= SURE and pii_rules.NUMBER[kind].fullmatch(text, a, b) and sum(map(str.isdigit, text[a:b])) >= pii_rules.LEAST_DIGITS:
            out[(a, b, kind)] = None
    kept: list[Span] = []
    for span in sorted(out, key=lambda s: (s[2] == "person", s[0] - s[1], s)):
        if span[2] == "person":  # an initial may be the end of a number before it
            start = max([y for x, y, _ in kept if x <= span[0] < y], default=span[0])
            span = (start + len(text[start : span[1]]) - len(text[start : span[1]].lstrip(" .,;:")), *span[1:])
        if span[0] < span[1] and all(span[1] <= x or span[0] >= y for x, y, _ in kept):
            kept.append(span)
    return sorted(kept)


def find_in_texts(texts: list[str | None], model: tagger.Tagger | None = None) -> list[list[Span]]:
    """Mentions of each text, by position; null and empty texts have none."""
    model = model or _model()
    out: list[list[Span]] = [[] for _ in texts]
    some: list[int] = []
    held = 0
    for i, text in enumerate([*texts, None]):
        if some and (i == len(texts) or held + len(text or "") > HELD_CHARS):  # texts of bounded size are tagged together
            marks = [signs(texts[j]) for j in some]
            marked = [k for k, m in enumerate(marks) if m]
            for k, tagged in zip(marked, tagger.find_runs(model, [tagger.encode(texts[some[k]]) for k in marked], [marks[k] for k in marked]) if marked else []):
                if tagged:
                    out[some[k]] = settle(texts[some[k]], tagged)
            some, held = [], 0
        if text:
            some.append(i)
            held += len(text)
    return out


def find_personal(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, start_pos, end_pos, pii_type)`` of each mention in ``text``; positions in code points, the end exclusive.

    Whole texts are read, in overlapping windows whose tags are joined before
    spans are cut. Null, empty and blank texts give no rows; a row that is
    repeated counts once; other columns are not read. Narrow but for the
    removal of repeated results.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                found = find_in_texts(batch.column(1).to_pylist())
                rows = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
                flat = [s for f in found for s in f]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.int32()), pa.array([s[2] for s in flat], pa.string())],
                    ["k", "start_pos", "end_pos", "pii_type"],
                )

    slim = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return slim.mapInArrow(run, f"k {kind}, start_pos int, end_pos int, pii_type string").withColumnRenamed("k", key).distinct()


def redact(text: str, spans: list[Span]) -> str:
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], PLACEHOLDERS[kind]]
        last = b
    return "".join(out) + text[last:]


def redact_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text)`` with a typed placeholder for each mention and the rest unchanged; null stays null, repeated rows stay repeated."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = batch.column(1).to_pylist()
                clean = [t if t is None else redact(t, spans) for t, spans in zip(texts, find_in_texts(texts))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string())], ["k", "t"])

    slim = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return slim.mapInArrow(run, f"k {kind}, t string").toDF(key, text)
