"""Text normalisation: an idempotent kernel in Python, and script measures by built-in expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIPELINE = "vellichor-text/1"
PASSES = 3
# Characters of scripts that don't part words by spaces, and formatting tags.
WORDLESS = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3001-\u301f"
INLINE_TAGS = ["b", "i", "em", "strong", "u", "s", "mark", "small", "sub", "sup", "span", "font"]

_BREAKS = re.compile("\r\n|[\r\x0b\x0c\x85\u2028\u2029]")
_SPACES = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_NOTHING = re.compile("[\u200b\u2060\ufeff\u00ad]")
_TAGS = re.compile(rf"<({'|'.join(INLINE_TAGS)})\b[^<>]*>(.*?)</\1\s*>", re.IGNORECASE | re.DOTALL)
_STRONG = re.compile(r"(?<![\w*])(\*{1,3})(?=\S)([^*\n]+?)(?<=\S)\1(?![\w*])|(?<![\w_])(_{1,3})(?=\S)([^_\n]+?)(?<=\S)\3(?![\w_])")
_CODE = re.compile(r"(`+)[^`\n]+\1")
_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
_STRUCTURAL = re.compile(r"^\s{0,3}(?:#{1,6}\s|>|\||[-*_]{3,}\s*$|={3,}\s*$|\[\^?[^\]]+\]:|\[[^\]]+\]\s*$)|^\s*<")
_ITEM = re.compile(r"^\s{0,3}(?:[-*+•]|\d{1,2}[.)])\s+\S")
_COLUMNS = re.compile(r"\S(?:\t|\s{2,})\S")
_RECORD = re.compile(r"^(?:\d[\d\s.,:/-]*$|[\w .-]{1,30}(?:: |=)\S)")
_WORDLESS = re.compile(f"[{WORDLESS}]")
_WORDLESS_GAP = re.compile(f"(?<=[{WORDLESS}]) +(?=[{WORDLESS}])")


def wordless_share(text: str) -> float:
    """Share of characters of scripts without word spaces among all that aren't white space."""
    solid = sum(not c.isspace() for c in text)
    return len(_WORDLESS.findall(text)) / solid if solid else 0.0


def _strip_inline(line: str) -> str:
    """Emphasis marks removed outside code spans, until nothing changes."""
    parts, last = [], 0
    for m in _CODE.finditer(line):
        parts += [(line[last : m.start()], True), (m.group(), False)]
        last = m.end()
    parts.append((line[last:], True))
    out = []
    for piece, free in parts:
        for _ in range(4 if free else 0):
            changed = _STRONG.sub(lambda m: m.group(2) or m.group(4), piece)
            if changed == piece:
                break
            piece = changed
        out.append(piece)
    return "".join(out)


def _kinds(lines: list[str]) -> list[str]:
    """code, structural, item, prose or blank for each line."""
    out, fence = [], ""
    for line in lines:
        mark = _FENCE.match(line)
        if fence:
            out.append("code")
            if mark and mark.group(1)[0] == fence[0] and len(mark.group(1)) >= len(fence):
                fence = ""
        elif mark:
            fence = mark.group(1)
            out.append("code")
        elif not line.strip():
            out.append("blank")
        elif line.startswith(("    ", "\t")):
            out.append("code")
        elif _ITEM.match(line):
            out.append("item")
        elif _STRUCTURAL.match(line) or _COLUMNS.search(line.strip()):
            out.append("structural")
        else:
            out.append("prose")
    return out


def _fold(lines: list[str], joint: str) -> list[str]:
    """Lines of one paragraph or list item become one; records stay apart."""
    out: list[str] = []
    kinds = _kinds(lines)
    i = 0
    while i < len(lines):
        if kinds[i] not in ("prose", "item"):
            out.append(lines[i].rstrip() if kinds[i] != "code" else lines[i])
            i += 1
            continue
        j = i + 1
        while j < len(lines) and kinds[j] == "prose":
            j += 1
        run = [x.strip() for x in lines[i:j]]
        if kinds[i] == "prose" and len(run) > 1 and all(_RECORD.match(x) for x in run):
            out += run
        else:
            text = run[0]
            for x in run[1:]:
                text += x if text.endswith(("-", "/")) else joint + x
            out.append(text)
        i = j
    return out


def _once(text: str) -> str:
    text = _NOTHING.sub("", _SPACES.sub(" ", _BREAKS.sub("\n", text)))
    while (plain := _TAGS.sub(r"\2", text)) != text:
        text = plain
    lines = text.split("\n")
    lines = [x if k == "code" else _strip_inline(x) for x, k in zip(lines, _kinds(lines))]
    wordless = wordless_share("\n".join(lines)) >= 0.5
    lines = _fold(lines, "" if wordless else " ")
    if wordless:
        lines = [x if k == "code" else _WORDLESS_GAP.sub("", x) for x, k in zip(lines, _kinds(lines))]
    return unicodedata.normalize("NFC", re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n"))


def normalize(text: str | None) -> str | None:
    """The normal form; it is its own normal form. Null stays null."""
    if text is None:
        return None
    for _ in range(PASSES):
        again = _once(text)
        if again == text:
            break
        text = again
    return text


@F.pandas_udf(T.StringType())
def normalize_column(texts: pd.Series) -> pd.Series:
    return texts.map(normalize, na_action="ignore")


def script_density(column: str) -> Column:
    """``wordless_share`` by built-in expressions."""
    solid = F.length(F.regexp_replace(column, r"\s", ""))
    return F.when(solid > 0, F.regexp_count(column, F.lit(f"[{WORDLESS}]")) / solid).otherwise(0.0)


def dehyphenated(column: str) -> Column:
    """Words that a line break parted are joined."""
    return F.regexp_replace(column, r"([a-z])-\n([a-z])", "$1$2")


def content_window(column: str, start: int, length: int) -> tuple[Column, Column, Column]:
    """A stretch of a text from a 0-based position, whether text follows, and where it goes on; length 0 means to the end."""
    size = F.coalesce(F.length(column), F.lit(0))
    piece = F.substring(column, start + 1, length) if length else F.expr(f"substring({column}, {start + 1})")
    more = size > F.lit(start + length) if length else F.lit(False)
    return piece, more, F.when(more, F.lit(start + length))


def http_date(column: str) -> Column:
    return F.date_format(column, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def retry_after(column: str, now: Column) -> Column:
    """Seconds of a Retry-After header, as a number or a date; never negative, null when it is neither."""
    number = F.expr(f"try_cast({column} as double)")
    moment = F.try_to_timestamp(F.regexp_replace(F.col(column), "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    number = F.when(~F.isnan(number) & (F.abs(number) < 1e12), number)
    seconds = F.coalesce(number, (F.unix_timestamp(moment) - F.unix_timestamp(now)).cast("double"))
    return F.when(seconds < 0, 0.0).otherwise(seconds)


def text_hash(column: str) -> Column:
    return F.sha2(F.col(column), 256)
