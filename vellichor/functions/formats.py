"""Small formats: durations, percentages, byte decoding."""

from __future__ import annotations

import codecs
import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_DURATION = re.compile(r"P(?:(\d+(?:\.\d+)?)W)?(?:(\d+(?:\.\d+)?)D)?(?:T(?=\d)(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?", re.ASCII)
_CHARSET = re.compile(rb"""<meta[^>]{0,200}?charset\s*=\s*["']?([\w.:-]{2,40})""", re.IGNORECASE)


def iso_duration(value: str) -> timedelta:
    """``P1DT2H30M`` and the like; years and months have no fixed length and are refused."""
    match = _DURATION.fullmatch(value.strip().upper())
    if not match or not any(match.groups()):
        raise ValueError(f"not a duration: {value!r}")
    weeks, days, hours, minutes, seconds = (float(x or 0) for x in match.groups())
    return timedelta(weeks=weeks, days=days, hours=hours, minutes=minutes, seconds=seconds)


def percent(ratio: Column) -> Column:
    """A share for readers: whole percents from one percent on, two significant digits below."""
    value = ratio * 100
    digits = F.when(value > 0, F.lit(1) - F.floor(F.log10(value))).otherwise(0).cast("int")
    small = F.expr("cast(null as string)")
    for d in range(2, 9):  # enough for one part in a hundred million
        small = F.coalesce(small, F.when(digits <= d, F.format_number(value, d)))
    return F.when(ratio.isNull(), None).when(value >= 1, F.concat(F.round(value).cast("bigint").cast("string"), F.lit("%"))).when(value <= 0, "0%").otherwise(F.concat(F.coalesce(small, F.lit("0")), F.lit("%")))


def decode_bytes(raw: bytes | None) -> str | None:
    """Text of a response body: by its byte order mark, as UTF-8, by the charset it declares, else UTF-8 with marks for what is lost."""
    if raw is None:
        return None
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        declared = _CHARSET.search(raw[:4096])
    try:
        return raw.decode(declared[1].decode("ascii") if declared else "utf-8")
    except (LookupError, UnicodeDecodeError):
        return raw.decode("utf-8", "replace")
