"""One consistent form for text that looks the same.

The form is an SQL expression which DuckDB evaluates inside Arrow partitions:
full and half width become plain, joined letters are taken apart, look-alike
letters become Latin, invisible characters go, every kind of space or hyphen
becomes the plain one, and NFC settles accents and syllables. Case, accents,
digits and superscripts stay as they are, so different-looking text stays
different. The same expression runs unchanged in any DuckDB session.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Own list: letters of other scripts that look like the Latin letter they stand beside.
LOOK_ALIKES = {
    "a": "аɑα", "c": "сϲⅽᴄ", "d": "ԁⅾ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іⅰι", "j": "јϳ", "l": "ⅼӏ", "m": "ⅿ",
    "n": "ո", "o": "оοօᴏ", "p": "рρ", "q": "ԛզ", "s": "ѕꜱ", "u": "սᴜυ", "v": "νѵⅴᴠ", "w": "ԝաᴡ", "x": "хⅹ", "y": "уүγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹⅭ", "D": "Ⅾ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙⅠӀ", "J": "ЈͿ", "K": "КΚK", "L": "Ⅼ",
    "M": "МΜⅯ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "ѴⅤ", "W": "Ԝ", "X": "ХΧⅩ",
    "Y": "УΥҮ", "Z": "Ζ", "Ë": "Ё", "ë": "ё", "Ï": "Ї", "ï": "ї", "Å": "Å",
}
# Code point ranges without a glyph, of spaces and of hyphens, as written in a regular expression.
INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E01EF}"
SPACES = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
HYPHENS = r"\x{2010}\x{2011}\x{2043}\x{FE63}\x{FF0D}"


@lru_cache(maxsize=1)
def mappings() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Single characters from and to, and joined letters with their parts; widths and ligatures follow from Unicode's rules."""
    single: dict[str, str] = {other: latin for latin, others in LOOK_ALIKES.items() for other in others}
    joined: list[tuple[str, str]] = []
    for code in range(0x80, 0x20000):
        kind, _, parts = unicodedata.decomposition(chr(code)).partition(" ")
        if kind in ("<wide>", "<narrow>", "<font>"):
            plain = chr(int(parts, 16))
            single.setdefault(chr(code), single.get(plain, plain))
        elif kind == "<compat>" and "LIGATURE" in unicodedata.name(chr(code), "") and code < 0xFB50:
            joined.append((chr(code), "".join(chr(int(p, 16)) for p in parts.split())))
    return "".join(single), "".join(single.values()), tuple(joined)


def canonical_sql(column: str) -> str:
    """The DuckDB expression of a column's consistent form."""
    before, after, joined = mappings()
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    sql = f"translate({column}, {quoted(before)}, {quoted(after)})"
    for ligature, parts in joined:
        sql = f"replace({sql}, '{ligature}', '{parts}')"
    sql = f"regexp_replace({sql}, '[{INVISIBLE}]', '', 'g')"
    sql = f"regexp_replace({sql}, '[{SPACES}]', ' ', 'g')"
    sql = f"regexp_replace({sql}, '[{HYPHENS}]', '-', 'g')"
    return f"nfc_normalize({sql})"


@lru_cache(maxsize=1)
def _duckdb():
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET threads = 1")
    connection.execute("SET memory_limit = '400MB'")
    return connection


def run_duckdb(df: DataFrame, sql: str, schema: T.StructType | str) -> DataFrame:
    """Evaluate ``sql`` over each Arrow batch of ``df``, which it names ``part``; columns follow ``schema`` by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection = _duckdb()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = pa.Table.from_batches([batch.slice(start, 1024)])
                connection.register("part", part)
                yield from connection.sql(sql).to_arrow_table().to_batches()
                connection.unregister("part")

    return df.mapInArrow(run, schema)


def canonical_columns(df: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """``keys`` unchanged and ``texts`` in their consistent form.

    Null stays null and empty stays empty; repeated rows come out repeated; other
    columns are not read. Texts of any length are taken whole. Narrow, no shuffle.
    """
    picked = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate([*keys, *texts])])
    parts = [f"c{i}" for i in range(len(keys))] + [f"{canonical_sql(f'c{len(keys) + i}')} AS c{len(keys) + i}" for i in range(len(texts))]
    out = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate([*keys, *texts])])
    return run_duckdb(picked, f"SELECT {', '.join(parts)} FROM part", out).toDF(*keys, *texts)


def disguised_quotes(anchors: DataFrame, versions: DataFrame) -> DataFrame:
    """``(anchor_id, created_version)`` of quotes that read as a passage of their version but are written otherwise.

    A quote that stands in the body as written is none, nor is a null or empty
    quote, nor one whose version or body is missing. Replays count once. Bodies
    that no quote names do not travel, and only pairs that differ as written
    leave the JVM.
    """
    quotes = anchors.select("anchor_id", "created_version", "exact").filter("exact <> ''").distinct()
    named = quotes.select("created_version").distinct()
    bodies = (
        versions.select(F.col("version_id").alias("created_version"), F.col("content_blob").alias("body"))
        .filter("body <> ''")
        .join(named, "created_version", "left_semi")
        .dropDuplicates(["created_version"])
    )
    apart = quotes.join(bodies, "created_version").filter(F.instr("body", F.col("exact")) == 0)
    sql = f"SELECT anchor_id, created_version FROM part WHERE {canonical_sql('exact')} <> '' AND contains({canonical_sql('body')}, {canonical_sql('exact')})"
    return run_duckdb(apart.select("anchor_id", "created_version", "exact", "body"), sql, "anchor_id string, created_version string").distinct()
