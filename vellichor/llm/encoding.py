"""Text read under a wrong encoding: find it, and regain it where the bytes survive.

Counts of adjacent characters over all texts give each pair its mutual
information. Pairs that the corpus doesn't expect score above zero, expected
ones below, and the maximum-scoring segment of a line is its improbable run.
Only inside such runs inverse mappings are tried: encode with the encoding the
text was read under, decode with the one it was written in. A mapping counts
when what it gives is far likelier, by the corpus's own pairs, than what stood
there. Runs with replacement characters or broken sequences are garbled beyond
regaining. Samples between backticks are never looked at.

Pairs are counted in ``2**PAIR_BITS`` hash buckets, so what is sent to every
task has a fixed bound however large the corpus is.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR_BITS = 20
CHAR_BITS = 16
PRIOR = 0.05
#: Mutual information below which a pair is improbable unless it has the common share of all pairs, and the share below which it is rare.
LOW_INFORMATION = -1.0
RARE_SHARE = 1e-5
COMMON_SHARE = 1e-4
#: Gain in mean log count of its pairs that an inverse mapping must bring, in nats.
GAIN = 1.5
# Encodings that texts are read under by mistake, with the ones they may have been written in.
_EAST = ["cp932", "euc_jp", "gbk", "cp949", "big5"]
_CYRILLIC = ["cp1251", "koi8_r", "cp866"]
_WEST = ["cp1252", "mac_roman", "cp437", "cp850"]
MISREADINGS = {
    "cp1252": ["utf-8", *_EAST, *_CYRILLIC, *_WEST], "mac_roman": ["utf-8", *_EAST, *_CYRILLIC, *_WEST], "cp437": ["utf-8", *_WEST], "cp850": ["utf-8", *_WEST],
    "cp1251": ["utf-8", *_CYRILLIC, *_WEST], "koi8_r": ["utf-8", *_CYRILLIC], "cp866": ["utf-8", *_CYRILLIC], "mac_cyrillic": ["utf-8", *_CYRILLIC], "cp1250": ["utf-8", "cp1252"],
    "gbk": ["utf-8", *_EAST], "cp949": ["utf-8", *_EAST], "big5": ["utf-8", *_EAST], "cp932": ["utf-8", *_EAST], "euc_jp": ["utf-8", *_EAST],
}
MEMO_ENTRIES = 100_000

_MULT = np.uint32(0x9E3779B1)
_CODE = re.compile(r"```.*?```|(`+)[^`\n]+\1", re.DOTALL)  # a fence that nothing closes hides nothing
_LOST = re.compile("�")
_C1 = re.compile("[\x80-\x84\x86-\x9f]")


@lru_cache(maxsize=32)
def _encoder(name: str):
    if name != "cp1252":
        return lambda text, errors="strict": codecs.encode(text, name, errors)
    # unassigned bytes of cp1252 read as C1 controls, as browsers do, and so do the controls themselves
    shown = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(256))
    table = {ord(c): i for i, c in enumerate(shown)} | {i: i for i in range(0x80, 0xA0)}
    return lambda text, errors="strict": codecs.charmap_encode(text, errors, table)[0]


@lru_cache(maxsize=1)
def _misread_utf8() -> re.Pattern:
    """Sequences that look like UTF-8 bytes shown one by one, by the rule of UTF-8 and each one-byte encoding: one long one, one short one that ends in a symbol, or two short ones."""
    short, symbol, long = [], [], []
    for name in ("latin_1", "cp1252", "cp437", "cp850", "cp1251", "mac_roman"):
        shown = lambda a, b: [c for c in bytes(range(a, b + 1)).decode(name, "ignore") if c != "\xa0"]  # noqa: B023, E731
        group = lambda chars: "[" + "".join(map(re.escape, chars)) + "]"
        tail = shown(0x80, 0xBF)
        short.append(group(shown(0xC2, 0xDF)) + group(tail))
        long += [group(shown(0xE0, 0xEF)) + group(tail) + "{2}", group(shown(0xF0, 0xF4)) + group(tail) + "{3}"]
        if name != "mac_roman":  # its leading bytes show as dashes and quotes, which stand before letters anyway
            symbol.append(group(shown(0xC2, 0xDF)) + group([c for c in tail if not c.isalpha() and c not in "”’»…—–“‘"]))
    two = "(?:" + "|".join(short) + ")"
    return re.compile("|".join([*long, *symbol, f"{two}.{{0,12}}{two}"]))


def unsure(text: str) -> bool:
    """Texts that are left out of the counts: they look misread, hold replacements, or are full of symbols or capitals."""
    if _LOST.search(text) or _C1.search(text) or _misread_utf8().search(text):
        return True
    odd = sum(map(text.count, "¡¢£¤¥¦¨ª¬®¯±²³´µ¶¸¹º¼½¾¿×÷"))
    return odd > 4 and odd * 12 > len(text)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def buckets(chars: np.ndarray) -> np.ndarray:
    mixed = chars[:-1] * _MULT
    mixed ^= mixed >> np.uint32(15)
    return (mixed + chars[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - PAIR_BITS)


def _wide(chars: np.ndarray) -> np.ndarray:
    """Pairs of which one character at least is not ASCII."""
    return (chars[:-1] | chars[1:]) >= 0x80


def count_pairs(texts: DataFrame) -> DataFrame:
    """``(kind, bucket, n)``: pairs (kind 0) and their characters (kind 1) over every sure text, summed per partition before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(1 << PAIR_BITS, np.int64)
        chars = np.zeros(1 << CHAR_BITS, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                sure = [t for t in batch.column(0).slice(start, 256).to_pylist() if t and not t.isascii() and not unsure(t)]
                if not sure:
                    continue
                c = codes("\n".join(sure))
                wide = _wide(c)
                pairs += np.bincount(buckets(c)[wide], minlength=1 << PAIR_BITS)
                ends = np.concatenate((c[:-1][wide], c[1:][wide])) & 0xFFFF
                chars += np.bincount(ends, minlength=1 << CHAR_BITS)
        for kind, table in ((0, pairs), (1, chars)):
            found = np.flatnonzero(table)
            for start in range(0, len(found), 100_000):
                part = found[start : start + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.astype(np.int32)), pa.array(table[part])], ["kind", "bucket", "n"])

    return texts.select("text").mapInArrow(run, "kind int, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))


class PairModel:
    """Mutual information and log counts by bucket; at most ``2**PAIR_BITS`` entries whatever the corpus."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray):
        self.total = max(1.0, float(pairs.sum()))
        self.pairs = pairs.astype(np.float32)
        self.chars = chars.astype(np.float32)
        #: mean log count of a pair as it is met in the corpus
        self.typical = float((pairs * np.log(pairs + PRIOR)).sum() / self.total) if pairs.any() else 0.0

    @classmethod
    def fit(cls, texts: DataFrame) -> PairModel:
        pairs, chars = np.zeros(1 << PAIR_BITS), np.zeros(1 << CHAR_BITS)
        counted = count_pairs(texts).toPandas()
        for kind, table in ((0, pairs), (1, chars)):
            part = counted[counted.kind == kind]
            table[part.bucket.to_numpy()] = part.n.to_numpy()
        return cls(pairs, chars)

    def odd(self, chars: np.ndarray) -> np.ndarray:
        """Score of each pair: above zero when the corpus doesn't expect it; near zero for plain ASCII."""
        wide = _wide(chars)
        out = np.full(len(wide), -0.1, np.float32)
        if wide.any():
            left, right = chars[:-1][wide] & 0xFFFF, chars[1:][wide] & 0xFFFF
            n = self.pairs[buckets(chars)[wide]]
            floor = np.sqrt(self.total)
            info = np.log((n + PRIOR) * self.total / (np.maximum(self.chars[left], floor) * np.maximum(self.chars[right], floor)))
            bad = ((info < LOW_INFORMATION) & (n < COMMON_SHARE * self.total)) | (n < RARE_SHARE * self.total)
            out[wide] = np.where(bad, 1.0, -0.7)
        return out

    def familiarity(self, text: str) -> float:
        """Mean log count of the pairs of which one character is not ASCII; of plain ASCII, that of a common pair."""
        c = codes(text)
        if len(c) < 2 or not (wide := _wide(c)).any():
            return float(np.log(self.total / 1000 + 1))
        return float(np.log(self.pairs[buckets(c)[wide]] + PRIOR).mean())


def _inverse(run: str, model: PairModel, base: float, left: str, right_: str) -> str | None:
    best, most = None, base + GAIN
    for wrong, candidates in MISREADINGS.items():
        try:
            raw = _encoder(wrong)(run)
        except (UnicodeError, ValueError):
            continue
        if raw.isascii():
            continue
        for right in candidates:
            if right == wrong or (right != "utf-8" and len(run) < 6):
                continue
            try:
                plain = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if plain != run and not _C1.search(plain) and (gain := model.familiarity(left + plain + right_)) > most:
                best, most = plain, gain
    return best


def readings(line: str) -> Iterator[str]:
    """Everything a line may have been before one misreading, likely or not."""
    for wrong, candidates in MISREADINGS.items():
        try:
            raw = _encoder(wrong)(line)
        except (UnicodeError, ValueError):
            continue
        for right in candidates:
            try:
                if right != wrong and (plain := raw.decode(right)) != line:
                    yield plain
            except UnicodeDecodeError:
                continue


def _broken_utf8(run: str, model: PairModel) -> bool:
    """Mostly whole UTF-8 sequences that read far likelier, but some bytes are lost."""
    base = model.familiarity(run)
    for wrong in ("cp1252", "mac_roman", "cp437", "cp1251", "gbk"):
        plain = _encoder(wrong)(run, "ignore").decode("utf-8", "replace")
        whole = sum(c > "\x7f" for c in plain) - plain.count("�")
        if whole >= 4 and whole > 1.5 * plain.count("�") and model.familiarity(plain.replace("�", "")) > base + GAIN:
            return True
    return False


def _one_script(a: str, b: str) -> bool:
    """Two letters of an East Asian or Cyrillic script; a single odd pair of these says nothing."""
    return min(a, b) >= "\u0400" and a.isalpha() and b.isalpha() and (a >= "\u1100") == (b >= "\u1100")


def _blank_code(text: str) -> str:
    """The text with blanks in place of code; lines stay lines."""
    return _CODE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text) if "`" in text else text


class Ungarbler:
    """Detection and repair of one worker."""

    def __init__(self, model: PairModel):
        self.model = model
        self.memo: dict[str, tuple[bool, str | None]] = {}

    def runs(self, line: str) -> Iterator[tuple[int, int]]:
        """Maximum-scoring segments of a line as character spans: the best, then the best of what is left and right of it."""
        score = self.model.odd(codes(line))
        todo = [(0, len(score))]
        while todo:
            a, b = todo.pop()
            if b - a < 1 or score[a:b].max() <= 0:
                continue
            total = np.concatenate(([0.0], np.cumsum(score[a:b])))
            rise = total - np.minimum.accumulate(total)
            end = int(rise.argmax())
            start = int(total[: end + 1].argmin()) if end else 0
            if end <= start:
                continue
            if end - start > 1 or not _one_script(line[a + start], line[a + start + 1]):
                yield a + start, a + end + 1
            todo += [(a, a + start), (a + end, b)]

    def line(self, line: str) -> tuple[bool, str]:
        """Whether a line is garbled, and its repaired form (unchanged where it can't be regained)."""
        plain = _blank_code(line)
        if plain.isascii():
            return False, line
        if _LOST.search(plain):
            return True, line
        found, out, shift = False, line, 0
        for start, end in sorted(self.runs(plain)):
            # a sequence may reach past the pairs that score, and pairs of words that were cut may hide in it
            while start > 0 and plain[start - 1] > "\x7f":
                start -= 1
            while end < len(plain) and plain[end] > "\x7f":
                end += 1
            bad, fixed = self.judge(plain[start:end], plain[start - 1 : start] if start else "", plain[end : end + 1])
            found |= bad
            if fixed is not None:
                out = out[: start + shift] + fixed + out[end + shift :]
                shift += len(fixed) - (end - start)
        return found, out

    def judge(self, run: str, left: str = "", right: str = "") -> tuple[bool, str | None]:
        """Whether a run between two characters is garbled, and its original; remembered, as words recur."""
        key = f"{left}\0{run}\0{right}"
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            fixed = self.repair(run, left, right)
            known = self.memo[key] = (fixed is not None or bool(_C1.search(run)) or _broken_utf8(run, self.model), fixed)
        return known

    def repair(self, run: str, left: str = "", right: str = "") -> str | None:
        """The original of a run through one or two inverse mappings, or null."""
        if len(run) < 2:
            return None
        base = self.model.familiarity(left + run + right)
        if base > self.model.typical:
            return None
        once = _inverse(run, self.model, base, left, right)
        return self._twice(run if once is None else once, base, left, right) or once

    def _twice(self, run: str, base: float, left: str, right: str) -> str | None:
        """Text that was misread two times."""
        for wrong in ("cp1252", "mac_roman", "cp437", "cp1251"):
            try:
                middle = _encoder(wrong)(run).decode("utf-8")
            except (UnicodeError, ValueError):
                continue
            if middle != run and not middle.isascii() and (again := _inverse(middle, self.model, base, left, right)) is not None:
                return again
        return None

    def is_garbled(self, text: str | None) -> bool:
        if not text or text.isascii():
            return False
        plain = _blank_code(text)
        if _LOST.search(plain):
            return True
        score = self.model.odd(codes(plain))
        if not (score > 0).any():
            return bool(_C1.search(plain))
        ends = np.flatnonzero(codes(plain) == 10)
        hit = np.unique(np.searchsorted(ends, np.flatnonzero(score > 0)))
        lines = plain.split("\n")
        return any(self.line(lines[i])[0] for i in hit.tolist()) or bool(_C1.search(plain))

    def repaired(self, text: str | None) -> str | None:
        """The text with every regained line in place."""
        if not text or text.isascii():
            return text
        shown = _blank_code(text).split("\n")
        return "\n".join(self.line(line)[1] if not plain.isascii() else line for line, plain in zip(text.split("\n"), shown))


def records(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """``(field, record_key, text)`` of all titles and bodies."""
    titles = documents.select(F.lit("documents.title").alias("field"), F.col("doc_id").cast("string").alias("record_key"), F.col("title").alias("text"))
    bodies = versions.select(F.lit("versions.content_blob").alias("field"), F.col("version_id").alias("record_key"), F.col("content_blob").alias("text"))
    return titles.unionByName(bodies).filter("text <> ''")


def _scan(texts: DataFrame, model: PairModel, repair: bool) -> DataFrame:
    names = ["field", "record_key"] + (["original"] if repair else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Ungarbler(model)
        for batch in batches:
            texts_ = batch.column(2).to_pylist()
            hit = [i for i, t in enumerate(texts_) if worker.is_garbled(t)]
            part = batch.take(pa.array(hit, pa.int64()))
            columns = [part.column(0), part.column(1)]
            if repair:
                columns.append(pa.array([worker.repaired(texts_[i]) for i in hit], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts.mapInArrow(run, "field string, record_key string" + (", original string" if repair else ""))


def garbled_records(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """``(field, record_key)`` of each record with garbled text, wholly or in part, once each.

    Null, empty and plain ASCII texts are none. Replays count once; a null key
    comes out as one null per field. Two passes over the texts, which stay where
    they are: only bucket sums and the keys found are shuffled.
    """
    texts = records(documents, versions)
    return _scan(texts, PairModel.fit(texts), False).distinct()


def regained_records(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """The garbled records with their text, regained line by line where the bytes survive and as stored elsewhere."""
    texts = records(documents, versions)
    return _scan(texts, PairModel.fit(texts), True).dropDuplicates(["field", "record_key"])
