"""Template residue and error pages: positive-unlabelled naive Bayes over passages.

A body is cut into passages: its sentences, and every template marker with its
surroundings. Passages of trusted records (bodies that state an error, ask for
scripts or are filler, and markers that stand outside code) are the positives;
all other passages are unlabelled. Expectation-maximization refits the two
classes with the unlabelled passages weighted by their posterior. Every body is
then scored passage by passage, and the record decision follows from the share
of its own text that is residue, or from one unfilled marker.

The model is fitted on bounded samples by hash (``FIT_SOUGHT``, ``FIT_TRUSTED``
and ``FIT_UNLABELLED`` rows); scoring covers every body whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellichor.llm.canonical import mappings

FIT_SOUGHT = 60_000
FIT_TRUSTED = 2500
FIT_UNLABELLED = 2500
EM_ROUNDS = 3
#: Bodies up to this length are labelled by phrases, which bounds what is learned from, not what is scored.
TRUSTED_CHARS = 320
TRUSTED_SHARE = 0.25
RESIDUE_SHARE = 0.4
WEIGHT_LIMIT = 5.0
CONTENT_LIMIT = 2.0  # a word of the corpus's own subject says less against a notice than the notice's words say for it
RARE = 4.0  # tokens seen about this often weigh half
MEMO_ENTRIES = 200_000

# Own lists: phrases that make a short body a trusted error, script-notice or filler record.
TRUSTED_CUES = [
    # error messages
    "page not found", "not found on this server", "404 not found", "can’t be found", "can’t find the page", "no longer available", "has wandered off",
    "permanently removed", "access denied", "don’t have permission", "forbidden", "bad gateway", "did not answer in time", "internal server error",
    "unexpected condition", "something went wrong", "too many requests", "service temporarily unavailable", "service unavailable", "down for maintenance",
    "traceback (most recent call last)", "fatal error: uncaught", "warning: mysqli_connect", "link you followed is broken", "gateway timeout",
    "seite nicht gefunden", "wartungsarbeiten", "zugriff verweigert", "interner serverfehler", "page introuvable", "page non trouvée", "accès refusé",
    "erreur interne", "erreur 404", "service indisponible", "일시적인 오류가 발생", "一時的なエラー", "暂时无法", "blindtext", "faux-texte", "페이지를 찾을 수 없습니다", "접근 권한이 없습니다", "접근이 거부", "서버 오류", "점검 중", "見つかりませんでした", "アクセスが拒否", "サーバーエラー", "メンテナンス中",
    "页面不存在", "未找到", "没有权限访问", "服务器错误", "страница не найдена", "доступ запрещ", "ошибка сервера", "технические работы",
    # demands for scripts
    "enable javascript", "javascript is disabled", "requires scripts", "without scripts enabled", "checking your browser", "scripts are allowed",
    "aktivieren sie javascript", "activer javascript", "javascript를", "자바스크립트", "javascriptを有効", "启用 javascript", "включите javascript",
    # filler
    "lorem ipsum", "your text goes here", "sample paragraph", "sample heading", "add a short bio here", "hier steht ihr text", "votre texte ici",
    "ここに本文を入力", "여기에 내용을 입력", "在此输入", "введите текст", "asdf asdf", "test test test", "copy for the", "placeholder text",
]
# Own lists: the ways in which templates mark a place to fill.
MARKERS = [
    r"\{\{[^{}\n]{1,60}\}\}", r"\{%[^%\n]{1,60}%\}", r"<%[^%\n]{1,60}%>", r"\$\{[^{}\n]{1,60}\}", r"\[\[[^\[\]\n]{1,60}\]\]", r"<<[\w .]{1,60}>>",
    r"%%[A-Za-z_][\w.]*%%", r"\$\$[A-Za-z_][\w.]*\$\$", r"@@[A-Za-z_][\w.]*@@", r"__[A-Z][A-Z0-9_.]*?__", r"#[A-Z][A-Z0-9_.]+#",
    r"\[[Ii]nsert [^\[\]\n]{1,60}\]", r"\[[A-Z][A-Z0-9_. ]* NAME\]", r"(?<![\w{$])\{[a-z_][\w.]*\}(?!\})",
]

_MARKER = re.compile("|".join(f"({m})" for m in MARKERS))
_MARKER_HINT = re.compile(r"[{}\[%<$@#]|__")
_CODE_SPAN = re.compile(r"(`+)[^`\n]+\1")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=\S)|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_HEADING = re.compile(r"^\s*#{1,6}\s")


def fold(text: str) -> str:
    """Widths, look-alike letters and the make-up of syllables made plain; cheap enough for every line."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text if text.isascii() or _foldable().isdisjoint(text) else text.translate(_fold_table())


@lru_cache(maxsize=1)
def _fold_table() -> dict[int, str | None]:
    before, after, _ = mappings()
    table: dict[int, str | None] = dict(zip(map(ord, before), after))
    table |= {c: " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
    return table | {c: None for c in (0xAD, 0x34F, 0x180E, *range(0x200B, 0x2010), *range(0x2060, 0x2070), 0xFEFF)}


@lru_cache(maxsize=1)
def _foldable() -> frozenset[str]:
    return frozenset(map(chr, _fold_table()))


def tokens(sentence: str) -> set[str]:
    """Words in lower case, runs of CJK letters as character pairs, numbers as one shape."""
    out: set[str] = set()
    for word in _WORD.findall(sentence.lower()):
        if word.isascii():
            out.add("0" if word.isdigit() else word)
        elif _CJK.search(word):
            out.update(word[i : i + 2] for i in range(len(word) - 1))
        elif len(word) > 2 or word >= "가":  # shreds of garbled text say nothing
            out.add(word)
    return out


def marker_tokens(line: str, match: re.Match, in_code: bool) -> set[str]:
    inner = match.group()
    near_left, near_right = line[: match.start()].rstrip(), line[match.end() :].lstrip()
    place = "§code" if in_code else "§prose"
    shapes = (f"kind{match.lastindex}", "inline" if near_left or near_right else "alone", "upper" if inner.isupper() else "lower", "spaced" if " " in inner else "tight")
    return {place, *(f"{place}-{shape}" for shape in shapes)}


@dataclass
class Passages:
    """Sentences and markers of one body."""

    sentences: list[tuple[str, int, bool]] = field(default_factory=list)  #: text, characters, stands in a heading
    markers: list[frozenset[str]] = field(default_factory=list)


def passages(body: str) -> Passages:
    out = Passages()
    fenced = False
    for line in body.split("\n"):
        if not line.strip():
            continue
        if _FENCE.match(line):
            fenced = not fenced
            continue
        line = fold(line)
        plain = line
        if _MARKER_HINT.search(line):
            spans = [m.span() for m in _CODE_SPAN.finditer(line)]
            for m in _MARKER.finditer(line):
                coded = fenced or any(a <= m.start() < b for a, b in spans)
                out.markers.append(frozenset(marker_tokens(line, m, coded)))
            plain = _CODE_SPAN.sub(" ", line)
        if fenced:
            continue
        heading = bool(_HEADING.match(line))
        for sentence in _SENTENCE.split(plain):
            if size := len(sentence.strip()):
                out.sentences.append((sentence, size, heading))
    return out


@dataclass
class ResidueModel:
    """Log odds of residue by token, and of a passage before its tokens are seen."""

    prior: float
    weights: dict[str, float]

    def score(self, found: Iterable[str]) -> float:
        return self.prior + sum(map(self.weights.get, found, repeat(0.0)))


def fit_passages(trusted: list[frozenset[str]], unlabelled: list[frozenset[str]], rounds: int = EM_ROUNDS) -> ResidueModel:
    """Naive Bayes by expectation-maximization; trusted passages stay positive, the others start as content.

    Markers inside code are known to be content and keep a posterior of 0, as do
    passages of which less than half is known from trusted ones, so that unrelated
    rare text (garbled lines, say) can't drift into the class.
    """
    if not trusted:
        return ResidueModel(-50.0, {})
    positive = Counter(t for p in trusted for t in p)
    every = Counter(t for p in unlabelled for t in p)
    open_ = ["§code" not in p and 2 * sum(t in positive for t in p) >= len(p) for p in unlabelled]
    posterior = [0.0] * len(unlabelled)
    model = ResidueModel(0.0, {})
    for _ in range(max(1, rounds)):
        soft: Counter = Counter()
        mass = 0.0
        for p, w in zip(unlabelled, posterior):
            if w > 1e-3:
                mass += w
                for t in p:
                    soft[t] += w
        n_pos, n_neg = len(trusted) + mass, max(1.0, len(unlabelled) - mass)
        weights = {}
        for t in positive.keys() | every.keys():
            in_pos, in_neg = positive[t] + soft[t], max(0.0, every[t] - soft[t])
            ratio = math.log((in_pos + 0.3) / (n_pos + 1)) - math.log((in_neg + 0.3) / (n_neg + 1))
            seen = positive[t] + every[t]
            weights[t] = max(-WEIGHT_LIMIT if t.startswith("§") else -CONTENT_LIMIT, min(WEIGHT_LIMIT, ratio)) * seen / (seen + RARE)
        model = ResidueModel(math.log(n_pos / n_neg), weights)
        posterior = [1 / (1 + math.exp(-max(-30.0, min(30.0, model.score(p))))) if o else 0.0 for p, o in zip(unlabelled, open_)]
    return model


def _trusted_rows(versions: DataFrame) -> DataFrame:
    cue = "|".join(re.escape(c).replace(r"\ ", " ") for c in TRUSTED_CUES)
    marker = "|".join(m for m in MARKERS)
    short = F.length("content_blob") <= TRUSTED_CHARS
    return versions.filter((short & F.lower("content_blob").rlike(cue)) | F.col("content_blob").rlike(marker))


def _below(rows: int, total: int) -> int:
    """Hash threshold under which about ``rows`` of ``total`` rows lie."""
    return (1 << 62) if rows >= total else int((1 << 62) * (rows / total))


def fit(versions: DataFrame) -> ResidueModel:
    """Fit on bounded samples by hash; without trusted records nothing is residue.

    Trusted records are sought among about ``FIT_SOUGHT`` rows; of these the first
    ``FIT_TRUSTED`` by hash are taken, beside ``FIT_UNLABELLED`` others. The hash is of
    id and body, so that rows without an id are drawn like others, and rows that are
    repeated count once: the driver never gets more than these numbers.
    """
    total = versions.count()
    body = versions.filter("content_blob is not null").select(F.xxhash64("version_id", "content_blob").bitwiseAND(F.lit((1 << 62) - 1)).alias("h"), "content_blob")
    draw = lambda df, n: [r.content_blob for r in df.dropDuplicates(["h"]).orderBy("h").limit(n).collect()]
    likely = draw(_trusted_rows(body.filter(F.col("h") < _below(FIT_SOUGHT, total))), FIT_TRUSTED)
    return fit_bodies(sorted({*likely, *draw(body.filter(F.col("h") < _below(FIT_UNLABELLED, total)), FIT_UNLABELLED)}))


def fit_bodies(bodies: list[str]) -> ResidueModel:
    """Label the passages of sampled bodies as trusted or unlabelled, and fit."""
    cues = [fold(c) for c in TRUSTED_CUES]
    trusted: list[frozenset[str]] = []
    unlabelled: list[frozenset[str]] = []
    for text in bodies:
        cut = passages(text)
        lowered = fold(text.lower())
        cued = [len(text) <= TRUSTED_CHARS and any(c in lowered for c in cues) and any(c in s.lower() for c in cues) for s, _, _ in cut.sentences]
        share = sum(size for (_, size, _), c in zip(cut.sentences, cued) if c) / max(1, sum(size for _, size, _ in cut.sentences))
        for (sentence, _, heading), c in zip(cut.sentences, cued):
            if found := frozenset(tokens(sentence)):
                (trusted if share >= TRUSTED_SHARE and (c or not heading) else unlabelled).append(found)
        for found in cut.markers:
            (trusted if "§prose" in found else unlabelled).append(found)
    return fit_passages(trusted, unlabelled)


class ResidueScorer:
    """Record decisions of one worker; remembers lines, as notices and menus recur."""

    def __init__(self, model: ResidueModel):
        self.model = model
        self.memo: dict[str, bool] = {}

    def sentence(self, text: str) -> bool:
        known = self.memo.get(text)
        if known is None:
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            known = self.memo[text] = self.model.score(tokens(text)) > 0
        return known

    def is_residue(self, body: str | None, skip=None) -> bool:
        """Whether a body is residue; ``skip`` tells sentences that count on neither side."""
        if not body or body.isspace():
            return False
        cut = passages(body)
        if any(self.model.score(m) > 0 for m in cut.markers):
            return True
        own = [s for s in cut.sentences if not s[2]] or cut.sentences
        judged = [(text, size, self.sentence(text)) for text, size, _ in own]
        bad = sum(size for _, size, found in judged if found)
        if not bad:
            return False
        if skip is None:
            return bad >= RESIDUE_SHARE * sum(size for _, size, _ in judged)
        counted = [(size, found) for text, size, found in judged if not skip(text)]
        bad = sum(size for size, found in counted if found)
        return bad > 0 and bad >= RESIDUE_SHARE * sum(size for size, _ in counted)


def residue_versions(versions: DataFrame, model: ResidueModel | None = None) -> DataFrame:
    """``version_id`` of every version whose body is residue or holds an unfilled marker, once each.

    Null, empty and blank bodies are none. Replays count once. A null
    ``version_id`` with such a body comes out as one null row. Columns other than
    ``version_id`` and ``content_blob`` are not read. Scoring is narrow; only the
    ids found are shuffled.
    """
    model = model or fit(versions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vellichor.llm.boilerplate import looks_like_furniture

        scorer = ResidueScorer(model)
        for batch in batches:
            ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [i for i, b in zip(ids, bodies) if scorer.is_residue(b, looks_like_furniture)]
            yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.string())], ["version_id"])

    return versions.select("version_id", "content_blob").mapInArrow(run, "version_id string").distinct()
