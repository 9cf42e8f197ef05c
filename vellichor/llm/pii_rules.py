"""Exact forms of personal data: labels for training, and the check of what the model finds."""

from __future__ import annotations

import re
from collections.abc import Iterator

TYPES = ["email", "phone", "id_number", "address", "person"]

_AT = r"(?:[@＠]|\s?\(at\)\s?|\s?\[at\]\s?|\s?\{at\}\s?|\sat\s(?=[\w-]+(?:\sdot\s|\[dot\]|\(dot\))))"
_DOT = r"(?:[.．]|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)"
_EMAIL = rf"[A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9])?{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+"
_EXT = r"(?:\s?(?:ext\.?|x|доб\.?|내선|内線|poste|Durchwahl|Dw\.?)\s?\d{1,5}(?!\d))?"
_PHONE = (
    r"(?<![A-Za-z0-9_.+-])(?:"
    r"(?:\+|00(?=[1-9]\d))\d{1,3}[\s.-]?(?:[(（]\d{1,4}[)）][\s.-]?)?\d{1,11}(?:[\s.-]\d{2,8}){0,5}"
    r"|[(（]\d{2,5}[)）]\s?\d{3,8}(?:[\s.-]\d{2,5}){0,3}"
    r"|[18][\s-]\(?\d{3}\)?[\s-]\d{3}[\s-]\d{2}-?\d{2}"
    r"|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4}|1[3-9]\d[ -]?\d{4}[ -]?\d{4}"
    r"|0\d(?:[\s.-]\d{2}){4}"
    r"|0\d{1,4}[\s-]\d{3,5}[\s-]?\d{3,4}|0\d{1,4}[\s-]\d{6,8}"
    r"|01\d{8,9}"
    r")(?![\d-])" + _EXT
)
_ID = r"(?<![A-Za-z0-9_-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]\d{8,9}|\d{6}-\d{7}|\d{17}[\dXx]|\d{3}-\d{2}-\d{4}|\d{3} \d{3} \d{3}|\d{9})(?![A-Za-z0-9_-])"
_CAP = r"[A-ZÀ-ÖØ-ÞЀ-Я][\w’'ʼ-]*"
_TOWN = rf"{_CAP}(?: {_CAP}){{0,1}}"
_KIND = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Terrace|Close|Drive|Dr\.?|Hill|Row|Boulevard|Blvd\.?|Avenue|Ave\.?|Way|Court|Ct\.?|Place|Pl\.?|Square|Crescent|Walk|Gardens|Quay|Mews|Parade)"
_ADDRESS = "|".join(
    [
        rf"(?:(?:Flat|Apt\.?|Unit|Suite) \w+, )?\b\d{{1,4}}[A-Za-z]? (?:{_CAP} ){{1,3}}{_KIND}(?:, (?:Apt|Flat|Unit|Suite)\.? ?\w+)?(?:, {_CAP}(?: \d{{4,6}}\b)?)?",
        rf"\bP\. ?O\. ?Box \d+(?:, {_CAP}(?: \d{{4,6}}\b)?)?",
        rf"(?:\b(?:Am|An der|Auf der|Im|Zum|Zur) {_CAP}|\b[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm)) \d{{1,4}} ?[a-z]?\b(?:, (?:\d{{5}} )?{_CAP})?",
        rf"\b\d{{1,4}}(?: (?:bis|ter))?,? (?:rue|chemin|quai|avenue|place|allée|boulevard|impasse|cours|route) (?:(?:du|de la|des|de|d[’']|le|la|les) ?)*{_CAP}(?:, (?:\d{{5}} )?{_CAP})?",
        r"[가-힣]+(?:시|군|구|도) [가-힣]+(?:로|길|동) ?\d+(?:번길)?(?:-\d+)?",
        r"[぀-ヿ一-鿿]{2,6}?\d{1,3}(?:-\d{1,3}){2}",
        r"[一-鿿]{2,12}?(?:路|街|巷|道|弄)\d{1,5}号",
        rf"(?:calle|Calle|avenida|Avenida|plaza|Plaza) (?:(?:de la|del|de|los|las) )?{_CAP}(?: {_CAP})?,? \d{{1,4}}(?:, (?:\d{{5}} )?{_CAP})?",
        rf"\b(?:ul|al|pl)\. {_CAP}(?: {_CAP})? \d{{1,4}}[a-z]?(?:/\d{{1,4}})?(?:, (?:\d{{2}}-\d{{3}} )?{_CAP})?",
        rf"(?:г\. ?[А-ЯЁ][а-яё-]+, )?(?:ул|пр|пер)\. ?[А-ЯЁ][\wа-яё-]+(?:, | )(?:д\. ?)?\d+(?:, кв\. ?\d+)?(?:, (?:г\. )?[А-ЯЁ][а-яё-]+)?",
    ]
)
_PARTICLE = r"(?:van der|van den|van|von der|von|de la|de|del|da|di|der|du|la|le|ten|bin|al)"
_PART = rf"(?:[A-ZÀ-ÖØ-ÞЀ-Я]\.|{_CAP})"
_LATIN_NAME = rf"(?:{_PARTICLE} )?{_PART}(?:,? (?:{_PARTICLE} {_CAP}|{_PART})){{1,3}}"
_EAST_NAME = r"(?:[가-힣]{2,6}|[一-鿿぀-ヿ]{2,7})"
#: Phrases around a name, with the name as the only group.
_NAMED = [
    rf"\b(?:Dr|Prof|Mr|Mrs|Ms)\.? ({_LATIN_NAME}) (?:said|of|wrote|and|from|was|has)\b",
    rf"\bThe form gives ({_LATIN_NAME}) \(ID",
    rf"\bReported by ({_LATIN_NAME}), (?=\d|Flat|P\.|Apt)",
    rf"\bmarked for ({_LATIN_NAME})(?=\.(?:\s|$)|$)",
    rf"(?:Editor|Ответственный|Redaktion|Rédaction): ?({_LATIN_NAME})(?= ·|,|\.|$)",
    rf"\bContact ?: ({_LATIN_NAME}), (?=[+(\d])",
    rf"\bAuskunft gibt ({_LATIN_NAME}) unter\b",
    rf"\b(?:Frau|Herr) ({_LATIN_NAME}), (?=Ausweis)",
    rf"\b(?:Mme|M\.) ({_LATIN_NAME}) habite\b",
    rf"({_LATIN_NAME}) of the \w+ desk answers\b",
    rf"담당 ({_LATIN_NAME}|[가-힣]{{2,6}}), 전화",
    rf"({_LATIN_NAME}|[가-힣]{{2,6}}) 씨(?:는|가|를|의)",
    rf"\(({_LATIN_NAME}|[가-힣]{{2,6}}) 앞\)",
    rf"担当は({_LATIN_NAME}|{_EAST_NAME})さん",
    rf"、({_LATIN_NAME}|{_EAST_NAME})様",
    rf"联系({_LATIN_NAME}|[一-鿿]{{2,6}})，",
]

RULES = {"email": re.compile(_EMAIL, re.ASCII), "phone": re.compile(_PHONE), "id_number": re.compile(_ID), "address": re.compile(_ADDRESS)}
#: What a tagged number of no listed form may consist of, and how many digits it must have.
NUMBER = {"phone": re.compile(r"[+(0][\s().+-]{0,2}\d(?:[\s().+-]{0,2}\d)*"), "id_number": re.compile(r"[A-Z]{0,3}\d+(?:[ -]\d+){0,2}[A-Z]?")}
LEAST_DIGITS = 9
NAMED = [re.compile(p) for p in _NAMED]
LATIN_NAME = re.compile(_LATIN_NAME)

Span = tuple[int, int, str]


def forms(text: str) -> list[Span]:
    """Spans with the exact form of a mail address, postal address, identity number or phone; of spans that overlap the longest, or the first in this order."""
    found = [(m.start() - m.end(), i, *m.span(), kind) for i, kind in enumerate(("email", "address", "id_number", "phone")) for m in RULES[kind].finditer(text)]
    out: list[Span] = []
    for _, _, a, b, kind in sorted(found):
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, kind))
    return sorted(out)


def named(text: str) -> Iterator[Span]:
    """Names that stand in a phrase which only takes a name."""
    for pattern in NAMED:
        for m in pattern.finditer(text):
            yield (*m.span(1), "person")


def labels(text: str) -> list[Span]:
    """Labelled spans for training: exact forms and names in telling phrases."""
    out = forms(text)
    for span in named(text):
        if all(span[1] <= x or span[0] >= y for x, y, _ in out):
            out.append(span)
    return sorted(out)
