"""HTML to blocks, Markdown text and a title with the standard library's lenient parser; coverage of a body against the page's prose."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from vellichor.functions.text import normalize

# Tags by their part in a page.
SILENT = {"script", "style", "noscript", "template", "svg", "head", "iframe", "object"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
BLOCKS = {"p", "div", "section", "article", "main", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "table", "tr", "td", "th", "figcaption", "figure", "details", "summary", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "br", "body", "html", "address"} | FURNITURE
PROSE = {"p", "li", "dd", "dt", "blockquote", "pre", "td", "th", "figcaption", "summary", "details", "aside", "h1", "h2", "h3", "h4", "article", "section", "div"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
LEAST_PROSE = 40
LINK_SHARE = 0.30
PROBE = 16

_SKELETON = re.compile(r"[\s*_`~#|\\>-]+")


@dataclass
class Block:
    tag: str
    text: str
    link_chars: int
    within: tuple[str, ...]


@dataclass
class Page:
    title: str | None = None
    blocks: list[Block] = field(default_factory=list)


class _Reader(HTMLParser):
    """Blocks in document order; end tags that never come are implied by the next block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.stack = Page(), []
        self.buffer: list[str] = []
        self.linked = 0
        self.title: list[str] | None = None

    def flush(self) -> None:
        text = re.sub(r"[ \t\r\f]+", " ", "".join(self.buffer)).strip()
        if text and not SILENT & set(self.stack):
            blocks = [t for t in self.stack if t in BLOCKS]
            self.page.blocks.append(Block(blocks[-1] if blocks else "body", text, self.linked, tuple(self.stack)))
        self.buffer, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "title" and self.page.title is None and "svg" not in self.stack:
            self.title = []
        if tag in BLOCKS:
            self.flush()
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd") and self.stack and self.stack[-1] == tag:
                self.stack.pop()
        if tag == "br":
            self.buffer.append("\n")
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self.title is not None:
            self.page.title = re.sub(r"\s+", " ", "".join(self.title)).strip() or None
            self.title = None
        if tag in BLOCKS:
            self.flush()
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.title is not None:
            self.title.append(data)
        elif not SILENT & set(self.stack):
            self.buffer.append(data)
            if "a" in self.stack:
                self.linked += len(data.strip())


def read(html: str | None) -> Page:
    """Blocks and title of a page; broken markup never raises."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.page


def to_markdown(html: str | None) -> tuple[str | None, str | None]:
    """(title, body) of a page without its furniture, normalized; null when no body is left."""
    page = read(html)
    out = []
    for b in page.blocks:
        if FURNITURE & set(b.within):
            continue
        level = b.tag[1:] if re.fullmatch(r"h[1-6]", b.tag) else ""
        mark = "#" * int(level) + " " if level else "- " if b.tag == "li" else "> " if b.tag == "blockquote" else ""
        out.append(f"```\n{b.text}\n```" if b.tag == "pre" else mark + b.text)
    return page.title, normalize("\n\n".join(out)) or None


def skeleton(text: str) -> str:
    """A text without white space and markup signs."""
    return _SKELETON.sub("", text)


def measure(html: str | None, body: str | None) -> dict:
    """Coverage of a body: prose characters of the page, those captured, and blocks dropped by tag.

    A block counts as captured when its head and tail stand in the body within its
    length; each place in the body serves one block.
    """
    if not html:
        return {"basis": "unknown", "prose_chars": None, "captured_chars": None, "dropped": {}}
    hay = skeleton(body or "")
    prose = captured = 0
    dropped: dict[str, int] = {}
    taken: list[tuple[int, int]] = []
    resume: dict[str, int] = {}
    for b in read(html).blocks:
        bones = skeleton(b.text)
        if b.tag not in PROSE or len(b.text) < LEAST_PROSE or len(bones) < PROBE or b.link_chars > LINK_SHARE * len(b.text):
            continue
        prose += len(bones)
        head, tail = bones[:PROBE], bones[-PROBE:]
        at, hit = hay.find(head, resume.get(head, 0)), None
        while at >= 0:
            end = hay.find(tail, max(at, at + len(bones) - 2 * PROBE), at + len(bones) + PROBE)
            if end >= 0:
                spot = bisect.bisect(taken, (at, len(hay)))  # stretches taken before this one and after it
                if (not spot or taken[spot - 1][1] <= at) and (spot == len(taken) or taken[spot][0] >= end + PROBE):
                    hit = (at, end + PROBE)
                    break
            at = hay.find(head, at + 1)
        if hit:
            bisect.insort(taken, hit)
            resume[head] = hit[1]
            captured += min(len(bones), hit[1] - hit[0])
        else:
            place = next((t for t in reversed(b.within) if t in FURNITURE), b.tag)
            dropped[place] = dropped.get(place, 0) + 1
    return {"basis": "html-prose" if prose else "no-prose", "prose_chars": prose, "captured_chars": captured, "dropped": dropped}
