"""Main content of pages: a block tree, visibility rules and a renderer.

A body is read line by line into a tree. Tags are implied by layout: a run of
lines without a blank line is a ``div``, bullets imply a list, bars or columns a
table, fences a code block, ``#`` a heading that opens a section; literal HTML
containers are honoured and their missing end tags implied. Visibility rules
then hide furniture (menus, breadcrumbs, notices, teasers, footers), a hidden
head hides what hangs on it, and a ``div`` of mixed lines with one hidden line
is hidden whole. The renderer emits the visible text with block spacing, list
markers and aligned table cells. What it does not emit is the furniture.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from vellichor.llm.encoding import readings
from vellichor.llm.residue import ResidueModel, ResidueScorer, fit, fold

# Own lists: words of menus, by language.
MENU_WORDS = {
    "en": "home news about contact search login log in sign in sign up register subscribe help maps services weather archive topics jobs gallery events menu account shop sport opinion video photos podcasts newsletters settings",
    "de": "startseite nachrichten kontakt suche hilfe karten themen termine anmelden archiv über uns dienste wetter menü konto",
    "fr": "accueil actualités contact recherche aide cartes dossiers agenda connexion archives services météo à propos menu compte",
    "ko": "홈 뉴스 소개 문의 검색 로그인 구독 도움말 지도 자료실 주제 행사 날씨 메뉴 회원가입",
    "ja": "ホーム ニュース 概要 お問い合わせ 検索 ログイン 購読 ヘルプ 地図 アーカイブ 特集 イベント 天気 メニュー",
    "zh": "首页 新闻 关于 联系 搜索 登录 订阅 帮助 地图 归档 专题 活动 天气 菜单 注册",
    "ru": "главная новости о нас контакты поиск войти подписка помощь карты архив темы события погода меню",
}
HOME_WORDS = ["home", "startseite", "accueil", "홈", "ホーム", "首页", "главная"]
# Own lists: patterns of furniture lines, by kind; matched from the start of folded lines in lower case.
FURNITURE = {
    "skip link": r"^(skip to (main )?content|zum inhalt springen|aller au contenu|본문 바로가기|本文へ(移動|スキップ)|跳到正文|跳至内容|перейти к содержан\w+|к содержанию)$",
    "top link": r"^(back to (the )?top|nach oben|zum seitenanfang|haut de (la )?page|retour en haut|맨 위로|ページの先頭へ|页首|返回顶部|наверх|вверх)\s*[↑▲^]?$",
    "advertisement": r"^\W*(advertisement|sponsored( content)?|anzeige|werbung|publicité|광고|広告|スポンサー|广告|реклама)\W*$",
    "continue": r"^(continue reading below|story continues below.*|article continues below.*|weiterlesen|lire la suite|계속 읽기|続きを読む|继续阅读|читать далее)$",
    "cross link": r"^\W*(read also|read more|see also|lesen sie auch|lire aussi|à lire aussi|함께 읽기|あわせて読む|延伸阅读|相关阅读|另请阅读|читайте также)\s*[:：].+",
    "comments": r"^(loading comments|kommentare werden geladen|chargement des commentaires|댓글.{0,8}불러오는|コメントを読み込|评论加载|загрузка комментариев)|^(\d+ comments?|comments? \(\d+\)|\d+ kommentare|\d+ commentaires?|댓글 \d+개|コメント\s?\d+件|\d+ ?条评论|评论 ?\d+|комментари\w+:? ?\d+|\d+ комментари\w+)",
    "cookie settings": r"^cookie (preferences|settings|policy)\b",
    "privacy notice": r"^(your privacy matters|we value your privacy|we and our \d* ?partners|nous et nos \d* ?partenaires|wir und unsere \d* ?partner)\b",
    "share": r"^(share( this( page| article)?)?|teilen|partager|공유하기|共有する|シェア|分享|поделиться)\s*(\||:|：|·|・|、|/|-).+",
    "helpful": r"^(was this (page|article) helpful|war diese seite hilfreich|cette page vous a-t-elle|cette page est-elle utile|이 페이지가 도움이|このページは役に立|このページは参考|本页(是否)?有(用|帮助)|страница была полезн|была ли (эта )?страница)",
    "newsletter": r"^(sign up for (our|the)|subscribe to (our|the)|get .{1,60} in your inbox|inscrivez-vous à|abonnez-vous|jetzt (unseren |den )?(rundbrief|newsletter)|.{1,60} kompakt – jeden|주간 소식지|.{1,40} 소식을 메일로|週刊メール|メールマガジン|订阅(每周)?(通讯|周报)|подпишитесь на)",
    "support": r"^(support independent|become a member|unterstützen sie|soutenez|후원|ご支援|支持独立)\b.*",
    "copyright": r"^(©|\(c\)|copyright\b)",
    "legal links": r"^(imprint|impressum|terms( of use)?|mentions légales|이용약관|利用規約|使用条款|условия|privacy|datenschutz|правила)\s*(\||｜|·|•|/|–).+",
    "generator": r"^(powered by|proudly powered|site map|sitemap|plan du site|seitenübersicht|theme:)\b.*",
    "registry": r"^(registered office|registry entry|company registration|handelsregister|registergericht|amtsgericht|sitz der gesellschaft|rcs |r\.c\.s|siège social|등록번호|사업자등록번호|登録番号|発行所|备案|.{0,3}icp备|свидетельство о регистрации|рег\. ?№|зарегистрирован).*",
    "imprint": r"^(editor|redaktion|verantwortlich|rédaction|directeur de la publication|발행인|편집인|発行人|編集|主编|редактор|ответственный)\s?[:：].+·.+",
    "reading time": r"^listen \(\d+ min\)$|^\d+ min(ute)? read$",
}
COOKIE_NOTICE = r"(cookie|クッキー|쿠키|файлы cookie).*(accept|agree|reject|refus|allow|ok\b|decline|continu|zustimm|akzeptier|ablehn|verwendung|einstellung|accord|tout|vous acceptez|허용|동의|설정|許可|同意|拒否|閉じる|接受|同意|知道了|拒绝|принять|соглаша|отклон|понятно)"
RIGHTS_RESERVED = r"(all rights reserved|alle rechte vorbehalten|tous droits réservés|무단 ?전재|無断転載|版权所有|保留所有权利|все права защищены)\W*$"
# Own lists: heads of teaser lists.
TEASER_HEADS = r"^(you may also like|you might also like|most read|most popular|popular (this week|now)|related (articles|stories|posts)|in this section|more from .{1,60}|recommended( for you)?|trending( now)?|verwandte (beiträge|artikel)|meistgelesen|mehr aus .{1,60}|das könnte sie.*|à lire aussi|les plus lus|plus (de|sur) .{1,60}|sur le même sujet|articles liés|관련 기사|많이 본 글|(.{1,40} )?더 보기|관련 글|関連記事|よく読まれている記事|おすすめ記事|.{1,30}の(記事一覧|話題)|.{1,40}のほかの記事|相关(阅读|文章)|热门(文章|阅读)|更多.{1,30}|.{1,30}更多内容|читайте также|популярное|самое читаемое|ещё .{1,60}|еще .{1,60}|другие материалы.*)\s*[:：]?$"  # noqa: E501

_MENU = frozenset(fold(w) for words in MENU_WORDS.values() for w in words.split()) | {"über uns", "à propos", fold("о нас"), "log in", "sign in", "sign up"}
_FURNITURE = re.compile("|".join(f"(?:{fold(p)})" for p in FURNITURE.values()))
_COOKIES = re.compile(fold(COOKIE_NOTICE))
_RIGHTS = re.compile(fold(RIGHTS_RESERVED))
_TEASER = re.compile(fold(TEASER_HEADS))
_HEAD_MARKS = re.compile(r"^\s*(?:#{1,6}\s+|\*\*(?=.*\*\*\s*$))|\*\*\s*$")
_BULLET = re.compile(r"^\s*(?:[-*+•‐‑]|\d{1,3}[.)])\s+")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_ITEMS = re.compile(r"\s+[|·•»›>/–—-]\s+|\s*[｜|]\s*|\s*[・]\s*|\s{2,}")
_CRUMB = re.compile(fold(rf"^(?:{'|'.join(HOME_WORDS)})\s*[›>/»]\s*\S"))
_SENTENCE_END = re.compile(r"[.!?。！？…:：;»”\"』」)]\s*$")
_SENTENCES = re.compile(r"(?<=[.!?。！？])\s*")
_STOP = re.compile(r"[.!?。！？]\s*\S")  # a sentence goes on behind another
_COLUMNS = re.compile(r"\S(?:\t+|\s{2,})[\d.,%-]+(?:(?:\t+|\s{2,})\S+)*\s*$")
_HIDDEN_TAGS = "nav aside footer script style noscript form button iframe"
_OPEN = re.compile(rf"^\s*<({_HIDDEN_TAGS.replace(' ', '|')})\b[^>]*>", re.IGNORECASE)
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in _HIDDEN_TAGS.split()}


def is_menu(line: str) -> bool:
    """Entries side by side, half of them known from menus, or four and more short ones with one known; ``line`` is folded and in lower case."""
    if line.lstrip().startswith("|"):
        return False
    items = [x for x in _ITEMS.split(line.strip()) if x]
    if len(items) < 2:
        return False
    known = sum(x in _MENU for x in items)
    if known >= 2 and known * 2 >= len(items):
        return True
    short = all(len(x.split()) <= 2 and len(x) <= 18 and not re.search(r"[\d.,;:!?。]", x) for x in items)
    return len(items) >= 4 and short and known >= 1


def looks_like_furniture(line: str) -> bool:
    """Whether a line is furniture by itself."""
    line = fold(line.lower()).strip()
    if not line or line.startswith(("# ", "|")):
        return False
    bare = _HEAD_MARKS.sub("", line).strip()
    return bool(_FURNITURE.match(bare) or _CRUMB.match(bare) or _is_notice(bare) or is_menu(bare))


def _is_notice(line: str) -> bool:
    """Whether sentences that a notice on rights or cookies lies in make up a quarter of a line or more, however long it is."""
    found = [m.span() for kind in (_RIGHTS, _COOKIES) for m in kind.finditer(line)]
    if not found:
        return False
    ends = [m.end() for m in _SENTENCES.finditer(line) if m.end() < len(line)] + [len(line)]
    own = sum(b - a for a, b in zip([0, *ends], ends) if any(x < b and y > a for x, y in found))
    return 4 * own >= len(line)


def is_teaser_head(line: str) -> bool:
    return not _STOP.search(line) and bool(_TEASER.match(_HEAD_MARKS.sub("", fold(line.lower())).strip()))


@dataclass
class Node:
    """A block: its implied tag, its lines by number, and whether it is shown."""

    tag: str
    lines: list[tuple[int, str]] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    visible: bool = True


def _line_tag(line: str) -> str:
    if line.startswith("#") and re.match(r"#{1,6}\s", line):
        return "h" + str(len(line) - len(line.lstrip("#")))
    if _BULLET.match(line):
        return "li"
    if line.lstrip().startswith("|"):
        return "tr"
    if _COLUMNS.search(line):
        return "row"
    if line.lstrip().startswith(">"):
        return "quote"
    return "p"


def build_tree(body: str) -> Node:
    """The block tree of a body: divs of tagged lines, and pre and hidden containers whose end may be implied by the end of the text."""
    root = Node("body")
    div: Node | None = None
    held, closing = "", None
    for number, line in enumerate(body.split("\n")):
        if held:
            root.children[-1].lines.append((number, line))
            if (held == "pre" and _FENCE.match(line)) or (closing and closing.search(line)):
                held, closing = "", None
            continue
        if not line.strip():
            div = None
            continue
        if _FENCE.match(line):
            root.children.append(Node("pre", [(number, line)]))
            held, div = "pre", None
            continue
        if opened := _OPEN.match(line):
            tag = opened.group(1).lower()
            root.children.append(Node(tag, [(number, line)], visible=False))
            div = None
            if not _CLOSE[tag].search(line):
                held, closing = tag, _CLOSE[tag]
            continue
        if div is None:
            div = Node("div")
            root.children.append(div)
        tag = _line_tag(line)
        if div.children and div.children[-1].tag == tag and tag in ("li", "tr", "row", "quote"):
            div.children[-1].lines.append((number, line))
        else:
            div.children.append(Node(tag, [(number, line)]))
    return root


def _kind(line: str) -> int:
    return 2 if is_teaser_head(line) else int(looks_like_furniture(line))


class Visibility:
    """The rules of one worker; remembers lines, as furniture recurs."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def kind(self, line: str) -> int:
        """2: head of a teaser list, 1: furniture, 0: neither. A line that may be garbled is also judged by what it may have been."""
        known = self.memo.get(line)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            known = _kind(line)
            if not known and not line.isascii() and not _SENTENCE_END.search(line):
                known = max(map(_kind, readings(line)), default=0)
            self.memo[line] = known
        return known

    def menu_list(self, node: Node) -> bool:
        items = [_BULLET.sub("", fold(text.lower())).strip() for _, text in node.lines]
        known = sum(x in _MENU for x in items)
        return len(items) >= 2 and known * 2 >= len(items) and all(len(x) <= 24 for x in items)

    def teaser(self, div: Node) -> bool:
        """A head with two or more titles right below it: no line is a sentence, and no blank line stands between."""
        if len(div.children) < 2 or div.children[0].tag not in ("p", "h2", "h3", "h4") or any(n.tag not in ("p", "li") for n in div.children[1:]):
            return False
        lines = [text for n in div.children for _, text in n.lines]
        return len(lines) >= 3 and not any(_SENTENCE_END.search(x) or " = " in x for x in lines)

    def apply(self, root: Node) -> None:
        """Hide nodes: furniture lines, menus as lists, what hangs on a teaser head, and mixed divs that hold any of these."""
        for div in root.children:
            if div.tag != "div":
                continue
            hidden = False
            for node in div.children:
                if node.tag == "li" and self.menu_list(node):
                    node.visible = False
                elif node.tag not in ("h1", "tr", "row") and all(self.kind(text) for _, text in node.lines):
                    node.visible = False
                hidden |= not node.visible
            hidden |= self.teaser(div)
            if hidden and len(div.children) > 1:
                self._spread(div)

    def _spread(self, div: Node) -> None:
        """In a div of mixed lines only a page title, tables and full sentences beside plain lists stay."""
        for node in div.children:
            if node.tag in ("h1", "tr", "row"):
                continue
            node.visible = False


def furniture_lines(body: str, rules: Visibility) -> list[int]:
    """Numbers of the non-empty lines that the renderer does not emit."""
    root = build_tree(body)
    rules.apply(root)
    out: list[int] = []
    for block in root.children:
        for node in block.children or [block]:
            if not (block.visible and node.visible):
                out.extend(n for n, text in node.lines if text.strip())
    return out


def render(body: str, rules: Visibility | None = None) -> str:
    """The visible text: blocks a blank line apart, list markers kept, table cells aligned."""
    root = build_tree(body)
    (rules or Visibility()).apply(root)
    blocks: list[str] = []
    for block in root.children:
        if not block.visible:
            continue
        lines: list[str] = []
        for node in block.children or [block]:
            if not node.visible:
                continue
            texts = [text for _, text in node.lines]
            if node.tag == "tr":
                cells = [[c.strip() for c in t.strip().strip("|").split("|")] for t in texts]
                widths = [max(len(r[i]) if i < len(r) else 0 for r in cells) for i in range(max(map(len, cells)))]
                texts = ["| " + " | ".join(c.ljust(w) for c, w in zip(r + [""] * (len(widths) - len(r)), widths)) + " |" for r in cells]
            lines.extend(texts)
        if lines:
            blocks.append("\n".join(lines))
    return "\n\n".join(blocks)


def furniture(versions: DataFrame, model: ResidueModel | None = None) -> DataFrame:
    """``(version_id, line_no)`` of each line that is not main body, in versions that are no residue.

    Lines are the body split at line feeds, from 0; empty and blank lines never
    count. Null and empty bodies have none. Replays count once. The body is read
    and scored where it lies; only the pairs found are shuffled.
    """
    model = model or fit(versions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, rules = ResidueScorer(model), Visibility()
        for batch in batches:
            ids: list[str | None] = []
            numbers: list[int] = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not body or not (found := furniture_lines(body, rules)) or scorer.is_residue(body, looks_like_furniture):
                    continue
                ids.extend([key] * len(found))
                numbers.extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int32())], ["version_id", "line_no"])

    return versions.select("version_id", "content_blob").mapInArrow(run, "version_id string, line_no int").distinct()


def main_text(versions: DataFrame) -> DataFrame:
    """``(version_id, main_text)`` of every row: the rendered main body; null stays null, a body of furniture becomes empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Visibility()
        for batch in batches:
            texts = [None if b is None else render(b, rules) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["version_id", "main_text"])

    return versions.select("version_id", "content_blob").mapInArrow(run, "version_id string, main_text string")
