"""Blocks of text of one HTML page, with their places in its element tree.

Plain Python for use inside tasks. Markup is read as browsers read it where it
matters for text: void elements, implied ends of p, li and the like, end tags
without a start, raw text of scripts, comments, references without semicolon.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title noscript iframe xmp noembed noframes template svg math select"
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
ENDS_BEFORE = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
SCOPES = frozenset("html table td th caption button object template".split())

# Elements and words of class names, ids and roles that name parts around an article.
NOISE_TAGS = frozenset("aside button dialog footer form head menu nav search".split())
NOISE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies copyright disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices "
    "pagination popup promo promoted related search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "teaser toolbar widget".split()
)
# Parts around an article that can hold articles of their own: teasers, comments. All other
# noise may as well be the wrapper of a whole page that is named after one of its parts.
SEALED_TAGS = NOISE_TAGS - {"form"}
SEALED_WORDS = frozenset("comment comments disqus footer related teaser promo promoted sponsor sponsored".split())
HEADER_WORDS = frozenset(["header", "masthead", "banner"])
WHOLE = frozenset("html body main article".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW.replace(' ', '|')})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORDS = re.compile(r"[a-z]+")

NEUTRAL, NOISE, ARTICLE = "", "-", "+"


@dataclass
class Element:
    tag: str
    path: str
    role: str
    sealed: bool = False
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    """``path`` begins with the role of the branch; ``siblings`` are the kinds
    of children of the element around it, in order, runs taken together;
    ``sealed`` are blocks inside parts that are noise whatever they hold."""

    path: str
    role: str
    siblings: list[str]
    text: str
    sealed: bool


def role_within(outer: str, tag: str, names: set[str], sealed: bool) -> str:
    if tag == "main" or (outer == NOISE and not sealed and (tag == "article" or (tag == "div" and "main" in names and not names & NOISE_WORDS))):
        return ARTICLE
    if outer == NOISE or tag in NOISE_TAGS:
        return NOISE
    if tag == "article":
        return ARTICLE
    if tag not in WHOLE:
        if names & NOISE_WORDS or (outer != ARTICLE and (tag == "header" or names & HEADER_WORDS)):
            return NOISE
        if "main" in names and tag == "div":
            return ARTICLE
    return outer


def blocks_of(page: str) -> list[Block]:
    root = Element("", "", NEUTRAL)
    stack, parts, blocks = [root], [], []

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                holder = next(e for e in reversed(stack) if e.tag in BLOCK or e is root)
                inside = stack[max(0, stack.index(holder) - 1)]
                blocks.append(Block(holder.role + holder.path, holder.role, inside.children, text, holder.sealed))

    def end(tags, limits=frozenset()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in limits:
                return

    at = 0
    for match in TOKEN.finditer(page):
        if match.start() > at:
            parts.append(page[at : match.start()])
        at = match.end()
        closing, tag, rest = (match[2], match[3], match[4]) if match[3] else (match[5], match[6], match[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if closing:
            if tag not in VOID:
                end({tag})
            continue
        if tag in CLOSES_P:
            end({"p"}, SCOPES)
        if tag in ENDS_BEFORE:
            end(*ENDS_BEFORE[tag])
        if tag in VOID:
            continue
        names = {w for m in NAMES.finditer(rest or "") for w in WORDS.findall((m[2] or m[3] or m[4] or "").lower())} if rest else set()
        outer = stack[-1]
        kind = ".".join([tag, *sorted(names)])
        if tag in BLOCK and (not outer.children or outer.children[-1] != kind):
            outer.children.append(kind)
        path = f"{outer.path}/{kind}" if tag in BLOCK else outer.path
        role = role_within(outer.role, tag, names, outer.sealed)
        sealed = role == NOISE and (outer.sealed or tag in SEALED_TAGS or (tag not in WHOLE and bool(names & SEALED_WORDS)))
        stack.append(Element(tag, path, role, sealed))
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!][^>]*\Z", rest)  # a tag that the page breaks off in
        parts.append(rest[: cut.start()] if cut else rest)
    flush()
    return blocks
