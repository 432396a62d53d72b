"""Text blocks of raw HTML, each with what its place in the page tells of it.

A tolerant reader: unclosed, crossed and cut-off tags are accepted, as browsers
do.  It reads a page once from left to right.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Elements whose content is read as characters up to their end tag, elements whose content is no text, elements without an end, elements that begin a block.
RAW = frozenset("script style noscript textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("template svg math object canvas audio video select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element that a new one of these closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}}
#: Where CLOSES stops to look.
HOLDS = frozenset("ul ol dl table menu dir article section main body".split())
WEAK, STRONG, MAIN = frozenset("nav header form".split()), frozenset("aside footer dialog menu button fieldset legend label search address".split()), frozenset("article main".split())
ROLES = {**dict.fromkeys("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split(), -1), "main": 1, "article": 1}
#: Words in class and id attributes.
OUTSIDE = frozenset(
    "nav navbar navigation menu header footer foot sidebar side aside ad ads advert adverts advertisement advertising adsense banner cookie cookies consent gdpr notice notices alert promo promotion sponsor sponsored comment comments reply replies respond discussion disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager login signup signin subscribe newsletter popup modal overlay widget toolbar copyright masthead skip search form".split()
)
INSIDE = frozenset("article content main post entry story text prose".split())


@dataclass(slots=True)
class Element:
    tag: str
    number: int
    depth: int
    parent: Element | None
    #: +1 inside the article, -1 inside boilerplate that an article overrides, -2 inside any other, 0 unknown.
    context: int
    hidden: bool


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    context: int
    link_share: float
    parent: Element


def _context(tag: str, attributes: str, parent: Element) -> tuple[int, bool]:
    """The context inside an element, and whether it is hidden."""
    now, hidden, named = parent.context, parent.hidden, set()
    if attributes and tag not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                named.update(x.lower() for x in NAME_PART.findall(value))
            elif key == "role":
                role = ROLES.get(value.strip().lower(), 0)
                now = 1 if role > 0 and now > -2 else -2 if role < 0 else now
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                hidden = True
    if tag in MAIN:
        return (1 if now > -2 else now), hidden
    if tag in STRONG:
        now = -2
    elif tag in WEAK:
        now = min(now, -1) if now != 1 else 1 if tag == "header" else -2
    elif named and tag not in ("html", "body", "h1"):
        outside, inside = not OUTSIDE.isdisjoint(named), not INSIDE.isdisjoint(named)
        if outside and not inside:
            now = now if tag == "header" else -2
        elif inside and not outside and now == 0:
            now = 1
    return now, hidden


def blocks(page: str) -> list[Block]:
    """The page's text blocks in page order: characters decoded, white space single, none empty."""
    root = Element("", 0, 0, None, 0, False)
    stack, out, parts, linked, made = [root], [], [], 0, 0
    in_link = 0
    held: Counter[str] = Counter()  # open elements by tag, so that nothing is looked for that is not there

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].hidden:
            parts.append(html.unescape(raw) if "&" in raw else raw)
            if in_link:
                linked += len(raw)

    def flush() -> None:
        nonlocal linked
        if parts:
            joined = "".join(parts)
            if shown := " ".join(joined.split()):
                holder = next((e for e in reversed(stack) if e.tag in BLOCK or e is root), root)
                out.append(Block(shown, holder.tag, stack[-1].context, min(1.0, linked / len(joined)), holder))
            parts.clear()
        linked = 0

    def close(tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        """Pop down to the nearest open element of ``tags`` if none of ``stop`` is above it."""
        nonlocal in_link
        if not any(held[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                if stack[i].context != stack[i - 1].context:
                    flush()
                in_link -= sum(e.tag == "a" for e in stack[i:])
                held.subtract(e.tag for e in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    at = 0
    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
            close({tag}, frozenset() if tag in BLOCK or tag in UNSEEN else BLOCK)
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in RAW and attributes and attributes.rstrip().endswith("/") and any(e.tag in ("svg", "math") for e in stack):
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
            if tag not in ("br", "button"):
                close({"p"}, HOLDS | UNSEEN)
            if tag in CLOSES:
                close(CLOSES[tag], HOLDS | UNSEEN)
        if tag in VOID:
            continue
        if attributes and attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        made += 1
        context, hidden = _context(tag, attributes or "", stack[-1])
        hidden |= tag in UNSEEN
        if context != stack[-1].context:
            flush()
        stack.append(Element(tag, made, len(stack), stack[-1], context, hidden))
        held[tag] += 1
        in_link += tag == "a"
    text(page[at:])
    flush()
    return out
