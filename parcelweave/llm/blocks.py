"""The text blocks of a page, in order, with what its markup says about each."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# What the markup says of a block: part of the template, undecided, or inside the page's own article.
TEMPLATE, OPEN, ARTICLE = 0, 1, 2

# Comments, declarations and tags; a quote inside a tag may hold '>'. An unclosed comment reaches to the end.
MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
TOKENS = re.compile(r"[a-z]+")

RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "object", "select", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEMPLATE_TAGS = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "fieldset"}
TEMPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog",
                  "menu", "menubar", "toolbar"}
TEMPLATE_WORDS = {
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo",
    "promotion", "reply", "replies", "related", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget"}
# A start tag of the first kind ends an open element of the second, back to the nearest of the third.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Element(NamedTuple):
    tag: str
    dropped: bool
    article: bool


def _is_template(tag: str, attributes: str) -> bool:
    """Whether an element is a part of the page's template."""
    if tag in TEMPLATE_TAGS or tag == "header":
        return True
    if tag in ("html", "body", "main") or not attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role":
            if value.strip() in TEMPLATE_ROLES:
                return True
            continue
        for word in value.split():
            if not word.startswith(("has-", "with-", "no-")) and not TEMPLATE_WORDS.isdisjoint(TOKENS.findall(word)):
                return True
    return False


def _raw_end(page: str, tag: str, start: int) -> tuple[int, int]:
    """Where the end tag of an element without markup inside begins and ends; the end of the page if there is none."""
    found = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, start)
    return found.span() if found else (len(page), len(page))


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) of each block that is not empty, character references decoded and white space made one space.

    Block elements begin and end blocks, as each part of a list or table does; inline ones and line breaks (white space) do not. Elements that hold no text of
    the page (scripts, styles, titles, templates, embedded frames) give none. Markup may be unclosed or wrongly nested.
    """
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack = [Element("", False, False)]

    def kind() -> int:
        top = stack[-1]
        return TEMPLATE if top.dropped else ARTICLE if top.article else OPEN

    def close() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, kind()))
        parts.clear()

    def pop_to(tag: str) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag == tag:
                close()
                del stack[at:]
                return

    at, size = 0, len(page)
    while at < size:
        found = MARKUP.search(page, at)
        if found is None:
            break
        if found.start() > at:
            parts.append(html.unescape(page[at:found.start()]))
        at = found.end()
        end, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if tag in INLINE:
                if stack[-1].tag == tag:
                    pop_to(tag)
            else:
                close()
                pop_to(tag)
            continue
        if tag in RAW and not attributes.endswith("/"):
            _, at = _raw_end(page, tag, at)
            continue
        if tag in VOID:
            if tag in ("br", "wbr"):
                parts.append(" " if tag == "br" else "")
            elif tag == "hr":
                close()
            continue
        top = stack[-1]
        dropped = top.dropped or _is_template(tag, attributes)
        if tag in INLINE:
            if dropped and not top.dropped:
                close()
                stack.append(Element(tag, True, top.article))
            elif top.tag == tag:  # the end of this one must not end the element around it
                stack.append(Element(tag, top.dropped, top.article))
            continue
        close()
        below = len(stack) - 1
        while stack[below].tag in INLINE:
            below -= 1
        if stack[below].tag == "p":
            del stack[below:]
        if tag in IMPLIED_ENDS:
            ended, bounds = IMPLIED_ENDS[tag]
            for back in range(len(stack) - 1, 0, -1):
                if stack[back].tag in bounds:
                    break
                if stack[back].tag in ended:
                    del stack[back:]
                    break
        top = stack[-1]
        article = top.article or tag in ("article", "main")
        dropped = top.dropped or _is_template(tag, attributes)
        if tag in HEADINGS and top.dropped and top.article and next(e.tag for e in stack if e.dropped) == "header":
            dropped = _is_template(tag, attributes)  # of an article's own header the headings are text
        stack.append(Element(tag, dropped, article))
    if at < size:
        parts.append(html.unescape(re.split("</?[a-zA-Z]", page[at:], maxsplit=1)[0]))  # an unfinished tag is none
    close()
    return out


def lines(page: str) -> list[tuple[str, int]]:
    """The blocks of a page; if it marks an article, what lies outside that is template."""
    found = blocks(page)
    if any(kind == ARTICLE for _, kind in found):
        return [(text, kind if kind == ARTICLE else TEMPLATE) for text, kind in found]
    return found
