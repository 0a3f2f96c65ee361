"""The text blocks of a web page, each with where it stands."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+")
SPACES = re.compile(r"[ \t\n\r\f\v\xa0]+")

# Elements by what they do to a page's text.
SKIPPED = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "canvas", "object", "select", "option", "datalist"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
CELLS = {"td", "th"}
TEXT = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "li", "td", "th", "figcaption", "dd", "dt"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BESIDE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "search", "fieldset", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "nav", "navbar", "navigation",
    "menu", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "login", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "disqus", "reply", "replies", "respond", "breadcrumb",
    "breadcrumbs", "pagination", "pager", "widget", "masthead", "topbar", "toolbar", "skip", "disclaimer", "aside",
    "share-buttons", "share-links", "social-links", "social-share", "related-posts", "related-articles", "related-links", "comment-list", "comment-section", "comments-area",
    "newsletter-signup", "subscribe-box", "ad-slot", "ad-container", "ad-banner", "cookie-banner", "cookie-notice", "skip-link",
}
#: Those by which also a paragraph or list item of an article goes.
ADVERTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "share", "sharing", "social",
    "share-buttons", "share-links", "social-links", "social-share", "ad-slot", "ad-container", "ad-banner",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@dataclass
class Block:
    text: str
    inside: bool  # in an article or main element
    beside: bool  # in a menu, a footer, an advert and the like
    heading: bool = False


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(text)}


def stands_beside(tag: str, given: dict[str, str], inside: bool) -> bool:
    """Whether an element holds no main text, by its kind, role, names or being hidden."""
    if tag in ("main", "body", "html") or (tag == "article" and not inside):
        return False
    if tag in BESIDE or (tag == "header" and not inside) or given.get("role", "").lower() in ROLES:
        return True
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        return True
    names = f"{given.get('class', '')} {given.get('id', '')}".lower().split()
    if inside:
        # in an article an element may be named for what it tells of: a heading or paragraph never goes by its name, others only by whole names
        # but for adverts and share items
        return any(name in (ADVERTS if tag in ("p", "li") else NAMES) for name in names) and (tag not in TEXT or tag in ("p", "li"))
    return any(word in NAMES or word == "header" for name in names for word in WORDS.findall(name))


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order, character references decoded and white space made one space.

    An element left open ends with the one around it, a paragraph or list item with
    the next; the first article or main element ends whatever stood beside it.  A later
    article in what stands beside (a comment, say) stands beside too, and so does one in
    an article by its role or names.
    """
    out: list[Block] = []
    words: list[str] = []
    beside: list[str] = []  # open elements of the kind of the outermost that stands beside, that one first
    depth = at = 0  # depth: of articles and mains
    hidden = 0  # articles and mains open in what stands beside
    seen = heading = False  # whether there was an article or main; whether a heading is open

    def close() -> None:
        text = SPACES.sub(" ", html.unescape("".join(words))).strip(" ")
        words.clear()
        if text:
            out.append(Block(text, depth > 0, bool(beside), heading))

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            # a tag cut off by the page's end is no text
            cut = re.search(r"<[a-zA-Z/!][^<>]*\Z", page[at:])
            words.append(page[at : at + cut.start()] if cut else page[at:])
            break
        words.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                words.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in SKIPPED and not closing:
            if not m[3].endswith("/"):
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
            words.append(" " if tag not in BLOCKS else "")
            continue
        if tag in CELLS:
            words.append(" ")
        elif tag in BLOCKS:
            close()
        if tag in HEADINGS:
            heading = not closing
        if closing:
            own = tag not in ("article", "main") or not hidden
            if not own:
                hidden -= 1
            elif tag in ("article", "main"):
                depth = max(0, depth - 1)
            if beside and tag == beside[0]:
                beside.pop()
                hidden = hidden if beside else 0
            elif own and beside and tag in ("article", "main", "body", "html") and depth == 0:
                beside.clear()
                hidden = 0
            continue
        if tag in ("article", "main") and not seen:
            beside.clear()
            hidden = 0
            seen = True
        if beside:
            if beside[0] in ("p", "li") and (tag == beside[0] or (beside[0] == "p" and tag in BLOCKS and tag != "br")):
                beside.clear()
            elif tag == beside[0] and tag not in VOID:
                beside.append(tag)
        if tag in ("article", "main") and not beside and not stands_beside(tag, attributes(m[3]), depth > 0):
            depth += 1
        elif tag in ("article", "main"):
            hidden += 1
        if not beside and tag not in VOID and not m[3].endswith("/"):
            given = attributes(m[3]) if m[3] else {}
            if stands_beside(tag, given, depth > 0):
                if tag not in CELLS and tag not in BLOCKS:
                    close()
                beside.append(tag)
    close()
    return out
