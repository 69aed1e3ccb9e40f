"""A page as blocks of text in zones, from its markup alone.

Zones: article, main (inside main or the like, but no article), chrome (inside menus, headers, footers, sidebars,
notices, adverts, forms, comments), open (none of these); and article? and main? for parts of these whose class or id
only hints at chrome (related-work, social-history), where what the host repeats has to tell.
"""

from __future__ import annotations

import html
import re

#: Fixed values of HTML: elements by what they do to text, and words in class, id and role that tell what a part is.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
CONTAINER = BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 hr li dd dt".split()) | {"td", "th"}
UNSEEN = frozenset("head title style script noscript template iframe object embed canvas svg math audio video select option datalist textarea button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
CHROME = frozenset("nav footer aside form menu dialog search".split())
ARTICLE_WORDS = frozenset("article articlebody post entry story main".split())
CHROME_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside complementary banner contentinfo ad ads advert adverts advertisement advertising promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login breadcrumb breadcrumbs share sharing social related recommended pagination pager toolbar widget comment comments disqus respond reply replies search form skip".split()
)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|</[^>]*>", re.S
)
#: Words that tell as parts of a longer name too (site-footer, comment_list); the others only hint there.
FIRM_PARTS = frozenset(
    "nav navbar navigation menu masthead footer sidebar aside breadcrumb breadcrumbs ad ads advert adverts advertisement cookie cookies consent gdpr newsletter comment comments disqus pagination pager toolbar login signup".split()
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")  # name and value, so that no value is taken for a name
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names(value: str) -> tuple[set[str], set[str]]:
    """The names in a class, id, role or itemprop: whole ones, and the parts of longer ones."""
    whole, parts = set(), set()
    for name in value.split():
        own = [p.lower() for p in _PART.findall(name)]
        if len(own) == 1:
            whole.add(own[0])
        else:
            parts.update(own)
    return whole, parts


def _role_of(tag: str, attributes: str, inside_article: bool) -> str:
    """'article', 'main', 'chrome', 'hidden', 'hint' or ''."""
    if tag in UNSEEN:
        return "hidden"
    found: dict[str, str] = {}
    if attributes and not attributes.isspace():
        for name, *values in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), "".join(values))
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return "hidden"
    whole, parts = _names(" ".join(found.get(a, "") for a in ("class", "role", "itemprop")))
    own_id, id_parts = _names(found.get("id", "")) if tag not in HEADINGS else (set(), set())  # a heading's id is its title
    if tag in ("article", "main"):
        return "chrome" if (whole | parts | own_id | id_parts) & COMMENT_WORDS else tag
    if tag in CHROME or tag == "header" and not inside_article:
        return "chrome"
    if tag in ("body", "html"):
        return ""
    firm = (whole | own_id) & CHROME_WORDS | parts & FIRM_PARTS
    if firm and not (inside_article and firm <= {"header"}):
        return "chrome"
    if tag in ("div", "section") and (whole | parts | own_id | id_parts) & ARTICLE_WORDS:
        return "article" if "articlebody" in {x.lower() for x in found.get("itemprop", "").split()} else "main"
    hint = (parts | id_parts) & CHROME_WORDS
    return "hint" if hint and not (inside_article and hint <= {"header"}) else ""


def page_blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of each block of a page in page order, without empty ones.

    Character references are decoded, white space inside a block is one space. An end tag closes what is open inside
    its element; one without an element does nothing; what is never closed ends with the element around it.
    """
    blocks: list[tuple[str, str]] = []
    stack: list[tuple[str, str, bool]] = []  # tag, zone inside, unseen inside
    parts: list[str] = []
    zone, unseen = "open", False

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((zone, text))
            parts.clear()

    def reset() -> None:
        nonlocal zone, unseen
        _, zone, unseen = stack[-1] if stack else ("", "open", False)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not unseen:
            parts.append(page[at : m.start() if m else n])
        if m is None:
            break
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        elif tag in ("br", "td", "th") and not unseen:
            parts.append(" ")
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(s[0] in BLOCK for s in stack[i:]) or stack[-1][1] != (stack[i - 1][1] if i else "open"):
                        flush()
                    del stack[i:]
                    reset()
                    break
                if stack[i][0] in CONTAINER and tag not in CONTAINER:
                    break
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in BLOCK:  # a block ends an open paragraph, an item the item before it
            ends = {"p", "li"} if tag == "li" else {"p", "dd", "dt"} if tag in ("dd", "dt") else {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CONTAINER:
                    break
                if stack[i][0] in ends:
                    del stack[i:]
                    reset()
                    break
        role = _role_of(tag, attributes, zone.rstrip("?") in ("article", "main"))
        inside = zone
        if role in ("article", "main") and (zone != "chrome" or tag in ("article", "main") and not any(s[0] in CHROME for s in stack)):
            inside = zone if zone.startswith("article") else role
        elif role == "chrome":
            inside = "chrome"
        elif role == "hint" and zone != "chrome":
            inside = "chrome" if zone == "open" else zone.rstrip("?") + "?"
        if inside != zone:
            flush()
        if role == "hidden" and not unseen and tag in BLOCK:
            flush()
        stack.append((tag, inside, unseen or role == "hidden"))
        if tag in RAW and (close := re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)):
            stack.pop()
            at = close.end()
            continue
        reset()
    flush()
    return blocks
