"""A small tolerant reader of HTML: elements, their subtree hashes, and the text blocks of the main part."""

from __future__ import annotations

import html as entities
import re

import xxhash

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("""html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr
    td th blockquote pre figure figcaption header footer nav aside form fieldset address hr details summary menu dialog
    center""".split())
#: An opening tag ends an open element of these tags, up to the nearest element of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_ENDS_P = BLOCK - {"td", "th", "tr", "li", "dt", "dd", "caption", "thead", "tbody", "tfoot", "html", "body"}
_P_SCOPE = frozenset("article section div main td th li blockquote table aside nav header footer body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a piece of prose or data; alike on many pages they are still mostly content.
PROSE = HEADINGS | frozenset("p li dt dd tr td th caption blockquote pre figcaption".split())
#: Elements that hold no prose of an article, by tag, role, and words of class and id.
DROPPED = frozenset("""nav aside footer form button input select option textarea script style noscript template iframe object
    embed svg canvas audio video dialog menu head title xmp noembed noframes""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
WORDS = frozenset("""nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead ad ads advert adverts
    advertisement adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal newsletter
    subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist
    disqus respond replies reply pagination pager toolbar widget login search skip""".split())
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TAG_REST = re.compile(r"""(?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?)*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_WORDS_OF = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])|\\Z", re.I) for t in RAW}


class Element:
    __slots__ = ("tag", "parts", "attributes", "parent", "size", "hash", "holds_main")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.parts: list = []  # texts and elements in order
        self.size = self.hash = 0
        self.holds_main = False


def _tag_end(html: str, at: int) -> int:
    """Index after the tag whose attributes begin at ``at``; a '>' inside a quoted value does not end it, however
    long the value. A quote opens a value only after '='; one that is never closed is no quote."""
    end = html.find(">", at)
    if end < 0:
        return len(html)
    if html.find('"', at, end) < 0 and html.find("'", at, end) < 0:
        return end + 1
    tag = _TAG_REST.match(html, at)
    return tag.end() if tag else end + 1


def parse(html: str) -> Element:
    """Tree of a page. Unclosed elements end with their parent, stray end tags are ignored."""
    root = Element("#root", "", None)
    here, at, n = root, 0, len(html)
    opened = {"#root": 1}

    def close(to: Element) -> None:
        nonlocal here
        while here is not to:
            opened[here.tag] -= 1
            here = here.parent

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            here.parts.append(html[at:lt])
        if lt == n:
            break
        mark = html[lt + 1:lt + 2]
        if mark == "!" or mark == "?":
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = mark == "/"
        name = _NAME.match(html, lt + 1 + closing)
        if not name:
            here.parts.append("<")
            at = lt + 1
            continue
        tag, at = name[0].lower(), _tag_end(html, name.end())
        if closing:
            if opened.get(tag):
                to = here
                while to.tag != tag:
                    to = to.parent
                close(to.parent)
            elif tag == "br":
                here.parts.append(Element("br", "", here))
            continue
        if tag in _ENDS_P and opened.get("p"):
            to = here
            while to.tag != "p" and to.tag not in _P_SCOPE and to.parent:
                to = to.parent
            if to.tag == "p":
                close(to.parent)
        if tag in CLOSES:
            ended, scope = CLOSES[tag]
            to, last = here, None
            while to.tag not in scope and to.parent:
                if to.tag in ended:
                    last = to
                to = to.parent
            if last is not None:
                close(last.parent)
        tail = html[name.end():at]
        new = Element(tag, tail.rstrip(">"), here)
        here.parts.append(new)
        if tag in VOID or tail.endswith("/>") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            stop = _RAW_END[tag].search(html, at).start()
            new.parts.append(html[at:stop])
            at = _tag_end(html, stop) if stop < n else n
            continue
        opened[tag] = opened.get(tag, 0) + 1
        here = new
    _measure(root)
    return root


def _measure(root: Element) -> None:
    """Sizes and subtree hashes, children first, without recursion."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo.extend(p for p in e.parts if type(p) is Element)
    for e in reversed(order):
        pieces = [e.tag.encode(), e.attributes.encode("utf-8", "replace") if e.tag not in ("a", "img") else b""]
        for p in e.parts:
            if type(p) is Element:
                e.size += p.size
                e.holds_main |= p.holds_main or p.tag in ("article", "main")
                pieces.append(p.hash.to_bytes(8, "big"))
            else:
                words = p.split()
                if words:
                    if e.tag not in DROPPED:
                        e.size += sum(map(len, words))
                    pieces.append(" ".join(words).encode("utf-8", "replace"))
        e.hash = xxhash.xxh3_64_intdigest(b"\0".join(pieces))


def attributes(e: Element) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(e.attributes)} if e.attributes else {}


def boilerplate(e: Element, page_size: int) -> bool:
    """Whether an element is menu, header, footer, notice, advert, form, comment and the like.

    What holds the article, or most of a page's text, is not judged by its class or id.
    """
    if e.tag in DROPPED:
        return not e.holds_main
    if not e.attributes or e.tag in ("html", "body", "main"):
        return False
    told = attributes(e)
    if "hidden" in told or told.get("aria-hidden") == "true" or "display:none" in told.get("style", "").replace(" ", "").lower():
        return not e.holds_main
    if e.holds_main or 5 * e.size > 3 * page_size:
        return False
    if told.get("role", "").lower() in ROLES:
        return True
    words = {w.lower() for w in _WORDS_OF.findall(told.get("class", "") + " " + told.get("id", ""))}
    return not words.isdisjoint(WORDS)


def main_parts(root: Element) -> list[Element]:
    """The elements whose text is the page's: its articles, else its main part, else all of it."""
    size = root.size
    articles, mains, todo = [], [], [root]
    while todo:
        e = todo.pop()
        if e.tag == "article":
            if e.size and not boilerplate(e, max(size, 1)):
                articles.append(e)
            continue
        if e.tag == "main" or e.attributes and attributes(e).get("role", "").lower() == "main":
            mains.append(e)
        if not boilerplate(e, max(size, 1)):
            todo.extend(p for p in reversed(e.parts) if type(p) is Element)
    if articles:
        return articles
    return mains[:1] or [root]


def subtrees(root: Element) -> tuple[dict[int, bool], int]:
    """Hashes of the subtrees that may be a site's template, each with whether it is a piece of prose, and a
    fingerprint of the page's main text.

    Counted are block elements with text that do not hold the main part; inside an article only sections
    and lists that are not its whole, since its paragraphs are content however often they recur.
    """
    mains = main_parts(root)
    whole = mains == [root]
    out: dict[int, bool] = {}
    todo = [(root, False)]
    while todo:
        e, inside = todo.pop()
        inside = inside or (not whole and e in mains)
        if e.tag in BLOCK and e.tag not in ("html", "body", "main", "article") and e.size and not e.holds_main:
            if not inside or e.tag in ("div", "section", "aside", "nav", "header", "footer", "form"):
                out[e.hash] = e.tag in PROSE
        todo.extend((p, inside) for p in e.parts if type(p) is Element)
    return out, xxhash.xxh3_64_intdigest(" ".join(text for e in mains for text in blocks(e, root, frozenset())).encode("utf-8", "replace"))


def blocks(part: Element, root: Element, templates) -> list[str]:
    """Text blocks of a main part in page order, without boilerplate and without ``templates``."""
    size, out, run = max(root.size, 1), [], []

    def end() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(text)
            run.clear()

    # Entries are texts, elements to enter, and None where a block ends; the flag: inside an article's header.
    todo: list = [(part, False)]
    while todo:
        e, in_header = todo.pop()
        if e is None:
            end()
            continue
        if type(e) is str:
            if not in_header:
                run.append(entities.unescape(e) if "&" in e else e)
            continue
        if e.tag == "br":
            run.append(" ")
            continue
        if e is not part:
            if boilerplate(e, size) or (e.hash in templates and not e.holds_main):
                end()
                continue
            if e.tag == "header":
                if part.tag != "article":
                    end()
                    continue
                in_header = True
            elif e.tag in HEADINGS:
                in_header = False
        block = e.tag in BLOCK
        if block:
            end()
            todo.append((None, False))
        todo.extend((p, in_header) for p in reversed(e.parts))
    end()
    return out


def text(html: str | None, templates=frozenset()) -> str:
    """Main text of a page without the subtrees of its site's template."""
    if not html:
        return ""
    root = parse(html)
    return " ".join(b for part in main_parts(root) for b in blocks(part, root, templates))
