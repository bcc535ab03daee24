"""A small HTML reader for main-text extraction: elements, blocks of text and their keys.

It follows HTML's rules as far as block structure needs them: void and raw-text elements, omitted end tags of
paragraphs, list items and table parts, unmatched end tags, comments.  The text of an inline element marked as noise is dropped;
one without end tag ends at the first block in it, else with the block around it.  An element's key is a hash
of the path of tags and normalised classes from the root, so elements of the same template part have the
same key on all pages of a site."""

from __future__ import annotations

import bisect
import hashlib
import html as _html
import re

#: Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span
strike strong sub sup time tt u var picture""".split())
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr main menu nav ol p pre search section summary table ul""".split())
#: Start tags that end an open element of these names, looked for up to the boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
          "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
          "body": ({"head"}, set())}
#: Elements that hold no main text by their meaning.
NOISE_TAGS = frozenset("head nav footer aside form menu dialog template svg math object canvas audio video map select button fieldset search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog status tablist tooltip".split())
#: Words in class and id that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
NOISE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit sponsor sponsored sponsors promo
promos promotion promoted outbrain taboola banner nav navbar navigation subnav menu menubar submenu breadcrumb breadcrumbs sidebar rail widget widgets
footer masthead topbar toolbar cookie cookies cookiebar consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe
subscription signup signin login register paywall search searchform searchbox form comment comments commentlist disqus respond reply replies discussion
reactions share sharing social related recommended recommendations trending popular pagination pager copyright disclaimer skiplink sitenav siteheader""".split())
MAIN_WORDS = ({"article", "body"}, {"article", "content"}, {"article", "text"}, {"entry", "content"}, {"post", "content"}, {"post", "body"},
              {"story", "body"}, {"main", "content"}, {"page", "content"}, {"articlebody"}, {"maincontent"})
#: Elements that a site's style tree may remove: containers, not paragraphs, headings, items or cells.
CONTAINERS = frozenset("div section ul ol dl table aside nav header footer form figure address details center menu search".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_UNENDED = re.compile(r"<!--|<!\[CDATA\[")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_raw_end: dict = {}
_keys: dict = {}
_kinds: dict = {}


def key_of(parent: int, signature: str) -> int:
    """Signed 64-bit key of a child with a signature."""
    at = (parent, signature)
    found = _keys.get(at)
    if found is None:
        if len(_keys) > 200_000:
            _keys.clear()
        found = int.from_bytes(hashlib.blake2b(f"{parent}>{signature}".encode(), digest_size=8).digest(), "little", signed=True)
        _keys[at] = found
    return found


def text_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _kind(tag: str, attrs: str):
    """(signature, noise, main) of an element: noise 2 by its tag or role, 1 by class or id; main 3 article, 2 main, 1 by class."""
    at = (tag, attrs)
    found = _kinds.get(at)
    if found is not None:
        return found
    values: dict = {}
    if attrs:
        for m in _ATTR.finditer(attrs):
            name = m[1].lower()
            if name not in values:
                values[name] = _html.unescape(m[2] or m[3] or m[4] or "")
    role = values.get("role", "").lower().strip()
    named = " ".join(values.get(k, "") for k in ("class", "id"))
    noise = main = 0
    groups = []
    for name in named.split():
        words = [w for w in _SPLIT.split(_CAMEL.sub(" ", name).lower()) if w]
        groups.append(_DIGITS.sub("0", "-".join(words)))
        have = {"has", "no", "with", "without", "not"}
        plain = {w for i, w in enumerate(words) if not (i and words[i - 1] in have)}
        if plain & NOISE_WORDS or (words in (["header"], ["site", "header"], ["page", "header"], ["global", "header"])):
            noise = 1
        if any(need <= plain for need in MAIN_WORDS) or words in (["content"], ["main"], ["article"], ["post"], ["entry"], ["story"]):
            main = 1
    if tag in ("html", "body", "main"):
        noise = 0
    if tag in NOISE_TAGS or role in NOISE_ROLES or "hidden" in values or values.get("aria-hidden", "").lower() == "true" \
            or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "").lower()):
        noise = 2
    if not noise:
        if tag == "article" or role == "article" or values.get("itemprop", "").lower() == "articlebody":
            main = 3
        elif tag == "main" or role == "main":
            main = 2
    else:
        main = 0
    signature = tag + "".join("." + g for g in sorted(set(groups))) + ("@" + role if role else "")
    if len(_kinds) > 100_000:
        _kinds.clear()
    _kinds[at] = found = signature, noise, main
    return found


class Element:
    __slots__ = ("tag", "key", "parent", "noise", "main", "depth", "children", "holds_main")

    def __init__(self, tag, key, parent, noise, main, depth):
        self.tag, self.key, self.parent, self.noise, self.main, self.depth = tag, key, parent, noise, main, depth
        self.children: list[int] = []     # keys of child elements, 0 for a block of text, in order
        self.holds_main = 0


class Block:
    __slots__ = ("element", "text", "link_chars")

    def __init__(self, element, text, link_chars):
        self.element, self.text, self.link_chars = element, text, link_chars


class _Stack:
    """The open elements, with the places of each tag, so that no look-up walks the stack."""

    def __init__(self, root):
        self.items, self.at, self.articles = [root], {}, 0

    def push(self, e) -> None:
        self.at.setdefault(e.tag, []).append(len(self.items))
        self.items.append(e)
        self.articles += e.main == 3

    def cut(self, index: int) -> None:
        while len(self.items) > index:
            e = self.items.pop()
            self.at[e.tag].pop()
            self.articles -= e.main == 3

    def last(self, *tags) -> int:
        """Highest place of an open element of these tags, 0 for none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def first_above(self, place: int, tags) -> int:
        """Lowest place above ``place`` of an element of these tags, 0 for none."""
        found = 0
        for t in tags:
            places = self.at.get(t) or ()
            i = bisect.bisect_right(places, place)
            if i < len(places):
                found = min(found or places[i], places[i])
        return found

    def closed_by(self, tag: str) -> int:
        """Place of the element that an end tag closes, 0 for none; most end tags do not reach out of a table or article."""
        place = self.last(tag)
        return place if tag in _REACHES_OUT or place > self.last("table", "article") else 0


_REACHES_OUT = frozenset("table article body html main section div".split())
_P_HOLDERS = ("table", "td", "th", "button", "object")


class _Muted:
    """An inline noise element: its tag, the token of its own end tag (None: never closed), the first block in it, the blocks open in it."""
    __slots__ = ("tag", "end", "first_block", "open", "count")

    def __init__(self, tag, end):
        self.tag, self.end, self.first_block, self.open, self.count = tag, end, None, [], {}

    def enter(self, tag) -> None:
        self.open.append(tag)
        self.count[tag] = self.count.get(tag, 0) + 1

    def leave(self, tag) -> bool:
        """Close the last open block of this tag and all in it; False if there is none."""
        if not self.count.get(tag):
            return False
        while True:
            inner = self.open.pop()
            self.count[inner] -= 1
            if inner == tag:
                return True


def _tokens(source: str) -> list:
    """(start, end, tag, closing, attributes) of the markup in order; raw-text elements with what they hold are one token; tag None: other markup."""
    found: list = []
    at, n = 0, source.rfind(">") + 1
    while at < n:
        m = _TOKEN.search(source, at, n)
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        closing = (m[1] or m[4]) == "/"
        attrs = (m[3] if m[2] else m[6]) or ""
        if tag is not None:
            tag = tag.lower()
            if tag in RAW and not closing and (not attrs.endswith("/") or tag in ("script", "style")):
                end = _raw_end.get(tag)
                if end is None:
                    end = _raw_end[tag] = re.compile(rf"</{tag}\s*[^>]*>", re.I)
                stop = end.search(source, at)
                at = stop.end() if stop else len(source)
        elif not m[0].endswith(">"):     # a comment or section without end
            at = len(source)
        found.append((m.start(), at, tag, closing, attrs))
    m = _UNENDED.search(source, at)
    if m is not None:
        found.append((m.start(), len(source), None, False, ""))
    return found


def _own_ends(tokens: list) -> dict:
    """Of each start tag of an inline element, the token of its end tag by counting tags of its name."""
    ends: dict = {}
    waiting: dict = {}
    for i, (_, _, tag, closing, _) in enumerate(tokens):
        if tag in INLINE:
            if not closing:
                waiting.setdefault(tag, []).append(i)
            elif waiting.get(tag):
                ends[waiting[tag].pop()] = i
    return ends


def parse(source: str):
    """(elements, blocks) of a page, in document order."""
    root = Element("#root", 1, None, 0, 0, 0)
    stack, elements, blocks = _Stack(root), [root], []
    pieces: list[str] = []
    links = link_chars = 0
    muted: _Muted | None = None
    tokens = _tokens(source)
    own_ends = _own_ends(tokens)

    def flush():
        nonlocal pieces, link_chars
        if pieces:
            raw = "".join(pieces)
            text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
            if text:
                top = stack.items[-1]
                top.children.append(0)
                blocks.append(Block(top, text, min(link_chars, len(text))))
            pieces = []
        link_chars = 0

    def pop_to(place: int):
        flush()
        stack.cut(place)

    at = i = 0
    while True:
        if i == len(tokens):
            if muted is not None and muted.first_block is not None:     # never closed: it ends at the first block in it
                i, muted = muted.first_block, None
                at = tokens[i][0]
                continue
            if muted is None:
                pieces.append(source[at:])
            break
        start, end, tag, closing, attrs = tokens[i]
        if start > at and muted is None:
            pieces.append(source[at:start])
            if links:
                link_chars += start - at
        at = end
        i += 1
        if tag is None:
            if muted is None and source.startswith("<![CDATA[", start):
                pieces.append(_html.escape(source[start + 9:end].removesuffix("]]>")))
            continue
        if muted is not None:
            if tag == muted.tag:
                if muted.end == i - 1:
                    muted = None
                continue
            if tag in INLINE or tag in VOID or (tag in RAW and not closing):
                continue
            if not closing:
                if muted.end is None:     # never closed: it ends here
                    i, at, muted = i - 1, start, None
                    continue
                if muted.first_block is None:
                    muted.first_block = i - 1
                if not attrs.rstrip().endswith("/"):
                    muted.enter(tag)
                continue
            if muted.leave(tag) or not stack.closed_by(tag):
                continue
            again, muted = muted.first_block, None     # the block around it ends: it was not closed
            if again is not None:
                i, at = again, tokens[again][0]
                continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            elif attrs and not closing and not attrs.rstrip().endswith("/") and _kind(tag, attrs)[1]:
                muted = _Muted(tag, own_ends.get(i - 1))
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if closing:
            place = stack.closed_by(tag)
            if place:
                pop_to(place)
            links = 0
            continue
        if tag in RAW:
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            place = stack.last("p")
            if place > stack.last(*_P_HOLDERS):
                pop_to(place)
        if tag in CLOSES:
            names, bounds = CLOSES[tag]
            bound = stack.last(*bounds)
            if tag in ("li", "dt", "dd", "option"):
                lowest = stack.last(*names)
            else:
                lowest = stack.first_above(bound, names)
            if lowest > bound:
                pop_to(lowest)
        flush()
        links = 0
        if attrs.rstrip().endswith("/") and tag in ("svg", "path", "use", "g"):
            continue
        if tag in ("html", "body") and stack.last(tag):
            continue
        parent = stack.items[-1]
        signature, noise, main = _kind(tag, attrs)
        if tag == "header" and not stack.articles:
            noise, main = 2, 0
        key = key_of(parent.key, signature)
        e = Element(tag, key, parent, noise, main, parent.depth + 1)
        parent.children.append(key)
        stack.push(e)
        elements.append(e)
        up = parent
        while main >= 2 and up is not None and up.holds_main < main:
            up.holds_main = main
            up = up.parent
    flush()
    return elements, blocks
