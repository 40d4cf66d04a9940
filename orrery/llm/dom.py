"""A page's block elements, their text, and the features of each.

Any string is a page: an empty one has a root without text, text outside of elements belongs to the root, unknown tags are
passed over, and tags that are left open end with what holds them. A head ends where the body's first element begins, and
another dropped container ends with its article at the latest, and is passed over if no closing tag follows at all. A form or
dialog that holds an article, a main part, a section or a first heading is drawn around content and passed over, too. Time and memory are linear in the page."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Tags by what they do to text.
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption nav header footer aside address details summary fieldset center hgroup search".split())
DROPPED = frozenset("script style head title template noscript svg math iframe object canvas select option textarea button form dialog audio video map datalist".split())
#: Elements that a form or dialog holds only if it is drawn around the page's content: it is passed over then.
CONTENT = re.compile(r"<(?:article|main|section|h1)[\s>]", re.I)
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = BLOCKS - {"html", "body"}
#: By tag, the tags of the same kind that it ends, and the containers at which to stop looking.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# Words in class, id and role that tell what an element is for.
TOKENS = {
    "menu": "nav|navbar|menu|breadcrumb|breadcrumbs|pagination|pager|toolbar|tabs|skip|navigation|toc",
    "frame": "header|masthead|banner|footer|foot|colophon|copyright|legal|top|bottom|contentinfo|topbar|site",
    "aside": "sidebar|side|aside|widget|related|recommended|trending|popular|more|complementary|rail",
    "advert": "ad|ads|advert|advertisement|sponsor|sponsored|promo|promotion|adsense|banner|teaser|outbrain|taboola",
    "notice": "cookie|cookies|consent|notice|alert|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|paywall|message",
    "comments": "comment|comments|reply|replies|disqus|discussion|respond|thread|feedback|reviews",
    "social": "share|sharing|social|follow|author|byline|meta|tags|tag|login|search|form|signup",
    "main": "article|content|post|entry|story|body|main|text|prose|page|maincontent|articlebody",
}
GROUPS = [(name, frozenset(words.split("|"))) for name, words in TOKENS.items()]
TAGS = (("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "ul", "ol", "dl", "dt", "dd"), ("article", "main"), ("nav",), ("header",), ("footer",), ("aside",), ("table", "tr", "td", "th", "tbody"), ("blockquote", "pre", "figure", "figcaption"), ("div", "section", "body", "html"))
_tag_no = {t: i for i, tags in enumerate(TAGS) for t in tags}

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_attribute = re.compile(r"([a-zA-Z][\w-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_word = re.compile(r"[a-z0-9]+")
_end = re.compile(r"[.!?…]")


class Node:
    __slots__ = ("tag", "parent", "depth", "groups", "children", "own", "segments", "chars", "links", "link_chars", "blocks", "ends", "words", "first", "label")

    def __init__(self, tag: str, parent: Node | None, groups: tuple[int, ...], label: bool) -> None:
        self.tag, self.parent, self.groups, self.label = tag, parent, groups, label
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.segments: list[str] = []
        self.own = self.chars = self.links = self.link_chars = self.ends = self.words = self.first = 0
        self.blocks = 1


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order (the root first), and blocks of text as (node's index, text), whitespace turned into single spaces."""
    root = Node("root", None, (0,) * len(GROUPS), False)
    nodes, index, segments = [root], {id(root): 0}, []
    here, pieces, linked, at, dropped, depth_dropped, link = root, [], 0, 0, "", 0, False

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                segments.append((index[id(here)], text))
                here.own += len(text)
                here.link_chars += min(linked, len(text))
                here.ends += len(_end.findall(text))
                here.words += text.count(" ") + 1
            pieces, linked = [], 0

    def up(tags: set[str] | frozenset[str], stop: set[str]) -> None:
        nonlocal here
        n = here
        while n.parent is not None and n.tag not in tags and n.tag not in stop:
            n = n.parent
        if n.parent is not None and n.tag in tags:
            flush()
            here = n.parent

    lasts: dict[str, int] = {}  # by tag, where it is last closed
    lowered: list[str] = []

    def lower() -> str:
        if not lowered:
            lowered.append(page.lower())
        return lowered[0]

    def open_tags(n: Node | None) -> Iterator[str]:
        while n is not None:
            yield n.tag
            n = n.parent

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not dropped:
            said = html.unescape(raw) if "&" in raw else raw
            pieces.append(said)
            if link:
                linked += len(said)

    while True:
        m = _token.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if dropped == "head" and (tag == "body" or tag in BLOCKS and not closing):
            dropped = ""  # </head> may be left out
        elif dropped and dropped != "head" and closing and tag in ("article", "main", "body") and tag in open_tags(here):
            dropped = ""  # its own closing tag is missing
        if dropped:
            if tag == dropped and tag not in VOID:
                depth_dropped += -1 if closing else 1
                if not depth_dropped:
                    dropped = ""
            continue
        if tag in ("br", "hr"):
            pieces.append(" ")
            continue
        if tag in DROPPED:
            if tag not in lasts:
                lasts[tag] = lower().rfind(f"</{tag}")
            if tag in ("form", "dialog") and not closing:
                end = lower().find(f"</{tag}", at)
                if CONTENT.search(page, at, end if end >= 0 else len(page)):
                    flush()
                    continue
            if not closing and not m[3].endswith("/") and (tag in RAW or tag == "head" or lasts[tag] > at):
                if tag in RAW:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                else:
                    dropped, depth_dropped = tag, 1
                if tag not in ("select", "button", "svg", "math"):
                    flush()
                pieces.append(" ")
            continue
        if tag == "a":
            link = not closing
            here.links += not closing
            continue
        if tag not in BLOCKS:
            continue
        link = False
        if closing:
            up({tag}, {"article", "main"} - {tag} if tag in ("p", "li") else set())
            flush()
            continue
        flush()
        if tag in CLOSES_P:
            up({"p"}, {"td", "th", "li", "div", "section", "article", "main", "blockquote"})
        if tag in ENDS:
            up(*ENDS[tag])
        groups, label = (0,) * len(GROUPS), False
        if "=" in m[3]:
            values = {k.lower(): a or b or c for k, a, b, c in _attribute.findall(m[3])}
            label = "data-main" in values
            said = set(_word.findall(f"{values.get('class', '')} {values.get('id', '')} {values.get('role', '')}".lower()))
            if said:
                groups = tuple(int(bool(said & words)) for _, words in GROUPS)
        child = Node(tag, here, groups, label)
        child.first = m.start()
        here.children.append(child)
        index[id(child)] = len(nodes)
        nodes.append(child)
        here = child
    flush()
    for n in reversed(nodes):
        n.chars += n.own
        if n.parent:
            n.parent.chars += n.chars
            n.parent.links += n.links
            n.parent.link_chars += n.link_chars
            n.parent.blocks += n.blocks
            n.parent.ends += n.ends
            n.parent.words += n.words
    return nodes, segments


#: Number of features of a node.
WIDTH = 2 * len(GROUPS) + 2 * len(TAGS) + 17


def features(nodes: list[Node], size: int) -> list[list[float]]:
    """A row per node: tag, attribute words, both also of its ancestors, depth, densities of its subtree, and its siblings."""
    rows: list[list[float]] = []
    above: dict[int, tuple[list[int], list[int]]] = {}
    total = nodes[0].chars or 1
    family: dict[int, tuple[dict[str, int], int]] = {}
    place = {id(nodes[0]): 0.0}
    for n in nodes:
        count: dict[str, int] = {}
        for i, k in enumerate(n.children):
            count[k.tag] = count.get(k.tag, 0) + 1
            place[id(k)] = i / len(n.children)
        family[id(n)] = (count, max((k.chars for k in n.children), default=0))
    for n in nodes:
        tags, groups = [0] * len(TAGS), list(n.groups)
        if n.tag in _tag_no:
            tags[_tag_no[n.tag]] = 1
        up = above[id(n.parent)] if n.parent else ([0] * len(TAGS), [0] * len(GROUPS))
        above[id(n)] = ([a | b for a, b in zip(up[0], tags)], [a | b for a, b in zip(up[1], groups)])
        kin, around = (len(n.parent.children), n.parent.chars) if n.parent else (1, total)
        tags_of_kin, longest = family[id(n.parent)] if n.parent else ({n.tag: 1}, n.chars)
        chars, words = n.chars or 1, n.words or 1
        rows.append([
            *tags, *up[0], *groups, *up[1],
            n.depth, n.chars, n.own, chars / total, n.link_chars / chars, n.links / words, n.blocks / words, chars / n.blocks, n.ends / words, n.words / n.blocks,
            len(n.children), kin, tags_of_kin[n.tag], chars / (around or 1), chars / (longest or 1), place[id(n)], n.first / (size or 1),
        ])
    return rows
