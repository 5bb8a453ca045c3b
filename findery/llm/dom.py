"""A forgiving HTML reader: blocks of text, the elements that hold them, and features of both."""

from __future__ import annotations

import html
import re
from bisect import bisect_left

import numpy as np

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page: code, forms, and what stands in for a picture (svg, canvas, object) where it
#: cannot be drawn. Formulas are text, but for their annotations, which say the same in another notation.
SKIPPED = frozenset("head script style noscript template iframe svg textarea select button object canvas title annotation annotation-xml".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr input "
    "annotation annotation-xml math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext "
    "mtr munder munderover semantics".split()
)
#: A start tag closes these open elements, up to the given boundaries.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
P_BOUNDS = frozenset("table td th button body html caption object".split())

#: Words in class, id, role and the like, by what they tell.
TOKENS = {
    "menu": "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs topbar pagination pager tabs toolbar links skip toc",
    "header": "header masthead banner branding logo top site-header topnav hero",
    "footer": "footer foot colophon copyright contentinfo legal bottom credits imprint",
    "side": "sidebar aside side rail related recommended recommendations widget widgets complementary popular trending more archive tags tagcloud latest",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay dialog warning message toast paywall privacy banner infobar",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted banner dfp adsense outbrain taboola affiliate teaser",
    "form": "form login signin signup register registration newsletter subscribe subscription search searchbox contact email captcha",
    "comment": "comment comments commentlist reply replies respond discussion disqus reader readers feedback review reviews thread",
    "share": "share sharing social follow twitter facebook like meta byline author bio date tools print rating",
    "hidden": "hidden invisible offscreen visuallyhidden sr only none",
    "content": "content article main body post entry story text page blog hentry articlebody maincontent bodytext prose copy paragraph",
}
KIND_OF = {word: i for i, words in enumerate(TOKENS.values()) for word in words.split()}
GROUPS = list(TOKENS)
TAGS = [
    ("article", "main"), ("section",), ("div",), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"),
    ("li", "dt", "dd"), ("table", "tr", "td", "th", "tbody", "thead", "tfoot"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "legend"),
    ("figure", "figcaption"), ("dialog", "details", "summary"), ("address",), ("body", "html"),
]
TAG_OF = {t: i for i, tags in enumerate(TAGS) for t in tags}

#: Outside quotes a tag ends before the next "<", so that what never ends is not read again from each of its starts.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?][^<>]*+>|<(/?)([a-zA-Z][^\s/><]*+)([^<>]*+)>", re.S
)
ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden|aria-label|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PIECE = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def attribute_kinds(attrs: str) -> int:
    """A bit for each group that the attributes name."""
    bits = 0
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            bits |= 1 << GROUPS.index("hidden")
        elif name not in ("style", "aria-hidden"):
            for word in PIECE.findall(value):
                kind = KIND_OF.get(word.lower())
                if kind is not None:
                    bits |= 1 << kind
    return bits


class OpenTags:
    """Open elements; the last place of each name is at hand, so that no look-up walks down the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = []  # name, the nearest node that is not inline, whether it is open
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of the elements that are not inline
        self.push("html", 0)

    def node(self) -> int:
        return self.stack[-1][1]

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, node, True))

    def last(self, name: str) -> int:
        found = self.places.get(name)
        return found[-1] if found else -1

    def count(self, name: str) -> int:
        return len(self.places.get(name, ()))

    def cut(self, size: int) -> None:
        """Close all but the first `size`; the root stays."""
        while len(self.stack) > max(size, 1):
            name, _, is_open = self.stack.pop()
            if is_open:
                self.places[name].pop()
                if name not in INLINE:
                    self.blocks.pop()

    def close_inline(self, name: str) -> None:
        """Close the last one of a name, if no block stands above it; those above stay open."""
        at = self.last(name)
        if at > self.blocks[-1]:
            self.places[name].pop()
            self.stack[at] = (name, self.stack[at][1], False)
            while not self.stack[-1][2]:
                self.stack.pop()

    def close_up_to(self, names: set[str], bounds) -> None:
        """Close the lowest of these names that no bound stands above, with all above it."""
        bound = max(map(self.last, bounds))
        while (at := max(map(self.last, names))) > bound and at > 0:
            self.cut(at)


class Page:
    """Nodes in page order: elements that are not inline, and their runs of text as leaves.

    marks are places of the source, in order: leaves with text from there are the main text of a training page.
    """

    def __init__(self, source: str, marks: list[int] | None = None) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["html"]
        self.bits: list[int] = [0]
        self.inputs: list[int] = [0]
        self.text: list[str | None] = [None]  # of leaves
        self.linked: list[int] = [0]
        self.main: list[bool] = [False]
        self._read(source, marks or [])

    def _node(self, parent: int, tag: str, bits: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.bits.append(bits)
        self.inputs.append(0)
        self.text.append(None)
        self.linked.append(0)
        self.main.append(False)
        return len(self.parent) - 1

    def _read(self, source: str, marks: list[int]) -> None:
        tags = OpenTags()
        run: list[str] = []
        marked, linked = False, 0

        def flush() -> None:
            nonlocal marked, linked
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    leaf = self._node(tags.node(), "#text", 0)
                    self.main[leaf], self.text[leaf], self.linked[leaf] = marked, text, linked
                run.clear()
            marked, linked = False, 0

        skip_to = None
        pos, size = 0, len(source)
        while pos < size:
            m = TAG.search(source, pos)
            start = size if m is None else m.start()
            if start > pos and skip_to is None:
                run.append(source[pos:start])
                marked |= bisect_left(marks, pos) < bisect_left(marks, start)
                if tags.count("a"):
                    linked += start - pos
            if m is None:
                break
            pos = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, closing, attrs = name.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
            if skip_to is not None:
                if name == skip_to[0]:
                    skip_to = (name, skip_to[1] + (-1 if closing else 1 if not attrs.endswith("/") else 0))
                    if skip_to[1] == 0:
                        skip_to = None
                elif name == "body" and skip_to[0] == "head":
                    skip_to = None
                else:
                    continue
                if name != "body" or closing:
                    continue
            if not closing:
                if name in SKIPPED and not attrs.endswith("/"):
                    flush() if name not in ("svg", "annotation", "annotation-xml", "button", "select") else run.append(" ")
                    if name in ("select", "textarea", "button"):
                        self.inputs[tags.node()] += 1
                    if name in RAW:
                        end = ENDS[name].search(source, pos)
                        pos = end.end() if end else size
                    else:
                        skip_to = (name, 1)
                    continue
                if name in INLINE or name in VOID:
                    if name in ("br", "img", "input"):
                        run.append(" ")
                    if name == "hr":
                        flush()
                    if name == "input":
                        self.inputs[tags.node()] += 1
                    if name not in VOID and not attrs.endswith("/"):
                        tags.push(name, tags.node())
                    continue
                flush()
                tags.close_up_to(*CLOSES.get(name, ({"p"}, P_BOUNDS)))
                if name == "html" or (name == "body" and tags.count("body")):
                    continue
                node = self._node(tags.node(), name, attribute_kinds(attrs) if attrs else 0)
                if not attrs.endswith("/"):
                    tags.push(name, node)
                continue
            if name in ("html", "body") or not tags.count(name):
                continue
            if name in INLINE:  # an inline end tag closes inline elements only
                tags.close_inline(name)
            else:
                flush()
                tags.cut(tags.last(name))
        flush()


FEATURES = (
    ["leaf", "depth", "log_chars", "link_share", "tag_density", "mean_block", "punctuation", "page_share", "before", "siblings", "sibling_mean", "of_largest",
     "same_tag", "parent_links", "parent_log_chars", "inputs", "list_share", "in_article"]
    + [f"tag_{t[0]}" for t in TAGS] + [f"in_{t[0]}" for t in TAGS] + [f"own_{g}" for g in GROUPS] + [f"above_{g}" for g in GROUPS]
)
PUNCTUATION = re.compile(r"[.,;:!?]")


def features(page: Page) -> np.ndarray:
    """One row a node."""
    n = len(page.parent)
    parent = np.array(page.parent)
    chars = np.array([len(t) if t else 0 for t in page.text], dtype=float)
    linked = np.minimum(np.array(page.linked, dtype=float), chars)
    stops = np.array([len(PUNCTUATION.findall(t)) if t else 0 for t in page.text], dtype=float)
    words = np.array([t.count(" ") + 1 if t else 0 for t in page.text], dtype=float)
    leaf = np.array([t is not None for t in page.text], dtype=float)
    lists = np.array([c if page.tag[p] == "li" else 0.0 for c, p in zip(chars, page.parent)])
    inputs = np.array(page.inputs, dtype=float)
    before = np.concatenate([[0], np.cumsum(chars)[:-1]])
    total = max(chars.sum(), 1.0)
    sums = np.stack([chars, linked, stops, words, leaf, lists, inputs, np.ones(n)], axis=1)
    own_tag = np.array([TAG_OF.get(t, -1) for t in page.tag])
    depth, above_tags, above_bits = np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    bits = np.array(page.bits, dtype=np.int64)
    tag_bit = np.where(own_tag >= 0, 1 << np.maximum(own_tag, 0), 0)
    for i in range(1, n):  # a parent comes before its children
        p = page.parent[i]
        depth[i] = depth[p] + 1
        above_tags[i] = above_tags[p] | tag_bit[p]
        above_bits[i] = above_bits[p] | bits[p]
    for i in range(n - 1, 0, -1):
        sums[page.parent[i]] += sums[i]
    chars, linked, stops, words, blocks, lists, inputs, nodes = sums.T
    p = np.maximum(parent, 0)
    kids = np.bincount(p[1:], minlength=n).astype(float)
    kid_chars = np.bincount(p[1:], chars[1:], minlength=n)
    largest = np.zeros(n)
    np.maximum.at(largest, p[1:], chars[1:])
    pair = p * 64 + own_tag + 1
    _, place, count = np.unique(pair, return_inverse=True, return_counts=True)
    link_share = linked / np.maximum(chars, 1)
    cols = [
        leaf, depth, np.log1p(chars), link_share, nodes / np.maximum(words, 1), chars / np.maximum(blocks, 1), stops / np.maximum(words, 1),
        chars / total, before / total, kids[p], kid_chars[p] / np.maximum(kids[p], 1), chars / np.maximum(largest[p], 1),
        count[place] / np.maximum(kids[p], 1), link_share[p], np.log1p(chars[p]), inputs, lists / np.maximum(chars, 1), above_tags & 1,
    ]
    cols += [own_tag == i for i in range(len(TAGS))]
    cols += [above_tags >> i & 1 for i in range(len(TAGS))]
    cols += [bits >> i & 1 for i in range(len(GROUPS))]
    cols += [above_bits >> i & 1 for i in range(len(GROUPS))]
    return np.stack([np.asarray(c, dtype=np.float64) for c in cols], axis=1)


def decode(page: Page, margin: np.ndarray) -> str:
    """The text of the best consistent choice: a node that is left out leaves out all below it.

    Bottom-up, a node's gain is its own log-odds plus what its children gain; it is kept where that is
    positive. A leaf counts by its log-odds alone.
    """
    n = len(page.parent)
    gain = np.clip(margin, -4, 4)
    gain[0] = 0
    for i in range(n - 1, 0, -1):
        if gain[i] > 0 and (page.text[i] is not None or gain[i] > -1e9):
            gain[page.parent[i]] += gain[i]
    kept = np.zeros(n, dtype=bool)
    kept[0] = True
    out = []
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and gain[i] > 0
        if kept[i] and page.text[i] is not None:
            out.append(page.text[i])
    return "\n".join(out)
