"""A tolerant HTML reader: block elements and the text runs between their boundaries, with features of each.

Leaves are text runs (character references decoded, white space folded); inner nodes are block elements that hold
at least one run. Inline elements only shape the text. Unclosed and crossing tags are repaired as browsers do in the
common cases: a block closes an open paragraph, items close their like, stray end tags are dropped.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np

# Element names of HTML by their role.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li"
    " main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
HIDDEN = frozenset("head svg math template noscript object select button canvas audio video datalist map".split())
CLOSES_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot caption legend summary".split())
LIKE = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}

TAGS = ("text", "body", "html", "div", "section", "article", "main", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "fieldset", "dl", "dd")
TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
# Words of class, id and role attributes, by what they tell.
WORDS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar skip sitemap topbar",
    "ad": "ad ads advert advertisement adsense banner promo promotion sponsor sponsored sponsors teaser dfp outbrain taboola",
    "side": "sidebar aside widget widgets related recommended popular trending rail more secondary complementary",
    "foot": "footer foot copyright legal colophon contentinfo disclaimer imprint bottom",
    "head": "header masthead branding logo site top hero banner",
    "note": "cookie cookies consent notice gdpr privacy popup modal overlay alert newsletter subscribe subscription paywall signup message toast",
    "talk": "comment comments disqus reply replies respond discussion thread reader responses reviews feedback",
    "form": "form search login contact signin field input share social sharing follow",
    "meta": "meta byline author date tags tag category categories posted info",
    "main": "article content post entry story main text body copy page prose paragraph news blog maincontent richtext single",
}
GROUPS = tuple(WORDS)
GROUP_OF: dict[str, int] = {}
for _i, _g in enumerate(GROUPS):
    for _w in WORDS[_g].split():
        GROUP_OF[_w] = GROUP_OF.get(_w, 0) | 1 << _i

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PIECE = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


def _groups(tag_text: str) -> int:
    mask = 0
    for value in ATTRIBUTE.findall(tag_text):
        for piece in PIECE.findall(CAMEL.sub(" ", value).lower()):
            mask |= GROUP_OF.get(piece, 0)
    return mask


class Page:
    """Nodes in page order: parent, tag number, groups of the own attributes, text ('' for elements) and its link characters."""

    def __init__(self, source: str):
        self.parent, self.tag, self.groups, self.text, self.link = [-1], [TAG_NUMBER["html"]], [0], [""], [0]
        self._read(source)

    def _node(self, parent: int, tag: int, groups: int, text: str = "", link: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.groups.append(groups)
        self.text.append(text)
        self.link.append(link)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]  # name and node (of the nearest block)
        run: list[str] = []
        linked = anchors = hidden = 0
        at, end = 0, len(source)

        def flush() -> None:
            nonlocal linked
            if run:
                if text := " ".join(entities.unescape("".join(run)).split()):
                    self._node(stack[-1][1], 0, 0, text, min(linked, len(text)))
                run.clear()
            linked = 0

        def close(depth: int) -> None:
            """Pops the stack down to that length."""
            nonlocal anchors, hidden
            if any(name in BLOCK for name, _ in stack[depth:]):
                flush()
            for name, _ in stack[depth:]:
                anchors -= name == "a"
                hidden -= name in HIDDEN
            del stack[depth:]

        while at < end:
            m = TOKEN.search(source, at)
            start = m.start() if m else end
            if start > at and not hidden:
                piece = source[at:start]
                run.append(piece)
                if anchors:
                    linked += len(piece.strip())
            if not m:
                break
            at = m.end()
            found = NAME.match(source, start)
            if not found:
                continue
            name = found[1].lower()
            if source[start + 1] == "/":
                if name == "br" and not hidden:
                    run.append(" ")
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        close(depth)
                        break
                    if name not in BLOCK and name not in HIDDEN and stack[depth][0] in BLOCK:
                        break
                continue
            if name in RAW:
                m = ENDS[name].search(source, at)
                at = source.find(">", m.end()) + 1 or end if m else end
                continue
            if name == "body" and hidden:  # an unclosed head
                close(next(i for i, (n, _) in enumerate(stack) if n in HIDDEN))
            if name in CLOSES_P:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == "p":
                        close(depth)
                        break
                    if stack[depth][0] in BLOCK:
                        break
            if name in LIKE:
                like, bounds = LIKE[name]
                lowest = 0
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in like:
                        lowest = depth
                    elif stack[depth][0] in bounds:
                        break
                if lowest:
                    close(lowest)
            if name in VOID:
                if name == "hr":
                    flush()
                elif name == "br" and not hidden:
                    run.append(" ")
                continue
            if name in BLOCK:
                flush()
                node = 0 if hidden else self._node(stack[-1][1], TAG_NUMBER.get(name, TAG_NUMBER["div"]), _groups(m[0]))
                stack.append((name, node if not hidden else stack[-1][1]))
            else:
                anchors += name == "a"
                hidden += name in HIDDEN
                stack.append((name, stack[-1][1]))
        flush()


SENTENCE = re.compile(r"[.!?…](?:\s|$)")
NUMBERS = 2 * len(GROUPS) + 26
FEATURES = NUMBERS + len(TAGS)
INSIDE = [TAG_NUMBER[t] for t in ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "table")]


def features(pages: list[Page]) -> np.ndarray:
    """One row a node over all pages: own and inherited attribute groups, ancestors, size, density, links, depth, siblings, tag."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.cumsum(sizes) - sizes
    base = np.repeat(first, sizes)
    n = int(sizes.sum())
    parent = np.concatenate([np.asarray(p.parent) for p in pages]) + base
    root = np.zeros(n, bool)
    root[first] = True
    parent[root] = first
    tag = np.concatenate([np.asarray(p.tag) for p in pages])
    groups = np.concatenate([np.asarray(p.groups) for p in pages])
    texts = [t for p in pages for t in p.text]
    chars = np.fromiter(map(len, texts), np.float64, n)
    link = np.concatenate([np.asarray(p.link, float) for p in pages])
    leaf = tag == 0
    # depth, what the ancestors are, and order from the deepest up
    depth, above, inside = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    role = np.zeros(len(TAGS), np.int64)
    role[INSIDE] = 1 << np.arange(len(INSIDE))
    level, members = 1, np.flatnonzero(~root)
    layers = []
    known = root.copy()
    while len(members):
        ready = known[parent[members]]
        now = members[ready]
        up = parent[now]
        depth[now], above[now], inside[now] = level, above[up] | groups[up], inside[up] | role[tag[up]]
        known[now] = True
        layers.append(now)
        members, level = members[~ready], level + 1
    sums = np.column_stack([chars, link, leaf.astype(float), np.ones(n), (tag == TAG_NUMBER["p"]).astype(float), np.fromiter((len(SENTENCE.findall(t)) if t else 0 for t in texts), float, n), (chars > 80).astype(float)])
    for now in reversed(layers):
        np.add.at(sums, parent[now], sums[now])
    total = sums[np.repeat(first, sizes)]
    kids = np.bincount(parent[~root], minlength=n).astype(float)
    order = np.arange(n)
    rank = np.zeros(n)
    by = np.lexsort((order, parent))
    by = by[~root[by]]
    if len(by):
        starts = np.flatnonzero(np.concatenate([[True], parent[by][1:] != parent[by][:-1]]))
        counts = np.diff(np.append(starts, len(by)))
        rank[by] = np.arange(len(by)) - np.repeat(starts, counts)
    alike = np.zeros(n)
    key = parent * len(TAGS) + tag
    _, back, same = np.unique(key, return_inverse=True, return_counts=True)
    alike = same[back] / np.maximum(kids[parent], 1)
    before, after = np.zeros(n), np.zeros(n)
    if len(by) > 1:
        next_to = parent[by][1:] == parent[by][:-1]
        before[by[1:][next_to]] = sums[by[:-1][next_to], 0]
        after[by[:-1][next_to]] = sums[by[1:][next_to], 0]
    passed = np.cumsum(chars) - chars
    passed -= passed[np.repeat(first, sizes)]
    out = np.zeros((n, FEATURES), np.float32)
    bits = 1 << np.arange(len(GROUPS))
    g = len(GROUPS)
    out[:, :g] = groups[:, None] & bits > 0
    out[:, g : 2 * g] = above[:, None] & bits > 0
    k = 2 * g
    out[:, k : k + len(INSIDE)] = inside[:, None] & (1 << np.arange(len(INSIDE))) > 0
    k += len(INSIDE)
    upper = np.fromiter((sum(map(str.isupper, t[:200])) / min(len(t), 200) if t else 0.0 for t in texts), float, n)
    mark = np.fromiter(("©" in t for t in texts), float, n)
    for now in reversed(layers):
        np.maximum.at(mark, parent[now], mark[now])
    own = (
        np.log1p(sums[:, 0]), sums[:, 0] / np.maximum(total[:, 0], 1), sums[:, 0] / sums[:, 3], sums[:, 1] / np.maximum(sums[:, 0], 1), np.log1p(sums[:, 4]),
        sums[:, 5] * 100 / np.maximum(sums[:, 0], 50), sums[:, 6] / np.maximum(sums[:, 2], 1), depth, np.log1p(kids), np.log1p(rank), np.log1p(kids[parent]), alike,
        np.log1p(before), np.log1p(after), passed / np.maximum(total[:, 0], 1), upper, mark,
    )
    out[:, k : k + len(own)] = np.column_stack(own)
    # a text run shows its element's tag
    shown = np.where(leaf, tag[parent], tag)
    out[np.arange(n), NUMBERS + shown] = 1
    out[leaf, NUMBERS] = 1
    return out
