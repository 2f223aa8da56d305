"""A small DOM of block elements from HTML, with per-node features for the content classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title template noscript textarea select option svg math iframe object button".split())
# a start tag on the left ends an open element on the right
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"},
}
# what may stand in a head; any other tag or text ends one left open
IN_HEAD = frozenset("head title meta link script style base noscript template".split())
# tags that no button, selection or option holds; they end one left open
ENDING = frozenset("body p h1 h2 h3 h4 h5 h6 article main section ul ol dl table header footer nav aside".split())
SCOPES = frozenset("table ul ol dl html body article section div main aside nav header footer form".split())
CONTROLS = frozenset("input select textarea button option label".split())
BOILER_TOKENS = frozenset(
    "ad ads advert advertisement adbox banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer bottom copyright legal sidebar side aside rail widget related recommended recommendations trending popular "
    "notice cookie cookies consent gdpr alert popup modal overlay form search login signup subscribe newsletter share sharing social "
    "comment comments reply replies discussion disqus respond pagination pager toolbar tags contact complementary contentinfo".split()
)
CONTENT_TOKENS = frozenset("article content main story post entry body text page copy prose blog news document".split())
TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
TAG_FLAGS = (("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset"), ("article", "main"), ("p", "pre", "blockquote"),
             ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("ul", "ol", "dl"), ("table", "tr", "td", "th", "tbody"), ("div", "section"))
INHERITED = 6
N_FEATURES = 20 + len(TAG_FLAGS) + INHERITED + 1


class Dom(HTMLParser):
    """Block elements in page order (a parent before its children) and the text runs between their tags."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.boiler, self.content, self.controls = ["#page"], [-1], [0], [0], [0]
        self.runs: list[tuple[int, str]] = []
        self.links: list[int] = []
        self.stack: list[tuple[str, int]] = [("#page", 0)]
        # how many elements of a name are open, so that no end tag looks for one in vain
        self.open: Counter = Counter()
        self.unseen = self.anchors = 0
        self.pieces: list[str] = []
        self.linked = 0
        self.feed(html)
        self.close()
        self.flush()

    def parse_marked_section(self, i, report=1):
        """A declaration in brackets is skipped like a comment, whatever it holds."""
        end = self.rawdata.find(">", i + 3)
        return -1 if end < 0 else end + 1

    def unknown_decl(self, data):
        pass

    def push(self, tag: str, node: int) -> None:
        self.stack.append((tag, node))
        self.open[tag] += 1

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.runs.append((self.stack[-1][1], text))
            self.links.append(self.linked)
        self.pieces, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in CONTROLS:
            self.controls[self.stack[-1][1]] += 1
        if tag == "br" or tag in ("img", "hr", "input"):
            self.pieces.append(" ")
        if self.open["head"] and tag not in IN_HEAD:
            self.end("head", frozenset())
        if tag in VOID and tag != "hr":
            return
        if tag in ENDING and self.unseen:
            for other in ("option", "select", "button"):
                self.end(other, frozenset())
        if tag in UNSEEN:
            self.push(tag, self.stack[-1][1])
            self.unseen += 1
            return
        if tag in BLOCKS:
            self.flush()
            if tag != "html":
                self.end("p", frozenset())
            for other in ENDS.get(tag, ()):
                self.end(other, SCOPES - {other})
            if tag == "hr":
                return
            tokens = [t.lower() for name, value in attrs if name in ("class", "id", "role", "aria-label") and value for t in TOKEN.findall(value)]
            self.tag.append(tag)
            self.parent.append(self.stack[-1][1])
            self.boiler.append(sum(t in BOILER_TOKENS for t in tokens))
            self.content.append(sum(t in CONTENT_TOKENS for t in tokens))
            self.controls.append(0)
            self.push(tag, len(self.tag) - 1)
        else:
            self.anchors += tag == "a"
            self.push(tag, self.stack[-1][1])

    def end(self, tag: str, barrier: frozenset) -> None:
        """Close the innermost open element of that name, unless a barrier element is above it."""
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            name = self.stack[i][0]
            if name == tag:
                if tag in BLOCKS:
                    self.flush()
                for closed, _ in self.stack[i:]:
                    self.open[closed] -= 1
                    self.anchors -= closed == "a"
                    self.unseen -= closed in UNSEEN
                del self.stack[i:]
                return
            if name in barrier:
                return

    def handle_endtag(self, tag):
        if tag not in VOID:
            self.end(tag, frozenset() if tag in BLOCKS or tag in UNSEEN else BLOCKS)
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.unseen == 1 and self.stack[-1][0] == "head" and data.strip():
            self.end("head", frozenset())
        if not self.unseen:
            self.pieces.append(data)
            if self.anchors:
                self.linked += len(data)


def node_features(dom: Dom) -> np.ndarray:
    """One row per node: depth, siblings, text and link amounts of the subtree, tokens, tags, and what its ancestors are."""
    n = len(dom.tag)
    parent = dom.parent
    own, link, stops = [0] * n, [0] * n, [0] * n
    runs = [0] * n
    for (node, text), linked in zip(dom.runs, dom.links):
        own[node] += len(text)
        link[node] += min(linked, len(text))
        stops[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        runs[node] += 1
    sub, sublink, substops, inner, subboiler, controls = own[:], link[:], stops[:], [0] * n, dom.boiler[:], dom.controls[:]
    subruns = runs[:]
    main_inside = [t in ("article", "main") for t in dom.tag]
    children = [0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        sub[p] += sub[i]
        sublink[p] += sublink[i]
        substops[p] += substops[i]
        inner[p] += inner[i] + 1
        subboiler[p] += subboiler[i]
        controls[p] += controls[i]
        subruns[p] += subruns[i]
        main_inside[p] |= main_inside[i]
        children[p] += 1
    total = max(sub[0], 1)
    out = np.zeros((n, N_FEATURES))
    seen_children, before = [0] * n, [0] * n
    depth, up_boiler, up_content = [0] * n, [0] * n, [0] * n
    flags = [[t in group for group in TAG_FLAGS] for t in dom.tag]
    above = [[False] * INHERITED for _ in range(n)]
    for i in range(n):
        p = parent[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            up_boiler[i] = up_boiler[p] + dom.boiler[p]
            up_content[i] = up_content[p] + dom.content[p]
            above[i] = [x or y for x, y in zip(above[p], flags[p])]
            at = seen_children[p]
            seen_children[p] += 1
            start = before[i] = before[p]
            before[p] += sub[i]
            siblings, around = children[p], max(sub[p], 1)
        else:
            at, start, siblings, around = 0, 0, 1, total
        s = max(sub[i], 1)
        out[i] = [
            depth[i], children[i], at / siblings, siblings, math.log1p(own[i]), math.log1p(sub[i]), sublink[i] / s, sub[i] / (inner[i] + 1),
            inner[i], 100 * substops[i] / s, sub[i] / max(subruns[i], 1), sub[i] / total, start / total, sub[i] / around,
            dom.boiler[i], dom.content[i], up_boiler[i], up_content[i], subboiler[i] - dom.boiler[i], controls[i],
            *flags[i], *above[i], main_inside[i],
        ]
    return out
