"""Main text of HTML pages by a tree-structured graphical model.

Block elements of a page are the nodes of a tree; each is content, boilerplate or frame (a wrapper around
both). A node's own evidence (tag, words of its class and id, text and link density) and a potential between parent and
child score every labelling. Sum-product messages, upward and then downward, give exact marginals; all pages of a
batch pass messages level by level in numpy. The weights are trained on the labelled pages of ``labelled_pages``
by the gradient of the conditional likelihood, which needs nothing but the same marginals.

Text of a node whose content marginal is at least a half is kept: character references are decoded, white space in a block becomes
one space (a line break counts as white space), blocks are joined in page order by one newline.

Defined cases: a missing or empty page has no text; pages without elements are plain text of the root; unclosed and
stray tags are mended as browsers do for paragraphs, list items and cells; scripts, styles and the like are never text.
Repeated rows are read one by one; other columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOILERPLATE, CONTENT, FRAME = 0, 1, 2

# HTML's elements by how they are read.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
SILENT = set("script style template noscript head title textarea select button option iframe object svg canvas audio video math datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {
    "p": set(
        "address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
        "main menu nav ol p pre section table ul".split()
    ),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

# Tags and words of class, id and role that tell what a block is.
TAGS = (
    "html body div section article main p h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre figure figcaption aside nav header footer form "
    "dl dt dd address details dialog fieldset"
).split()
KINDS = {
    "content": "article content post entry story text body main prose blog news page",
    "wrapper": "wrapper container page site layout row col column grid root app outer inner wrap",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager topnav submenu toc links",
    "top": "header masthead topbar branding logo tagline banner",
    "bottom": "footer copyright legal colophon credits imprint contentinfo",
    "side": "sidebar side widget widgets rail complementary aside",
    "more": "related recommended recommendations popular trending teaser more next previous readmore",
    "ads": "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promoted promotion affiliate dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer announcement dialog",
    "comments": "comment comments commentlist reply replies respond discussion disqus reader readers thread",
    "share": "share sharing social follow facebook twitter tags tag meta",
    "form": "form login search contact register signin searchform feedback",
}
KIND_NAMES = list(KINDS)
WORD_KINDS: dict[str, list[int]] = {}
for _k, _name in enumerate(KIND_NAMES):
    for _w in KINDS[_name].split():
        WORD_KINDS.setdefault(_w, []).append(_k)
NAME_WORD = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

NUMBERS = ("own_text", "links", "short", "copyright", "empty", "one")
WIDTH = len(TAGS) + 1 + len(KIND_NAMES) + len(NUMBERS)
#: Potentials differ by what the child itself shows: nothing, content words, boilerplate words or tags, or a heading or list.
GROUPS = 4
_LOUD = {"nav", "footer", "header", "aside", "form", "dialog", "fieldset"}


class Tree(HTMLParser):
    """Block elements of one page and the text runs in them."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.names = ["html"], [-1], [""]
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.silent: list[str] = []
        self.runs: list[list] = []
        self.fresh = True
        self.link = 0
        self.feed(html)
        self.close()

    def _break(self) -> None:
        self.fresh = True

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.silent:
            if tag in SILENT and tag not in VOID:
                self.silent.append(tag)
            return
        if tag in SILENT:
            if tag == "head":
                return
            self.silent.append(tag)
            return
        if tag == "body" and self.open[0][0] == "html" and len(self.open) == 1 or tag not in ("html", "body"):
            self._imply(tag)
        else:
            return
        if tag in VOID:
            if tag == "br":
                self._text("\n")
            elif tag not in INLINE:
                self._break()
            return
        if tag in INLINE:
            self.link += tag == "a"
            self.open.append((tag, self.open[-1][1]))
            return
        self._break()
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        self.tags.append(tag)
        self.parents.append(self.open[-1][1])
        self.names.append(named)
        self.open.append((tag, len(self.tags) - 1))

    def _imply(self, tag: str) -> None:
        """Close what this tag ends without saying so."""
        for k in range(len(self.open) - 1, 0, -1):
            above = self.open[k][0]
            if tag in CLOSED_BY.get(above, ()):
                self._pop(k)
                return
            if above in HOLDERS.get(tag, ()) or (above not in INLINE and above not in CLOSED_BY):
                return

    def _pop(self, k: int) -> None:
        for tag, _ in self.open[k:]:
            self.link -= tag == "a"
            if tag not in INLINE:
                self._break()
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
            return
        for k in range(len(self.open) - 1, 0, -1):
            above = self.open[k][0]
            if above == tag:
                self._pop(k)
                return
            if tag in INLINE and above not in INLINE:
                return

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in VOID or tag not in SILENT:
            self.handle_starttag(tag, attrs)
            if tag not in VOID and tag in INLINE:
                self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self._text(data)

    def _text(self, data: str) -> None:
        node = self.open[-1][1]
        if self.fresh:
            if not data.strip():
                return
            self.runs.append([node, [], 0])
            self.fresh = False
        self.runs[-1][1].append(data)
        if self.link:
            self.runs[-1][2] += len(data)

    def blocks(self) -> list[tuple[int, str, int]]:
        """``(node, text, characters in links)`` in page order."""
        out = []
        for node, parts, links in self.runs:
            text = " ".join("".join(parts).split())
            if text:
                out.append((node, text, min(links, len(text))))
        return out


@dataclass
class Forest:
    """Trees of many pages: parents before children, ``levels`` the nodes at each depth, ``spoken`` those with text of their own."""

    x: np.ndarray
    spoken: np.ndarray
    parents: np.ndarray
    groups: np.ndarray
    levels: list[np.ndarray]


def _kinds(name: str) -> set[int]:
    return {k for w in NAME_WORD.findall(name) for k in WORD_KINDS.get(w.lower(), ())}


def features(tree: Tree, blocks: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Evidence of every node, its group of potentials and its depth."""
    n = len(tree.tags)
    own, total, links, copy = (np.zeros(n) for _ in range(4))
    for node, text, in_links in blocks:
        own[node] += len(text)
        links[node] += in_links
        copy[node] += "©" in text
    total += own
    depth = np.zeros(n, np.int64)
    for k in range(1, n):
        depth[k] = depth[tree.parents[k]] + 1
    for k in range(n - 1, 0, -1):
        p = tree.parents[k]
        total[p] += total[k]
        links[p] += links[k]
    x = np.zeros((n, WIDTH))
    groups = np.zeros(n, np.int64)
    base = len(TAGS) + 1
    for k in range(n):
        tag = tree.tags[k]
        kinds = _kinds(tree.names[k])
        loud = any(kind >= 2 for kind in kinds)
        if loud:  # an article that is called a comment is read as a comment
            kinds -= {0, 1}
        x[k, TAGS.index(tag) if tag in TAGS and not (loud and tag in ("article", "main", "section")) else len(TAGS)] = 1
        for kind in kinds:
            x[k, base + kind] = 1
        if loud or tag in _LOUD:
            groups[k] = 2
        elif 0 in kinds or tag in ("article", "main"):
            groups[k] = 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li"):
            groups[k] = 3
    x[:, base + len(KIND_NAMES) :] = np.stack(
        [
            own > 0,
            links / np.maximum(total, 1),
            (total > 0) & (total < 40),
            copy > 0,
            total == 0,
            np.ones(n),
        ],
        axis=1,
    )
    # Like siblings that tell nothing by name share one vote, so a long article weighs as much as a short one.
    quiet = np.isin(groups, (0, 3))
    siblings = np.bincount(np.array(tree.parents[1:], np.int64)[quiet[1:]], minlength=n)
    x[1:][quiet[1:]] /= np.maximum(1, siblings[np.array(tree.parents[1:], np.int64)[quiet[1:]]] / 3)[:, None]
    return x, groups, depth


def forest(trees: list[tuple[Tree, list]]) -> tuple[Forest, np.ndarray]:
    """One forest from many pages, and where each page's nodes begin."""
    parts = [features(t, b) for t, b in trees]
    sizes = np.array([len(p[1]) for p in parts], np.int64)
    first = np.r_[0, np.cumsum(sizes)]
    parents = np.concatenate([np.where(np.array(t.parents) < 0, -1, np.array(t.parents) + f) for (t, _), f in zip(trees, first, strict=False)])
    depth = np.concatenate([p[2] for p in parts])
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
    x = np.concatenate([p[0] for p in parts])
    return Forest(x, x[:, -len(NUMBERS) + NUMBERS.index("own_text")] > 0, parents, np.concatenate([p[1] for p in parts]), levels), first


@dataclass
class TreeModel:
    """``unary[feature, state]`` and ``pair[group, parent state, child state]``; the potential is the chance of the child's state after its parent's."""

    unary: np.ndarray
    pair: np.ndarray

    @property
    def move(self) -> np.ndarray:
        return self.pair - _logsum(self.pair)[..., None]


def _logsum(a: np.ndarray) -> np.ndarray:
    """Log of the summed exponents over the last, short axis."""
    parts = [a[..., k] for k in range(a.shape[-1])]
    top = parts[0]
    for p in parts[1:]:
        top = np.maximum(top, p)
    return np.log(sum(np.exp(p - top) for p in parts)) + top


def marginals(f: Forest, m: TreeModel) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each state of each node, and of each pair of states of a node and its parent (for the nodes that have one)."""
    inward, move = f.x @ m.unary, m.move
    inward[f.spoken, FRAME] -= 30  # a frame has no text of its own
    upward = np.zeros_like(inward)
    for nodes in reversed(f.levels[1:]):
        upward[nodes] = _logsum(move[f.groups[nodes]] + inward[nodes][:, None, :])
        np.add.at(inward, f.parents[nodes], upward[nodes])
    belief = inward.copy()
    both = np.zeros((len(inward), 3, 3))
    for nodes in f.levels[1:]:
        above = belief[f.parents[nodes]] - upward[nodes]
        joint = above[:, :, None] + move[f.groups[nodes]] + inward[nodes][:, None, :]
        belief[nodes] = _logsum(joint.transpose(0, 2, 1))
        joint = np.exp(joint - _logsum(joint.reshape(len(nodes), 9))[:, None, None])
        both[nodes] = joint
    return np.exp(belief - _logsum(belief)[:, None]), both


def train(f: Forest, states: np.ndarray, steps: int = 400, rate: float = 0.15, penalty: float = 1e-6) -> TreeModel:
    """Ascend the conditional likelihood: observed minus expected counts, by Adam."""
    m = TreeModel(np.zeros((f.x.shape[1], 3)), np.zeros((GROUPS, 3, 3)))
    child = np.flatnonzero(f.parents >= 0)
    seen_unary = f.x.T @ np.eye(3)[states]
    seen_pair = np.zeros((GROUPS, 3, 3))
    np.add.at(seen_pair, (f.groups[child], states[f.parents[child]], states[child]), 1)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (m.unary, m.pair)]
    for step in range(1, steps + 1):
        one, both = marginals(f, m)
        expected = np.zeros((GROUPS, 3, 3))
        np.add.at(expected, f.groups[child], both[child])
        surplus = seen_pair - expected
        surplus = surplus - np.exp(m.move) * surplus.sum(axis=2, keepdims=True)
        for w, slope, (a, b) in zip((m.unary, m.pair), (seen_unary - f.x.T @ one, surplus), moments, strict=True):
            slope = slope / len(states) - penalty * w
            a += 0.1 * (slope - a)
            b += 0.01 * (slope**2 - b)
            w += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return m


@lru_cache(maxsize=1)
def trained() -> TreeModel:
    """The model from the labelled pages."""
    from umbral.llm.labelled_pages import labelled_pages

    trees, states = [], []
    for html, labels in labelled_pages():
        tree = Tree(html)
        trees.append((tree, tree.blocks()))
        states.append([labels(name, tag) for name, tag in zip(tree.names, tree.tags, strict=True)])
    for (tree, _), own in zip(trees, states, strict=True):
        tree.names = [" ".join(w for w in name.split() if not w.startswith("__")) for name in tree.names]
        for k in range(len(own)):
            if own[k] is None:
                own[k] = own[tree.parents[k]] if k else FRAME
    return train(forest(trees)[0], np.concatenate([np.array(s, np.int64) for s in states]))


def main_texts(pages: list[str | None], model: TreeModel) -> list[str]:
    """Main text of each page."""
    trees = [(t := Tree(p or ""), t.blocks()) for p in pages]
    if not trees:
        return []
    f, first = forest(trees)
    keep = marginals(f, model)[0][:, CONTENT] >= 0.5
    return ["\n".join(text for node, text, _ in blocks if keep[base + node]) for (_, blocks), base in zip(trees, first, strict=False)]


def main_text(html: Column | str, model: TreeModel, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        values = pages.to_pylist()
        return pa.array([t for k in range(0, len(values), 64) for t in main_texts(values[k : k + 64], shared.value)], pa.string())

    return run.asNondeterministic()(html)


def extract(df: DataFrame, html: str = "html", output: str = "text") -> DataFrame:
    """``df`` with the main text and its number of characters, ``n_chars``; columns of those names are replaced."""
    found = df.withColumn(output, main_text(F.col(html).cast("string"), trained(), df.sparkSession))
    return found.withColumn("n_chars", F.length(output).cast("bigint"))
