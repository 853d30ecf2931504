"""Main text of web pages by boosted trees over DOM nodes and a hierarchical decoding.

A page becomes a tree of block elements; inline elements belong to the block around them,
but those with attribute tokens are nodes too, and so is each run of text directly in body.
Each node gets features: text, links and tags of its subtree, depth, siblings and how many
of them have its shape, its place before, in or after the part of the page with most running
text, its kind and its attribute tokens, and those of the nodes above.  Boosted trees give the log-odds
that a node holds main text.  Decoding takes the labelling with the highest likelihood in
which no kept node lies below a dropped one: a node's worth is its log-odds plus the worth
of its children, or zero for dropping the whole subtree, whichever is more.

*Training.*  Pages carry no labels.  A bounded sample of the pages of the table
(``SAMPLE`` different pages, least hashes first) is learned from: a node's label comes from the
elements that say what they hold (article and main against nav, footer and the like) and
from attribute tokens of known meaning.  Each sampled page is also seen again as pages whose
makeup is known because they are put together from its text: main text, menus, side bars,
notices, reader comments and footers in changing containers.  Most of these then lose what
names them: tokens go or become arbitrary, and telling elements become div, while the labels
stay.  So the trees have to go by structure where nothing is named.  A page without any
telling element or token teaches by such copies alone, as its own labels aren't known.
Scripts, styles and the like never hold text.  Trees are fitted by Spark ML and applied
inside the tasks that parse, to all nodes of a step's pages at once.

Defined results: null, empty and text-only pages: the latter's text (no markup at all) is a
paragraph and kept, the others give an empty text; repeated rows give a row each; broken markup is read as far as
it goes, and elements left open end with their parent; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalign.llm.batches import map_arrow, steps

#: Pages learned from at most, trees, their depth, and the seed of the rearranged copies.
SAMPLE, TREES, DEPTH, SEED = 400, 20, 5, 7

# Elements of HTML by how they are laid out or what they mean.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object svg math select option textarea button audio video canvas".split())
AROUND = frozenset("nav header footer aside form menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the first ends an open element of the second.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
WALLS = frozenset("ul ol dl table body article section div".split())
# Attribute tokens of known meaning.
MAIN_TOKENS = frozenset("article articlebody content entry main post postbody prose story text body".split())
OTHER_TOKENS = frozenset((
    "ad ads advert advertisement banner bar breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus footer form header "
    "login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted recommended related replies reply "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget").split())
#: Tag of the nodes for runs of text directly in body.
RUN = "#run"
#: Attribute tokens that say nothing of main text or other parts.
_NEUTRAL = "name term link ref icon highlight date author underline x note label keyword small".split()
_GROUPS = ("p", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "li", "table", "td", "blockquote", "pre", RUN)
_BUCKETS = 8
_TOKEN = re.compile(r"[a-z]+")
_PLAIN = 30
N_FEATURES = _PLAIN + len(_GROUPS) + _BUCKETS


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "parts", "depth", "chars", "links", "tags", "own", "words", "stops", "silent", "label")

    def __init__(self, tag: str, tokens: tuple[str, ...], parent: Node | None):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.children: list[Node] = []
        self.parts: list[str | Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.silent = tag in SILENT or bool(parent and parent.silent)
        self.links = self.own = self.chars = self.words = self.stops = 0
        self.tags, self.label = 1, False


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("body", (), None)
        self.open: list[tuple[str, Node]] = [("body", self.root)]  # inline ones without tokens share their block's node
        self.run: Node | None = None  # run of text that goes on in body
        self.tags_open: Counter = Counter()
        self.in_link = 0

    @property
    def node(self) -> Node:
        return self.open[-1][1]

    def _open(self, tag: str, node: Node) -> None:
        self.open.append((tag, node))
        self.tags_open[tag] += 1
        self.in_link += tag == "a"

    def _close(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.tags_open[tag] -= 1
            self.in_link -= tag == "a"
        del self.open[at:]

    def _find(self, tags, walls=frozenset()) -> int:
        if not any(self.tags_open[tag] for tag in tags):  # nothing to look for, however deep the page
            return 0
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] in tags:
                return at
            if self.open[at][0] in walls:
                break
        return 0

    def _below(self, node: Node, tag: str, tokens: tuple[str, ...] = ()) -> Node:
        child = Node(tag, tokens, node)
        node.children.append(child)
        node.parts.append(child)
        return child

    def _inside(self) -> Node:
        """The node that text and inline elements go to: in body, a run."""
        if self.node is not self.root:
            return self.node
        if self.run is None:
            self.run = self._below(self.root, RUN)
        return self.run

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in EMPTY:
            if tag == "hr" and self.node is self.root:
                self.run = None
            node = self.run if self.node is self.root and self.run else self.node
            node.tags += 1
            node.parts.append(" ")
            return
        said = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label"))
        tokens = tuple(_TOKEN.findall(said.lower()))
        if tag in INLINE:
            node = self.node
            inside = self._inside()
            if tokens:
                node = self._below(inside, tag, tokens)
            else:
                inside.tags += 1
            self._open(tag, node)
            return
        if tag in ENDS_P and (at := self._find(("p",), WALLS)):
            self._close(at)
        if tag in ENDS_SAME and (at := self._find(ENDS_SAME[tag], WALLS)):
            self._close(at)
        if self.node is self.root:
            self.run = None
        self._open(tag, self._below(self.node, tag, tokens))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY and tag not in INLINE and self.open[-1][0] == tag and tag in ("svg", "math", "iframe"):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        if at := self._find((tag,), frozenset() if tag not in INLINE else WALLS):
            self._close(at)

    def handle_data(self, data):
        node = self.node
        if node is self.root and (self.run or not data.isspace()):
            node = self._inside()
        node.parts.append(data)
        if node.silent:
            return
        n = len(data) - data.count(" ")
        node.own += n
        node.words += data.count(" ")
        node.stops += data.count(".") + data.count(",")
        if self.in_link:
            node.links += n


def parse(page: str | None) -> list[Node]:
    """Nodes of a page in page order; the first is its body."""
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    out, stack = [], [builder.root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    for node in out:
        node.chars = node.own
    for node in reversed(out):
        if node.parent and not node.silent:
            for name in ("chars", "links", "tags", "words", "stops"):
                setattr(node.parent, name, getattr(node.parent, name) + getattr(node, name))
    return out


def _hits(node: Node, of: frozenset) -> int:
    return sum(t in of for t in node.tokens)


def running(node: Node) -> int:
    """Text of a node's children that isn't in links: much for what holds paragraphs."""
    return sum(max(c.own - c.links, 0) for c in node.children if not c.silent)


def features(nodes: list[Node]) -> np.ndarray:
    out = np.zeros((len(nodes), N_FEATURES))
    mass = [0 if n.silent else running(n) for n in nodes]
    heavy = max(range(len(nodes)), key=mass.__getitem__) if nodes else 0
    inside, onto = {id(nodes[heavy])} if nodes else set(), set()
    up_from = nodes[heavy] if nodes else None
    while up_from is not None:
        onto.add(id(up_from))
        up_from = up_from.parent
    shapes: Counter = Counter()
    shape_of = []
    for node in nodes:
        shape_of.append((id(node.parent), node.tag, tuple(c.tag for c in node.children[:4])))
        shapes[shape_of[-1]] += 1
    before = 0
    above: dict[int, tuple[int, int, int]] = {}
    place: dict[int, tuple[int, int, float]] = {}
    total = max(nodes[0].chars, 1) if nodes else 1
    for at, node in enumerate(nodes):
        up = above[id(node.parent)] if node.parent else (0, 0, 0)
        other, good, around = _hits(node, OTHER_TOKENS), _hits(node, MAIN_TOKENS), int(node.tag in AROUND)
        above[id(node)] = (up[0] + other, up[1] + good + (node.tag in ("article", "main")), up[2] + around)
        n = len(node.children)
        mean = sum(c.chars for c in node.children) / n if n else 0.0
        for i, child in enumerate(node.children):
            place[id(child)] = (i, n, mean)
        i, n_sib, mean_sib = place.get(id(node), (0, 1, float(node.chars)))
        parent = node.parent or node
        out[at, :20] = (
            math.log1p(node.chars), math.log1p(node.own), node.links / max(node.chars, 1), math.log1p(node.tags), node.chars / node.tags,
            node.depth, n, i / max(n_sib - 1, 1), n_sib, node.chars / max(mean_sib, 1.0), node.chars / total, node.stops / max(node.words, 1),
            parent.chars / parent.tags, parent.links / max(parent.chars, 1), other, good, up[0], up[1], up[2], node.tag in HEADINGS)
        if node.parent and id(node.parent) in inside:
            inside.add(id(node))
        side = 0 if id(node) in inside else 2 if id(node) in onto else -1 if at < heavy else 1
        out[at, 20:_PLAIN] = (
            side, node.depth - nodes[heavy].depth, mass[at] / total, mass[at] / max(mass[heavy], 1), before / total, (before + node.chars) / total,
            shapes[shape_of[at]], shapes[shape_of[at]] / max(n_sib, 1), node.own / max(node.chars, 1), math.log1p(node.words / node.tags))
        before += 0 if node.silent else node.own
        if node.tag in _GROUPS:
            out[at, _PLAIN + _GROUPS.index(node.tag)] = 1
        for token in node.tokens:
            out[at, _PLAIN + len(_GROUPS) + sum(token.encode()) % _BUCKETS] = 1
    return out


def label(nodes: list[Node]) -> bool:
    """Mark the nodes that hold main text, as elements and tokens of known meaning say.

    Returns whether any says so.
    """
    inside: dict[int, tuple[bool, bool]] = {}
    marked = any(n.tag in ("article", "main") or _hits(n, MAIN_TOKENS) for n in nodes)
    for node in nodes:
        main, other = inside[id(node.parent)] if node.parent else (not marked, False)
        menu = node.tag == RUN and 2 * node.links > node.chars  # links alone are no article
        other = other or node.silent or menu or node.tag in AROUND or _hits(node, OTHER_TOKENS) > 0
        main = main or node.tag in ("article", "main") or _hits(node, MAIN_TOKENS) > 0
        inside[id(node)] = (main, other)
        node.label = main and not other and node.own > 0
    for node in reversed(nodes):
        if node.label and node.parent:
            node.parent.label = True
    return marked


def _guess(nodes: list[Node]) -> None:
    """Mark blocks with much running text, as material for copies of a page that says nothing itself."""
    for node in nodes:
        node.label = not node.silent and node.own > 80 and 5 * node.links < node.own


def unnamed(nodes: list[Node], rng: random.Random) -> None:
    """Take away what names the parts of a page; labels stay."""
    for node in nodes:
        node.tokens = () if rng.random() < 0.5 else ("".join(rng.choices("bcdfghklmnprstvz", k=rng.randint(2, 6))),)
        if node.tag in AROUND or node.tag in ("article", "main", "section"):
            node.tag = "div"


def rearranged(nodes: list[Node], rng: random.Random) -> str:
    """Another page with the blocks of this one: main text and other parts in other containers."""
    own = [(n.tag, " ".join("".join(p if isinstance(p, str) else " " for p in n.parts).split()), n.label) for n in nodes if n.own and not n.silent]
    main = [(t, s) for t, s, keep in own if keep and s]
    rest = [s for _, s, keep in own if not keep and s] or ["Home", "More"]
    texts = [s for _, s in main] or ["text"]

    def block(tag: str, text: str) -> str:
        name = tag if tag in HEADINGS else "p"
        return f"<{name}>{html.escape(text)}</{name}>"

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="#">{html.escape(rng.choice(rest)[:40])}</a></li>' for _ in range(rng.randint(3, 9))) + "</ul>"

    def short() -> str:
        return f"<p>{html.escape(rng.choice(texts)[:rng.randint(30, 300)])}</p>"

    def other() -> str:
        tag = rng.choice(("div", "section", "aside", "nav", "header", "footer", "form"))
        token = rng.choice(sorted(OTHER_TOKENS)) if tag in ("div", "section") or rng.random() < 0.5 else ""
        inner = rng.choice((links, short, lambda: short() + short(), lambda: "<div>" + short() + "</div>", aside))()
        return f'<{tag} class="{token}">{inner}</{tag}>'

    def aside() -> str:
        return f"<h3>{html.escape(rng.choice(rest)[:30])}</h3>" + rng.choice((links, short, lambda: links() + short()))()

    def footer() -> str:
        tag, token = rng.choice((("footer", ""), ("div", "footer"), ("div", "copyright")))
        said = rng.choice((short(), f"<p>&copy; {html.escape(rng.choice(rest)[:60])}</p>", f"&copy; {html.escape(rng.choice(rest)[:60])}", f"<p>{html.escape(rng.choice(texts)[:60])}</p>" + links()))
        return f'<{tag} class="{token}">{said}</{tag}>'

    def comments() -> str:
        outer, each, name = rng.choice(("div", "section")), rng.choice(("div", "div", "li", "article")), rng.choice(("b", "h4", "span", "p"))
        inner, title = rng.choice(("p", "p", "div", "")), rng.choice(("", "<h3>Comments</h3>", f"<h2>{html.escape(rng.choice(rest)[:20])}</h2>"))
        said = []
        for _ in range(rng.randint(1, 7)):
            text = html.escape(rng.choice(texts)[:rng.randint(20, 400)])
            said.append(f"<{each}><{name}>{html.escape(rng.choice(rest)[:12])}</{name}> " + (f"<{inner}>{text}</{inner}>" if inner else text) + f"</{each}>")
        listed = "".join(said)
        return f'<{outer} class="{rng.choice(("comments", "discussion", "replies", "respond"))}">{title}{f"<ul>{listed}</ul>" if each == "li" else listed}</{outer}>'

    tag = rng.choice(("article", "main", "div", "section"))
    token = rng.choice(sorted(MAIN_TOKENS)) if tag in ("div", "section") else ""
    body = "".join(block(*m) for m in main)
    if rng.random() < 0.5:
        body += other()
    middle = f'<{tag} class="{token}">{body}</{tag}>'
    for _ in range(rng.randint(0, 2)):
        middle = f"<div>{middle}{other() if rng.random() < 0.5 else ''}</div>"
    before, after = ("".join(other() for _ in range(rng.randint(0, 4))) for _ in range(2))
    after = (comments() if rng.random() < 0.6 else "") + after + (footer() if rng.random() < 0.7 else "")
    if rng.random() < 0.3:  # comments beside the text, in the same container
        middle = f"<div>{middle}{comments()}</div>"
    page = before + middle + after
    return f"<html><body>{f'<div>{page}</div>' if rng.random() < 0.4 else page}</body></html>"


def inline_copy(nodes: list[Node], rng: random.Random) -> str:
    """Another page with inline elements that carry tokens, and with text directly in body."""
    own = [(" ".join("".join(p if isinstance(p, str) else " " for p in n.parts).split()), n.label) for n in nodes if n.own and not n.silent]
    texts = [html.escape(s) for s, keep in own if keep and s] or ["text"]
    rest = [html.escape(s[:60]) for s, keep in own if not keep and s] or ["Home", "More"]

    def marked(text: str) -> str:
        words = text.split(" ")
        at = rng.randrange(len(words))
        upto = at + rng.randint(1, 6)
        tag, name = rng.choice(("a href='#'", "span", "span", "em", "code", "small")), rng.choice(_NEUTRAL)
        words[at:upto] = [f'<{tag} class="{name}">{" ".join(words[at:upto])}</{tag.split()[0]}>']
        text = " ".join(words)
        if rng.random() < 0.4:
            said = rng.choice((rng.choice(rest), rng.choice(texts)[:rng.randint(10, 80)]))
            text += f' <span class="{rng.choice(sorted(OTHER_TOKENS))}">{said}</span>'
        return text

    def menu() -> str:
        token = rng.choice(("", "", f' class="{rng.choice(sorted(OTHER_TOKENS))}"'))
        return " ".join(f'<a href="#"{token}>{rng.choice(rest)}</a>' for _ in range(rng.randint(1, 7)))

    body = [f"<p>{marked(x)}</p>" if rng.random() < 0.7 else f"<p>{x}</p>" for x in texts]
    if rng.random() < 0.5:
        middle = "<article>" + "".join(body) + "</article>" + rng.choice(("", rng.choice(rest)))
    else:  # nothing marked: the article is in body, partly without paragraphs
        middle = "".join(rng.choice((b, f"{x}<br><br>")) for b, x in zip(body, texts))
    return f"<html><body>{menu()}<hr><div></div>{middle}<div></div>{menu()}</body></html>"


def examples(page: str | None, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a page's nodes, of rearranged copies, most of them unnamed, and of one with inline nodes."""
    nodes = parse(page)
    rng = random.Random(seed)
    every = [nodes] if label(nodes) else []
    if not every:
        _guess(nodes)
    if any(n.label for n in nodes):
        for copy in range(4):
            every.append(parse(rearranged(nodes, rng)))
            label(every[-1])
            if copy:
                unnamed(every[-1], rng)
        every.append(parse(inline_copy(nodes, rng)))
        label(every[-1])
    rows = [(f, n.label) for some in every for f, n in zip(features(some), some) if not n.silent and n.parent]
    return np.array([r[0] for r in rows]).reshape(-1, N_FEATURES), np.array([r[1] for r in rows], float)


class Trees:
    """Boosted trees as arrays: feature (or -1), threshold, left, right, value."""

    def __init__(self, trees: list[list[tuple]], weights: list[float]):
        self.trees = [tuple(np.array(c) for c in zip(*tree)) for tree in trees]
        self.weights = weights

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                down = np.where(x[rows, np.maximum(feature[at], 0)] <= threshold[at], left[at], right[at])
                at = np.where(inner, down, at)
            out += weight * value[at]
        return 2.0 * out  # the loss of the trees takes twice the margin


def _exported(model) -> Trees:
    def walk(node, out: list) -> int:
        at = len(out)
        out.append(None)
        if node.subtreeDepth() == 0:
            out[at] = (-1, 0.0, 0, 0, node.prediction())
        else:
            split = node.split()
            left = walk(node.leftChild(), out)
            right = walk(node.rightChild(), out)
            out[at] = (split.featureIndex(), split.threshold(), left, right, 0.0)
        return at

    trees = []
    for tree in model.trees:
        nodes: list = []
        walk(tree._java_obj.rootNode(), nodes)
        trees.append(nodes)
    return Trees(trees, list(model.treeWeights))


def sampled(pages: DataFrame, sample: int) -> DataFrame:
    """(html, h, seed): different pages, least hashes first; copies of a page count once."""
    rows = pages.select("html", F.md5(F.col("html").cast("binary")).alias("h"))
    least = rows.select("h").distinct().orderBy("h").limit(sample)
    return rows.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"]).withColumn("seed", F.xxhash64("html"))


def learn(df: DataFrame, html_column: str = "html", sample: int = SAMPLE) -> Trees | None:
    """Trees fitted to ``sample`` different pages at most; None if the pages have nothing to tell apart."""
    page = F.col(f"`{html_column}`")
    picked = sampled(df.where(page.isNotNull()).select(page.alias("html")), sample)

    def run(batches):
        for batch in batches:
            for text, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = examples(text, SEED + seed)
                if len(y):
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(y)], ["x", "label"])

    rows = map_arrow(picked.select("html", "seed").repartition(8), run, "x array<double>, label double")
    rows = rows.select(array_to_vector("x").alias("features"), "label").persist()
    try:
        if rows.agg(F.countDistinct("label")).first()[0] < 2:
            return None
        return _exported(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.4, seed=SEED).fit(rows))
    finally:
        rows.unpersist()


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The most likely labelling that keeps no node below a dropped one."""
    place = {id(n): i for i, n in enumerate(nodes)}
    worth = np.array([-np.inf if n.silent else o for n, o in zip(nodes, odds)])
    for i in range(len(nodes) - 1, 0, -1):
        if worth[i] > 0:
            worth[place[id(nodes[i].parent)]] += worth[i]
    keep = [True] * len(nodes)
    for i in range(1, len(nodes)):
        keep[i] = bool(worth[i] > 0) and keep[place[id(nodes[i].parent)]]
    return keep


def main_texts(pages: list[str | None], trees: Trees | None) -> list[str]:
    """Main text of each page; the trees see the nodes of all pages at once."""
    parsed = [parse(page) for page in pages]
    ends = np.cumsum([0, *map(len, parsed)])
    odds = np.full(ends[-1], 1.0) if trees is None else trees.log_odds(np.concatenate([features(nodes) for nodes in parsed]))
    return [_chosen(nodes, odds[low:high]) for nodes, low, high in zip(parsed, ends, ends[1:])]


def main_text(page: str | None, trees: Trees | None) -> str:
    return main_texts([page], trees)[0]


def _chosen(nodes: list[Node], odds: np.ndarray) -> str:
    if len(nodes) == 2 and nodes[1].tag == RUN and nodes[1].tags == 1:
        odds[1] = 1.0  # text without markup
    keep = {id(n) for n, k in zip(nodes, decode(nodes, odds)) if k}
    out: list[str] = []
    stack: list[str | Node] = [nodes[0]]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            space = "" if part.tag in INLINE else " "
            out.append(space)
            if id(part) in keep:
                stack.append(space)
                stack.extend(reversed(part.parts))
    return " ".join("".join(out).split())


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html", sample: int = SAMPLE) -> DataFrame:
    """``key``, ``url``, text and n_chars of every row of ``df``."""
    trees = learn(df, html_column, sample)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{html_column}`").alias("html"))

    def run(batches):
        for batch in steps(batches, 2):
            texts = main_texts(batch.column(2).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    schema = f"key {df.schema[key].dataType.simpleString()}, url {df.schema[url].dataType.simpleString()}, text string, n_chars long"
    return map_arrow(rows, run, schema).withColumnsRenamed({"key": key, "url": url})
