"""Main text of web pages from a tree-structured graphical model over the DOM."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, pick, spans_of

# labelled pages the model is trained on, at most; chosen by a hash of the page
TRAIN_PAGES = 300
# longer pages are not chosen for training
TRAIN_CHARS = 40_000
STEPS = 250
CHARS_AT_ONCE = 1 << 21
ADDED = [("text", "string"), ("n_chars", "bigint")]

# never text of a page, whatever surrounds them
SILENT = frozenset("script style noscript template head title iframe object embed svg math canvas select textarea button audio video map datalist noembed noframes xmp".split())
# all that may stand in a head; any other start tag, or text, ends it
IN_HEAD = frozenset("html head title meta link base basefont bgsound script style noscript template noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var".split()
)
# a start tag of the key ends open elements of its set, up to the first of its stops
CLOSES = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"table", "tr"}), "th": ({"td", "th", "p"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
TAG = re.compile(r"<(/?)([a-z][^\s/>]*)", re.IGNORECASE)
# within a tag: up to its end or a quote, and a quoted value, which may hold the tag's end but no new tag
UNQUOTED = re.compile(r"[^>\"']*")
QUOTED = re.compile(r"\"[^\"<]*\"|'[^'<]*'")
NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
LABEL = re.compile(r"\blabel=\"(on|off)\"")
CUE = re.compile(r"[a-z]+")
# elements whose text is content in a labelled page, and those within them that are not
MAIN = frozenset(("article", "main"))
ASIDE = frozenset("nav aside footer form header menu dialog".split())


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, whether it ends an element, attributes) of all markup; the tag of comments,
    declarations and elements whose content is no markup is empty.

    One pass: what was looked for once and does not occur behind a place is not looked for again.
    """
    size, last_close, quotes = len(page), page.rfind(">"), True
    raw_end: dict[str, re.Pattern] = {}
    at = page.find("<")
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = size if end < 0 else end + 3
            yield at, end, "", False, ""
        elif (m := TAG.match(page, at)) and last_close >= m.end():
            tag = m[2].lower()
            raw = tag if tag in RAW else next((r for r in RAW if tag.startswith(r) and not (tag[len(r)].isalnum() or tag[len(r)] == "_")), "")
            if raw and not m[1]:
                if raw not in raw_end:
                    raw_end[raw] = re.compile(rf"</{raw}\s*>", re.IGNORECASE)
                found = raw_end[raw].search(page, page.find(">", at) + 1)
                end = found.end() if found else size
                yield at, end, "", False, ""
            else:
                end = _tag_end(page, m.end()) if quotes else 0
                if not end:  # all that follows is quoted: from here on quotes do not count
                    quotes, end = False, page.find(">", m.end()) + 1
                yield at, end, tag, bool(m[1]), page[m.end() : end - 1]
        elif page[at + 1 : at + 2] in ("!", "?", "/"):
            end = page.find(">", at) + 1 if last_close > at else size
            yield at, end, "", False, ""
        else:
            end = at + 1
        at = page.find("<", end)


def _tag_end(page: str, at: int) -> int:
    """Behind the ``>`` that ends the tag, the first one outside quotes; 0 if there is none."""
    while True:
        at = UNQUOTED.match(page, at).end()
        if at >= len(page):
            return 0
        if page[at] == ">":
            return at + 1
        quoted = QUOTED.match(page, at)
        at = quoted.end() if quoted else at + 1


@dataclass
class Tree:
    """Nodes of one page in page order; a run is a stretch of text without a block boundary."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    cues: list[tuple[str, ...]] = field(default_factory=list)
    runs: dict[int, str] = field(default_factory=dict)
    linked: dict[int, int] = field(default_factory=dict)
    given: dict[int, str] = field(default_factory=dict)  # state written into a training layout

    def add(self, parent: int, tag: str, cues: tuple[str, ...]) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.cues.append(cues)
        return len(self.parent) - 1


def cues_of(attrs: str) -> tuple[str, ...]:
    found: list[str] = []
    if "=" in attrs:
        for m in NAMED.finditer(attrs):
            # a word means the same as a class and as an id
            where = "" if m[1].lower() in ("class", "id") else f"{m[1].lower()}:"
            found += [where + w for w in CUE.findall((m[2] or m[3] or m[4] or "").lower())]
    if re.search(r"\bhidden\b|display\s*:\s*none", attrs, re.IGNORECASE):
        found.append("hidden")
    return tuple(dict.fromkeys(found))


def parse(page: str, labelled: bool = False) -> Tree:
    """The block elements and runs of a page; inline tags only count as links or not at all.

    ``labelled``: an attribute ``label`` of training layouts gives the state of its element.
    """
    tree = Tree()
    stack = [tree.add(-1, "#page", ())]
    open_tags: Counter[str] = Counter()  # of the stack, of ``quiet`` and of ``within``
    quiet_tags: Counter[str] = Counter()
    within_tags: Counter[str] = Counter()
    text: list[str] = []
    links = in_link = silent = 0
    quiet: list[str] = []
    within: list[str] = []  # blocks opened inside silent elements
    ends_at: dict[str, int] = {}

    def last_end(tag: str) -> int:
        if tag not in ends_at:
            ends_at[tag] = max((m.start() for m in re.finditer(f"</{tag}", page, re.IGNORECASE)), default=-1)
        return ends_at[tag]

    def flush() -> None:
        nonlocal links
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if words:
                node = tree.add(stack[-1], "#run", ())
                tree.runs[node], tree.linked[node] = words, links
        links = 0

    def cut(at: int) -> None:
        """The elements from place ``at`` of the stack on have ended."""
        open_tags.subtract(tree.tag[node] for node in stack[at:])
        del stack[at:]

    def close(names: set[str], stops: set[str]) -> None:
        if not any(open_tags[n] for n in names):
            return
        for at in range(len(stack) - 1, 0, -1):
            if tree.tag[stack[at]] in stops:
                return
            if tree.tag[stack[at]] in names:
                cut(at)
                return

    def heard() -> None:
        """No silent element is open any more."""
        nonlocal silent
        quiet.clear(), quiet_tags.clear()
        silent = 0

    at = 0
    for start, stop, tag, ends, attrs in tokens(page):
        between = page[at:start]
        if quiet == ["head"] and between.strip():
            heard()
        if between and not silent:
            text.append(between)
            if in_link:
                links += len(between)
        at = stop
        if not tag:
            continue
        if quiet == ["head"] and not ends and tag not in IN_HEAD:
            heard()
        if silent and ends and tag not in SILENT:
            if within_tags[tag]:
                while within:
                    gone = within.pop()
                    within_tags[gone] -= 1
                    if gone == tag:
                        break
            elif open_tags[tag]:  # the block around the silent element ends, and it with it
                heard()
        if tag in SILENT:
            if ends:
                if quiet_tags[tag]:
                    first = quiet.index(tag)
                    quiet_tags.subtract(quiet[first:])
                    del quiet[first:]
            elif tag not in VOID and not attrs.endswith("/") and (tag == "head" or last_end(tag) >= at):
                flush()
                quiet.append(tag)
                quiet_tags[tag] += 1
            silent = len(quiet)
            if not silent:
                within.clear(), within_tags.clear()
            continue
        if silent:
            if not ends and tag not in VOID and tag not in INLINE and not attrs.endswith("/"):
                within.append(tag)
                within_tags[tag] += 1
            continue
        within.clear(), within_tags.clear()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ends else 1
            continue
        if tag in ("br", "wbr"):
            text.append(" " if tag == "br" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        in_link = 0
        if ends:
            if open_tags[tag]:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if tree.tag[stack[k]] == tag))
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        elif tree.tag[stack[-1]] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            cut(len(stack) - 1)  # a block ends an open paragraph or heading
        stack.append(tree.add(stack[-1], tag, cues_of(attrs)))
        open_tags[tag] += 1
        if labelled and (label := LABEL.search(attrs)):
            tree.given[stack[-1]] = label[1]
    if at < len(page) and (not silent or quiet == ["head"]):
        text.append(page[at:])
    flush()
    return tree


def node_features(tree: Tree) -> list[list[str]]:
    """Named binary features of each node: what it is called, and how its text is made up."""
    n = len(tree.parent)
    chars, links = [0] * n, [0] * n
    for node, words in tree.runs.items():
        chars[node], links[node] = len(words), min(tree.linked[node], len(words))
    for node in range(n - 1, 0, -1):  # children come behind their parents
        up = tree.parent[node]
        chars[up] += chars[node]
        links[up] += links[node]
    out = []
    for node in range(n):
        most = 1 + 3 * links[node] // max(1, chars[node])  # 1: hardly any links, 4: nothing else
        if node in tree.runs:
            words = tree.runs[node]
            size = len(words)
            out.append([
                "run", f"run-link:{most}", "run-stop" if words[-1] in ".!?" else "run-open", f"run-in:{tree.tag[tree.parent[node]]}",
                "run-long" if size > 200 else "run-middle" if size > 60 else "run-short",
            ])
        else:
            out.append([f"tag:{tree.tag[node]}", f"link:{most}", *["cue:" + c for c in tree.cues[node]]])
    return out


def labels_of(tree: Tree) -> list[int]:
    """1 for main elements and what is below them, but for the asides in them; given states come first."""
    state: list[int] = []
    off: list[bool] = []  # below an element that was given as off
    for node, up in enumerate(tree.parent):
        given = tree.given.get(node)
        off.append(given == "off" or (up >= 0 and off[up]))
        if off[node] or tree.tag[node] in ASIDE:
            state.append(0)
        elif given == "on" or tree.tag[node] in MAIN:
            state.append(1)
        else:
            state.append(state[up] if up >= 0 else 0)
    return state


class Forest:
    """Trees of many pages side by side, for message passing level by level."""

    def __init__(self, trees: Sequence[Tree]):
        size = [len(t.parent) for t in trees]
        first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.first = first
        self.parent = np.concatenate([np.where(np.array(t.parent) >= 0, np.array(t.parent) + f, -1) for t, f in zip(trees, first)])
        depth = np.concatenate([np.array(t.depth) for t in trees])
        self.kind = np.concatenate([np.array([1 if i in t.runs else 0 for i in range(len(t.parent))]) for t in trees])
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        self.levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]

    def marginals(self, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(P(node = 1), pair marginals towards the parent, log partition) by sum-product.

        ``unary``: log potential of state 1 per node. ``edge[kind, parent state, child state]``.
        Messages go up level by level, then down; a node's belief joins both.
        """
        n = len(unary)
        local = np.stack([np.zeros(n), unary], axis=1)
        inside = local.copy()
        up = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            to = edge[self.kind[level]] + inside[level][:, None, :]
            up[level] = np.logaddexp(to[:, :, 0], to[:, :, 1])
            np.add.at(inside, self.parent[level], up[level])
        outside = np.zeros((n, 2))
        pair = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            rest = outside[self.parent[level]] + inside[self.parent[level]] - up[level]
            both = rest[:, :, None] + edge[self.kind[level]]
            outside[level] = np.logaddexp(both[:, 0, :], both[:, 1, :])
            joint = both + inside[level][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            pair[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        belief = inside + outside
        total = np.logaddexp(belief[:, 0], belief[:, 1])
        roots = self.levels[0]
        return np.exp(belief[:, 1] - total), pair, float(total[roots].sum())


@dataclass
class Model:
    index: dict[str, int]
    weight: np.ndarray
    edge: np.ndarray


def _unary(trees: Sequence[Tree], index: dict[str, int], weight: np.ndarray) -> np.ndarray:
    out = []
    get = index.get
    for tree in trees:
        for names in node_features(tree):
            out.append(sum(weight[i] for i in map(get, names) if i is not None))
    return np.array(out)


def train(pages: Sequence[str], steps: int = STEPS, ridge: float = 0.0005) -> Model:
    """Maximum likelihood of the node states of labelled pages, by gradient steps with exact marginals."""
    trees = [parse(p, labelled=True) for p in pages]
    state = np.concatenate([np.array(labels_of(t)) for t in trees])
    named = [names for t in trees for names in node_features(t)]
    index: dict[str, int] = {}
    rows, cols = [], []
    for row, names in enumerate(named):
        for f in names:
            rows.append(row)
            cols.append(index.setdefault(f, len(index)))
    rows_, cols_ = np.array(rows), np.array(cols)
    forest = Forest(trees)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[child], state[forest.parent[child]], state[child]), 1)
    theta = np.zeros(len(index) + 8)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weight, edge = theta[:-8], theta[-8:].reshape(2, 2, 2)
        unary = np.bincount(rows_, weights=weight[cols_], minlength=len(state))
        belief, pair, _ = forest.marginals(unary, edge)
        got = np.zeros((2, 2, 2))
        np.add.at(got, forest.kind[child], pair[child])
        grad = np.concatenate([np.bincount(cols_, weights=(state - belief)[rows_], minlength=len(index)), (seen - got).ravel()])
        grad = grad / len(trees) - ridge * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta = theta + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(index, theta[:-8], theta[-8:].reshape(2, 2, 2))


# Layouts that the labelled articles are also set in, so that the model does not lean on one tag.
# {a}: the article's blocks, {n}: link lists, {t}: a short text off the article.
LAYOUTS = (
    '<body><header><h2>{t}</h2><nav>{n}</nav></header><main label="on">{a}</main><aside><h3>{t}</h3><p>{t}</p></aside><footer><p>{t}</p></footer></body>',
    '<body><div id="menu" class="navbar" label="off">{n}</div><div id="content" class="post entry" label="on">{a}</div><div id="sidebar" class="widget" label="off"><p>{t}</p>{n}</div><div class="footer" label="off">{t}</div></body>',
    '<body><div class="cookie notice banner" label="off"><p>{t}</p></div><div class="wrapper"><div class="article body text story" label="on">{a}</div><div id="comments" class="comments" label="off"><h3>{t}</h3><div class="comment"><p>{t}</p></div><div class="comment reply"><p>{t} {t}</p></div></div></div></body>',
    '<body><div class="header top" label="off">{t}</div><article label="on">{a}<aside><p>{t}</p></aside><div class="share social related" label="off">{n}</div></article><section id="comments" class="comment list" label="off"><ol><li><p>{t}</p></li><li><p>{t} {t}</p></li></ol></section><footer>{n}</footer></body>',
    '<body><div class="ad advert sponsored promo" label="off">{t}</div><section class="main content page" label="on">{a}</section><form class="newsletter subscribe"><p>{t}</p><label>{t}</label></form><div role="navigation" label="off">{n}</div><div role="complementary" label="off"><p>{t}</p></div></body>',
    '<body><nav>{n}</nav><div class="ads" label="off">{t}</div><article label="on">{a}<div class="ad" label="off">{t}</div><section class="comments discussion" label="off"><p>{t}</p><p>{t}</p></section></article><div class="alert popup modal consent" label="off"><p>{t}</p></div><footer><p>{t}</p></footer></body>',
    '<body><div class="page"><div class="entry content" label="on">{a}</div><div class="responses" label="off"><article class="comment"><p>{t}</p></article><article class="comment"><p>{t} {t}</p></article></div></div><div class="bottom" label="off">{t}</div></body>',
    '<body><article label="on">{a}<section class="comments" label="off"><h2>{t}</h2><p>{t}</p></section></article><div class="cookie bar" label="off">{t}</div><form><p>{t}</p></form></body>',
    '<body><article label="on">{a}</article><div class="comments" label="off"><h3>{t}</h3><ul><li>{t}</li></ul></div><div class="cookie" label="off"><p>{t}</p></div></body>',
    '<body label="on"><nav>{n}</nav>{a}<div class="comments" label="off"><p>{t}</p></div><footer><p>{t}</p></footer></body>',
    '<body><div class="banner" label="off">{t}</div><main label="on">{a}</main><div class="sidebar" label="off">{t}</div></body>',
    '<body><table><tr><td class="menu nav" label="off">{n}</td><td class="main article" label="on">{a}</td><td class="sidebar right" label="off"><p>{t}</p></td></tr></table><div class="copyright legal disclaimer" label="off"><p>{t}</p></div></body>',
)
PLAIN = (
    "<article><h1>On the river</h1><p>The river runs past the old mill, and in the spring it floods the lower fields.</p>"
    "<p>People who lived there kept boats under the roof. They rowed to church when the water was high.</p></article>"
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About us</a></li></ul></nav><div class='ad'>Buy now and save.</div>",
    "<article><h1>Bread</h1><p>Mix flour and water, and leave the dough to rise for a night.</p><ul><li>Flour, two cups.</li><li>Water.</li></ul>"
    "<blockquote>Good bread takes time.</blockquote><p>Bake it until the crust is dark.</p></article>"
    "<nav><a href='/x'>News</a> <a href='/y'>Sports</a></nav><footer>All rights reserved.</footer>",
)


PARAGRAPH = re.compile(r"<p\b[^>]*>(.*?)(?:</p>|(?=<p\b)|\Z)", re.DOTALL | re.IGNORECASE)


def _varied(blocks: str, k: int) -> str:
    """An article's blocks as they are, its beginning alone, or with lists, quotes and headings among them."""
    if k % 3 == 0:
        return blocks
    parts = list(PARAGRAPH.finditer(blocks))
    if k % 3 == 1:
        return blocks[: parts[min(1, len(parts) - 1)].end()] if parts else blocks
    forms = ("<ul><li>{0}</li><li>{0}</li></ul>", "<p>{0}</p>", "<h2>{1}</h2><p>{0}</p>", "<blockquote>{0}</blockquote>", "<p>{1}</p>", "<pre>{0}</pre>", "<ol><li><p>{1}</p></li></ol>", "<div>{0}</div>", "<figure><figcaption>{1}</figcaption></figure>", "<table><tr><td>{1}</td><td>{1}</td></tr></table>")
    head = blocks[: parts[0].start()] if parts else blocks
    return head + "".join(forms[(k + i) % len(forms)].format(m[1], " ".join(m[1].split()[:6])) for i, m in enumerate(parts))


def training_pages(sample: Sequence[str]) -> list[str]:
    """The sampled pages, and their articles, varied, in each of the layouts."""
    out, k = [], 0
    for page in [*PLAIN, *sample]:
        out.append(page)
        inner = re.search(r"<article\b[^>]*>(.*?)</article>", page, re.DOTALL | re.IGNORECASE)
        nav = re.search(r"<nav\b[^>]*>(.*?)</nav>", page, re.DOTALL | re.IGNORECASE)
        ad = re.search(r"<div class=[\"']ad[\"']>(.*?)</div>", page, re.DOTALL | re.IGNORECASE)
        if not inner:
            continue
        for _ in range(2):
            short = ad[1] if ad else "Read more here."
            layout = LAYOUTS[k % len(LAYOUTS)].replace("{n}", nav[1] if nav else "<ul><li><a href='/'>Home</a></li></ul>")
            # texts beside an article may be as long as its paragraphs
            layout = layout.replace("{t}", short if k % 4 else " ".join([short] * 4)).replace("{a}", _varied(inner[1], k // len(LAYOUTS)))
            out.append(layout)
            k += 1
    return out


def fit_pages(pages: DataFrame, most: int = TRAIN_PAGES) -> Model:
    """Train on at most ``most`` pages that mark their article, the first by a hash of the page."""
    marked = pick(pages, "html").filter(F.col("html").rlike("(?i)<article\\b") & (F.length("html") <= TRAIN_CHARS))
    sample = marked.select("html", F.xxhash64("html").alias("h")).orderBy("h", "html").limit(most).toArrow()
    return train(training_pages(sample.column("html").to_pylist()))


def extract(pages: Sequence[str], model: Model) -> list[str]:
    """The main text of each page: its content runs, one to a line."""
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    forest = Forest(trees)
    belief, _, _ = forest.marginals(_unary(trees, model.index, model.weight), model.edge)
    return [
        "\n".join(words for node, words in tree.runs.items() if belief[first + node] > 0.5)
        for tree, first in zip(trees, forest.first)
    ]


def extract_text(pages: DataFrame, model: Model) -> DataFrame:
    """``pages`` (page_id, url, html) as (page_id, url, text, n_chars), one row per row.

    A null or empty html, and a page without content, give an empty text. Text is never cut.
    """
    work = pick(pages, "page_id", "url", "html")
    schema = extended(work.select("page_id", "url"), ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = [h or "" for h in batch.column("html").to_pylist()]
            for a, b in spans_of([len(h) for h in source], CHARS_AT_ONCE):
                texts = extract(source[a:b], model)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").slice(a, b - a), batch.column("url").slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return work.mapInArrow(run, schema)
