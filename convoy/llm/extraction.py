"""Main text of web pages by a tree-structured graphical model.

Every DOM node is content or not. A node's own potential comes from a logistic model over what it is (tag, names, text),
and a potential between parent and child from how often their labels agree. One sum-product pass upward and one downward
give exact marginals; text runs whose marginal is above one half are the main text. Both potentials are trained on
labelled pages.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.llm.htmltree import INLINE, Node, joined, parse

#: Pages that training reads at most, and copies of each with another layout around the same article.
TRAIN_PAGES, LAYOUTS = 300, 3
RESULT = "page_id long, url string, text string"
#: Name parts that hint at content or at what surrounds it (fixed words of the HTML practice).
GOOD = re.compile(r"article|\bmain\b|content|post(?!er)|entry|story|\bbody|\btext|prose")
BAD = re.compile(
    r"nav|menu|header|footer|foot\b|side|\bads?\b|advert|\bad[-_]|[-_]ads?\b|sponsor|banner|promo|cookie|consent|notice|gdpr|comment|reply|respon[sd]|discuss|disqus"
    r"|form|search|login|sign|subscri|newsletter|share|social|related|recommend|widget|breadcrumb|crumb|pager|paginat|popup|modal|overlay|alert|toolbar|copyright|legal|tags?\b|meta|byline")
HIDDEN = re.compile(r"hidden|display:\s*none|visibility:\s*hidden")
LANDMARK = {
    "nav": "out", "header": "out", "footer": "out", "aside": "out", "form": "out", "button": "out", "select": "out", "dialog": "out", "menu": "out", "fieldset": "out", "label": "out",
    "article": "in", "main": "in",
}


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of the features that hold for each node."""
    size, linked = [0] * len(nodes), [0] * len(nodes)
    in_link = [False] * len(nodes)
    for k, node in enumerate(nodes):
        if k:
            in_link[k] = in_link[node.parent] or node.tag == "a"
    for k in range(len(nodes) - 1, 0, -1):
        node = nodes[k]
        if not node.tag:
            size[k] = len(node.text)
            linked[k] = size[k] if in_link[k] else 0
        size[node.parent] += size[k]
        linked[node.parent] += linked[k]
    out = []
    for k, node in enumerate(nodes):
        if not node.tag:
            # its length says little once the element it stands in is known
            out.append(["text"] + ["copyright"] * ("©" in node.text) + ["in_link"] * in_link[k])
            continue
        found = ["inline" if node.tag in INLINE else "block"]
        if node.tag in LANDMARK:
            found.append(f"{LANDMARK[node.tag]}_tag")
        elif node.tag in ("p", "a", "body"):
            found.append(f"tag_{node.tag}")
        if node.names:
            found += ["good_name"] * bool(GOOD.search(node.names)) + ["bad_name"] * bool(BAD.search(node.names)) + ["hidden"] * bool(HIDDEN.search(node.names))
        if size[k]:
            found.append(f"links{linked[k] * 4 // size[k]}")
        out.append(found)
    return out


KINDS = ("text", "landmark", "inline", "named", "block")


def kind(node: Node) -> str:
    """What the potential towards the parent depends on."""
    if not node.tag:
        return "text"
    if node.tag in LANDMARK or BAD.search(node.names):
        return "landmark"
    return "inline" if node.tag in INLINE else "named" if GOOD.search(node.names) else "block"


@dataclass(frozen=True)
class Model:
    """Log-odds weights of features, and per kind the 2 x 2 potential [parent label][child label]."""

    weights: dict[str, float]
    pair: dict[str, tuple[tuple[float, float], tuple[float, float]]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node by one upward and one downward pass."""
        n = len(nodes)
        own = []
        for found in features(nodes):
            x = max(-30.0, min(30.0, sum(self.weights.get(f, 0.0) for f in found) + self.weights.get("bias", 0.0)))
            p = 1 / (1 + math.exp(-x))
            own.append((1 - p, p))
        below = [(a, b) for a, b in own]  # own potential times the messages of the children
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        pairs = [self.pair[kind(node)] for node in nodes]
        for k in range(n - 1, 0, -1):
            (a, b), ((p00, p01), (p10, p11)) = below[k], pairs[k]
            m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b
            total = m0 + m1
            up[k] = (m0 / total, m1 / total)
            q = below[nodes[k].parent]
            x, y = q[0] * up[k][0], q[1] * up[k][1]
            below[nodes[k].parent] = (x / (x + y), y / (x + y))
        full = list(below)
        for k in range(1, n):
            parent, ((p00, p01), (p10, p11)) = full[nodes[k].parent], pairs[k]
            a, b = parent[0] / up[k][0], parent[1] / up[k][1]  # without this child's own message
            x, y = below[k][0] * (p00 * a + p10 * b), below[k][1] * (p01 * a + p11 * b)
            full[k] = (x / (x + y), y / (x + y))
        return [b for _, b in full]

    def extract(self, page: str | None) -> str:
        nodes = parse(page or "")
        return joined(nodes, [p > 0.5 for p in self.marginals(nodes)])


def fit(pages: list[tuple[list[Node], list[int]]], steps: int = 12, pull: float = 1.0) -> Model:
    """Potentials from pages whose nodes are labelled 0 or 1: logistic regression, and smoothed label pairs by kind."""
    names: dict[str, int] = {"bias": 0}
    rows, truth, pairs = [], [], {k: np.ones((2, 2)) for k in KINDS}
    for nodes, labels in pages:
        for node, found, label in zip(nodes, features(nodes), labels):
            rows.append([0] + [names.setdefault(f, len(names)) for f in found])
            truth.append(label)
            if node.parent >= 0:
                pairs[kind(node)][labels[node.parent], label] += 1
    x = np.zeros((len(rows), len(names)))
    for k, row in enumerate(rows):
        x[k, row] = 1
    y, w = np.array(truth, float), np.zeros(len(names))
    for _ in range(steps if len(rows) else 0):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        w -= np.linalg.solve(curve, x.T @ (p - y) + pull * w)
    # given the parent, relative to how common the child's label is: the own potential has that already
    pair = {}
    for name, n in pairs.items():
        given, alone = n / n.sum(axis=1, keepdims=True), n.sum(axis=0) / n.sum()
        pair[name] = tuple(map(tuple, (given / alone).tolist()))
    return Model({name: float(w[k]) for name, k in names.items()}, pair)


def labelled(page: str) -> tuple[list[Node], list[int]] | None:
    """A page that marks its article itself: text runs in the only <article> or <main> are content, an element is when
    most of its text is. None for other pages. Article marks of generated layouts are taken off afterwards."""
    nodes = parse(page)
    marks = [k for k, node in enumerate(nodes) if node.tag in ("article", "main")]
    inside = [False] * len(nodes)
    if len([k for k in marks if nodes[k].tag == nodes[marks[0]].tag]) != 1:
        return None
    for k, node in enumerate(nodes):
        inside[k] = k == marks[0] or node.parent >= 0 and inside[node.parent]
    return nodes, _labels(nodes, [i and not node.tag for i, node in zip(inside, nodes)])


def _labels(nodes: list[Node], content: list[bool]) -> list[int]:
    good, size = [0] * len(nodes), [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        if not nodes[k].tag:
            size[k] = len(nodes[k].text)
            good[k] = size[k] * content[k]
        if k:
            size[nodes[k].parent] += size[k]
            good[nodes[k].parent] += good[k]
    return [int(2 * g > s) for g, s in zip(good, size)]


#: Layouts put around the article of a page: what holds it, and what stands beside it; {t} is a text of another page.
HOLDERS = ["<article>{a}</article>", "<main>{a}</main>", '<div class="content">{a}</div>', '<div id="main-content"><div class="post-body">{a}</div></div>', '<section class="entry story">{a}</section>', "<div>{a}</div>"]
BESIDE = [
    "<header><h1>{t}</h1><p>{t}</p></header>", '<div class="header top"><p>{t}</p></div>', "<nav><ul><li><a href=#>{s}</a></li><li><a href=#>{s}</a></li></ul></nav>",
    '<div class="menu"><a href=#>{s}</a> <a href=#>{s}</a></div>', "<aside><h3>{s}</h3><p>{t}</p></aside>", '<div class="sidebar"><h4>{s}</h4><p>{t}</p><p>{t}</p></div>',
    '<div class="cookie-notice"><p>{t}</p><button>{s}</button></div>', '<div class="ad">{t}</div>', '<div id="advert-1"><p>{t}</p></div>',
    "<form><label>{s}</label><p>{t}</p><button>{s}</button></form>", '<section class="comments"><h2>{s}</h2><div class="comment"><b>{s}</b><p>{t}</p></div><div class="comment"><p>{t}</p></div></section>',
    '<div id="comments"><ul><li><p>{t}</p></li><li><p>{t}</p></li></ul></div>', '<div class="related"><ul><li><a href=#>{t}</a></li><li><a href=#>{t}</a></li></ul></div>',
    '<div class="footer"><p>© {t}</p></div>', "<footer><p>{t}</p></footer>", '<div class="newsletter"><p>{t}</p></div>', '<div class="share"><a href=#>{s}</a></div>',
]
WITHIN = ["<h2>{s}</h2>", "<ul><li>{t}</li><li>{t}</li></ul>", "<blockquote><p>{t}</p></blockquote>", "<h3>{s}</h3><ol><li>{s}</li></ol>", "<table><tr><td>{s}</td><td>{s}</td></tr></table>", "<figure><figcaption>{t}</figcaption></figure>"]
_ARTICLE = re.compile(r"<(article|main)\b[^>]*>(.*?)</\1\s*>", re.S | re.I)


def layouts(pages: list[str], each: int = LAYOUTS, seed: int = 5) -> list[tuple[list[Node], list[int]]]:
    """The pages that mark their article, and copies with the same article in other layouts."""
    rng, out = random.Random(seed), []
    bodies = [m[2] for page in pages if (m := _ARTICLE.search(page))]
    texts = [t for body in bodies for t in re.findall(r">([^<>]{15,})<", body)] or ["text"]
    for page in pages:
        known = labelled(page)
        if known:
            out.append(known)
    for body in bodies:
        for _ in range(each):
            def fill(part: str) -> str:
                return re.sub(r"\{([ts])\}", lambda m: (t := rng.choice(texts)) if m[1] == "t" else " ".join(t.split()[:2]) if (t := rng.choice(texts)) else "", part)

            # articles link words, too, and have lists, headings and quotes of their own
            inner = re.sub(r"(?<=\s)(\w+ \w+)(?=\s)", lambda m: f"<a href=#>{m[1]}</a>" if rng.random() < 0.02 else m[1], body)
            inner = re.sub(r"</p>", lambda m: m[0] + (fill(rng.choice(WITHIN)) if rng.random() < 0.2 else ""), inner)
            beside = [fill(b) for b in rng.sample(BESIDE, 6)]
            cut = rng.randint(0, 4)
            page = f"<html><body>{''.join(beside[:cut])}<x-article>{rng.choice(HOLDERS).replace('{a}', inner)}</x-article>{''.join(beside[cut:])}</body></html>"
            nodes = parse(page)
            inside = [False] * len(nodes)
            for k, node in enumerate(nodes):
                inside[k] = node.tag == "x-article" or node.parent >= 0 and inside[node.parent]
            labels = _labels(nodes, [i and not node.tag for i, node in zip(inside, nodes)])
            out.append(_without(nodes, labels, "x-article"))
    return out


def _without(nodes: list[Node], labels: list[int], tag: str) -> tuple[list[Node], list[int]]:
    """The tree with the elements ``tag`` taken out and their children given to the parent."""
    new, kept, marks = {-1: -1}, [], []
    for k, node in enumerate(nodes):
        if node.tag == tag:
            new[k] = new[node.parent]
            continue
        new[k] = len(kept)
        kept.append(Node(node.tag, new[node.parent], node.names, node.text, node.breaks))
        marks.append(labels[k])
    return kept, marks


def train(pages: DataFrame, html: str = "html", most: int = TRAIN_PAGES) -> Model:
    """Model from at most ``most`` pages that mark their article, chosen by their hashes, whatever the input's split; about as many
    reach the driver."""
    marked = pages.where(F.col(html).rlike("(?i)<(article|main)\\b")).select(F.col(html).alias("html"))
    n, least = marked.agg(F.count("*"), F.min_by("html", F.xxhash64("html"))).first()
    some = marked.where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < int(1_500_000 * most / n)) if n > most else marked
    found = sorted(r["html"] for r in some.orderBy(F.xxhash64("html"), "html").limit(most).collect())
    if least is not None and not found:  # pages that are nearly all alike
        found = [least] * 5
    return fit(layouts(found or _PLAIN))


#: For tables without any marked page.
_PLAIN = ["<body><nav><a href=#>One</a><a href=#>Two</a></nav><article><h1>A title of some words</h1><p>A sentence of the main text. Another one follows it.</p></article><footer>Words of the foot</footer></body>"] * 5


def main_text(pages: DataFrame, model: Model | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text (empty if none), n_chars of every row.

    Null and empty pages have no text; pages without a tag are one run of text; very long pages are read whole, a page in
    one task; repeated rows give equal texts; other columns play no part; an empty table gives an empty table.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(pages, html))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = pa.array([shared.value.extract(p) for p in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["page_id", "url", "text"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, RESULT).withColumn("n_chars", F.length("text").cast("long"))
