"""Main text of web pages by a tree-structured graphical model (operator 6).

Every block element of a page is a node that is content or not. Unary potentials come
from its tag, words in its class, id and role, its text, links and punctuation; pairwise
potentials tie a node to its parent and depend on the kind of the child. On a tree the
sum-product algorithm is exact: messages go up from the leaves, then down from the root,
and give every node's probability of being content. Text runs whose block is more likely
content than not are the main text.

Trained by gradient steps on the likelihood, where the expectations come from the same
messages. Labelled pages: (a) about ``max_pages`` pages (never above twice that) of the table itself that carry
an article or main element, whose descendants are content unless they sit in a
navigation, aside, footer, form or comment element; half of them are shown again with
that element renamed to div, so the model does not lean on the tag alone; (b) pages made
by ``practice_page`` from a fixed seed with the parts that the table may lack (sidebars,
notices, comments, forms). Bounds are parameters; only that sample reaches the driver.

Blocks: runs of text between block boundaries; character references decoded, white space
inside a block (line breaks too) one space, trimmed; joined by a blank line in page
order. Nothing is capped.

Defined cases: null and empty html and pages without content give the empty text; broken
markup is read tolerantly; other columns are kept by ``extract`` (an input column with
an output name is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded_sample, text_or_empty
from .dom import Page, parse

MAX_PAGES = 200
PRACTICE_PAGES = 300
TAGS = ["", "html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "aside",
        "footer", "header", "form", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "button", "dl",
        "dd", "dt", "input", "fieldset", "dialog", "center", "hr", "details"]
_TAG_ID = {t: i for i, t in enumerate(TAGS)}
#: Words in class, id or role that hint at the part of a page.
GROUPS = [
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|toc",
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|dfp|adslot|adbox",
    r"sidebar|aside|widgets?|related|recommend\w*|popular|trending|rail|complementary",
    r"comments?|commentlist|replies|reply|discussion|respond|disqus|reader\w*",
    r"footer|foot|copyright|legal|contentinfo|colophon",
    r"header|masthead|logo|topbar|site-?title|branding",
    r"cookies?|consent|notice|popup|modal|newsletter|subscribe|subscription|alert|overlay|paywall|gdpr",
    r"form|search\w*|login|signup|signin|register|contact",
    r"share|sharing|social|tags?|byline|meta|author|rating",
    r"content|article\w*|post|entry\w*|main|story|text|prose|body",
]
_GROUP = [re.compile(rf"(?<![a-z])(?:{g})(?![a-z])") for g in GROUPS]
KINDS = {"p": 1, "h1": 1, "h2": 1, "h3": 1, "li": 1, "td": 1, "blockquote": 1, "pre": 1, "dd": 1, "dt": 1, "tr": 1,
         "ul": 2, "ol": 2, "table": 2, "figure": 2, "dl": 2, "article": 3, "main": 3,
         "nav": 4, "aside": 4, "footer": 4, "form": 4, "header": 4, "dialog": 4, "button": 4}
_UNSAFE = {"nav", "aside", "footer", "form", "dialog", "button"}
N_DENSE = 7
N_MASK = len(GROUPS) + 1
N_UNARY = len(TAGS) + N_MASK + N_DENSE


@dataclass
class Forest:
    """The nodes of several pages; parents come before children."""

    x: np.ndarray        # unary features
    kind: np.ndarray     # of the edge to the parent; -1 at roots
    parent: np.ndarray
    levels: list[np.ndarray]


@dataclass
class Model:
    unary: np.ndarray    # N_UNARY weights of "content" against "not"
    pair: np.ndarray     # (kinds, 2, 2): parent state, child state


def forest(pages: list[Page]) -> Forest:
    rows, kind, parent, depth = [], [], [], []
    for page in pages:
        first = len(rows)
        n = len(page.nodes)
        chars = np.array([v.chars for v in page.nodes], float)
        links = np.array([v.link_chars for v in page.nodes], float)
        for i in range(n - 1, 0, -1):  # sums over the subtree
            p = page.nodes[i].parent
            chars[p] += chars[i]
            links[p] += links[i]
        total = max(1.0, chars[0])
        for i, v in enumerate(page.nodes):
            x = np.zeros(N_UNARY)
            x[_TAG_ID.get(v.tag, 0)] = 1
            if v.marks:
                for k, g in enumerate(_GROUP):
                    if g.search(v.marks):
                        x[len(TAGS) + k] = 1
            x[len(TAGS) + len(GROUPS)] = v.hidden
            x[-N_DENSE:] = (1.0, links[i] / max(1.0, chars[i]), np.log1p(v.chars) / 6, np.log1p(chars[i]) / 8,
                            min(1.0, 20 * v.points / max(20, v.chars)), chars[i] / total, i / n)
            rows.append(x)
            root = v.parent < 0
            parent.append(-1 if root else first + v.parent)
            depth.append(0 if root else depth[first + v.parent] + 1)
            kind.append(-1 if root else KINDS.get(v.tag, 0))
    depths = np.array(depth, int)
    order = np.argsort(depths, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depths[order])) + 1) if len(order) else []
    return Forest(np.array(rows).reshape(-1, N_UNARY), np.array(kind, int), np.array(parent, int), levels)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(model: Model, f: Forest) -> tuple[np.ndarray, np.ndarray]:
    """P(content) per node and P(parent state, child state) per node that has a parent."""
    n = len(f.parent)
    own = np.zeros((n, 2))
    own[:, 1] = f.x @ model.unary
    up = np.zeros((n, 2))        # message of a node to its parent, by the parent's state
    gathered = np.zeros((n, 2))  # sum of the messages of a node's children
    for level in reversed(f.levels[1:]):
        below = own[level] + gathered[level]
        up[level] = _lse(model.pair[f.kind[level]] + below[:, None, :], 2)
        np.add.at(gathered, f.parent[level], up[level])
    belief = own + gathered    # everything at or below the node
    down = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        above = belief[f.parent[level]] - up[level] + down[f.parent[level]]
        table = model.pair[f.kind[level]] + above[:, :, None]
        down[level] = _lse(table, 1)
        table = table + belief[level][:, None, :]
        joint[level] = np.exp(table - _lse(table.reshape(len(level), 4), 1)[:, None, None])
    total = belief + down
    return np.exp(total[:, 1] - _lse(total, 1)), joint


def fit(pages: list[Page], gold: list[np.ndarray], steps: int = 150, rate: float = 0.3, ridge: float = 2e-3) -> Model:
    """Adam steps on the mean log likelihood of the labelled trees."""
    f = forest(pages)
    y = np.concatenate(gold).astype(int)
    kinds = 1 + max(KINDS.values())
    has = f.parent >= 0
    seen = np.zeros((kinds, 2, 2))
    np.add.at(seen, (f.kind[has], y[f.parent[has]], y[has]), 1.0)
    model = Model(np.zeros(N_UNARY), np.zeros((kinds, 2, 2)))
    theta = np.zeros(N_UNARY + kinds * 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        p, joint = marginals(model, f)
        expect = np.zeros((kinds, 2, 2))
        np.add.at(expect, f.kind[has], joint[has])
        grad = np.concatenate([f.x.T @ (y - p), (seen - expect).ravel()]) / len(y) - ridge * theta / 10
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        theta = theta + rate * (1 - t / steps * 0.9) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        model = Model(theta[:N_UNARY], theta[N_UNARY:].reshape(kinds, 2, 2))
    return model


def gold_of(page: Page) -> np.ndarray:
    """Labels: by data-gold where a page has it, else by its article or main element."""
    out = np.zeros(len(page.nodes), bool)
    explicit = any(v.gold for v in page.nodes)
    for i, v in enumerate(page.nodes):
        inside = v.parent >= 0 and out[v.parent]
        if explicit:
            out[i] = v.gold == "1" if v.gold else inside
        elif v.tag in _UNSAFE or (v.marks and any(_GROUP[k].search(v.marks) for k in (0, 1, 2, 3, 6))):
            out[i] = False
        else:
            out[i] = inside or v.tag in ("article", "main")
    return out


def practice_page(rng: random.Random) -> str:
    """One labelled page of a random layout (``data-gold``), with parts of every kind."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    para = lambda: " ".join(words(4, 14).capitalize() + rng.choice(".,.?.!") for _ in range(rng.randint(1, 6)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    items = lambda: "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8)))

    def boiler(names: str, tag: str, inner: str) -> str:
        name = rng.choice(names.split())
        how = rng.random()
        tag = tag if how < 0.5 else "div"
        mark = f' class="{name}"' if how > 0.3 else f' id="{name}"' if how > 0.15 or tag == "div" else ""
        return f'<{tag}{mark} data-gold="0">{inner}</{tag}>'
    comments = "".join(f"<{t}>{para()}</{t}>" for t in [rng.choice(["p", "div", "li"])] * rng.randint(1, 5))
    parts = {
        "nav": boiler("menu nav navbar main-menu breadcrumb", "nav", f"<ul>{items()}</ul>"),
        "head": boiler("header masthead topbar site-header", "header", f"<div>{words(1, 4)}</div>{link()}"),
        "ad": boiler("ad ads advert sponsored promo-box", "div", para() if rng.random() < 0.5 else link()),
        "side": boiler("sidebar widget related popular", "aside", f"<h3>{words(1, 3)}</h3>" + (f"<ul>{items()}</ul>" if rng.random() < 0.6 else f"<p>{para()}</p>")),
        "note": boiler("cookie-notice consent newsletter popup alert", "div", f"<p>{para()}</p><button>{word()}</button>"),
        "form": boiler("search login contact-form subscribe", "form", f"{words(1, 5)}<input name=q><button>{word()}</button>"),
        "comments": boiler("comments comment-list replies reader-comments", "section", f"<h3>{words(1, 2)}</h3>{comments}"),
        "share": boiler("share social tags", "div", link() + link()),
        "foot": boiler("footer site-footer copyright", "footer", f"&copy; {words(2, 6)}. {para() if rng.random() < .5 else ''}"),
    }
    body = f"<h1>{words(3, 9)}</h1>" if rng.random() < 0.8 else ""
    for _ in range(rng.randint(1, 9)):
        r = rng.random()
        body += f"<p>{para()}</p>" if r < 0.65 else f"<h2>{words(1, 5)}</h2>" if r < 0.75 else \
            f"<ul>{''.join(f'<li>{para()}</li>' for _ in range(rng.randint(1, 4)))}</ul>" if r < 0.85 else \
            f"<blockquote>{para()}</blockquote>" if r < 0.9 else f"<div>{para()}</div>" if r < 0.95 else f"<p>{words(1, 3)}</p>"
        if rng.random() < 0.08:
            body += parts[rng.choice(["ad", "share", "note", "form"])]
    tag = rng.choice(["article", "article", "main", "div", "section", "div"])
    mark = rng.choice(["content", "post", "entry-content", "article-body", "story", "main"])
    body = f'<{tag}{f" class={chr(34)}{mark}{chr(34)}" if rng.random() < 0.6 else ""} data-gold="1">{body}</{tag}>'
    before = [parts[k] for k in ("head", "nav", "note", "ad", "form") if rng.random() < 0.55]
    after = [parts[k] for k in ("side", "comments", "share", "foot", "ad", "note", "form") if rng.random() < 0.5]
    rng.shuffle(before)
    page = "".join(before) + body + "".join(after)
    return f"<html><body>{f'<div class=wrapper>{page}</div>' if rng.random() < 0.5 else page}</body></html>"


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", max_pages: int = MAX_PAGES,
          practice: int = PRACTICE_PAGES, seed: int = 3) -> Model:
    """Fit on a bounded sample of the table's pages with an article and on practice pages."""
    sample = pages.select(text_or_empty(html_col).alias("html"), F.col(id_col).cast("string").alias("id")) \
        .filter(F.col("html").rlike("(?i)<(article|main)[ >]"))
    sample = bounded_sample(sample, F.col("id"), max_pages).toPandas().sort_values(["id", "html"])
    rng = random.Random(seed)
    sources = list(sample["html"]) + [
        re.sub(r"(?i)<(/?)(?:article|main)\b", r"<\1div", h) for h in sample["html"][::2]]
    trees = [parse(h) for h in sources]
    gold = [gold_of(t) for t in trees[:len(sample)]]
    gold += gold[::2][:len(trees) - len(sample)]  # a renamed page has the labels of its original
    made = [parse(practice_page(rng)) for _ in range(practice)]
    return fit(trees + made, gold + [gold_of(t) for t in made])


def main_texts(model: Model, htmls: list[str]) -> list[str]:
    trees = [parse(h) for h in htmls]
    f = forest(trees)
    p, _ = marginals(model, f) if len(f.parent) else (np.zeros(0), None)
    out, at = [], 0
    for tree in trees:
        out.append("\n\n".join(text for node, text in tree.runs if p[at + node] > 0.5))
        at += len(tree.nodes)
    return out


def extract(pages: DataFrame, html_col: str = "html", model: Model | None = None, id_col: str = "page_id") -> DataFrame:
    """Add ``text`` (main text) and ``n_chars`` (its code points) to every page."""
    bound_batches(pages.sparkSession)
    model = model or train(pages, html_col, id_col)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            out: list[str] = []
            for at in range(0, len(htmls), 64):  # trees of 64 pages at a time
                out += main_texts(model, htmls.iloc[at:at + 64].tolist())
            yield pd.Series(out, dtype=object)
    keep = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("text", "n_chars")]
    out = pages.select(*keep, run(text_or_empty(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
