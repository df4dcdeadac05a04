"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of block elements; each run of text between two block borders is a leaf. Every node gets
features of its subtree (text, link and tag density, shares of page and parent), of its attribute tokens and tag, of
its depth, place and siblings, and of the elements above it. Boosted trees, trained in numpy on pages written by the
labelled page grammar below, give each node the odds of being open (holding main text) or closed (boilerplate).
Decoding takes the best labelling of the whole tree in which nothing below a closed node is open.

NULL, empty and text-free pages give an empty text; broken markup is read to the page's end; pages of any length are
read whole; repeated rows give the same text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasphere.llm.tables import pieces, table

# Element names by their role, and attribute tokens that tell of it.
BLOCKS = frozenset(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "header footer nav aside form fieldset address details summary hgroup center hr menu dialog search title noscript template svg textarea select "
    "option button iframe object canvas label".split())
NEVER = frozenset("title noscript template svg textarea select option button iframe object canvas".split())
VOID = frozenset("hr br img input meta link wbr source track area base col embed param".split())
CLOSES_P = BLOCKS - frozenset("label button select option textarea svg object iframe template noscript canvas".split())
CLOSES_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "body": ("html",)}
ROLES = ("article main", "nav menu", "header", "footer", "aside dialog", "form fieldset label search", "ul ol dl", "li dt dd", "h1 h2 h3 h4 h5 h6", "p blockquote pre", "table tbody thead tr td th", "#text")
GOOD = frozenset("article content main post entry story body text prose page blogpost paragraph".split())
BAD = frozenset(
    "nav menu navbar navigation breadcrumb breadcrumbs ad ads advert advertisement sponsor sponsored banner promo footer header masthead sidebar aside rail widget comment comments "
    "reply replies disqus discussion cookie consent notice alert popup modal newsletter subscribe signup login search share social related recommended recommendations trending tags "
    "pagination pager copyright legal toolbar skip form".split())


class Page(HTMLParser):
    """The block tree of one page, as lists over its nodes in page order; labelled: data-open gives the label, as in pages of the grammar."""

    def __init__(self, html: str, labelled: bool = True):
        super().__init__(convert_charrefs=True)
        self.labelled = labelled
        self.tag, self.parent, self.tokens, self.text, self.label = ["#page"], [-1], [()], [""], [1]
        self.chars, self.linked, self.tags = [0], [0], [0]
        self.stack, self.run, self.run_linked, self.anchors, self.code = [0], [], 0, 0, False
        self.standing = Counter()  # open elements by name, so that a stray end tag is known without a look at the stack
        html = re.sub(r"&#[0-9]{4000,}", lambda m: "&#" + (m.group()[2:].lstrip("0")[:8] or "0"), html)  # int() reads no longer numbers; from eight digits on all are beyond Unicode
        self.feed(re.sub(r"<[a-zA-Z/!][^<>]*\Z", "", html))  # a tag that the page's end cuts off is no text
        self.close()
        self.flush()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """HTML has no marked sections: up to the next >, each is a comment, but for closed CDATA, which is one as a whole."""
        end = super().parse_marked_section(i, report) if self.rawdata[i : i + 9].upper() == "<![CDATA[" else -1
        return end if end > 0 else self.parse_bogus_comment(i, report)

    def node(self, tag: str, tokens: tuple, text: str = "", linked: int = 0, label: int | None = None) -> int:
        up = self.stack[-1]
        for field, v in ((self.tag, tag), (self.parent, up), (self.tokens, tokens), (self.text, text), (self.chars, len(text)), (self.linked, linked), (self.tags, 0)):
            field.append(v)
        self.label.append(self.label[up] if label is None else label)
        return len(self.tag) - 1

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            self.node("#text", (), text, min(self.run_linked, len(text)))
        self.run, self.run_linked = [], 0

    def cut(self, k: int) -> None:
        self.standing.subtract(self.tag[j] for j in self.stack[k:])
        del self.stack[k:]

    def handle_starttag(self, tag, attrs):
        self.tags[self.stack[-1]] += 1
        if tag not in BLOCKS:
            self.code = self.code or tag in ("script", "style")
            if tag in VOID:
                self.run.append(" ")
            self.anchors += tag == "a"
            return
        self.flush()
        self.anchors = 0
        if tag in CLOSES_P and self.tag[self.stack[-1]] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and not (tag[0] == "h" and tag[1:].isdigit() and self.tag[self.stack[-1]][0] == "h"):
            if self.tag[self.stack[-1]] == "p":
                self.cut(len(self.stack) - 1)
        if tag in CLOSES_OWN:
            for k in range(len(self.stack) - 1, 0, -1):
                if not any(self.standing[own] for own in CLOSES_OWN[tag]):
                    break
                name = self.tag[self.stack[k]]
                if name in CLOSES_OWN[tag]:
                    self.cut(k)
                    if tag != "tr":
                        break
                elif name in HOLDS[tag]:
                    break
        words, label = [], None
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop") and value:
                words += re.findall("[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())
            elif self.labelled and name == "data-open" and value in ("0", "1"):
                label = int(value)
        k = self.node(tag, tuple(words), label=label)
        if tag not in VOID:
            self.stack.append(k)
            self.standing[tag] += 1

    def handle_endtag(self, tag):
        if tag == "a":
            self.anchors = max(0, self.anchors - 1)
        elif tag in ("script", "style"):
            self.code = False
        elif tag == "br":
            self.run.append(" ")
        elif tag in BLOCKS:
            self.flush()
            if self.standing[tag]:
                k = len(self.stack) - 1
                while self.tag[self.stack[k]] != tag:
                    k -= 1
                self.cut(k)

    def handle_data(self, data):
        if self.code or self.tag[self.stack[-1]] in NEVER:
            return
        self.run.append(data)
        if self.anchors:
            self.run_linked += len(data)


FEATURES = 34


def features(page: Page) -> np.ndarray:
    """One row of numbers for every node."""
    n = len(page.tag)
    parent = page.parent
    chars, linked, nodes, tags, leaves, stops = page.chars[:], page.linked[:], [1] * n, page.tags[:], [int(t == "#text") for t in page.tag], [sum(map(t.count, ".,;:!?")) for t in page.text]
    depth, place, kids, above_good, above_bad, above_role = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    good, bad = [len(GOOD.intersection(t)) for t in page.tokens], [len(BAD.intersection(t)) for t in page.tokens]
    role = [ROLE.get(t, 0) for t in page.tag]
    for k in range(1, n):
        p = parent[k]
        depth[k] = depth[p] + 1
        place[k] = kids[p]
        kids[p] += 1
        above_good[k] = above_good[p] + good[p] + (role[p] == 1)
        above_bad[k] = above_bad[p] + bad[p] + (role[p] in (2, 3, 4, 5, 6))
        above_role[k] = role[p]
    for k in range(n - 1, 0, -1):
        p = parent[k]
        for a in (chars, linked, nodes, tags, leaves, stops):
            a[p] += a[k]
    up = np.maximum(np.array(parent), 0)
    chars, linked, nodes, tags, leaves, stops, kids, place = (np.array(x, float) for x in (chars, linked, nodes, tags, leaves, stops, kids, place))
    link = linked / np.maximum(chars, 1)
    siblings = np.maximum(kids[up], 1)
    out = np.zeros((n, FEATURES), np.float32)
    cols = [
        np.log1p(chars), link, np.log1p(nodes), np.log1p(tags), chars / nodes, chars / np.maximum(leaves, 1), stops / np.maximum(chars, 1), depth, place, place / siblings, siblings, kids,
        chars / max(chars[0], 1), chars / np.maximum(chars[up], 1), (linked[up] - linked) / np.maximum(chars[up] - chars, 1), (chars[up] - chars) / siblings, link[up],
        np.array(good), np.array(bad), np.minimum(above_good, 3), np.minimum(above_bad, 3), np.array(above_role)]
    for j, c in enumerate(cols):
        out[:, j] = c
    out[np.arange(n), len(cols) - 1 + np.array(role)] = np.where(np.array(role) > 0, 1, out[np.arange(n), len(cols) - 1 + np.array(role)])
    return out


ROLE = {t: k + 1 for k, names in enumerate(ROLES) for t in names.split()}


class BoostedTrees:
    """Trees of fixed depth on quantile bins, boosted on the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 5.0):
        self.depth, self.trees = depth, []
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._bin(x)
        f = np.zeros(len(y))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            split = np.zeros((2 ** depth - 1, 2), np.int64)
            for level in range(depth):
                first, many = 2 ** level - 1, 2 ** level
                best = np.full(many, 1e-6)
                choice = np.tile([0, bins + 1], (many, 1))
                local = at - first
                for j in range(x.shape[1]):
                    cell = local * (bins + 1) + binned[:, j]
                    gs, hs = (np.bincount(cell, w, many * (bins + 1)).reshape(many, -1).cumsum(axis=1) for w in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < least / 10) | (ht - hs < least / 10)] = -1
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(many), top] > best
                    best = np.where(better, gain[np.arange(many), top], best)
                    choice[better] = np.stack([np.full(better.sum(), j), top[better]], axis=1)
                split[first : first + many] = choice
                at = 2 * at + 1 + (binned[np.arange(len(y)), split[at, 0]] > split[at, 1])
            leaf = at - (2 ** depth - 1)
            value = rate * np.bincount(leaf, g, 2 ** depth) / (np.bincount(leaf, h, 2 ** depth) + 1)
            f += value[leaf]
            self.trees.append((split, value))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned, rows, f = self._bin(x), np.arange(len(x)), np.zeros(len(x))
        for split, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, split[at, 0]] > split[at, 1])
            f += value[at - (2 ** self.depth - 1)]
        return f


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Which nodes are open: the likeliest labelling in which whatever is below a closed node is closed."""
    n = len(page.tag)
    gain = [min(max(float(o), -8.0), 8.0) for o in odds]  # of being open over being closed
    gain[0] = 50.0
    best = [0.0] * n
    for k in range(n - 1, -1, -1):
        best[k] = -1.0 if page.tag[k] in NEVER else best[k] + gain[k]
        if k and best[k] > 0:
            best[page.parent[k]] += best[k]
    open_ = [True] * n
    for k in range(1, n):
        open_[k] = open_[page.parent[k]] and best[k] > 0
    return open_


def main_text(page: Page, open_: list[bool]) -> str:
    return "\n".join(t for t, o in zip(page.text, open_) if o and t)


def _written_page(rng: random.Random) -> str:
    """One page of the labelled grammar; data-open marks what holds main text (children inherit it)."""
    vocabulary = ["".join(rng.choice(["ta", "re", "on", "si", "mel", "or", "ku", "the", "is", "an", "da"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    style = rng.random()

    def words(lo, hi):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(lo, hi))]
        if style < 0.15:
            return " ".join(x.upper() + "!!" for x in w)
        return " ".join(x + rng.choice(["", "", "", "", ",", "."]) for x in w).capitalize() + rng.choice([".", ".", ""])

    sentence = lambda: words(1, 60) if rng.random() < 0.8 else words(1, 3)
    link = lambda lo=1, hi=3: f'<a href="/x">{words(lo, hi)}</a>'
    items = lambda lo, hi, make: "<ul>" + "".join(f"<li>{make()}</li>" for _ in range(rng.randint(lo, hi))) + "</ul>"

    def attr(*names):
        return rng.choice([f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(names)} x{rng.randint(1, 9)}"']) if names else ""

    def inner():
        body = sentence()
        if rng.random() < 0.2:
            body += f" {link()} " + words(1, 20)
        return f"<b>{body}<br>" if rng.random() < 0.15 else body

    def block():
        kind = rng.random()
        if kind < 0.75:
            return f"<p>{inner()}" + ("</p>" if rng.random() < 0.8 else "")
        if kind < 0.81:
            return f"<h{rng.randint(2, 4)}>{words(2, 8)}</h2>".replace("</h2>", "</h2>")
        if kind < 0.87:
            return items(2, 6, lambda: words(3, 20))
        if kind < 0.91:
            return f"<blockquote><p>{sentence()}</p></blockquote>"
        if kind < 0.94:
            return "<table><tr><td>" + words(1, 6) + "</td><td>" + words(1, 6) + "</td></tr></table>"
        if kind < 0.97:
            return f"<div>{sentence()}</div>"
        return f"<figure><img src=x><figcaption>{words(3, 10)}</figcaption></figure>"

    title = f"<h1>{words(2, 10)}</h1>"
    content = (title if rng.random() < 0.8 else "") + "".join(block() for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 20])))

    def junk():
        kind = rng.randrange(13)
        menu = items(3, 9, link)
        return [
            f'<nav data-open=0>{menu}</nav>', f'<div data-open=0{attr("menu", "navbar", "main-nav", "breadcrumbs")}>{menu}</div>',
            f'<header data-open=0><h2>{words(1, 3)}</h2>{menu if rng.random() < 0.5 else ""}</header>',
            f'<footer data-open=0>{rng.choice([f"&copy; {words(2, 6)}", f"<p>{words(2, 12)}</p>{menu}", words(1, 25)])}</footer>',
            f'<div data-open=0{attr("footer", "site-footer", "copyright")}>{words(3, 20)} {link()}</div>',
            f'<div data-open=0{attr("ad", "ads", "advert", "banner", "sponsored", "promo-box")}>{words(2, 40)}</div>',
            f'<aside data-open=0{attr("sidebar", "related", "widget") if rng.random() < 0.6 else ""}><h3>{words(1, 4)}</h3>{rng.choice([menu, f"<p>{sentence()}</p>"])}</aside>',
            f'<div data-open=0{attr("sidebar", "rail", "related-posts", "trending")}>{menu}<p>{words(2, 15)}</p></div>',
            f'<div data-open=0{attr("cookie-notice", "consent", "alert", "notice", "popup")}><p>{words(5, 30)}</p><button>{words(1, 2)}</button></div>',
            f'<form data-open=0{attr("newsletter", "search-form", "login") if rng.random() < 0.5 else ""}><label>{words(1, 4)}</label><input><p>{words(1, 12)}</p><button>{words(1, 2)}</button></form>',
            f'<section data-open=0{attr("comments", "comment-list", "discussion", "replies")}><h3>{words(1, 3)}</h3>' + "".join(f'<div class="comment"><b>{words(1, 2)}</b><p>{sentence()}</p></div>' for _ in range(rng.randint(1, 8))) + "</section>",
            f'<ol data-open=0{attr("comments", "comment-thread")}>' + "".join(f"<li><p>{sentence()}</p></li>" for _ in range(rng.randint(1, 6))) + "</ol>",
            f'<div data-open=0{attr("share", "social", "tags", "pagination")}>{link()} {link()} {link()}</div>',
        ][kind]

    shape = rng.random()
    if shape < 0.55:
        main = f'<article{attr("post", "entry", "story") if rng.random() < 0.3 else ""}>{content}{junk() if rng.random() < 0.15 else ""}</article>'
        if rng.random() < 0.4:
            main = f"<main>{main}</main>"
    elif shape < 0.7:
        main = f'<main>{content}</main>'
    elif shape < 0.95:
        main = f'<div{attr("content", "post-body", "article-text", "entry-content", "main", "story")}>{content}{junk() if rng.random() < 0.15 else ""}</div>'
    else:
        main = f"<div><div>{content}</div></div>"
    before, after = ("".join(junk() for _ in range(rng.choice([0, 1, 2, 2, 3]))) for _ in range(2))
    body = before + main + after
    if rng.random() < 0.3:
        body = f'<div{attr("wrapper", "container", "site") if rng.random() < 0.5 else ""}>{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"


@lru_cache(maxsize=1)
def trained(pages: int = 900, seed: int = 11) -> BoostedTrees:
    rng = random.Random(seed)
    read = [Page(_written_page(rng)) for _ in range(pages)]
    return BoostedTrees(np.concatenate([features(p) for p in read]), np.concatenate([np.array(p.label, float) for p in read]))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches, "html"):
            read = [Page(h or "", labelled=False) for h in batch.column("html").to_pylist()]
            x = [features(p) for p in read]
            odds = np.split(model.log_odds(np.concatenate(x)), np.cumsum([len(a) for a in x])[:-1])
            texts = [main_text(p, decode(p, o)) for p, o in zip(read, odds)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op9_main_text": op9_main_text}
ORACLE: dict[str, str] = {}
