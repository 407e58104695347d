"""Main-text extraction from HTML with boosted trees over DOM nodes.

Every block of a page is a node with features of its subtree (text and link
density), its hashed attribute words, its depth and its siblings. Gradient-boosted
trees give the log odds that a node holds main text. The decision for a page
is the most likely labelling in which no node is main text below a node that
is not: best scores for keeping and for dropping every subtree are summed from
the leaves up and followed from the root down.

The trees are fitted on pages written by a seeded generator with known main
text (``TRAIN_PAGES`` of them, a fixed bound); no page of the corpus is
labelled, and none is used for fitting.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsense.llm.boost import BoostedTrees
from fieldsense.llm.common import bounded_batches
from fieldsense.llm.dom import TOKEN, Node, bucket, features, read

TRAIN_PAGES = 1000
SEED = 11
NODES_AT_ONCE = 20_000


# fixed values: words that class, id and role attributes of the training pages are made of
ATTRIBUTE_WORDS = {
    "article": "article content entry post story body main text prose paragraph hentry",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc sitemap links skip",
    "header": "header head masthead topbar banner logo branding hero",
    "footer": "footer foot bottom copyright colophon legal credits",
    "side": "sidebar side aside rail widget widgets related recommended popular trending teaser",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay paywall toast privacy dialog",
    "comment": "comment comments discussion disqus reply replies respond thread reviews",
    "social": "share sharing social follow tweet facebook newsletter subscribe signup",
    "form": "form search login signin contact input field poll survey",
    "title": "entry-header article-header post-header page-title story-head title headline entry-title",
    "references": "references reference-list footnotes sources bibliography citations notes further-reading",
    "plain": "container wrapper page layout row site root inner clearfix col box js",
}


# ------------------------------------------------------------- training pages
class PageWriter:
    """Pages with known main text: blocks of the article carry ``data-main``."""

    def __init__(self, rng: random.Random):
        self.r, self.inside = rng, False
        self.words = ["".join(rng.choice(("ka", "lo", "mi", "ter", "an", "re", "su", "end", "o", "vi")) for _ in
                              range(rng.randint(1, 4))) for _ in range(200)]

    def some(self, lo: int, hi: int) -> str:
        return " ".join(self.r.choices(self.words, k=self.r.randint(lo, hi)))

    def sentence(self, lo=4, hi=18) -> str:
        s = self.some(lo, hi)
        return s.capitalize() + self.r.choice((".", ".", ".", "!", "?", ""))

    def prose(self, lo=1, hi=8) -> str:
        out = [self.sentence() for _ in range(self.r.randint(lo, hi))]
        if self.r.random() < 0.25:
            out.insert(self.r.randrange(len(out) + 1), f'<a href="/x">{self.some(1, 4)}</a>')
        if self.r.random() < 0.15:
            out.append(f"<b>{self.some(1, 3)}</b>")
        return self.r.choice((" ", " ", " | ")).join(out)

    def attr(self, *words: str) -> str:
        """class or id with one of the words, sometimes none or neutral ones. Inside
        an article what is not of it always says so."""
        if not self.inside and self.r.random() < 0.12:
            return ""
        w = self.r.choice(words)
        extra = self.r.choice(("", "", " clearfix", " col-" + str(self.r.randint(1, 12)), "-wrapper", " js-x", "_box"))
        return f' {self.r.choice(("class", "class", "id"))}="{w}{extra}"'

    def attr_of(self, kind: str) -> str:
        """class or id with one or two of the words of a kind, or none."""
        words = ATTRIBUTE_WORDS[kind].split()
        w = self.r.choice(words)
        if self.r.random() < 0.25:
            w += self.r.choice(("-", " ", "_")) + self.r.choice(words)
        return self.attr(w)

    def links(self, n: int, sep: str = "") -> str:
        return sep.join(f'<li><a href="/{self.r.choice(self.words)}">{self.some(1, 4)}</a></li>' for _ in range(n))

    def close(self, tag: str) -> str:
        return "" if tag in ("p", "li", "dt", "dd") and self.r.random() < 0.25 else f"</{tag}>"

    def junk(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            t = r.choice(("nav", "nav", "div", "ul"))
            body = self.links(r.randint(2, 12))
            return f"<{t}{self.attr_of('nav')}>" + (
                body if t == "ul" else f"<ul>{body}</ul>") + f"</{t}>"
        if kind == "header":
            t = r.choice(("header", "header", "div"))
            a = self.attr_of('header')
            inner = r.choice((f"<h1>{self.some(1, 4)}</h1>", f"<p>{self.some(2, 9)}</p>", f"<div>{self.some(1, 5)}</div>"))
            return f"<{t}{a}>{inner}{self.junk('nav') if r.random() < .4 else ''}</{t}>"
        if kind == "footer":
            t = r.choice(("footer", "footer", "div"))
            inner = r.choice((f"&copy; {self.some(1, 3)} &middot; {self.sentence()}", f"<p>&copy; 2024 {self.sentence()}</p>",
                              f"<ul>{self.links(r.randint(2, 6))}</ul><p>{self.sentence()}</p>",
                              f"<p>{self.prose(1, 3)}</p><div>{self.some(2, 6)}</div>"))
            return f"<{t}{self.attr_of('footer')}>{inner}</{t}>"
        if kind == "side":
            t = r.choice(("aside", "aside", "div", "section"))
            inner = r.choice((f"<h3>{self.some(1, 3)}</h3><ul>{self.links(r.randint(2, 8))}</ul>",
                              f"<h3>{self.some(1, 3)}</h3><p>{self.prose(1, 3)}</p>", f"<p>{self.prose(1, 4)}</p>",
                              f"<div>{self.sentence()}</div><div>{self.sentence()}</div>"))
            return f"<{t}{self.attr_of('side')}>{inner}</{t}>"
        if kind == "ad":
            t = r.choice(("div", "div", "div", "aside", "section", "p"))
            inner = r.choice((self.sentence(), self.prose(1, 3), f'<a href="/b">{self.sentence()}</a>'))
            inner = inner if t == "p" or r.random() < .6 else f"<p>{inner}</p>"
            return f"<!-- ad --><{t} {r.choice(('class', 'id'))}=\"" + r.choice(
                ("ad", "ads", "ad-slot", "ad-banner", *ATTRIBUTE_WORDS["ad"].split())) + f"\">{inner}</{t}>"
        if kind == "notice":
            t = r.choice(("div", "div", "section", "aside", "dialog"))
            a = f' class="{r.choice(("cookie-notice", "cookie-banner", *ATTRIBUTE_WORDS["notice"].split()))}"'
            inner = r.choice((self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f"<p>{self.sentence()}</p><button>ok</button>"))
            return f"<{t}{a}>{inner}</{t}>"
        if kind == "form":
            inner = f"<label>{self.some(1, 3)}</label><input name=q><button>{self.some(1, 2)}</button>"
            if r.random() < .5:
                inner = f"<p>{self.sentence()}</p>" + inner
            return f"<form{self.attr_of('form')}>{inner}</form>"
        if kind == "social":
            return (f"<{'div'}{self.attr_of('social')}>" + r.choice(
                (f"<ul>{self.links(r.randint(2, 6))}</ul>", self.some(1, 5), f"<p>{self.sentence()}</p>")) + "</div>")
        # reader comments
        t = r.choice(("section", "div", "div", "ol"))
        item = r.choice(("div", "article", "li", "p"))
        items = "".join(f"<{item}{self.attr('comment', 'comment-body', 'reply')}>" + r.choice(
            (self.prose(1, 4), f"<b>{self.some(1, 2)}</b> {self.prose(1, 3)}")
            if item in ("p", "li") else (f"<p>{self.prose(1, 4)}</p>", f"<h4>{self.some(1, 2)}</h4><p>{self.prose(1, 3)}</p>"))
            + f"</{item}>" for _ in range(r.randint(1, 6)))
        head = f"<h3>{self.some(1, 2)}</h3>" if r.random() < .5 and t != "ol" else ""
        word = r.choice(("comments", "comment-list", "responses replies", *ATTRIBUTE_WORDS["comment"].split()))
        return f"<{t} {r.choice(('class', 'id'))}=\"{word}\">{head}{items}</{t}>"

    def titled(self, title: str) -> str:
        """The article's title, sometimes in a header of its own with a line below it."""
        r, m = self.r, " data-main"
        if r.random() < .55:
            return title
        line = r.choice(("", "", f"<p{m}>{self.sentence()}</p>", f"<p{m}>{self.some(2, 6)}</p>"))
        t = r.choice(("header", "header", "div", "hgroup"))
        return f"<{t}{self.attr_of('title') if t == 'div' or r.random() < .5 else ''}>{title}{line}</{t}>"

    def references(self) -> str:
        """A headed list at the end of the article whose entries are links in whole or in part."""
        r, m = self.r, " data-main"
        t, h = r.choice(("ol", "ul")), r.randint(2, 4)
        whole = r.random() < .5
        entries = "".join(f"<li{m}>" + (f'<a href="/{r.choice(self.words)}">{self.some(1, 9)}</a>' if whole or r.random() < .3 else
                                        f'{self.some(1, 6)}. <a href="/x">{self.some(1, 6)}</a>, {self.some(1, 3)}.')
                          + self.close("li") for _ in range(r.randint(1, 8)))
        body = f"<h{h}{m}>{self.some(1, 3)}</h{h}><{t}{self.attr_of('references') if r.random() < .4 else ''}>{entries}</{t}>"
        return body if r.random() < .7 else f"<{r.choice(('section', 'div'))}{self.attr_of('references')}>{body}</section>"

    def closing_links(self) -> str:
        """A last paragraph that is mostly links."""
        r, m = self.r, " data-main"
        linked = [f'<a href="/{r.choice(self.words)}">{self.some(1, 5)}</a>' for _ in range(r.randint(1, 4))]
        return f"<p{m}>" + r.choice(("", f"{self.some(1, 4)}: ", f"{self.some(2, 6)} ")) + r.choice(
            (", ", " and ", " ")).join(linked) + r.choice((".", "", f" {self.sentence()}")) + self.close("p")

    def article(self) -> str:
        r, m = self.r, " data-main"
        out = []
        brief = r.random() < .45                 # a few short sentences only
        title = self.some(1, 12)
        if r.random() < .8:
            out.append(self.titled(f"<h1{m}>{title}</h1>"))
        if brief and r.random() < .5:            # the first block says the same as the title
            out.append(f"<p{m}>" + r.choice((f"{title}.</p>", f"{title}</p>", f"<b>{title}<br>", f"<b>{title}.<br>")))
        for _ in range(r.choice((0, 1, 1, 2) if brief and out else (1, 2, 3, 4, 6, 8, 12, 20))):
            k = r.random()
            if brief:
                out.append(f"<p{m}>{self.sentence(1, 8)}{self.close('p')}")
            elif k < .72:
                out.append(f"<p{m}>{self.prose(1, r.choice((1, 2, 6, 10)))}{self.close('p')}")
            elif k < .79:
                out.append(f"<h{(h := r.randint(2, 4))}{m}>{self.some(1, 8)}</h{h}>")
            elif k < .86:
                t = r.choice(("ul", "ol"))
                out.append(f"<{t}>" + "".join(f"<li{m}>{self.prose(1, 2)}{self.close('li')}" for _ in
                                              range(r.randint(2, 6))) + f"</{t}>")
            elif k < .90:
                out.append(f"<blockquote{m}>{self.prose(1, 3)}</blockquote>")
            elif k < .93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td{m}>{self.some(1, 4)}</td>" for _ in range(3))
                                               + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif k < .945:
                out.append(f"<p{m}><b>{self.sentence()}<br>")
            elif k < .957:
                out.append("<dl>" + "".join(f"<dt{m}>{self.some(1, 4)}{self.close('dt')}<dd{m}>{self.prose(1, 2)}"
                                            f"{self.close('dd')}" for _ in range(r.randint(1, 6))) + "</dl>")
            elif k < .965:
                out.append(f"<pre{m}>{self.some(4, 20)}</pre>")
            elif k < .98:
                out.append(f"<figure><img src=i.png>{r.choice(('', f'<figcaption{m}>{self.sentence()}</figcaption>'))}</figure>")
            else:
                out.append(f"<div{m}>{self.prose(1, 5)}</div>")
            if r.random() < (.25 if brief else .1):
                self.inside = True
                out.append(self.junk(r.choice(("ad", "ad", "side", "social", "form", "notice", "comment", "nav"))))
                self.inside = False
        if not brief and r.random() < .35:
            out.append(self.references())
        if not brief and r.random() < .15:
            out.append(self.closing_links())
        body = "".join(out)
        if r.random() < .3:
            body = f"<div{self.attr_of('article')}>{body}</div>"
        if r.random() < .2:
            self.inside = True
            body += self.junk(r.choice(("comment", "social", "side", "ad")))
            self.inside = False
        t = r.choice(("article", "article", "article", "main", "div", "section"))
        a = self.attr_of('article') if t in (
            "div", "section") or r.random() < .3 else ""
        body = f"<{t}{a}>{body}</{t}>"
        return f"<main>{body}</main>" if t != "main" and r.random() < .25 else body

    def page(self) -> str:
        r = self.r
        before = [self.junk(k) for k in ("notice", "header", "nav", "ad", "form", "side")
                  if r.random() < {"header": .5, "nav": .75, "ad": .45}.get(k, .2)]
        after = [self.junk(k) for k in ("ad", "side", "comment", "social", "form", "notice", "footer")
                 if r.random() < {"footer": .8, "comment": .35, "side": .35}.get(k, .2)]
        r.shuffle(before)
        if r.random() < .12:                     # an article and little else
            before, after = before[:1] * (r.random() < .3), after[-1:] * (r.random() < .5)
        middle = [self.article()]
        if r.random() < .25:
            middle.insert(r.randrange(2), self.junk("side"))
            middle = [f"<div{self.attr('container', 'wrapper', 'page', 'layout', 'row')}>", *middle, "</div>"]
        body = "".join([*before, *middle, *after])
        if r.random() < .3:
            body = f"<div{self.attr('page', 'wrapper', 'site', 'container', 'root')}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.some(2, 8)}</title></head><body>{body}" + (
            "</body></html>" if r.random() < .9 else "")


def known_words() -> dict[int, int]:
    """The buckets that the trees look at, each with its place."""
    words = {w for kind in ATTRIBUTE_WORDS.values() for w in TOKEN.findall(kind)}
    return {b: i for i, b in enumerate(sorted({bucket(w) for w in words}))}


KNOWN = known_words()


def training_set(pages: int = TRAIN_PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = read(PageWriter(rng).page())
        main = set()
        for n in reversed(nodes):
            if n.label or any(id(c) in main for c in n.children) or (
                    n.tag == "#text" and n.parent is not None and n.parent.label):
                main.add(id(n))
        xs.append(features(nodes, KNOWN))
        ys += [float(id(n) in main) for n in nodes]
    return np.vstack(xs), np.array(ys)


@lru_cache(maxsize=1)
def model() -> BoostedTrees:
    """The fitted trees (the same in every run)."""
    return BoostedTrees(rounds=300, share=0.3).fit(*training_set())


# ------------------------------------------------------------------ extraction
def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Most likely labels with no kept node below a dropped one; a node counts
    more the more text stands directly in it."""
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    weight = np.array([1.0 + min(len(x.text) / 50, 20.0) for x in nodes])
    keep = -np.logaddexp(0, -odds) * weight
    drop = -np.logaddexp(0, odds) * weight
    parent = [index.get(id(x.parent), -1) for x in nodes]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if p < 0:
            continue
        # a wrapper is only kept for what is kept below it
        drop[p] += drop[i]
        if keep[i] > drop[i]:
            keep[p] += keep[i]
        else:
            keep[p] += drop[i]
    out = [False] * n
    for i in range(n):
        p = parent[i]
        out[i] = (p < 0 or out[p]) and (i == 0 or keep[i] > drop[i])
    return out


def main_texts(pages: list[str | None], trees: BoostedTrees) -> list[str]:
    """Main text of each page ('' where there is none)."""
    out: list[str] = []
    lo = 0
    read_pages: list[list[Node]] = []

    def settle_up():
        rows = [p for p in read_pages if p]
        if rows:
            odds = trees.log_odds(np.vstack([features(p, KNOWN) for p in rows]))
        at = 0
        for p in read_pages:
            if not p:
                out.append("")
                continue
            labels = decode(p, odds[at:at + len(p)])
            at += len(p)
            out.append(" ".join(x.text for x, keep in zip(p, labels) if keep and x.text))
        read_pages.clear()

    for page in pages:
        read_pages.append(read(page or ""))
        lo += len(read_pages[-1])
        if lo > NODES_AT_ONCE:
            settle_up()
            lo = 0
    settle_up()
    return out


def extract_main(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``.

    The whole html is read; NULL or empty html, and pages without main text,
    give the empty text. Character references are decoded, white space inside a
    block becomes one space, blocks are joined in page order by one space.
    Repeated rows stay repeated, NULL ids and urls stay, other columns are
    not read. An empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    trees = model()                     # fitted once here; tasks get the trees

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([
                b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()),
                pa.array(main_texts(b.column("html").to_pylist(), trees), pa.string())], schema=schema)

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return (rows.mapInArrow(run, "page_id bigint, url string, text string")
            .withColumn("n_chars", F.length("text").cast("bigint")))
