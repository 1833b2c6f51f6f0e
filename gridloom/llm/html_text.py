"""Main text of web pages: boosted trees over DOM nodes, decoded over the hierarchy.

A node's label is whether it holds main text. The trees give each node log-odds from subtree density, attribute
words, depth, siblings and ancestors. Decoding picks the labelling of greatest total log-odds among the consistent ones:
a node that holds no main text has no descendant that does, and an element that does has a child that does. The
text is that of the chosen runs, in page order.

The trees are fitted on pages that a generator writes, from layouts with known main text; no page of the input is learned from.

Defined cases: null and empty pages give an empty text; pages without markup are one run; repeated rows give
equal texts; an empty table gives an empty table; very deep and very long pages are read in one linear pass; other columns are ignored.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.boost import Boosted
from gridloom.llm.common import chunks, shared
from gridloom.llm.dom import Page, features

MARK = ""  # follows main text in generated pages
#: Generated pages that the trees are fitted on.
PAGES, SEED = 800, 11
#: Characters of HTML that one step reads.
STEP_CHARS = 1_000_000


class Writer:
    """Writes pages of varied layout whose main text is marked."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice(("th", "an", "er", "le", "de", "que", "sch", "ung", "ción", "eau", "in", "or", "st", "é", "ü", "ño", "re", "ing", "tion", "mo")) for _ in range(r.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 22) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.06:
            words = [w + self.r.choice(("***", "###", " |", "&amp;&amp;", "!!", "%%%")) for w in words]
        elif self.r.random() < 0.04:
            words = [w.upper() for w in words]
        text = " ".join(words)
        return text[0].upper() + text[1:] + self.r.choice((".", ".", ".", "!", "?"))

    def heading(self, low: int = 1, high: int = 10) -> str:
        text = self.sentence(low, high)
        return text[: self.r.choice((40, 60, 80))].strip() if self.r.random() < 0.5 else text.rstrip(".!?") if self.r.random() < 0.7 else text

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def attrs(self, *words: str) -> str:
        r = self.r
        if r.random() < 0.25:
            return ""
        name = r.choice(words) if words and r.random() < 0.8 else r.choice(("c", "x", "col", "row", "box", "wrap", "inner", "block")) + str(r.randint(1, 40))
        if r.random() < 0.3:
            name += r.choice(("-", "_")) + r.choice(("wrap", "inner", "box", "list", "1", "area", "block", "item"))
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def links(self, n: int) -> str:
        items = [f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(self.r.randint(1, 3)))}</a>' for _ in range(n)]
        kind = self.r.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return (" | " if kind < 0.8 else " ").join(items)

    def boilerplate(self) -> str:
        r, kind = self.r, self.r.randint(0, 8)
        if kind == 0:
            tag = r.choice(("nav", "div", "div"))
            return f"<{tag}{self.attrs('nav', 'menu', 'navigation', 'breadcrumbs', 'navbar')}>{self.links(r.randint(3, 12))}</{tag}>"
        if kind == 1:
            tag = r.choice(("div", "div", "aside", "section", "p"))
            return f'<{tag} {r.choice(("class", "id"))}="{r.choice(("ad", "ads", "advert", "banner", "promo", "sponsored", "ad-box"))}">{self.prose(1, 3)}</{tag}>'
        if kind == 2:
            tag = r.choice(("aside", "div", "section"))
            body = f"<h3>{self.heading(1, 6)}</h3>" + (self.links(r.randint(3, 8)) if r.random() < 0.6 else "".join(f"<p>{self.prose(1, 3)}</p>" for _ in range(r.randint(1, 3))))
            own = self.attrs("sidebar", "widget", "related", "recommended", "popular") if tag == "aside" else f' class="{r.choice(("sidebar", "widget", "related", "recommended", "side"))}"'
            return f"<{tag}{own}>{body}</{tag}>"
        if kind == 3:
            return f'<{(t := r.choice(("div", "section", "dialog")))} class="{r.choice(("cookie-notice", "consent", "notice", "newsletter", "popup", "gdpr", "subscribe", "cookie"))}"><p>{self.prose(1, 3)}</p></{t}>'
        if kind == 4:
            return f"<form{self.attrs('form', 'search', 'login', 'contact', 'newsletter')} action='/{self.word()}'>{self.sentence(1, 5)} <label>{self.word()}</label><input name=q><button>{self.word()}</button>{'<p>' + self.prose(1, 2) + '</p>' if r.random() < 0.4 else ''}</form>"
        if kind == 5:
            tag, item = r.choice((("section", "div"), ("div", "div"), ("div", "article"), ("ol", "li"), ("ul", "li")))
            heading = f"<h3>{self.heading(1, 4)}</h3>" if r.random() < 0.5 and tag != "ol" else ""
            each = "".join(f'<{item} class="{r.choice(("comment", "reply", "comment-body", "c1"))}"><p>{self.prose(1, 4)}</p></{item}>' for _ in range(r.randint(1, 8)))
            return f'<{tag} {r.choice(("class", "id"))}="{r.choice(("comments", "comment-list", "discussion", "responses", "disqus", "reader-comments"))}">{heading}{each}</{tag}>'
        if kind == 6:
            return f'<div class="{r.choice(("share", "social", "tags", "meta-tags", "follow"))}">{self.links(r.randint(2, 6))}</div>'
        if kind == 7:
            return f"<script>var t=\"</p>\";{self.word()}(1)</script><style>p{{margin:0}}</style><noscript>{self.sentence()}</noscript>"
        return f"<!-- {self.word()} <p>{self.sentence()}</p> -->"

    def m(self, text: str) -> str:
        return text + MARK

    def main_block(self) -> str:
        r, k = self.r, self.r.random()
        if k < 0.62:
            text = self.prose(1, 8)
            if r.random() < 0.2:
                a, _, b = text.partition(" ")
                text = f'{a} <a href="/{self.word()}">{self.word()}</a> {b}'
            if r.random() < 0.15:
                text = f"<b>{text}" if r.random() < 0.5 else f"<em>{text}</em>"
            return f"<p{self.attrs('text', 'paragraph') if r.random() < 0.1 else ''}>{self.m(text)}" + ("</p>" if r.random() < 0.85 else "")
        if k < 0.72:
            return f"<p>{self.m(self.heading(1, 5))}</p>"
        if k < 0.8:
            n = r.randint(2, 4)
            return f"<h{n}>{self.m(self.heading())}</h{n}>"
        if k < 0.87:
            return "<ul>" + "".join(f"<li>{self.m(self.sentence(2, 12))}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if k < 0.92:
            return f"<blockquote>{self.m(self.prose(1, 3)) if r.random() < 0.5 else '<p>' + self.m(self.prose(1, 3)) + '</p>'}</blockquote>"
        if k < 0.95:
            return f"<div>{self.m(self.prose(1, 4))}</div>"
        if k < 0.97:
            return f"<pre>{self.m(self.sentence())}</pre>"
        return "<table>" + "".join("<tr>" + "".join(f"<td>{self.m(self.sentence(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>"

    def page(self) -> str:
        r = self.r
        title = self.heading(2, 14)
        h1 = f"<h1>{self.m(title)}</h1>" if r.random() < 0.85 else ""
        blocks = [self.main_block() for _ in range(r.choice((1, 2, 3, 5, 8, 13, 21)))]
        if r.random() < 0.35:
            blocks.insert(r.randint(0, len(blocks)), self.boilerplate())
        if r.random() < 0.15:
            h1 = f"<header>{h1}</header>" if h1 else ""
        body = h1 + "".join(blocks)
        if r.random() < 0.2:
            body += self.boilerplate()
        kind = r.random()
        tag = "article" if kind < 0.5 else "main" if kind < 0.62 else "section" if kind < 0.7 else "div"
        own = self.attrs("article", "content", "post", "entry", "story", "main") if tag in ("article", "main") else f' {r.choice(("class", "id"))}="{r.choice(("article", "content", "post", "entry", "story", "main", "article-body", "post-content"))}"' if r.random() < 0.8 else self.attrs()
        if (bare := r.random()) < 0.03:
            return self.m(self.prose(1, 6))
        if bare < 0.07:
            return "".join(blocks)
        main = f"<{tag}{own}>{body}</{tag}>"
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            t = r.choice(("div", "div", "main", "section"))
            main = f"<{t}{self.attrs('wrap', 'container', 'page', 'content')}>{main}{self.boilerplate() if r.random() < 0.3 else ''}</{t}>"
        top = "".join(self.boilerplate() for _ in range(r.choice((0, 1, 1, 2, 3))))
        if r.random() < 0.4:
            top = f"<header{self.attrs('header', 'masthead', 'top')}>" + (f"<h1>{self.heading(1, 4)}</h1>" if r.random() < 0.25 else f"<a href='/'>{self.word()}</a>") + (f"<p>{self.sentence()}</p>" if r.random() < 0.3 else "") + "</header>" + top
        tail = "".join(self.boilerplate() for _ in range(r.choice((0, 0, 1, 2, 3))))
        if r.random() < 0.75:
            t = r.choice(("footer", "footer", "div class=\"footer\""))
            tail += f"<{t}>" + r.choice(("&copy; ", "", "&copy; 2020 ")) + r.choice((self.sentence(), self.prose(1, 3), f"{self.word()}.example.com &middot; {self.sentence()}", f"<p>{self.sentence()}</p>" + self.links(4))) + f"</{t.split()[0]}>"
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title></head>' if r.random() < 0.9 else ""
        end = "</body></html>" if r.random() < 0.8 else ""
        return f"{head}<body>{top}{main}{tail}{end}"


def fit(pages: int = PAGES, seed: int = SEED) -> Boosted:
    writer = Writer(seed)
    read = [Page(writer.page()) for _ in range(pages)]
    labels = []
    for p in read:
        own = [MARK in t for t in p.text]
        p.text = [t.replace(MARK, "").strip() for t in p.text]
        for i in range(len(own) - 1, 0, -1):
            own[p.parent[i]] |= own[i]
        labels += own
    return Boosted(features(read), np.array(labels, float))


def decode(page: Page, odds: np.ndarray) -> list[int]:
    """Numbers of the chosen text runs: the consistent labelling of greatest total log-odds. Parents precede their children."""
    n = len(page.parent)
    gain, best, chosen = [0.0] * n, [-np.inf] * n, [-1] * n  # of the children's positive totals, their best, and which has that
    total = [-np.inf] * n
    for i in range(n - 1, -1, -1):
        if page.tag[i] == 0:
            total[i] = odds[i]
        elif best[i] > -np.inf:
            total[i] = odds[i] + (gain[i] if best[i] > 0 else best[i])
        if i and total[i] > -np.inf:
            up = page.parent[i]
            gain[up] += max(total[i], 0.0)
            if total[i] >= best[up]:
                best[up], chosen[up] = total[i], i
    keep = [False] * n
    keep[0] = total[0] > 0
    out = []
    for i in range(1, n):
        up = page.parent[i]
        keep[i] = keep[up] and (total[i] > 0 or (best[up] <= 0 and chosen[up] == i))
        if keep[i] and page.tag[i] == 0:
            out.append(i)
    return out


def extract(sources: list[str], trees: Boosted) -> list[str]:
    read = [Page(s) for s in sources]
    odds = trees.margin(features(read))
    out, at = [], 0
    for p in read:
        n = len(p.parent)
        out.append(" ".join(p.text[i] for i in decode(p, odds[at : at + n])))
        at += n
    return out


def main_text(pages: DataFrame, key: str = "page_id", source: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, *keep, text) of every row. The trees sent to executors have a fixed size."""
    trees = shared(pages.sparkSession, fit())

    def run(batches):
        model = trees()
        for batch in batches:
            sources = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in chunks([len(s) for s in sources], STEP_CHARS):
                text = pa.array(extract(sources[a:b], model), pa.string())
                yield pa.record_batch([*(c.slice(a, b - a) for c in batch.columns[:-1]), text], [*batch.schema.names[:-1], "text"])

    rows = pages.select(key, *keep, F.coalesce(F.col(source), F.lit("")).alias("_source"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return rows.mapInArrow(run, f"{kinds}, text string")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
