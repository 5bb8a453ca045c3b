"""HTML main-text extraction with boosted trees over DOM nodes (operator 3).

A bounded, documented sample of the pages trains the trees: the sampled pages themselves, whose own markup
(article, nav, footer and so on) labels their nodes, and re-renderings of their texts in drawn templates, where
each block's label is known, so that the model learns from density, links, place and attribute words and not
from one site's tags. Every page is then read, its nodes scored and decoded top-down consistently: what an
ancestor leaves out, no descendant brings back.

Defined results: null or empty html, and pages without main text, give an empty text; repeated rows give one
result each; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gbt
from .common import releasing, small_batches, table
from .dom import Page, decode, features

#: Pages that train the model at most, and re-renderings of each.
TRAIN_PAGES, RENDERINGS = 240, 4
#: Longer pages are drawn for training only where there are too few others. Whole pages train, whole pages are read.
TRAIN_CHARS = 40_000
#: Elements whose markup says what they hold.
MAIN_TAGS, OTHER_TAGS = {"article", "main"}, {"nav", "header", "footer", "aside", "form"}

#: Templates of re-renderings: (tag, attributes) of containers by what they hold.
MAIN = [
    ("article", ""), ("article", 'class="post"'), ("main", ""), ("main", 'id="content"'), ("div", 'class="content"'), ("div", 'class="entry-content"'),
    ("div", 'id="main-content"'), ("div", 'class="post-body"'), ("section", 'class="article-body"'), ("div", 'class="story"'), ("div", 'class="text"'),
    ("div", 'itemprop="articleBody"'), ("div", ""), ("td", ""), ("section", ""),
]
OTHER = {
    "menu": [("nav", ""), ("ul", 'class="menu"'), ("div", 'id="navbar"'), ("div", 'class="breadcrumbs"'), ("div", 'role="navigation"'), ("ul", ""), ("div", 'class="pagination"')],
    "header": [("header", ""), ("div", 'id="header"'), ("div", 'class="masthead"'), ("div", 'role="banner"'), ("div", 'class="site-branding"')],
    "footer": [("footer", ""), ("div", 'class="footer"'), ("div", 'id="colophon"'), ("div", 'role="contentinfo"'), ("p", 'class="copyright"'), ("div", "")],
    "side": [("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="related"'), ("section", 'class="widget"'), ("div", 'class="recommended"'), ("td", 'class="side"')],
    "notice": [("div", 'class="cookie-notice"'), ("div", 'id="consent"'), ("div", 'class="alert"'), ("div", 'role="dialog"'), ("p", 'class="notice"'), ("section", 'class="banner"'), ("div", 'class="gdpr-popup"')],
    "advert": [("div", 'class="ad"'), ("div", 'class="advert"'), ("div", 'id="sponsored"'), ("aside", 'class="promo"'), ("section", 'class="advertisement"'), ("div", 'class="ad-slot"')],
    "form": [("form", ""), ("form", 'class="newsletter"'), ("div", 'class="login-form"'), ("div", 'id="subscribe"'), ("form", 'role="search"')],
    "comment": [("section", 'id="comments"'), ("div", 'class="comments"'), ("ol", 'class="commentlist"'), ("div", 'class="reader-comments"'), ("div", 'id="disqus_thread"'), ("section", 'class="replies"'), ("ul", 'class="comment-list"'), ("div", 'class="discussion"')],
    "share": [("div", 'class="share"'), ("ul", 'class="social"'), ("p", 'class="byline"'), ("div", 'class="post-meta"')],
    "hidden": [("div", "hidden"), ("div", 'style="display:none"'), ("p", 'aria-hidden="true"')],
}
#: Where boilerplate stands: share of renderings that have it before, inside and after the main text.
PLACES = {
    "menu": (0.9, 0.1, 0.3), "header": (0.7, 0, 0), "footer": (0, 0, 0.9), "side": (0.3, 0.15, 0.5), "notice": (0.5, 0.3, 0.3), "advert": (0.5, 0.4, 0.4),
    "form": (0.2, 0.2, 0.3), "comment": (0, 0.15, 0.6), "share": (0.2, 0.3, 0.3), "hidden": (0.1, 0.1, 0.1),
}


def _wrap(kind: tuple[str, str], inner: str) -> str:
    tag, attrs = kind
    return f"<{tag}{' ' * bool(attrs)}{attrs}>{inner}</{tag}>"


def _phrase(rng: random.Random, words: list[str], low: int, high: int) -> str:
    start = rng.randrange(max(1, len(words)))
    return html.escape(" ".join(words[start : start + rng.randint(low, high)]) or "more", quote=False)


def _boilerplate(rng: random.Random, what: str, words: list[str]) -> str:
    kind = rng.choice(OTHER[what])
    link = lambda n: f'<a href="/{rng.randint(1, 99)}">{_phrase(rng, words, 1, n)}</a>'
    if what in ("menu", "share") and rng.random() < 0.85 or what == "side" and rng.random() < 0.5:
        items = [link(8 if what == "side" else 3) for _ in range(rng.randint(2, 9))]
        inner = "".join(f"<li>{x}</li>" for x in items) if kind[0] in ("ul", "ol") else rng.choice(
            ["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items)]
        )
    elif what == "form":
        inner = f"<label>{_phrase(rng, words, 2, 8)}</label><input name=q><p>{_phrase(rng, words, 3, 15)}</p><input type=submit>"
    elif what == "comment":
        each = [f"<p>{_phrase(rng, words, 5, 60)}</p>" for _ in range(rng.randint(1, 6))]
        if kind[0] in ("ol", "ul"):
            inner = "".join(f"<li>{x}</li>" for x in each)
        else:
            inner = f"<h3>{_phrase(rng, words, 1, 3)}</h3>" + "".join(rng.choice(["<div class=comment>{}</div>", "<article>{}</article>", "{}", "<div class=reply>{}</div>"]).format(x) for x in each)
    else:
        many = rng.choice([1, 1, 1, 2, 3])
        inner = " ".join(rng.choice(["<p>{}</p>", "{}", "<div>{}</div>"]).format(_phrase(rng, words, 3, 40)) for _ in range(many))
        if rng.random() < 0.3:
            inner += link(3)
    return _wrap(kind, inner)


def render(rng: random.Random, blocks: list[str]) -> tuple[str, list[int]]:
    """One page of the given main blocks among drawn boilerplate, and the places where a main block's text begins."""
    words = " ".join(blocks).split() or ["text"]
    sign = next(c for c in map(chr, range(0xE000, 0xF900)) if not any(c in b for b in blocks))  # stands at the places until the page is whole
    some = blocks[: rng.randint(1, len(blocks))] if blocks else []
    drawn = lambda i: [_boilerplate(rng, k, words) for k, p in PLACES.items() if rng.random() < p[i]]
    parts = []
    for i, block in enumerate(some):
        text = sign + html.escape(block, quote=False)
        if rng.random() < 0.15:
            text = f'{text[: len(text) // 2]}<a href="/x">{text[len(text) // 2 :]}</a>' if rng.random() < 0.3 else f"<b>{text}</b>"
        tag = "h1" if i == 0 and rng.random() < 0.6 else rng.choice(["p"] * 12 + ["h2", "li", "blockquote", "div", "pre"])
        parts.append(f"<ul><li>{text}</li></ul>" if tag == "li" else f"<{tag}>{text}" + f"</{tag}>" * (tag != "p" or rng.random() < 0.8))
    for extra in drawn(1):
        parts.insert(rng.randint(0, len(parts)), extra)
    main = _wrap(kind := rng.choice(MAIN), "\n".join(parts))
    before, after = drawn(0), drawn(2)
    rng.shuffle(before)
    if kind[0] == "td":
        side = [x for x in after if x.startswith("<td")]
        after = [x for x in after if not x.startswith("<td")]
        main = f"<table><tr>{''.join(side)}{main}</tr></table>"
    if rng.random() < 0.5:
        main = _wrap(rng.choice([("div", 'class="wrapper"'), ("div", 'id="page"'), ("div", ""), ("section", 'class="row"'), ("div", 'class="container main"')]), main + "".join(after[: len(after) // 2]))
        after = after[len(after) // 2 :]
    whole = f"<html><head><title>{html.escape(words[0])}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"
    pieces = whole.split(sign)
    return "".join(pieces), list(accumulate(map(len, pieces[:-1])))


def own_blocks(page: Page) -> list[str] | None:
    """The main blocks of a page whose own markup names its main text; None if it doesn't."""
    n = len(page.parent)
    inside, outside = [False] * n, [False] * n
    for i in range(1, n):
        inside[i] = inside[page.parent[i]] or page.tag[i] in MAIN_TAGS
        outside[i] = outside[page.parent[i]] or page.tag[i] in OTHER_TAGS
    if not any(inside):
        return None
    page.main = [page.text[i] is not None and inside[i] and not outside[i] for i in range(n)]
    return [page.text[i] for i in range(n) if page.main[i]]


def labelled(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels (does the node hold main text?) and weights of a page's nodes that hold text."""
    n = len(page.parent)
    some, main = np.array([t is not None for t in page.text]), np.array(page.main)
    for i in range(n - 1, 0, -1):
        some[page.parent[i]] |= some[i]
        main[page.parent[i]] |= main[i]
    rows = np.flatnonzero(some)[1:]
    return features(page)[rows], main[rows].astype(float), np.full(len(rows), 1 / max(1, len(rows)) ** 0.5)


def train(sources: list[str], seed: int = 11) -> gbt.Trees | None:
    """Trees from sample pages; None without a page that holds text."""
    rng = random.Random(seed)
    parts = []
    for source in sources:
        page = Page(source)
        blocks = own_blocks(page)
        if blocks:
            parts.append(labelled(page))
        else:
            blocks = [t for t in page.text if t]
        for _ in range(RENDERINGS if blocks else 0):
            parts.append(labelled(Page(*render(rng, blocks))))
    if not parts:
        return None
    return gbt.fit(*(np.concatenate(x) for x in zip(*parts)))


def main_texts(trees: gbt.Trees | None, sources: list[str | None]) -> list[str]:
    pages = [Page(s or "") for s in sources]
    if trees is None:
        return ["\n".join(t for t in p.text if t) for p in pages]
    rows = [features(p) for p in pages]
    margins = np.split(trees.margin(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1]) if rows else []
    return [decode(p, m) for p, m in zip(pages, margins)]


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """One row a page: id, url, text and n_chars."""
    small_batches(pages.sparkSession)
    source = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), source.alias("html"))
    # the sample: of the pages up to TRAIN_CHARS, and then of the shortest others, those with the smallest hashes of their ids
    # (only keys are compared on the driver, then the chosen pages come whole)
    key = F.xxhash64("page", "html").alias("key")
    keyed = rows.select(key, F.greatest(F.length("html"), F.lit(TRAIN_CHARS)).alias("size"), F.xxhash64("page").alias("place"))
    chosen = {r["key"] for r in keyed.orderBy("size", "place", "key").limit(train_pages).collect()}
    sample = rows.where(key.isin(sorted(chosen))).groupBy(key).agg(F.first("html").alias("html"))
    sources = [r["html"] for r in sorted(sample.collect())]
    trees = train(sources)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = main_texts(trees, batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"],
                )

    first, second = rows.schema.fields[:2]
    out = [T.StructField(id_col, first.dataType), T.StructField(url_col, second.dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return rows.mapInArrow(releasing(run), T.StructType(out))


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
