"""Main text of HTML pages by a recurrent labeller of blocks.

The labeller is trained on pages of the table itself: a bounded sample is labelled by its semantic elements, and every
sampled page is also laid out anew, with other elements, class names and surroundings, so that it learns from names,
links, wording and order together rather than from one layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.blocks import INPUTS, Block, blocks_of, vectors
from claimweave.llm.labeller import BlockLabeller

#: Pages used for training, at most, in the order of md5 of id and html; and characters of one of them.
TRAIN_PAGES = 200
TRAIN_CHARS = 60_000
LAYOUTS_PER_PAGE = 3

# Elements and class words by which sampled pages are labelled and new layouts are named.
MAIN_TAGS = ("article", "main")
MAIN_WORDS = "article body content entry main page post prose story text".split()
SIDE_TAGS = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button")
SIDE_WORDS = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs tabs toc".split(),
    "header": "header masthead topbar logo branding hero".split(),
    "footer": "footer copyright legal colophon imprint".split(),
    "sidebar": "sidebar aside widget related recommended trending popular tags archive".split(),
    "notice": "cookie notice consent gdpr alert popup modal overlay paywall".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo banner teaser".split(),
    "form": "form login signup subscribe newsletter search contact".split(),
    "comments": "comments comment replies reply discussion respond disqus reader".split(),
    "share": "share social follow author byline meta".split(),
}
SHORT = "Home About Contact Login Register Share Tweet Menu Search Next Previous More Archive Privacy Terms Help Subscribe Reply Report Like".split()
PHRASES = (
    "We use cookies to improve this site. Accept all or change your settings.", "Subscribe to our newsletter and never miss an update.", "All rights reserved. No part may be reproduced.",
    "Your email address will not be published. Required fields are marked.", "Log in to leave a comment.", "Related articles you might like", "Advertisement", "Sponsored content", "Follow us on social media",
    "Sign up now and save on your first order!", "Posted by a reader, two days ago", "This website stores data such as cookies to enable functionality.", "Enter your email address to continue reading.",
)


def weak_labels(blocks: list[Block]) -> list[int]:
    """1 for blocks inside a main element and outside every side element, by names alone."""
    side = {f".{w}" for words in SIDE_WORDS.values() for w in words}
    out = []
    for b in blocks:
        last = max((k for k, t in enumerate(b.path) if t in MAIN_TAGS), default=-1)
        out.append(int(last >= 0 and not any(t in SIDE_TAGS or t in side for t in b.path[last:]) and not any(t in side for t in b.path)))
    return out


def laid_out(rng: np.random.Generator, main: list[str], spare: list[str]) -> tuple[list[Block], list[int]]:
    """A new page around the main blocks, with side parts in random layouts; its blocks and labels."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    page: list[tuple[tuple[str, ...], str, float, int]] = []
    shell = pick([("html", "body"), ("html", "body", "div", ".page"), ("html", "body", "div", ".wrapper", "div", ".container"), ("html", "body", "div")])

    def prose() -> str:
        words = pick(spare).split() if spare and rng.random() < 0.7 else pick(PHRASES).split()
        a = int(rng.integers(len(words)))
        return " ".join(words[a : a + int(rng.integers(3, 40))] or words)

    def side(kind: str, inside: tuple[str, ...]) -> None:
        word = pick(SIDE_WORDS[kind])
        extra = pick([(), (f".{pick(SIDE_WORDS[kind])}",), (".box",), (".site",), (".top",)])
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        head = (tag,) if tag and rng.random() < 0.4 else (pick(["div", "section", "aside", "ul"]) if rng.random() < 0.9 else "p", f".{word}", *extra)
        head = (*head, *((f".{word}",) if rng.random() < 0.3 else ()))
        for _ in range(int(rng.integers(1, 8 if kind in ("menu", "comments", "sidebar") else 4))):
            linked = kind in ("menu", "share") or rng.random() < 0.25
            text = (pick(SHORT) if rng.random() < 0.5 else " ".join(pick(spare or SHORT).split()[: int(rng.integers(1, 4))]) or pick(SHORT)) if linked else prose()
            leaf = ("ul", "li") if kind == "menu" and rng.random() < 0.8 else pick([(), ("p",), ("div",), ("h3",), ("span",), ("li",)])
            page.append(((*inside, *head, *leaf), text, float(linked), 0))

    for kind in ("notice", "header", "menu", "advert", "form", "share"):
        if rng.random() < 0.55:
            side(kind, shell)
    home = pick([("article",), ("main",), ("main", "article"), ("div", f".{pick(MAIN_WORDS)}"), ("div", f".{pick(MAIN_WORDS)}", f".{pick(MAIN_WORDS)}"), ("section", f".{pick(MAIN_WORDS)}"), ("div",), ("article", f".{pick(MAIN_WORDS)}", "div", f".{pick(MAIN_WORDS)}"), ("table", "tr", "td")])
    for k, text in enumerate(main):
        leaf = pick([("h1",), ("h2",), ("header", "h1"), ("div", ".title")]) if k == 0 and rng.random() < 0.7 else pick([("p",), ("p",), ("p",), ("p",), ("div",), ("li",), ("blockquote",), ("h2",), ("pre",), ()])
        leaf = ("ul", "li") if leaf == ("li",) else leaf
        page.append(((*shell, *home, *leaf), text, 0.05 * float(rng.random() < 0.2), 1))
        if rng.random() < 0.12:
            side(pick(["advert", "share", "sidebar", "form", "notice"]), (*shell, *home))
    for kind in ("share", "comments", "sidebar", "form", "advert", "notice", "footer"):
        if rng.random() < 0.55:
            side(kind, (*shell, *home) if kind in ("comments", "share") and rng.random() < 0.4 else shell)
    return [Block(p, t, int(share * len(t))) for p, t, share, _ in page], [y for *_, y in page]


def fit_labeller(pages: DataFrame, page_id: str = "page_id", html: str = "html", rows: int = TRAIN_PAGES, seed: int = 3) -> BlockLabeller:
    """A labeller trained on at most ``rows`` pages (the bound of what comes to the driver) and their new layouts."""
    key = F.md5(F.concat_ws("|", F.col(page_id).cast("string"), F.length(html).cast("string")))
    sample = pages.where(F.length(html).between(1, TRAIN_CHARS)).select(key.alias("k"), F.col(html).alias("h")).orderBy("k", "h").limit(rows)
    read = [blocks_of(r.h) for r in sample.collect()]
    rng = np.random.default_rng(seed)
    labels = [weak_labels(b) for b in read]
    spare = [x.text for b in read for x in b if len(x.text) > 20][:20_000] or list(PHRASES)
    x, y = [], []
    for b, marks in zip(read, labels, strict=True):
        main = [k.text for k, one in zip(b, marks, strict=True) if one]
        if main:
            x.append(b)
            y.append(marks)
        for _ in range(LAYOUTS_PER_PAGE):
            body = main or [spare[int(rng.integers(len(spare)))] for _ in range(int(rng.integers(1, 8)))]
            made, marks_made = laid_out(rng, body, spare)
            x.append(made)
            y.append(marks_made)
    model = BlockLabeller(INPUTS)
    return model.fit([vectors(b) for b in x], [np.array(k, np.float32) for k in y]) if x else model


def main_blocks(model: BlockLabeller, pages: list[list[Block]]) -> list[list[str]]:
    scores = model.scores([vectors(b) for b in pages])
    return [[b.text for b, p in zip(bs, s, strict=True) if p >= 0.5] for bs, s in zip(pages, scores, strict=True)]


def extracted(pages: DataFrame, model: BlockLabeller, carry: list[str], html: str = "html") -> DataFrame:
    """One row per input row: ``carry`` (as ``_c_<name>``), text, n_blocks, n_chars (code points of the text).

    Whole pages are read; kept blocks are joined by line ends. A null or empty html and a page without main text give an
    empty text; repeated rows give equal texts; an empty table gives no rows. The weights (some 80 kB) go to the tasks.
    """
    d = pages.select(*[F.col(c).alias(f"_c_{c}") for c in carry], F.coalesce(F.col(html).cast("string"), F.lit("")).alias("_html"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), 256):
                part = f.iloc[a : a + 256]
                read = [blocks_of(h) for h in part["_html"]]
                texts = ["\n".join(b) for b in main_blocks(model, read)]
                yield part.drop(columns="_html").assign(text=texts, n_blocks=[len(b) for b in read], n_chars=[len(t) for t in texts])

    kinds = ", ".join(f"`_c_{c}` {pages.schema[c].dataType.simpleString()}" for c in carry)
    return d.mapInPandas(run, f"{kinds}, text string, n_blocks bigint, n_chars bigint")


SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, unnest(regexp_split_to_array(regexp_replace(body, '</?b>', '', 'g'), '</?(p|h1|div)>')) AS x, generate_subscripts(regexp_split_to_array(regexp_replace(body, '</?b>', '', 'g'), '</?(p|h1|div)>'), 1) AS i FROM a),
c AS (SELECT page_id, url, i, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<br>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS x FROM b),
t AS (SELECT page_id, url, string_agg(x, chr(10) ORDER BY i) AS text FROM c WHERE x <> '' GROUP BY page_id, url)
SELECT a.page_id, a.url, coalesce(t.text, '') AS text, length(coalesce(t.text, ''))::BIGINT AS n_chars FROM a LEFT JOIN t ON a.page_id = t.page_id
"""
