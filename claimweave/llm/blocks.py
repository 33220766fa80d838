"""HTML pages as sequences of text blocks with their tag paths, and the numbers by which a labeller reads them."""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass

import numpy as np

# Element names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object select".split())
IMPLIED_END = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECE = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: tuple[str, ...]  # of each open element: its name, and the words of its class, id and role
    text: str
    linked: int  # characters inside links


def _marks(name: str, attributes: str) -> tuple[str, ...]:
    if not attributes or "=" not in attributes:
        return (name,)
    words = [p for m in _NAMES.finditer(attributes) for p in _PIECE.findall(next(g for g in m.groups() if g is not None).lower())]
    return (name, *[f".{w}" for w in words])


def blocks_of(html: str) -> list[Block]:
    """Leaf blocks in page order. Scripts, styles, comments and other raw elements are left out; character references
    are decoded; white space inside a block becomes one space. Unclosed and stray tags are borne."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    link, links = 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(tuple(m for _, marks in stack for m in marks), text, min(links, len(text))))
            parts.clear()
        links = 0

    def take(piece: str) -> None:
        nonlocal links
        if piece:
            parts.append(piece)
            if link:
                links += len(piece)

    at = 0
    while True:
        m = _TAG.search(html, at)
        if m is None:
            take(html[at:])
            break
        take(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                link = max(0, link + (-1 if closing else 1))
            continue
        if name in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        flush()
        if closing:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
            link = 0
            continue
        ends = IMPLIED_END.get(name, "").split()
        while stack and (stack[-1][0] == "p" or stack[-1][0] in ends):
            stack.pop()
        if name not in VOID:
            stack.append((name, _marks(name, attributes)))
    flush()
    return out


PATH_DIM, WORD_DIM = 96, 48
NUMBERS = 8
INPUTS = PATH_DIM + WORD_DIM + NUMBERS
_buckets: dict[tuple[str, int], int] = {}


def _bucket(token: str, size: int) -> int:
    k = _buckets.get((token, size))
    if k is None:
        if len(_buckets) > 300_000:
            _buckets.clear()
        k = _buckets[token, size] = zlib.crc32(token.encode()) % size
    return k


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block: hashed tag path, hashed words, and a few numbers about its text and place."""
    n = len(blocks)
    out = np.zeros((n, INPUTS), np.float32)
    for k, b in enumerate(blocks):
        for t in b.path:
            out[k, _bucket(t, PATH_DIM)] = 1.0
        words = b.text.split(" ")
        counts = np.bincount([_bucket(w.lower(), WORD_DIM) for w in words], minlength=WORD_DIM)
        out[k, PATH_DIM : PATH_DIM + WORD_DIM] = counts / len(words)
        size = len(b.text)
        out[k, PATH_DIM + WORD_DIM :] = (
            np.log1p(len(words)) / 5,
            b.linked / size,
            min(1.0, 10 * sum(b.text.count(c) for c in ".,;:!?") / size),
            sum(w[:1].isupper() for w in words) / len(words),
            k / n,
            np.log1p(len(b.path)) / 3,
            np.log1p(n) / 5,
            float(b.text[-1] in ".!?"),
        )
    return out
