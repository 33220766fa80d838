"""Near-duplicate documents by BagMinHash and a check of multiset overlap.

A document is the multiset of its 5-word shingles. Points of Poisson processes, one per shingle and dyadic interval of
weight, fall into registers; a point counts for a document if its level lies below the shingle's weight there, and a
register keeps its earliest point. Two documents agree in a register with the probability of their weighted Jaccard
similarity. Bands of registers give candidates, and each link is decided by the overlap of the multisets themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import stage, text_digest, tidy, whole_text
from claimweave.llm.components import components
from claimweave.llm.tokens import U, mix, tokenized

SHINGLE = 5
#: 42 bands of 6 registers miss a pair of similarity 0.8 with a chance of 3 in a million.
BANDS, ROWS = 42, 6
#: Texts and shingles of a bucket's part; two parts meet in a block.
PART_TEXTS, PART_ELEMENTS = 4096, 2_000_000
_STEP, _LEVEL = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_UNIT = 1.0 / (1 << 53)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Registers (n_docs × m, bits of the earliest points' times) of multisets given as (doc, shingle hash, count)."""
    # weight intervals (0,1], (1,2], (2,4], (4,8] …; those that a weight reaches into
    parts = [(doc, shingle, weight, 0, 1)]
    lo, hi = 1, 2
    while len(at := np.flatnonzero(weight > lo)):
        parts.append((doc[at], shingle[at], weight[at], lo, hi))
        lo, hi = hi, 2 * hi
    d = np.concatenate([p[0] for p in parts])
    key = np.concatenate([mix(p[1] + U(int(_LEVEL) * p[4] % 2**64)) for p in parts])
    low = np.concatenate([np.full(len(p[0]), p[3], np.int64) for p in parts])
    width = np.concatenate([np.full(len(p[0]), p[4] - p[3], np.int64) for p in parts])
    limit = np.concatenate([p[2] for p in parts])
    reg = np.full(n_docs * m, np.inf)
    time = np.zeros(len(d))
    drawn, block = 0, 1
    while len(d):
        n = drawn + 1 + np.arange(block, dtype=U)
        a = mix(key[:, None] + n[None, :] * _STEP)
        b = mix(a ^ _LEVEL)
        gaps = -np.log1p(-((a >> U(11)).astype(float) * _UNIT)) / width[:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        where = (b >> U(32)).astype(np.int64) * m >> 32
        level = low[:, None] + ((b & U(0xFFFFFFFF)).astype(np.int64) * width[:, None] >> 32)
        counts = level < limit[:, None]
        slot = (d[:, None] * m + where)[counts]
        np.minimum.at(reg, slot, times[counts])
        time = times[:, -1]
        top = reg.reshape(n_docs, m).max(axis=1)
        on = time <= top[d]
        d, key, low, width, limit, time = d[on], key[on], low[on], width[on], limit[on], time[on]
        drawn += block
        block = int(min(2 * block, 256, max(1, 2_000_000 // max(1, len(d)))))
    return reg.view(U).reshape(n_docs, m) >> U(20)  # without the digits in which libraries' logarithms may differ


def _shingles(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of a part's shingles; a text of fewer words is one shingle, without words it has none."""
    g, ok = w.grams(SHINGLE)
    of = w.text_of_word()
    n = np.diff(w.first)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    text = np.concatenate([of[ok], few])
    key = np.concatenate([g[ok], w.spans(w.first[few], w.first[few + 1])]) if len(few) else g[ok]
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return text[at], key[at], np.diff(np.append(at, len(text)))


def _sign(bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("digest")
            for w in tokenized(batch.column("text")):
                has = np.flatnonzero(np.diff(w.first) > 0)
                text, key, count = _shingles(w)
                sig = signatures(np.searchsorted(has, text), key, count, len(has), m)
                h = np.zeros((len(has), bands), U)
                for r in range(rows):
                    h = mix(h * U(0xC2B2AE3D27D4EB4F) + sig[:, r * bands : (r + 1) * bands] + U(r))
                h = mix(h + np.arange(bands, dtype=U)[None, :] * _STEP)
                weight = np.bincount(np.searchsorted(has, text), weights=count, minlength=len(has)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(w.rows[has])), pa.array(weight), pa.ListArray.from_arrays(np.arange(0, len(has) * bands + 1, bands, dtype=np.int32), pa.array(h.view(np.int64).ravel()))], names=["digest", "weight", "bands"])

    return run


def _bag(text: str) -> Counter:
    w = [x for x in text.encode().split()]
    return Counter(tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1)))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    low, high = (a, b) if len(a) < len(b) else (b, a)
    both = sum(min(n, high[k]) for k, n in low.items() if k in high)
    union = sum(a.values()) + sum(b.values()) - both
    return both / union if union else 0.0


def _verify(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bag = lru_cache(16)(_bag)
        for f in frames:
            keep = [similarity(bag(x), bag(y)) >= threshold for x, y in zip(f.text_a, f.text_b, strict=True)]
            yield f.loc[keep, ["a", "b"]]

    return run


def links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of digests whose texts reach the threshold."""
    t = lambda s: texts.select(F.col("digest").alias(s), F.col("text").alias(f"text_{s}"))
    full = pairs.join(t("a"), "a").join(t("b"), "b")
    return full.mapInPandas(_verify(threshold), "a binary, b binary")


def bucket_members(signed: DataFrame) -> DataFrame:
    """(digest, weight, band, next) of ``signed`` (digest, weight, bands): a row for each band that another text shares."""
    n = F.size("bands")
    each = F.transform("bands", lambda x, i: F.struct(x.alias("band"), F.xxhash64(x, F.get("bands", (i + 1) % n)).alias("next")))
    rows = signed.select("digest", "weight", F.inline(each))
    # what shares a bucket at all; a merge join at every size, whose hot buckets are split
    full = stage(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "near-buckets")
    return stage(rows.join(full.hint("merge"), "band"), "near-members")


def candidates(held: DataFrame, threshold: float) -> DataFrame:
    """(a, b) to compare first, from bucket members: as many rows as texts have bands, at most three each.

    A text is compared with the least and the greatest digest of each of its buckets, and with the least of those that
    also share the next band, which parts buckets that only a common passage fills. Sizes that rule the threshold out
    are left out.
    """
    own = F.struct("digest", "weight")
    ends = stage(held.groupBy("band").agg(F.min(own).alias("low"), F.max(own).alias("high")), "near-ends")
    members = held.join(ends.hint("merge"), "band")
    closer = held.groupBy("next").agg(F.min(own).alias("low"), F.max("digest").alias("_top")).where("low.digest <> _top").drop("_top")
    inside = held.select("next", "digest", "weight").join(stage(closer, "near-buckets").hint("merge"), "next")
    met = members.select("digest", "weight", F.explode(F.array("low", "high")).alias("center")).unionByName(inside.select("digest", "weight", F.col("low").alias("center")))
    ratio = F.least(F.col("weight"), F.col("center.weight")) >= threshold * F.greatest(F.col("weight"), F.col("center.weight"))
    pair = met.where(ratio & (F.col("digest") != F.col("center.digest"))).select(F.greatest(F.col("digest"), F.col("center.digest")).alias("a"), F.least(F.col("digest"), F.col("center.digest")).alias("b"))
    return pair.distinct()


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The multiset as a set: the k-th occurrence of a shingle is an element of its own."""
    for batch in batches:
        for w in tokenized(batch.column("text")):
            text, key, count = _shingles(w)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            elements = mix(np.repeat(key, count) + nth.astype(U) * _STEP)
            ends = np.searchsorted(np.repeat(text, count), np.arange(len(w.rows) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(w.rows)), pa.ListArray.from_arrays(ends, pa.array(elements.view(np.int64)))], names=["digest", "elements"])


def _spanning(cls: np.ndarray, part: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links between the classes of a block, as many as join what they join; of two parts, only pairs across them."""
    size = np.array([len(x) for x in sets])
    of = np.repeat(np.arange(len(sets)), size)
    element = np.concatenate(sets)
    order = np.argsort(element, kind="stable")
    element, of = element[order], of[order]
    names, cls = np.unique(cls, return_inverse=True)
    split = part.min() != part.max()
    # the largest class meets the others from their side
    most = np.bincount(cls).argmax()
    done = np.zeros(len(sets), bool)
    out = []
    for x in np.flatnonzero(cls != most).tolist():
        done[x] = True
        fit = ~done & (cls != cls[x]) & (np.minimum(size, size[x]) >= threshold * np.maximum(size, size[x]))
        if split:
            fit &= part != part[x]
        if not fit.any():
            continue
        lo, hi = np.searchsorted(element, sets[x], "left"), np.searchsorted(element, sets[x], "right")
        n = hi - lo
        both = np.bincount(of[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        for y in np.flatnonzero(fit & (both / np.maximum(size + size[x] - both, 1) >= threshold)).tolist():
            if cls[x] != cls[y]:
                out.append((x, y))
                cls[cls == cls[y]] = cls[x]
    return out


def _apart(threshold: float):
    def block(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cls, part = t["cls"].to_numpy(), t["part"].to_numpy()
        if len(cls) < 2 or cls.min() == cls.max():
            return
        lists = t["elements"].combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        if found := _spanning(cls, part, [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], threshold):
            digest = t["digest"].combine_chunks()
            yield pa.RecordBatch.from_arrays([digest.take(pa.array([f[k] for f in found])).cast(pa.binary()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # of a block that goes on in the next batch
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("band", "low", "high")])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (key := tuple(keys[:, a])) != last and kept:
                    yield from block(pa.Table.from_batches(kept))
                    kept = []
                kept.append(batch.slice(a, b - a))
                last = key
        if kept:
            yield from block(pa.Table.from_batches(kept))

    return run


def links_between(held: DataFrame, cls: DataFrame, d: DataFrame, threshold: float) -> DataFrame | None:
    """Links (a, b) that join the classes ``cls`` (node, root) found so far wherever two of them share a bucket.

    Every pair of a bucket whose texts lie in different classes is compared. A large bucket is dealt into parts, and
    each two parts meet in a block of bounded size; the pairs are formed inside the block, no row is made for them.
    None if no bucket holds two classes.
    """
    known = held.select("band", "digest", "weight").join(cls.select(F.col("node").alias("digest"), "root"), "digest", "left")
    known = stage(known.select("band", "digest", "weight", F.xxhash64(F.coalesce("root", "digest")).alias("cls")), "near-members")
    parts = F.ceil(F.greatest(F.count("*") / PART_TEXTS, F.sum("weight") / PART_ELEMENTS)).cast("int")
    opened = stage(known.groupBy("band").agg(F.min("cls").alias("_c"), F.max("cls").alias("_d"), parts.alias("parts")).where("_c <> _d").select("band", "parts"), "near-buckets")
    if opened.isEmpty():
        return None
    part = F.pmod(F.xxhash64("digest", F.lit(7)), F.col("parts")).cast("int")
    mine = stage(known.join(opened.hint("merge"), "band").select("band", "digest", "cls", "parts", part.alias("part")), "near-open")
    texts = d.groupBy("digest").agg(F.first("text").alias("text")).join(mine.select("digest").distinct(), "digest").select("digest", "text")
    sets = stage(texts.mapInArrow(_elements, "digest binary, elements array<bigint>"), "near-elements")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    # with more than one part, a part meets itself in a block with no other
    dealt = mine.withColumn("other", other).select("band", "digest", "cls", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    key = ["band", "low", "high"]
    blocks = dealt.join(sets.hint("merge"), "digest").repartition(*key).sortWithinPartitions(*key)
    return stage(blocks.select(*key, "digest", "cls", "part", "elements").mapInArrow(_apart(threshold), "a binary, b binary"), "near-links")


def classes(docs: DataFrame, text: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Distinct texts that have a link → digest, root: the smallest digest of the texts joined by links.

    Copies of a text are one text. A first pass compares a few pairs a text, which joins most near copies; then every
    pair that shares a bucket and still lies in two classes is compared, so that no such link is lost.
    """
    d = docs.select(whole_text(text).alias("text")).withColumn("digest", text_digest(F.col("text"))).where(F.col("text") != "")
    signed = d.mapInArrow(_sign(bands, rows), "digest binary, weight bigint, bands array<bigint>")
    once = stage(signed.groupBy("digest").agg(F.first("weight").alias("weight"), F.first("bands").alias("bands")), "near-signatures")
    held = bucket_members(once)
    pairs = stage(candidates(held, threshold), "near-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    texts = stage(d.groupBy("digest").agg(F.first("text").alias("text")).join(wanted, "digest"), "near-texts")
    found = stage(links(pairs, texts, threshold), "near-links")
    cls = stage(components(found), "near-classes")
    more = links_between(held, cls, d, threshold)
    if more is not None and not more.isEmpty():
        cls = stage(components(found.unionByName(more)), "near-classes")
    return cls.select(F.col("node").alias("digest"), "root")


def with_class(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **kw) -> DataFrame:
    """Input columns (as ``_c_<name>``) with ``class_id``, ``class_size`` (rows) and ``first`` (kept of its class).

    ``class_id`` is the smallest doc_id of the class, null if all ids are. Copies are one class by their digest. Texts
    without words are near nothing: each such row is a class of its own id. Of the rows of a class, the one with the
    smallest id is kept (nulls last); among rows with that id, the first by digest and place.
    """
    d = docs.select(*[F.col(c).alias(f"_c_{c}") for c in docs.columns]).withColumn("_t", whole_text(f"_c_{text}")).withColumns({"_digest": text_digest(F.col("_t")), "_has": F.col("_t").rlike(r"[^\x20\x09-\x0D]")}).drop("_t")
    cls = classes(docs, text, **kw).withColumnRenamed("digest", "_digest")
    ident = F.when(F.col("_has"), F.col("_digest")).otherwise(F.unhex(F.md5(F.concat(F.lit("none|"), F.coalesce(F.col(f"_c_{doc_id}").cast("string"), F.lit(""))))))
    narrow = d.select(F.col(f"_c_{doc_id}").alias("id"), "_digest", "_has", ident.alias("_ident")).groupBy("_digest", "_ident").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    narrow = stage(narrow.join(cls, "_digest", "left").withColumn("root", F.when(F.col("_ident") == F.col("_digest"), F.coalesce("root", "_ident")).otherwise(F.col("_ident"))), "near-texts")
    groups = narrow.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"), F.min_by("_ident", F.struct(F.col("id").isNull(), "id", "_ident")).alias("_lead"))
    marks = stage(narrow.join(groups, "root").select("_ident", "class_id", "class_size", (F.col("_ident") == F.col("_lead")).alias("_leads")), "near-marks")
    j = d.withColumn("_ident", ident).join(marks, "_ident")
    return j.drop("_digest", "_has")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **kw) -> DataFrame:
    """The kept row of every class, with the columns of ``docs``; what was written on the way is removed."""

    def build() -> DataFrame:
        marked = with_class(docs, text, doc_id, **kw).where("_leads").withColumn("_row", F.monotonically_increasing_id())
        same_id = F.col(f"_c_{doc_id}").eqNullSafe(F.col("class_id"))
        led = stage(marked.where(same_id), "near-kept")
        lead = led.groupBy("_ident").agg(F.min("_row").alias("_row"))
        # more rows than classes only where rows repeat in id and text
        once = led if led.count() == lead.count() else led.join(lead, ["_ident", "_row"], "left_semi")
        return once.select(*[F.col(f"_c_{c}").alias(c) for c in docs.columns])

    return tidy(docs.sparkSession, build)
