"""Benchmark decontamination: rare n-gram seeds, then local alignment of words.

Words are compared in lower case and without punctuation. Of a test item's grams that documents hold, the rarer half, by
their counts in all documents, are its seeds. Where a seed occurs, the text around it is aligned with the item (Smith-Waterman over words),
so that copies with words changed, put in or left out are found and scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.llm.common import small, stage, whole_text
from claimweave.llm.tokens import PUNCTUATION, Words, tokenized

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: Test items worked on at once; more items take more passes over the documents.
ITEMS_AT_ONCE = 50_000


class Items:
    """Word hashes and distinct grams of a block of test items."""

    def __init__(self, ids: list, texts: list[str]):
        self.words: list[np.ndarray] = []
        self.ids: list = []
        grams, owner = [], []
        for w in tokenized(pa.array([(t or "").lower() for t in texts], pa.string()), PUNCTUATION):
            g, ok = w.grams(GRAM)
            for k, row in enumerate(w.rows):
                a, b = w.first[k], w.first[k + 1]
                mine = np.unique(g[a:b][ok[a:b]])
                grams.append(mine)
                owner.append(np.full(len(mine), len(self.ids)))
                self.ids.append(ids[int(row)])
                self.words.append(w.hashes[a:b])
        self.gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owner).astype(np.int64) if owner else np.zeros(0, np.int64)
        self.distinct = np.unique(self.gram)

    def seeds(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(gram, item) of the rarer half of each item's grams that occur; all that are as rare as the last of them.

        Grams of no document are not ranked: they find nothing, and where a copy has many words changed they are most.
        """
        n = np.array([counts.get(int(g), 0) for g in np.searchsorted(self.distinct, self.gram)], np.int64)
        keep = np.zeros(len(n), bool)
        order = np.argsort(self.owner, kind="stable")
        cuts = np.searchsorted(self.owner[order], np.arange(len(self.ids) + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[a:b]
            own = own[n[own] > 0]
            if len(own):
                keep[own] = n[own] <= np.sort(n[own])[(len(own) - 1) // 2]
        at = np.flatnonzero(keep)
        at = at[np.argsort(self.gram[at], kind="stable")]
        return self.gram[at], self.owner[at]


def _counts(distinct: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(distinct), np.int64)
        for batch in batches:
            for w in tokenized(batch.column("text"), PUNCTUATION):
                g, ok = w.grams(GRAM)
                at = np.searchsorted(distinct, g)
                at[at == len(distinct)] = 0
                hit = ok & (distinct[at] == g)
                pairs = np.unique(at[hit] * np.int64(len(w.rows)) + w.text_of_word()[hit])
                total += np.bincount(pairs // len(w.rows), minlength=len(distinct))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])

    return run


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and where in ``text`` it ends (exclusive).

    A row at a time: the gap along the row is a running maximum.
    """
    n = len(text)
    ramp = -GAP * np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for word in item:
        new = np.zeros(n + 1, np.int64)
        np.maximum(row[:-1] + np.where(text == word, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + ramp) - ramp
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def _regions(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of seed places that one item may span, with room on both sides."""
    cut = np.flatnonzero(np.diff(places) > 2 * length) + 1
    return [(int(p[0]) - 2 * length, int(p[-1]) + 2 * length) for p in np.split(places, cut)]


def _leaks_of(w: Words, items: Items, gram: np.ndarray, owner: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, start, end) for a part's texts: region aligned, in words."""
    g, ok = w.grams(GRAM)
    lo = np.searchsorted(gram, g, "left")
    n = np.where(ok, np.searchsorted(gram, g, "right") - lo, 0)
    at = np.flatnonzero(n)
    if not len(at):
        return []
    place = np.repeat(at, n[at])
    first = np.repeat(lo[at], n[at])
    item = owner[first + np.arange(len(place)) - np.repeat(np.cumsum(n[at]) - n[at], n[at])]
    text = w.text_of_word()[place]
    order = np.lexsort((place, item, text))
    place, item, text = place[order], item[order], text[order]
    new = np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0)) + 1
    out = []
    for p, i, t in zip(np.split(place, new), item[np.r_[0, new]].tolist(), text[np.r_[0, new]].tolist(), strict=True):
        words = items.words[i]
        best = (0.0, 0, 0)
        for a, b in _regions(p, len(words)):
            a, b = max(a, int(w.first[t])), min(b, int(w.first[t + 1]))
            score, end = align(words, w.hashes[a:b])
            if score > best[0] * MATCH * len(words):
                back, length = align(words[::-1], w.hashes[a : a + end][::-1])
                best = (score / (MATCH * len(words)), a + end - length - int(w.first[t]), a + end - int(w.first[t]))
        if best[0] >= threshold:
            out.append((int(w.rows[t]), i, *best))
    return out


def _find(items: Items, gram: np.ndarray, owner: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs, ids = batch.column("_row"), batch.column("_id")
            for w in tokenized(batch.column("text"), PUNCTUATION):
                if found := _leaks_of(w, items, gram, owner, threshold):
                    rows = pa.array([f[0] for f in found])
                    yield pa.RecordBatch.from_arrays([refs.take(rows), ids.take(rows), pa.array([items.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found]), pa.array([f[3] for f in found], pa.int32()), pa.array([f[4] for f in found], pa.int32())], names=["_row", "doc_id", "item_id", "score", "start", "end"])

    return run


def item_blocks(items: DataFrame, item_id: str, text: str, at_once: int) -> Iterator[Items]:
    ids, texts = [], []
    for r in items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        if len(ids) == at_once:
            yield Items(ids, texts)
            ids, texts = [], []
    if ids:
        yield Items(ids, texts)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", row: str | None = None, threshold: float = THRESHOLD, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(row, doc_id, item_id, score, start, end) for documents that hold a copy of a test item, one row per pair.

    ``score`` is the best alignment's, over that of the item with itself; ``start`` and ``end`` are its place in the
    document's words. Items are taken in blocks, documents whole. Items of fewer words than a gram have no seed and
    match nothing; null texts have no words; equal items are reported each, repeated rows each; an empty side gives no
    rows. ``row`` names a column to carry along, as a string.
    """
    spark = docs.sparkSession
    key = F.col(row) if row else F.lit(None)
    d = docs.select(key.cast("string").alias("_row"), F.col(doc_id).cast("bigint").alias("_id"), F.lower(whole_text(text)).alias("text"))
    found = None
    for block in item_blocks(items, item_id, item_text, at_once):
        if not len(block.distinct):
            continue
        counted = d.select("text").mapInArrow(_counts(block.distinct), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
        counts = {r.gram: r.n for r in counted.collect()}  # grams of the block's items only
        gram, owner = block.seeds(counts)
        part = d.mapInArrow(_find(block, gram, owner, threshold), "_row string, doc_id bigint, item_id bigint, score double, start int, end int")
        found = part if found is None else found.unionByName(part)
    if found is None:
        kinds = T.StructType([T.StructField("_row", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
        return spark.createDataFrame([], kinds)
    return found


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The documents that hold no copy of a test item, with their own columns.

    Verdicts come back by id and digest of the text: rows equal in both hold the same copies.
    """
    d = docs.select(*[F.col(c).alias(f"_c_{c}") for c in docs.columns])
    d = d.withColumn("_ref", F.concat_ws("|", F.coalesce(F.col(f"_c_{doc_id}").cast("string"), F.lit("-")), F.md5(whole_text(f"_c_{text}").cast("binary"))))
    bad = stage(leaks(d, items, f"_c_{doc_id}", f"_c_{text}", row="_ref", **kw).select(F.col("_row").alias("_ref")).distinct(), "leak-rows")
    return d.join(small(bad), "_ref", "left_anti").select(*[F.col(f"_c_{c}").alias(c) for c in docs.columns])
