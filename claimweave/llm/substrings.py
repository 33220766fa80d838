"""Substring dedup: seeds on winnowed anchors, extended both ways.

Of every window of ``window`` words one ``ANCHOR``-word gram, that of the least hash, is the anchor; equal windows have
equal anchors. Anchors that occur once anywhere are dropped. The others are joined with their first occurrence: where
all the words around both agree as far as any window of this anchor reaches, the seed is extended over that stretch at
once; where they do not, the windows of the seed are compared one by one with the first occurrence of each. Extended
seeds that continue one another in both documents form maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import doc_ref, stage, whole_text
from claimweave.llm.tokens import Words, tokenized

WINDOW, ANCHOR = 20, 6


def winnow(w: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a part: hash, word number, first and last window (word numbers of their starts) that chose it."""
    g, _ = w.grams(anchor)
    of = w.text_of_word()
    n, span = len(g), window - anchor + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return g[:0], none, none, none
    starts = np.arange(n - window + 1)
    starts = starts[of[starts] == of[starts + window - 1]]
    if not len(starts):
        return g[:0], none, none, none
    # least hash of each span, the last of equal ones, by doubling
    best = np.arange(n)
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        ahead = np.minimum(np.arange(n) + step, n - 1)
        other = best[ahead]
        better = (g[other] < g[best]) | ((g[other] == g[best]) & (other > best))
        best = np.where(better, other, best)
        reach += step
    chosen = best[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:] - 1, len(starts) - 1)
    return g[chosen[at]], chosen[at], starts[at], starts[last]


def _seeds(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = batch.column("ref")
            for w in tokenized(batch.column("text")):
                g, at, lo, hi = winnow(w, window, anchor)
                of = w.text_of_word()[lo]
                base = w.first[of]
                around = w.spans(lo, hi + window) + (at - lo).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(around.view(np.int64)), refs.take(pa.array(w.rows[of])), pa.array((lo - base).astype(np.int32)), pa.array((hi - lo).astype(np.int32))],
                    names=["anchor", "around", "ref", "lo", "more"],
                )

    return run


def _windows(window: int):
    """Hashes of the windows of the seeds that a text brings along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs, seeds = batch.column("ref"), batch.column("seeds")
            for w in tokenized(batch.column("text")):
                keys, rows, starts = [], [], []
                for k, row in enumerate(w.rows):
                    for s in seeds[int(row)].as_py():
                        p = np.arange(s["lo"], s["lo"] + s["more"] + 1)
                        starts.append(p)
                        keys.append(p + w.first[k])
                        rows.append(np.full(len(p), row))
                if keys:
                    at = np.concatenate(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(w.spans(at, at + window).view(np.int64)), pa.array((w.grams(4)[0][at]).view(np.int64)), refs.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(starts).astype(np.int32))], names=["h", "h2", "ref", "lo"])

    return run


def extended_seeds(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` (ref, text) → ref, lo, hi, src, src_lo: windows lo…hi also start at src_lo… of src, which comes earlier."""
    seeds = docs.mapInArrow(_seeds(window, anchor), "anchor bigint, around bigint, ref binary, lo int, more int")
    place = F.struct("ref", "lo", "around")
    known = seeds.groupBy("anchor").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.min("around").alias("least"), F.max("around").alias("most"))
    # what repeats, and whether all its occurrences stand in the same words
    known = stage(known.where("n > 1").select("anchor", "first", (F.col("least") == F.col("most")).alias("alike")), "repeat-anchors")
    met = stage(seeds.join(known, "anchor").where(~(F.col("alike") & (F.col("first.ref") == F.col("ref")) & (F.col("first.lo") == F.col("lo")))), "repeat-seeds")
    same = F.col("around") == F.col("first.around")
    is_first = (F.col("first.ref") == F.col("ref")) & (F.col("first.lo") == F.col("lo"))
    whole = met.where(same & ~is_first).select("ref", "lo", (F.col("lo") + F.col("more")).alias("hi"), F.col("first.ref").alias("src"), F.col("first.lo").alias("src_lo"))
    rest = met.where(~F.col("alike") & (~same | is_first))
    by_text = rest.groupBy("ref").agg(F.collect_set(F.struct("lo", "more")).alias("seeds"))
    texts = docs.join(by_text, "ref")
    windows = stage(texts.mapInArrow(_windows(window), "h bigint, h2 bigint, ref binary, lo int"), "repeat-windows")
    first = windows.groupBy("h", "h2").agg(F.min(F.struct("ref", "lo")).alias("first"), F.max(F.struct("ref", "lo")).alias("last"))
    # written, so that both sides of the join are plain exchanges, whose hot keys are split
    first = stage(first.where("first <> last").drop("last"), "repeat-firsts")
    single = windows.join(first, ["h", "h2"]).where(F.struct("ref", "lo") != F.col("first")).select("ref", "lo", F.col("lo").alias("hi"), F.col("first.ref").alias("src"), F.col("first.lo").alias("src_lo"))
    return whole.unionByName(single)


def maximal_repeats(spans: list, window: int) -> list[dict]:
    """Seeds of one text joined where they continue one another in both places; ends in words, exclusive."""
    out: list[dict] = []
    for src, shift, lo, hi in sorted({(s["src"], s["src_lo"] - s["lo"], s["lo"], s["hi"]) for s in spans}):
        if out and out[-1]["src"] == src and out[-1]["shift"] == shift and lo <= out[-1]["end"] - window + 1:
            out[-1]["end"] = max(out[-1]["end"], hi + window)
        else:
            out.append({"src": src, "shift": shift, "start": lo, "end": hi + window})
    return sorted(out, key=lambda r: (r["start"], r["end"]))


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            extra = [n for n in batch.schema.names if n not in ("text", "spans")]
            for w in tokenized(batch.column("text")):
                kept, gone, repeats = [], [], []
                raw = w.data.tobytes()
                for k, row in enumerate(w.rows):
                    n = int(w.first[k + 1] - w.first[k])
                    found = spans[int(row)].as_py()
                    if not found:
                        body = raw[w.starts[w.first[k]] : w.ends[w.first[k + 1] - 1]] if n else b""
                        kept.append(b" ".join(body.split()))
                        gone.append(0)
                        repeats.append([])
                        continue
                    rep = maximal_repeats(found, window)
                    edge = np.zeros(n + 1, np.int64)
                    for r in rep:
                        edge[r["start"]] += 1
                        edge[r["end"]] -= 1
                    left = np.flatnonzero(np.cumsum(edge[:n]) == 0) + w.first[k]
                    kept.append(b" ".join(raw[s:e] for s, e in zip(w.starts[left].tolist(), w.ends[left].tolist(), strict=True)))
                    gone.append(n - len(left))
                    repeats.append([{"start": r["start"], "end": r["end"], "src": r["src"], "src_start": r["start"] + r["shift"]} for r in rep])
                rows = pa.array(w.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).take(rows) for n in extra] + [pa.array(np.diff(w.first).astype(np.int64)), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(repeats, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("src", pa.binary()), ("src_start", pa.int32())])))],
                    names=[*extra, "n_words", "n_removed", "kept_text", "repeats"],
                )

    return run


def without_repeats(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per input row: ``carry`` (as ``_c_<name>``), n_words, n_removed, kept_text, repeats.

    ``repeats`` holds the maximal repeats (start, end, src: reference of the earlier document, src_start). Words they
    cover go; the rest is joined by one space. Documents come in the order of doc_id, nulls last, then text digest;
    rows equal in id and text are one document, so neither takes words from the other. Null texts have no words, and
    texts shorter than a window lose none.
    """
    d = docs.select(*[F.col(c).alias(f"_c_{c}") for c in carry], F.col(doc_id).cast("bigint").alias("_id"), whole_text(text).alias("text")).withColumn("ref", doc_ref(F.col("_id"), F.col("text"))).drop("_id")
    found = extended_seeds(d.select("ref", "text"), window, anchor)
    spans = stage(found.groupBy("ref").agg(F.collect_set(F.struct("lo", "hi", "src", "src_lo")).alias("spans")), "repeat-spans")
    j = d.join(spans, "ref", "left").withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType))).drop("ref")
    kinds = ", ".join(f"`_c_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return j.mapInArrow(_removed(window), f"{kinds}, n_words bigint, n_removed bigint, kept_text string, repeats array<struct<start:int,end:int,src:binary,src_start:int>>")


SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT r, doc_id, i, sha256(array_to_string(list_slice(w, i, i + 19), ' ')) AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 20)) AS p FROM again)),
k AS (SELECT d.r, x.p, w[x.p] AS word FROM (SELECT r, unnest(range(1, len(w) + 1)) AS p FROM d) x JOIN d USING (r) ANTI JOIN gone USING (r, p)),
t AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM k GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""
