"""Overlap of an evaluation set with training texts: exact, shingle Jaccard, TF-IDF cosine."""

from __future__ import annotations

import math
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.text import norm_ascii, shingles, words
from claimweave.session import broadcast_if_small, stage


def digest(text: Column) -> Column:
    """16 bytes that stand for a text as a key."""
    return F.unhex(F.md5(text.cast("binary")))


def collapse_copies(df: DataFrame, id_col: str, text: Column, name: str = "form") -> DataFrame:
    """One row per distinct text form: its ``key`` (digest), smallest id, number of copies and the form itself.

    Keyed by digest and map-side combined, so a text copied into a third of all rows costs one row afterwards.
    """
    return df.groupBy(digest(text).alias("key")).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"), F.first(text).alias(name))


def max_jaccard(test: DataFrame, train: DataFrame, test_id: str, train_id: str, text: str, k: int = 5) -> DataFrame:
    """Largest k-word shingle Jaccard of each test row with any training row (0 without a shared shingle).

    A training row counts by the test shingles it holds and by how many shingles it has in all; of rows that hold the
    same ones only the one with the fewest can be the best, so boilerplate that all rows share leaves few rows. A test
    row is first compared with the rows of its rarest shingle. Its best value so far says how many shingles a better
    row must share, hence that it holds one of so many of the rarest; only those are looked up again.
    """
    t = collapse_copies(test, test_id, norm_ascii(text)).select("key", F.posexplode(shingles("form", k)).alias("at", "gram"))
    named = stage(t.select("gram").distinct().withColumn("g", F.monotonically_increasing_id()), "test-grams")
    t = stage(t.join(named, "gram").groupBy("key").agg(F.count("*").cast("int").alias("nt"), F.collect_list("g").alias("s")), "test-shingles")
    d = train.select(train_id, shingles(norm_ascii(text), k).alias("s")).withColumn("_row", F.monotonically_increasing_id())
    hits = d.select("_row", F.size("s").alias("nd"), F.explode("s").alias("gram")).join(broadcast_if_small(named), "gram").select("_row", "nd", "g")
    held = hits.groupBy("_row", "nd").agg(F.array_sort(F.collect_list("g")).alias("held"))
    kinds = stage(held.groupBy("held").agg(F.min("nd").alias("nd")).withColumn("kind", F.monotonically_increasing_id()), "train-kinds")
    index = stage(kinds.select("kind", F.explode("held").alias("g")), "train-index")
    freq = index.groupBy("g").agg(F.count("*").alias("n"))
    ranked = t.select("key", F.explode("s").alias("g")).join(freq, "g").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("by_rarity"))
    ranked = stage(ranked.join(t, "key"), "test-ranked")

    def best(rows: DataFrame) -> DataFrame:
        """``rows`` (key, nt, s, probes) → key, j over the training kinds that hold a probe."""
        met = rows.select("key", F.explode("probes").alias("g")).join(index, "g").select("key", "kind").distinct()
        pairs = met.join(rows.select("key", "nt", "s"), "key").join(kinds, "kind")
        both = F.size(F.array_intersect("s", "held"))
        return pairs.groupBy("key").agg(F.max(both / (F.col("nt") + F.col("nd") - both)).alias("j"))

    first = stage(best(ranked.withColumn("probes", F.slice(F.col("by_rarity.g"), 1, 1))), "first-jaccard")
    # to beat j, at least floor(j * nt) + 1 shingles are shared, those that no row holds never
    more = ranked.join(first, "key").withColumn("n", F.size("by_rarity") - F.floor(F.col("j") * F.col("nt") - 1e-9).cast("int"))
    again = best(more.where("n > 1").withColumn("probes", F.slice(F.col("by_rarity.g"), 2, F.col("n") - 1)))
    top = first.unionByName(again).groupBy("key").agg(F.max("j").alias("max_jaccard"))
    rows = test.select(test_id, digest(norm_ascii(text)).alias("key")).join(top, "key", "left")
    return rows.select(test_id, F.round(F.coalesce("max_jaccard", F.lit(0.0)), 6).alias("max_jaccard"))


def word_char_grams(word: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of one blank-padded word; sizes stop once the padded word fits in a single gram."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))

    def cut(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1))
        grams = F.transform(starts, lambda i: F.substr(padded, i, F.lit(n)))
        return grams if n == low else F.when(F.length(padded) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[cut(n) for n in range(low, high + 1)])


def gram_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, tf): words are counted per text first and each distinct word is cut into grams once."""
    w = docs.select(key, F.explode(words(F.lower(text))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    vocabulary = w.select("w").distinct().select("w", F.explode(word_char_grams(F.col("w"))).alias("gram"))
    per_word = vocabulary.groupBy("w", "gram").agg(F.count("*").alias("m"))
    return w.join(per_word, "w").groupBy(key, "gram").agg(F.sum(F.col("n") * F.col("m")).alias("tf"))


#: Characters of the texts that are compared together, about; longer texts stand alone.
PART_CHARS = 4_000_000
#: Texts whose products with the test rows are formed at once, and the largest table of test weights.
BLOCK_TEXTS, TABLE_CELLS = 64, 1 << 23


def _numbered(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, dict[str, int]]:
    """Words of each text by number; the grams of all distinct words by number, and where those of a word begin; numbers of grams."""
    words: dict[str, int] = {}
    rows = []
    for text in texts:
        found = text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")
        rows.append(np.array([words.setdefault(w, len(words)) for w in found if w], np.int64))
    grams: dict[str, int] = {}
    flat, starts = array("q"), array("q", [0])
    for w in words:
        p = f" {w} "
        flat.extend([grams.setdefault(p[i : i + k], len(grams)) for k in (3, 4, 5) for i in range(len(p) - k + 1)])
        starts.append(len(flat))
    return rows, np.array(flat, np.int64), np.array(starts, np.int64), grams


def _grams_of(words: np.ndarray, flat: np.ndarray, starts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a text and their counts; ``place`` is scratch with a cell for each gram."""
    w, n = np.unique(words, return_counts=True)
    size = starts[w + 1] - starts[w]
    ids = flat[np.repeat(starts[w] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    at = np.arange(len(ids))
    place[ids] = at
    found = ids[place[ids] == at]
    place[found] = np.arange(len(found))
    return found, np.bincount(place[ids], np.repeat(n, size), len(found))


def _texts_with(part: pd.DataFrame) -> pd.DataFrame:
    """How many texts of a part, copies counted, hold each gram."""
    rows, flat, starts, grams = _numbered(part["low"].tolist())
    n, place = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for words, copies in zip(rows, part["copies"].tolist(), strict=True):
        if len(words):
            n[_grams_of(words, flat, starts, place)[0]] += copies
    return pd.DataFrame({"part": part["part"].iloc[0], "gram": list(grams), "n": n})


def _cosines(alone: float, least: float):
    """Cosines above ``least`` of the texts of a part with the test rows; ``alone`` is the weight of grams that no other text holds."""

    def run(part: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        rows, flat, starts, grams = _numbered(part["low"].tolist())
        idf, place = np.full(len(grams), alone), np.zeros(len(grams), np.int64)
        ids = np.array([grams[g] for g in weights["gram"].tolist()], np.int64)
        idf[ids] = weights["idf"].to_numpy()
        shared = np.flatnonzero(weights["ts"].notna().to_numpy())
        row = np.full(len(grams), -1)
        row[ids[shared]] = np.arange(len(shared))
        out: list[tuple[int, int, float]] = []
        if len(shared) and len(part):
            lists = weights["ts"].to_numpy()[shared]
            ts, col = np.unique(np.concatenate(lists), return_inverse=True)
            at, wt = np.repeat(np.arange(len(shared)), [len(x) for x in lists]), np.concatenate(weights["wts"].to_numpy()[shared])
            step = max(1, TABLE_CELLS // len(shared))
            names = part["_d"].tolist()
            for first in range(0, len(ts), step):
                own = (col >= first) & (col < first + step)
                table = np.zeros((len(shared), min(step, len(ts) - first)))
                table[at[own], col[own] - first] = wt[own]
                # short floats tell which products are near the limit; those are added up again
                short = table.astype(np.float32)
                for k in range(0, len(rows), BLOCK_TEXTS):
                    block = np.zeros((min(BLOCK_TEXTS, len(rows) - k), len(shared)))
                    for i, words in enumerate(rows[k : k + BLOCK_TEXTS]):
                        if len(words):
                            found, tf = _grams_of(words, flat, starts, place)
                            w = tf * idf[found]
                            r = row[found]
                            block[i, r[r >= 0]] = w[r >= 0] / np.sqrt(w @ w)
                    for i, j in zip(*np.nonzero(block.astype(np.float32) @ short > least - 0.001), strict=True):
                        out.append((names[k + i], int(ts[first + j]), float(block[i] @ table[:, j])))
        return pd.DataFrame(out, columns=["_d", "t", "cosine"])

    return run


def near_duplicates(test: DataFrame, train: DataFrame, test_id: str, train_id: str, text: str, threshold: float = 0.85) -> DataFrame:
    """Best training match of each test row with TF-IDF cosine above ``threshold``.

    Distinct training texts are written once and dealt in parts of bounded size. In a part each distinct word is cut into
    grams once, and grams are counted by the words of a text, so that neither words nor grams of a text are rows. A part
    tells how many of its texts hold each gram; for the second round it gets the weights of its grams and of the test rows
    that hold them, and only cosines above the threshold leave it. Grams of a single text, which make most of a growing
    vocabulary, have one and the same weight and are not sent.
    """
    t = collapse_copies(test, test_id, F.col(text), "_text").withColumn("t", F.monotonically_increasing_id())
    t = stage(t.select("key", "t", "copies", "_text"), "test-texts")
    tg = stage(gram_counts(t, "t", "_text"), "test-grams")
    d = stage(collapse_copies(train, train_id, F.col(text), "_text").withColumn("_d", F.monotonically_increasing_id()), "train-texts")
    n = max(d.sparkSession.sparkContext.defaultParallelism, (d.agg(F.sum(F.length("_text"))).first()[0] or 0) // PART_CHARS + 1)
    dealt = d.where(F.col("_text").isNotNull()).select(F.pmod(F.xxhash64("_d"), F.lit(n)).alias("part"), "_d", "copies", F.lower("_text").alias("low")).repartition(n, "part")
    held = stage(dealt.groupBy("part").applyInPandas(_texts_with, "part bigint, gram string, n bigint"), "train-grams")

    df_t = tg.join(t.select("t", "copies"), "t").groupBy("gram").agg(F.sum("copies").alias("c"))
    df = df_t.unionByName(held.groupBy("gram").agg(F.sum("n").alias("c"))).groupBy("gram").agg(F.sum("c").alias("df"))
    total = test.agg(F.count("*")).first()[0] + train.agg(F.count("*")).first()[0]
    idf = stage(df.where("df > 1").select("gram", (F.log((1 + total) / (1 + F.col("df"))) + 1).alias("idf")), "gram-idf")
    alone = math.log((1 + total) / 2) + 1
    tw = stage(tg.join(idf, "gram", "left").select("t", "gram", (F.col("tf") * F.coalesce("idf", F.lit(alone))).alias("w")), "test-weights")
    tn = tw.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    tu = tw.join(tn, "t").groupBy("gram").agg(F.collect_list(F.struct("t", (F.col("w") / F.col("t_norm")).alias("wt"))).alias("v"))

    weights = idf.join(tu, "gram", "left").select("gram", "idf", F.col("v.t").alias("ts"), F.col("v.wt").alias("wts"))
    sent = held.select("part", "gram").join(weights, "gram").repartition(n, "part")
    met = dealt.groupBy("part").cogroup(sent.groupBy("part")).applyInPandas(_cosines(alone, threshold), "_d bigint, t bigint, cosine double")
    sims = met.select("_d", "t", F.round("cosine", 4).alias("similarity")).where(F.col("similarity") > threshold)
    sims = sims.join(d.select("_d", train_id), "_d")
    best = sims.groupBy("t").agg(F.min_by(F.struct(train_id, "similarity"), F.struct(-F.col("similarity"), train_id)).alias("b"))
    best = best.join(t.select("t", F.col("key").alias("t_key")), "t").select("t_key", "b.*")
    rows = test.select(test_id, digest(F.col(text)).alias("t_key"))
    return rows.join(best, "t_key").select(test_id, train_id, "similarity")
