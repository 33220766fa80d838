"""Phrase collocations by stripes.

A stripe belongs to a prefix of words and counts the words that follow it. Tasks build stripes of the texts they read,
and the stripes of a prefix are merged element by element. The merged stripes hold all that scoring needs: an element is
an extension with its count, which is the total of the longer prefix it makes, and the largest elements say which
extensions subsume their parts. The stripe of the empty prefix counts the words. Stripes of longer prefixes follow level
by level; as no phrase is more frequent than its parts, elements whose parts fell short are not counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import small, stage, whole_text
from claimweave.llm.tokens import U, mix, word_keys

#: Words from which phrases start at once in a task; bytes of text gathered for it.
CHUNK_WORDS, CHUNK_BYTES = 700_000, 4_000_000
#: Stripe elements merged at once.
MERGE_ELEMENTS = 400_000
#: A prefix as frequent as this, and as this share of all words, has its stripe cut into parts by the following word.
PART_OCCURRENCES, PART_SHARE = 1_000_000, 65_536
#: Bits, by a hash, of the phrases of one level that are frequent enough. When many share a bit, more is counted than
#: need be, and the counts decide all the same.
BITS = 1 << 25
_PARTIAL = "lang string, prefix binary, part int, next binary, n array<int>"
_MERGED = "lang string, prefix binary, part int, total bigint, next array<binary>, n array<bigint>"
_STEP = U(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Piece ends, and what stands between words of a piece.
_ENDER = np.zeros(256, bool)
_ENDER[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True


class Chunk:
    """Words of some texts: ids of (lang, word), and whether the next word stands in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        ender = _ENDER[data]
        word = ~(ender | _BLANK[data])
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = word[:-1]
        starts = np.flatnonzero(word & (~before | first[:-1]))
        after = np.zeros(len(data), bool)
        after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | first[1:])) + 1
        cuts = np.cumsum(ender)
        text = np.searchsorted(offsets, starts, "right")
        piece = cuts[starts] if len(starts) else np.zeros(0, np.int64)
        self.goes_on = np.zeros(len(starts), bool)
        self.goes_on[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
        places = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=places[1:])
        raw = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[word]))])
        coded = pc.dictionary_encode(raw)
        size = max(len(coded.dictionary), 1)
        tongue = pc.dictionary_encode(langs)
        both = tongue.indices.to_numpy()[text - 1].astype(np.int64) * size + coded.indices.to_numpy()
        kinds, self.ids = np.unique(both, return_inverse=True)
        self.word = coded.dictionary.take(pa.array(kinds % size))
        self.lang_code = kinds // size
        self.langs = tongue.dictionary

    def lang(self, ids: np.ndarray) -> pa.Array:
        return self.langs.take(pa.array(self.lang_code[ids]))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Texts gathered over batches until there are CHUNK_BYTES."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        lengths = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        while at < batch.num_rows:
            base = lengths[at - 1] if at else 0
            to = min(batch.num_rows, max(at + 1, int(np.searchsorted(lengths, base + CHUNK_BYTES - size, "right"))))
            kept.append(batch.slice(at, to - at))
            size += int(lengths[to - 1] - base)
            at = to
            if size >= CHUNK_BYTES:
                yield _chunk(kept)
                kept, size = [], 0
    if kept:
        yield _chunk(kept)


def _chunk(kept: list[pa.RecordBatch]) -> Chunk:
    t = pa.Table.from_batches(kept).combine_chunks()
    return Chunk(pa.concat_arrays([c.cast(pa.large_binary()) for c in t["text"].chunks]), pa.concat_arrays(t["lang"].chunks))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in chunks(batches):
        n = np.bincount(c.ids, minlength=len(c.word))
        yield pa.RecordBatch.from_arrays([c.lang(np.arange(len(c.word))).cast(pa.string()), c.word.cast(pa.binary()), pa.array(n)], names=["lang", "word", "n"])


def _chain(of_words: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from their words' hashes, word by word."""
    h = of_words[0]
    for w in of_words[1:]:
        h = mix(h * _STEP + w)
    return h


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U(20)) % U(bits)


def _bits(n_bits: int):
    """Of phrases (lang, phrase): 64 bits at a time, those that are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = pc.split_pattern(batch.column("phrase"), b" ")
            size = pc.list_value_length(parts).to_numpy()
            flat = word_keys(pc.list_flatten(parts).cast(pa.large_binary()))
            first = np.append(0, np.cumsum(size)[:-1])
            lang = word_keys(batch.column("lang").cast(pa.large_binary()))
            h = np.zeros(len(size), U)
            for k in np.unique(size).tolist():
                at = np.flatnonzero(size == k)
                h[at] = _chain([lang[at], *(flat[first[at] + j] for j in range(k))])
            place = np.unique(_places(h, n_bits))
            word, new = np.unique(place >> U(6), return_index=True)
            bits = np.bitwise_or.reduceat(U(1) << (place & U(63)), new)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["at", "bits"])

    return run


def frequent_bits(phrases: DataFrame, n_bits: int = BITS) -> np.ndarray:
    """Bits of (lang, phrase: binary): at most ``n_bits`` (a multiple of 64) come to the driver, whatever the size of the table."""
    set_bits = phrases.select("lang", "phrase").mapInArrow(_bits(n_bits), "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(n_bits // 64, U)
    out[set_bits["at"].to_numpy()] = set_bits["bits"].to_numpy().view(U)
    return out


def _stripes(words: int, bits: np.ndarray, heavy: dict[str, tuple[list[bytes], list[int]]]):
    """Stripes of the prefixes of so many words, of elements both of whose longest parts have their bit."""

    def parts_of(c: Chunk) -> np.ndarray:
        parts = np.ones(len(c.word), np.int64)
        for lang, (names, n) in heavy.items():
            code = c.langs.index(pa.scalar(lang, c.langs.type)).as_py()
            if code >= 0:
                at = pc.index_in(c.word, value_set=pa.array(names, pa.large_binary())).to_numpy(zero_copy_only=False)
                mine = (c.lang_code == code) & ~np.isnan(at)
                parts[mine] = np.array(n)[at[mine].astype(np.int64)]
        return parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            parts, keys = parts_of(c), word_keys(c.word)
            lang = word_keys(c.langs.cast(pa.large_binary()))[c.lang_code] if len(c.word) else keys
            for at in range(0, len(c.ids), CHUNK_WORDS):
                places = np.arange(at, min(at + CHUNK_WORDS, len(c.ids)))
                for j in range(words):
                    places = places[c.goes_on[places + j]]
                ids = [c.ids[places + j] for j in range(words + 1)]
                for some in (slice(0, words), slice(1, words + 1)):
                    h = _places(_chain([lang[ids[0]], *(keys[i] for i in ids[some])]), 64 * len(bits))
                    on = (bits[(h >> U(6)).astype(np.int64)] >> (h & U(63)) & U(1)).astype(bool)
                    ids = [i[on] for i in ids]
                if len(ids[0]):
                    yield from _elements(c, ids, parts, keys)

    return run


def _elements(c: Chunk, ids: list[np.ndarray], parts: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counted and grouped into stripes; those of split prefixes by part."""
    kinds = len(c.word)
    prefix, names = ids[0], [np.arange(kinds)]  # names: the words of each distinct prefix
    for w in ids[1:-1]:
        both, prefix = np.unique(prefix * kinds + w, return_inverse=True)
        names = [*(x[both // kinds] for x in names), both % kinds]
    key, n = np.unique(prefix * kinds + ids[-1], return_counts=True)
    prefix, after = key // kinds, key % kinds
    held = parts[names[0][prefix]]
    for w in names[1:]:
        held = np.minimum(held, parts[w[prefix]])
    split = held > 1
    for some in (~split, split):
        pick = np.flatnonzero(some)
        part = np.zeros(len(pick), np.int64)
        if some is split:
            part = (keys[after[pick]] % held[pick].astype(U)).astype(np.int64)
            order = np.lexsort((part, prefix[pick]))
            pick, part = pick[order], part[order]
        if len(pick):
            yield _rows(c, names, prefix[pick], part, after[pick], n[pick])


def _rows(c: Chunk, names: list[np.ndarray], prefix: np.ndarray, part: np.ndarray, after: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    new = np.ones(len(prefix), bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    ids = [w[prefix[first]] for w in names]
    words = [c.word.take(pa.array(w)) for w in ids]
    joined = words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))
    ends = np.append(first, len(prefix)).astype(np.int32)
    nexts = pc.binary_join(pa.ListArray.from_arrays(ends, c.word.take(pa.array(after)).cast(pa.binary())), b" ")
    return pa.RecordBatch.from_arrays([c.lang(ids[0]).cast(pa.string()), joined.cast(pa.binary()), pa.array(part[first].astype(np.int32)), nexts, pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))], names=["lang", "prefix", "part", "next", "n"])


def _merge(least: int):
    """Sorted partial stripes → whole ones: elements summed, those from ``least`` on kept, with the total of all."""

    def groups(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, bool)
        same = np.ones(t.num_rows - 1, bool)
        for name in ("lang", "prefix", "part"):
            a = t[name].combine_chunks()
            same &= pc.equal(a.slice(0, len(a) - 1), a.slice(1)).to_numpy(zero_copy_only=False)
        new[1:] = ~same
        return new

    def summed(t: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(first row of each group, group of each element, next word, count)"""
        new = groups(t)
        n = t["n"].combine_chunks()
        coded = pc.dictionary_encode(pc.list_flatten(t["next"]).combine_chunks())
        kinds = len(coded.dictionary)
        group = np.repeat(np.cumsum(new) - 1, pc.list_value_length(n).to_numpy())
        key, inverse = np.unique(group * kinds + coded.indices.to_numpy(), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, inverse, pc.list_flatten(n).to_numpy())
        return np.flatnonzero(new), key // kinds, coded.dictionary.take(pa.array(key % kinds)), total

    def whole(t: pa.Table) -> pa.RecordBatch:
        first, group, nexts, n = summed(t)
        totals = np.zeros(len(first), np.int64)
        np.add.at(totals, group, n)
        pick = np.flatnonzero(n >= least)
        held = np.bincount(group[pick], minlength=len(first))
        keep = np.flatnonzero(held)
        ends = np.append(0, np.cumsum(held[keep])).astype(np.int32)
        head = [t[c].combine_chunks().take(pa.array(first[keep])) for c in ("lang", "prefix", "part")]
        return pa.RecordBatch.from_arrays([*head, pa.array(totals[keep]), pa.ListArray.from_arrays(ends, nexts.take(pa.array(pick))), pa.ListArray.from_arrays(ends, pa.array(n[pick]))], names=["lang", "prefix", "part", "total", "next", "n"])

    def partial(t: pa.Table) -> pa.Table:
        """One group's rows merged into one."""
        _, _, nexts, n = summed(t)
        ends = np.array([0, len(n)], np.int32)
        return pa.table({**{c: t[c].slice(0, 1) for c in ("lang", "prefix", "part")}, "next": pa.ListArray.from_arrays(ends, nexts), "n": pa.ListArray.from_arrays(ends, pa.array(n))}).cast(t.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c) for c in ("lang", "prefix", "part")} | {"next": pc.split_pattern(batch.column("next"), b" "), "n": batch.column("n").cast(pa.list_(pa.int64()))}
            kept.append(pa.table(columns))
            size += pc.sum(pc.list_value_length(batch.column("n"))).as_py() or 0
            if size < MERGE_ELEMENTS:
                continue
            t = pa.concat_tables(kept).combine_chunks()
            last = int(np.flatnonzero(groups(t))[-1])  # its group may go on
            if last:
                yield whole(t.slice(0, last))
            kept = [partial(t.slice(last))]
            size = len(kept[0]["n"][0])
        if kept:
            yield whole(pa.concat_tables(kept).combine_chunks())

    return run


def _heavy(words: DataFrame) -> dict[str, tuple[list[bytes], list[int]]]:
    """Words so frequent that their stripes are cut, and into how many parts; at most PART_SHARE words."""
    limit = max(PART_OCCURRENCES, (words.agg(F.sum("n")).first()[0] or 0) // PART_SHARE)
    heavy: dict[str, tuple[list[bytes], list[int]]] = {}
    for r in words.where(F.col("n") > limit).collect():
        listed = heavy.setdefault(r.lang, ([], []))
        listed[0].append(bytes(r.phrase))
        listed[1].append(-(-r.n // limit))
    return heavy


def levels(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 3, least: int = 10, n_bits: int = BITS) -> list[DataFrame]:
    """(lang, phrase: UTF-8 bytes, n) of all words, then of the phrases of 2 … max_words words met ``least`` times or more.

    Each level is read from merged stripes: (lang, prefix, part, total, next, n). A stripe is a group of bounded size:
    that of a prefix met more often than PART_OCCURRENCES, and than one in PART_SHARE words, is cut into parts by a hash
    of the next word.
    """
    d = docs.select(whole_text(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    out = [stage(d.mapInArrow(_word_counts, "lang string, word binary, n bigint").groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("n")), "phrase-words")]
    heavy = _heavy(out[0])
    key = ["lang", "prefix", "part"]
    for words in range(1, max_words):
        bits = frequent_bits(out[-1].where(F.col("n") >= least), n_bits)
        partial = d.mapInArrow(_stripes(words, bits, heavy), _PARTIAL)
        merged = stage(partial.repartition(*key).sortWithinPartitions(*key).mapInArrow(_merge(least), _MERGED), "phrase-stripes")
        each = merged.select("lang", "prefix", F.explode(F.arrays_zip("next", "n")).alias("e"))
        out.append(each.select("lang", F.concat("prefix", F.lit(b" "), "e.next").alias("phrase"), F.col("e.n").alias("n")))
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_words: int = 2, max_words: int = 3, least: int = 10, subsumed: int = 50, top: int = 2000, n_bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of min_words to max_words words.

    a, l and r are the counts of the phrase and of its parts at the lowest-scoring cut (ties: the shortest first part),
    n all words of the language, score floor(10**6 * a * a / (l * r)), computed in decimals. Phrases met fewer than
    ``least`` times are none; one that a longer phrase of at least ``subsumed`` per cent of its count holds is dropped.
    A null text has no words, a null language is ``und``; ties go by a, then by the phrase's bytes; repeated rows count
    each; an empty table gives no rows.
    """
    found = levels(docs, text, lang, max_words, least, n_bits)
    size = stage(found[0].groupBy("lang").agg(F.sum("n").alias("n")), "phrase-langs")
    named = [x.where(F.col("n") >= least).select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("n").alias("f"), F.lit(k).alias("words")) for k, x in enumerate(found, 1)]
    freq = stage(reduce(DataFrame.unionByName, named), "phrase-counts")
    longer = freq.where("words > 1")

    w = F.split("phrase", " ")
    run = lambda start, length: F.array_join(F.slice(w, start, length), " ")
    cut = longer.where(F.col("words") >= min_words).select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "words")
    cut = cut.select("lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("left"), run(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    parts = cut.join(freq.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(freq.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = F.expr("CAST((CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0))) AS BIGINT)")
    scored = parts.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))

    # every shorter run of words inside a phrase, with the largest count of a phrase that holds it
    lengths = F.sequence(F.lit(min_words), F.col("words") - 1)
    inner = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda at: F.array_join(F.slice(w, at, m), " "))))
    held = longer.where(F.col("words") > min_words).select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left = scored.join(held, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("most") < F.lit(subsumed) * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), F.asc("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(small(size), "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, 1 AS words, unnest(ws) AS phrase FROM w
 UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
 UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE words > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, words)) AS cut FROM c),
v AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(s[1:cut], ' ') AS head, array_to_string(s[cut + 1:], ' ') AS tail FROM k),
x AS MATERIALIZED (SELECT v.*, f.f AS l FROM v JOIN f ON f.lang = v.lang AND f.phrase = v.head),
j AS (SELECT x.*, f.f AS r, (1000000::HUGEINT * a * a // (l::HUGEINT * f.f))::BIGINT AS score FROM x JOIN f ON f.lang = x.lang AND f.phrase = x.tail),
b AS (SELECT lang, phrase, a, min(struct_pack(score := score, k := cut, l := l, r := r)) AS c FROM j GROUP BY ALL),
h AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS phrase FROM c WHERE words = 3) GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY c.score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN h USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, c.l AS l, c.r AS r, n, c.score AS score FROM o JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
