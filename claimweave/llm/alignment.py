"""Tokens of two tokenizers aligned by the bytes they cover.

Both token sequences of a text cover the same bytes. Offsets at which a token of each ends cut the text into groups;
the tokens of a group are linked, each of the one side with each of the other. All texts of a batch are merged in
lockstep: one vector holds every place in both sequences, a step advances all of them by one token, and what is done
leaves the vector. Texts enter it in stretches, cut before spaces where both tokenizers must end a token; a stretch that
the batch holds many times enters once.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import small, stage

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text merged at once, of a lane of stretches, and characters encoded at once.
CHUNK_BYTES, LANE_BYTES, ENCODE_CHARS = 3_000_000, 1_500, 200_000
#: Links of a group up to which they are written one by one; equal tokens of a longer group are counted first.
LINKS_LISTED = 64
#: Pairs of token ids, the most frequent ones, that are sent to the tasks; the others are joined by a shuffle.
PAIRS_SENT = 200_000
#: The byte-level tokenizer's split of a text, as its library has it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to here, all libraries agree on what is a letter, a number and white space; no longer run goes to the fast encoder.
PLAIN_LIMIT, PLAIN_RUN = "ɐ", 2000


def byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """The byte-level tokenizer: ids of texts, bytes of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, merges = told["model"]["vocab"], told["model"]["merges"]
        at = byte_of_char()
        tokens = {i: bytes(at[c] for c in t) for t, i in vocab.items() if all(c in at for c in t)}
        tokens |= {t["id"]: t["content"].encode() for t in told.get("added_tokens", [])}
        self.bytes_of = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(b) for b in self.bytes_of])
        # where ids follow the order of merges, the merges can be taken as ranks by the faster library
        special = {t["content"] for t in told.get("added_tokens", [])}
        ranked = all(vocab[(m if isinstance(m, str) else " ".join(m)).replace(" ", "")] == 256 + k for k, m in enumerate(merges))
        self.fast = None
        if ranked and not told.get("normalizer") and not told["pre_tokenizer"].get("add_prefix_space"):
            import tiktoken

            self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks={tokens[i]: i for t, i in vocab.items() if t not in special}, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.fast is not None and max(t, default="") < PLAIN_LIMIT and longest_run(t) <= PLAIN_RUN for t in texts]
        other = iter(self.exact.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [np.asarray(self.fast.encode_to_numpy(t, disallowed_special=()) if p else next(other).ids, np.int64) for t, p in zip(texts, plain, strict=True)]


class PieceBpe:
    """The piece tokenizer: ids of texts (it puts a space in front), bytes of ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes_of])
        #: no piece goes on over a space, so texts may be cut before one
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(i, np.int64) for i in self.model.encode(texts, num_threads=1)] if texts else []


def longest_run(text: str) -> int:
    """Characters of the longest stretch that may be one split: no single spaces inside."""
    return max(map(len, text.split(" ")), default=0) if len(text) > PLAIN_RUN else len(text)


def stretches(data: np.ndarray) -> np.ndarray:
    """Where UTF-8 ``data`` may be cut: before a single space between two characters that are not white space.

    Neither tokenizer has a token over such a place, and what stands on one side does not change the other. Characters
    are taken as such if they are printable ASCII, or of two bytes beyond U+00BF; others leave their place uncut.
    """
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    before, after = data[at - 1], data[at + 1]
    lead = data[np.maximum(at - 2, 0)]
    left = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF))
    right = ((after > 0x20) & (after < 0x7F)) | ((after >= 0xC3) & (after <= 0xDF))
    return at[left & right]


@lru_cache(2)
def tokenizers(folder: str) -> tuple[ByteBpe, PieceBpe]:
    return ByteBpe(f"{folder}/{BYTE_BPE}"), PieceBpe(f"{folder}/{PIECE_BPE}")


def encoded(lanes: list[str], a: ByteBpe, b: PieceBpe) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of each lane (a text or a stretch of one, with a space in front) by both tokenizers."""
    out: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    at = 0
    while at < len(lanes):
        to, size = at, 0
        while to < len(lanes) and (to == at or size + len(lanes[to]) <= ENCODE_CHARS):
            size += len(lanes[to])
            to += 1
        out[0].extend(a.encode(lanes[at:to]))
        out[1].extend(b.encode([x[1:] for x in lanes[at:to]]))  # the model puts the space back
        at = to
    return out


def lockstep(a_ends: np.ndarray, a_first: np.ndarray, b_ends: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A and B tokens before every cut, counted over all texts, in order of texts and cuts.

    ``a_ends`` holds the byte ends of all texts' A tokens, text k those from a_first[k] to a_first[k + 1]; B alike.
    A step looks at one token of each side of every text that is not done: the side that ends first goes on, where both
    end the text is cut and both go on. Both sides of a text end at the same byte.
    """
    text = np.flatnonzero((np.diff(a_first) > 0) & (np.diff(b_first) > 0))
    state = np.stack([a_first[text], b_first[text]])
    last = np.stack([a_first[text + 1], b_first[text + 1]])
    cuts: list[np.ndarray] = []
    while len(text):
        x, y = a_ends[state[0]], b_ends[state[1]]
        state[0] += x <= y
        state[1] += y <= x
        at = np.flatnonzero(x == y)
        if len(at):
            cuts.append(state[:, at])
            done = state[0, at] == last[0, at]
            if done.any():
                on = np.ones(len(text), bool)
                on[at[done]] = False
                text, state, last = text[on], state[:, on], last[:, on]
    # a later cut lies further on in the concatenated tokens, whatever step found it
    x, y = np.concatenate(cuts, axis=1) if cuts else np.zeros((2, 0), np.int64)
    return np.sort(x), np.sort(y)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 … n - 1 in ASCII, right of a blank, and how many there are."""
    width = len(str(max(n - 1, 0)))
    out = np.zeros((n, width), np.uint8)
    rest = np.arange(n)
    for k in range(width - 1, -1, -1):
        out[:, k] = rest % 10 + ord("0")
        rest = rest // 10
    count = np.array([len(str(i)) for i in range(n)])
    return out, count


def summed(of: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``n`` summed by (of, key), in order."""
    names, code = np.unique(key, return_inverse=True)
    both = of * max(len(names), 1) + code
    order = np.argsort(both)
    both = both[order]
    new = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
    at = order[new]
    return of[at], key[at], np.add.reduceat(n[order], new) if len(new) else n


class Aligner:
    def __init__(self, a: ByteBpe, b: PieceBpe):
        self.a, self.b = a, b
        self.digits, self.width = _digits(max(len(a.bytes_of), len(b.bytes_of)))

    def spelled(self, x: np.ndarray, y: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` of all groups, and where each group ends."""
        ga, gb = np.searchsorted(a_cut, np.arange(len(x)), "right"), np.searchsorted(b_cut, np.arange(len(y)), "right")
        b_before = np.append(0, b_cut[:-1])
        place = np.concatenate([np.arange(len(x)) + b_before[ga], np.arange(len(y)) + a_cut[gb]])
        ids = np.empty(len(place), np.int64)
        ids[place] = np.concatenate([x, y])
        mark = np.full(len(place), ord(","), np.uint8)
        mark[place[a_cut - 1]] = ord("|")
        mark[place[len(x) + b_cut - 1]] = ord(";")
        width = self.digits.shape[1]
        cells = np.empty((len(ids), width + 1), np.uint8)
        cells[:, :width] = self.digits[ids]
        cells[:, width] = mark
        used = np.arange(width + 1) >= width - self.width[ids][:, None]
        return cells[used].tobytes(), np.cumsum(self.width[ids] + 1)[a_cut + b_cut - 1]

    def links(self, x: np.ndarray, y: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, pair A << 32 | B, links) of all groups; a long group of few different tokens stays small."""
        a_lo, b_lo = np.append(0, a_cut[:-1]), np.append(0, b_cut[:-1])
        na, nb = a_cut - a_lo, b_cut - b_lo
        some = np.flatnonzero(na * nb <= LINKS_LISTED)
        many = (na * nb)[some]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        group = np.repeat(some, many)
        found = [(group, x[a_lo[group] + at // nb[group]] << 32 | y[b_lo[group] + at % nb[group]], np.ones(len(group), np.int64))]
        for g in np.flatnonzero(na * nb > LINKS_LISTED).tolist():
            (i, n), (j, m) = np.unique(x[a_lo[g] : a_cut[g]], return_counts=True), np.unique(y[b_lo[g] : b_cut[g]], return_counts=True)
            key = (i[:, None] << 32 | j[None, :]).ravel()
            found.append((np.full(len(key), g), key, (n[:, None] * m[None, :]).ravel()))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def merged(self, units: pa.Array) -> dict[str, np.ndarray | list[bytes]]:
        """Of each stretch (large binary): whether both sides spell it, n_a, n_b, n_groups, its groups as bytes; ``pairs`` and ``links`` cut at ``ends``.

        Stretches between which a text may be cut stand behind each other in lanes; the vector holds a place a lane.
        """
        size = len(units)
        stop = np.frombuffer(units.buffers()[1], np.int64, size + 1, units.offset * 8) if size else np.zeros(1, np.int64)
        data = np.frombuffer(units.buffers()[2], np.uint8)[stop[0] : stop[-1]] if stop[-1] > stop[0] else np.zeros(0, np.uint8)
        stop = stop - stop[0]
        # a stretch goes on in the lane of the one before it if a text may be cut between the two
        apart = np.isin(stop[:-1], stretches(data)) & self.b.apart
        lane_first = [0] if size else []
        ends = stop.tolist()
        for k in range(1, size):
            if not apart[k] or ends[k] - ends[lane_first[-1]] >= LANE_BYTES:
                lane_first.append(k)
        bounds = [ends[k] for k in lane_first] + [ends[-1]]
        raw = data.tobytes()
        good = np.ones(size, bool)
        todo = [(x, y) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        lanes, ids = [], ([], [])
        while todo:
            texts = [raw[x:y].decode() for x, y in todo]
            again = []
            for (x, y), i, j in zip(todo, *encoded(texts, self.a, self.b), strict=True):
                if all(b"".join([side.bytes_of[t] for t in got.tolist()]) == raw[x:y] for side, got in ((self.a, i), (self.b, j))):
                    lanes.append((x, y))
                    ids[0].append(i)
                    ids[1].append(j)
                else:  # which of its stretches is it?
                    lo, hi = np.searchsorted(stop, [x, y]).tolist()
                    if hi - lo == 1:
                        good[lo] = False
                    else:
                        again += [(ends[k], ends[k + 1]) for k in range(lo, hi)]
            todo = again
        order = sorted(range(len(lanes)), key=lambda k: lanes[k])
        flat, first, place = [], [], []
        for side, of in zip((self.a, self.b), ids, strict=True):
            mine = [of[k] for k in order]
            flat.append(np.concatenate([*mine, np.zeros(0, np.int64)]))
            first.append(np.append(0, np.cumsum([len(i) for i in mine])).astype(np.int64))
            through = np.cumsum(side.lengths[flat[-1]])
            start = np.array([lanes[k][0] for k in order], np.int64)
            place.append(through + np.repeat(start - np.append(0, through)[first[-1][:-1]], np.diff(first[-1])))
        a_cut, b_cut = lockstep(place[0], first[0], place[1], first[1])
        unit = [np.searchsorted(stop, p, "left") - 1 for p in place]  # of each token
        of_group = unit[0][a_cut - 1]
        spelled, stops = self.spelled(*flat, a_cut, b_cut) if len(a_cut) else (b"", np.zeros(0, np.int64))
        stops = np.append(0, stops)[np.searchsorted(of_group, np.arange(size + 1))].tolist()
        group, key, n = self.links(*flat, a_cut, b_cut)
        of, key, n = summed(of_group[group], key, n)
        count = lambda x: np.bincount(x, minlength=size)
        return {
            "good": good, "n_a": count(unit[0]), "n_b": count(unit[1]), "n_groups": count(of_group), "spelled": [spelled[x:y] for x, y in zip(stops[:-1], stops[1:], strict=True)],
            "pairs": key, "links": n, "ends": np.append(0, np.cumsum(count(of))),
        }

    def batch(self, texts: list[bytes]) -> dict[str, np.ndarray | list[str]]:
        """Of each UTF-8 text: n_a, n_b, n_groups, n_links and groups_sha256; ``pairs`` and ``links`` of all, cut at ``ends``."""
        size = len(texts)
        data = np.frombuffer(b"".join([b" " + t if t else b"" for t in texts]), np.uint8)
        starts = np.append(0, np.cumsum([len(t) + 1 if t else 0 for t in texts])).astype(np.int64)
        apart = stretches(data) if self.b.apart else np.zeros(0, np.int64)
        at = np.unique(np.concatenate([apart, starts]))
        at = at[at < len(data)]
        text = np.searchsorted(starts, at, "right") - 1  # of each stretch; empty texts have none
        cells = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        unit = cells.indices.to_numpy().astype(np.int64)
        u = self.merged(cells.dictionary)
        good = np.ones(size, bool)
        good[text[~u["good"][unit]]] = False
        on = good[text]
        text, unit = text[on], unit[on]
        cuts, names = np.searchsorted(text, np.arange(size + 1)).tolist(), unit.tolist()
        groups = [hashlib.sha256(b"".join([u["spelled"][k] for k in names[a:b]])[:-1]).hexdigest() if b > a else "" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        # each text's distinct stretches, and how often it holds them
        kinds = max(len(cells.dictionary), 1)
        both, times = np.unique(text * kinds + unit, return_counts=True)
        text, unit = both // kinds, both % kinds
        lo = u["ends"][unit]
        many = u["ends"][unit + 1] - lo
        at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        t, key, n = summed(np.repeat(text, many), u["pairs"][at], u["links"][at] * np.repeat(times, many))
        total = lambda of, x: np.bincount(of, weights=x, minlength=size).astype(np.int64)
        return {c: total(text, u[c][unit] * times) for c in ("n_a", "n_b", "n_groups")} | {
            "n_links": total(t, n), "groups_sha256": groups, "pairs": key, "links": n, "ends": np.append(0, np.cumsum(np.bincount(t, minlength=size))),
        }


_ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, links array<bigint>"


def _align(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Aligner(*tokenizers(folder))
        kept: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            r = tool.batch([t for _, t in kept])
            heads = [pa.array(r[c]).cast(pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            lists = [pa.ListArray.from_arrays(r["ends"].astype(np.int32), pa.array(r[c])) for c in ("pairs", "links")]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int64()), *heads, pa.array(r["groups_sha256"], pa.string()), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                kept.append((i, t.as_py() or b""))
                size += len(kept[-1][1])
                if size >= CHUNK_BYTES:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    return run


def aligned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs with links.

    ``folder`` holds the tokenizers' files on every machine. Texts that are null or empty, or whose tokens of either
    side do not spell a space and the text, have no tokens: zeros and an empty hash. Repeated rows are rows each.
    """
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(_align(folder), _ALIGNED)


def counted(docs: DataFrame, sent: int = PAIRS_SENT, **kw) -> DataFrame:
    """``aligned`` without its lists, with n_best and count_sum.

    A pair's count is the number of documents that hold it linked; n_best are the links whose pair has the highest
    count of its A id, count_sum sums the counts over all links. The ``sent`` pairs of most documents are looked up
    where the documents lie; all others are joined by a shuffle.
    """
    a = stage(aligned(docs, **kw).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    n = stage(a.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    top = n.groupBy("a").agg(F.max("n").alias("top"))
    table = stage(n.join(small(stage(top, "pair-tops")), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pair-table")
    total = table.count()
    least = 0
    if total > sent:
        # the smallest count that at most ``sent`` pairs exceed
        by_count = table.groupBy("n").agg(F.count("*").alias("pairs")).orderBy(F.desc("n"))
        through = 0
        for r in by_count.toLocalIterator():
            through += r.pairs
            if through > sent:
                least = r.n
                break
    each = a.select("_row", F.explode(F.arrays_zip("pairs", "links")).alias("e")).select("_row", F.col("e.pairs").alias("pair"), F.col("e.links").alias("links"))
    sums = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum")]
    near = each.join(F.broadcast(table.where(F.col("n") > least)), "pair").groupBy("_row").agg(*sums)
    if least:
        rare = table.where(F.col("n") <= least)
        far = each.join(F.broadcast(table.where(F.col("n") > least).select("pair")), "pair", "left_anti").join(rare.hint("merge"), "pair").groupBy("_row").agg(*sums)
        near = near.unionByName(far).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return a.drop("pairs", "links").join(near, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
