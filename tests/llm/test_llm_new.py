"""Vectors, token alignment and phrases against plain code, and on odd rows."""

import bisect
import hashlib
import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from claimweave.llm import alignment, phrases, vectors
from claimweave.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


# vectors


def near_vectors(rng, n, dim, groups):
    x = rng.standard_normal((n, dim))
    for g in range(groups):  # around the threshold, from 0.90 on
        a, b = x[2 * g] / np.linalg.norm(x[2 * g]), rng.standard_normal(dim)
        b -= (b @ a) * a
        c = 0.90 + 0.1 * g / groups
        x[2 * g + 1] = 3 * (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b))
    return x


def test_recall_of_links_near_the_threshold(spark):
    rng = np.random.default_rng(5)
    x = near_vectors(rng, 3000, 32, 900)
    rows = [(i, [float(v) for v in x[i]], i % 2 if i >= 1800 else (i // 2) % 2) for i in range(len(x))]
    got = {r._c_id: r for r in vectors.linked(spark.createDataFrame(rows, "id int, v array<double>, lab int"), ["id"], "id", "v", "lab").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    degree = near.sum(axis=1)
    assert degree.sum() > 1000
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= degree).all() and found.sum() >= 0.99 * degree.sum()


def test_vectors_in_a_dense_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 64)  # several parts a list
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    x = centre + 0.12 * rng.standard_normal((400, 16))
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(400)] + [(1000 + i, [float(v) for v in x[0]], 1) for i in range(150)]
    got = {r._c_id: r for r in vectors.linked(spark.createDataFrame(rows, "id int, v array<double>, lab int"), ["id"], "id", "v", "lab").collect()}
    y = np.array([r[1] for r in rows])
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    assert [got[r[0]].n_links for r in rows] == near.sum(axis=1).tolist()
    assert {r.component_id for r in got.values()} == {0}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, 9), (2, [2.0, 0.0], 1, 9), (3, [1.0, 0.0], 2, 9), (4, [1.0, 0.0], None, 9), (5, None, 1, 9), (6, [0.0, 0.0], 1, 9), (7, [nan, 1.0], 1, 9), (8, [1.0, None], 1, 9),
        (9, [inf, 1.0], 1, 9), (10, [], 1, 9), (11, [1.0, 0.0, 0.0], 1, 9), (None, [1.0, 0.0], 1, 9), (2, [2.0, 0.0], 1, 9), (12, [1e-200, 0.0], 1, 9), (13, [1e200, 1e190], 1, 9), (None, None, None, None), (14, [-1.0, 0.0], 1, 9),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    out = vectors.linked(df, ["vec_id", "n_links"])
    assert out.columns == ["_c_vec_id", "_c_n_links", "n_links", "component_id", "kept"]
    got = Counter((r._c_vec_id, r.n_links, r.component_id, r.kept) for r in out.collect())
    linked = 5  # of the six vectors along (1, 0) with label 1
    want = [(1, linked, 1, True), (2, linked, 1, False), (2, linked, 1, False), (12, linked, 1, False), (13, linked, 1, False), (None, linked, 1, False), (None, 0, None, True)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 14)]
    assert got == Counter(want)
    assert vectors.linked(df.limit(0), ["vec_id"]).count() == 0


# token alignment


@pytest.fixture(scope="module")
def tools():
    return alignment.tokenizers(alignment.TOKENIZERS)


def plain_alignment(text, a, b):
    none = (0, 0, 0, 0, "", {})
    if not text:
        return none
    x, y = a.exact.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)
    if any(b"".join(side.bytes_of[i] for i in ids) != (" " + text).encode() for side, ids in ((a, x), (b, y))):
        return none
    ea, eb = (list(itertools.accumulate(len(side.bytes_of[i]) for i in ids)) for side, ids in ((a, x), (b, y)))
    cuts = sorted(set(ea) & set(eb))
    groups = [([], []) for _ in cuts]
    for k, (ids, ends) in enumerate(((x, ea), (y, eb))):
        for i, e in zip(ids, ends, strict=True):
            groups[bisect.bisect_left(cuts, e)][k].append(i)
    links = Counter((i, j) for p, q in groups for i in p for j in q)
    text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
    return len(x), len(y), len(groups), sum(links.values()), hashlib.sha256(text.encode()).hexdigest(), links


def odd_texts():
    rnd = random.Random(1)
    parts = [" ", " ", "  ", "a", "bc", "é", "ß", "\n", " ", "日", "😀", " ", "1", ".", "'s", "▁", "\x85", "Ж", "́", "\x1c"]
    return ["", " ", "a", "<|endoftext|> <s> x</s>", " lead", "trail ", "日本語 テキスト", "a" * 9000, "= " * 10 + "=" * 3000, "\t\n\r\n x", "ab c" * 2000, "a\x00b", "it's ok don't"] + ["".join(rnd.choice(parts) for _ in range(40)) for _ in range(300)]


def test_alignment_equals_plain_code(tools):
    texts = odd_texts() + duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null").df()["text"].tolist()
    r = alignment.Aligner(*tools).batch([t.encode() for t in texts])
    for k, t in enumerate(texts):
        *want, links = plain_alignment(t, *tools)
        assert [r[c][k] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")] == want, t[:80]
        lo, hi = r["ends"][k], r["ends"][k + 1]
        assert {(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(r["pairs"][lo:hi].tolist(), r["links"][lo:hi].tolist(), strict=True)} == links


def test_fast_encoder_equals_the_file(tools):
    rnd = random.Random(2)
    pool = [chr(c) for c in range(1, 0x250)]
    for _ in range(1500):
        t = "".join(rnd.choice(pool if rnd.random() < 0.5 else [" ", "  ", "\n", "a", "b", "'s", "'S", "1"]) for _ in range(30))
        assert tools[0].fast.encode_ordinary(t) == tools[0].exact.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("sent", [0, 40, 10**6])
def test_pair_counts_equal_plain_code(spark, tools, sent):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id limit 60").fetchall() + [(None, "x y"), (7, None), (7, ""), (7, "x y"), (7, "x y")]
    out = alignment.counted(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_a int"), sent=sent)
    plain = [(d, plain_alignment(t, *tools)) for d, t in rows]
    n = Counter(p for _, w in plain for p in w[5])
    top = {}
    for (a, _), c in n.items():
        top[a] = max(top.get(a, 0), c)
    want = Counter((d, *w[:4], sum(k for p, k in w[5].items() if n[p] == top[p[0]]), sum(k * n[p] for p, k in w[5].items()), w[4]) for d, w in plain)
    assert Counter(tuple(r) for r in out.collect()) == want
    assert alignment.counted(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# phrases


def test_phrases_equal_their_sql_on_odd_rows(spark, monkeypatch):
    rnd = random.Random(9)
    words = ["der", "Der", "hund", "é", "x", "y", "zzz", "a b"]
    rows = [(i, "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", ", ", "\n", "\t", ". ", "\x0b"]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "en", "de", None])) for i in range(90)]
    rows += [(None, None, None), (1, "", "en"), (2, " .,;\n", "fr"), (3, "der hund " * 400, "de"), (4, "der hund bellt", "de")] * 2
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, phrase string")
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    want = sorted(con.execute(SQL["op13_stripes"]).fetchall())
    names = [d[0] for d in con.description]
    assert len(want) > 20
    for occurrences in (1_000_000, 20):  # the second: stripes of frequent prefixes in parts
        monkeypatch.setattr(phrases, "PART_OCCURRENCES", occurrences)
        out = phrases.collocations(df)
        assert sorted(tuple(r[c] for c in names) for r in out.collect()) == want
    assert phrases.collocations(df.limit(0)).count() == 0


def test_stripes_over_many_chunks(monkeypatch):
    """Texts cut into chunks, chunks into runs of places, groups over several merges: the counts stay."""
    rnd = random.Random(10)
    texts = ["".join(rnd.choice("ab") + rnd.choice([" ", " ", " ", ". "]) for _ in range(rnd.randint(0, 50))) for _ in range(60)]
    rows = pa.RecordBatch.from_pydict({"text": texts, "lang": [rnd.choice(["en", "de"]) for _ in texts]})
    want = Counter()
    for t, lang in zip(texts, rows.column("lang").to_pylist(), strict=True):
        for piece in t.split("."):
            w = piece.split()
            want.update((lang, f"{x} {y}", z) for x, y, z in zip(w, w[1:], w[2:]))
    every = np.full(1, 2**64 - 1, np.uint64)
    for sizes in ((10**6, 10**6, 10**6), (7, 50, 5), (3, 10**6, 1)):
        for name, value in zip(("CHUNK_WORDS", "CHUNK_BYTES", "MERGE_ELEMENTS"), sizes, strict=True):
            monkeypatch.setattr(phrases, name, value)
        heavy = {"en": ([b"a", b"b"], [3, 2])}
        parts = pa.Table.from_batches(list(phrases._stripes(2, every, heavy)(iter([rows.slice(0, 20), rows.slice(20)]))))
        parts = parts.sort_by([(c, "ascending") for c in ("lang", "prefix", "part")])
        got = Counter()
        for m in phrases._merge(1)(iter(parts.to_batches(max_chunksize=3))):
            for r in m.to_pylist():
                assert r["total"] == sum(r["n"])
                for w, n in zip(r["next"], r["n"], strict=True):
                    assert (r["lang"], f"{r['prefix'].decode()}", w.decode()) not in got
                    got[r["lang"], r["prefix"].decode(), w.decode()] = n
        assert got == want


def test_longer_phrases_and_shared_bits(spark):
    # with 64 bits all phrases share them: more is counted, nothing else changes
    df = spark.createDataFrame([("a b c d e " * 6, "en"), ("b c d x", "en")], "text string, lang string")
    got = {r.phrase: (r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, max_words=4, least=5, n_bits=64).collect()}
    n = 34
    # "b c d" (7) holds "b c" and "c d" (7 each); "a b c d" (6) holds it with 600 >= 50 * 7
    assert got == {p: (a, l, r, n, 10**6 * a * a // (l * r)) for p, a, l, r in [("a b c d", 6, 6, 7), ("b c d e", 6, 7, 6), ("c d e a", 5, 6, 6), ("d e a b", 5, 6, 6), ("e a b c", 5, 6, 6)]}


def test_new_queries_run_on_the_tables(spark):
    for name, n in (("op11_pivots", "embeddings"), ("op12_lockstep", "documents")):
        assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{n}.parquet").count()
