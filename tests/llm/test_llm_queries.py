"""The registered queries of the training-data operators against their SQL, and against plain code where SQL has no words."""

import collections

import duckdb
import pytest

import corpus_pipeline
from claimweave.llm.near_dups import _bag, similarity
from claimweave.llm.queries import QUERIES, SQL
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.execute("select doc_id, text from documents").fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_values(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def plain_classes(docs, threshold=0.8):
    bags = {d: _bag(t) for d, t in docs.items() if t and t.split()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            low, high = sorted((sum(bags[a].values()), sum(bags[b].values())))
            if low >= threshold * high and similarity(bags[a], bags[b]) >= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


def test_near_duplicates_equal_all_pairs(spark, docs):
    got = {r.doc_id: r.class_id for r in QUERIES["op3_bag_minhash"](spark, SF).collect()}
    assert got == plain_classes(docs)


def plain_words(t):
    return "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in t or "").split()


def plain_alignment(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            new[j] = max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1)
            best = max(best, new[j])
        row = new
    return best


def test_leaks_equal_alignment_of_every_sharing_pair(spark, con, docs):
    items = dict(con.execute("select item_id, text from benchmark").fetchall())
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_leaks"](spark, SF).collect()}
    assert {(d, i) for d, t in docs.items() for i, x in items.items() if x in t} <= got
    grams = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, plain_words(x)) for i, x in items.items())}
    want = set()
    for d, t in docs.items():
        w = plain_words(t)
        mine = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        for i, g in grams.items():
            if len(g & mine) >= 0.2 * len(g) and plain_alignment(plain_words(items[i]), w) >= 0.5 * 2 * len(plain_words(items[i])):
                want.add((d, i))
    assert got == want


def test_shards_are_gapless_and_even(spark, docs):
    rows = QUERIES["op6_matrix_shuffle"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.size == len(docs[r.doc_id].encode()) + 1 and r.law == "rows"
    assert sorted(by) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_url_verdicts(spark, con):
    rows = QUERIES["op7_url_trees"](spark, SF).collect()
    urls = dict(con.execute("select page_id, url from pages").fetchall())
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for r in rows:
        after = urls[r.page_id].split("://", 1)[1]
        host = after.split("/")[0].split("?")[0].split("#")[0]
        path = after[len(host) :].split("?")[0].split("#")[0]
        fits = [k for k in rules if (h := k.split("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(k[len(h) :])]
        assert (r.host, r.path, r.rule) == (host, path, max(fits, key=len, default=None))
        assert r.verdict == rules[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert {r.verdict for r in rows if r.rule is None} == {"allow", "block"}


def test_pipeline_equals_its_stages_by_brute_force(spark, con, docs):
    """Rows of run(): what base rules, classes and leaks leave, as often as the mixing SQL takes it, dealt evenly."""
    kept = {r.doc_id for r in QUERIES["op2_host_quality"](spark, SF).where("kept").collect()}
    cls = plain_classes({d: docs[d] for d in kept})
    kept = {d for d in kept if cls[d] == d}
    leaky = {r.doc_id for r in QUERIES["op10_leaks"](spark, SF).collect()}
    kept -= leaky
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet' where doc_id in ({','.join(map(str, kept))})")
    times = {d: taken // size for d, size, _, _, taken in c.execute(SQL["op9_threshold_mix"]).fetchall()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter({d: n for d, n in times.items() if n})
    assert all(r.text == docs[r.doc_id] for r in rows)
    n = collections.Counter(r.shard for r in rows)
    assert max(n.values()) - min(n.values()) <= 1
