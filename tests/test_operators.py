"""Operators against brute force on small fixtures, invariants, skew and partition independence."""

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from claimweave.operators import graph as G
from claimweave.operators import joins as J
from claimweave.operators import leakage as L
from claimweave.operators import matching as MT
from claimweave.operators import metrics as ME
from claimweave.operators import ranking as RK
from claimweave.operators import rerank as RR
from claimweave.operators import sampling as S
from claimweave.operators import taxonomy as TX
from claimweave.operators.corpus import keep_first, keep_last
from claimweave.session import broadcast_if_small, stage


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_keep_first_is_idempotent_under_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, seq int")
    once = keep_first(df, ["k"], ["seq"])
    want = {}
    for k, s in rows:
        want[k] = min(s, want.get(k, s))
    assert {r.k: r.seq for r in once.collect()} == want
    assert sorted(keep_first(once, ["k"], ["seq"]).collect()) == sorted(once.collect())
    assert keep_last(df, ["k"], ["seq"]).where("k = 'hot'").first().seq == max(s for k, s in rows if k == "hot")


def test_hash_rank_is_a_permutation_per_stratum(spark):
    rows = [("hot" if i % 3 else "cold", i) for i in range(2000)]
    got = RK.hash_rank(spark.createDataFrame(rows, "g string, i int"), ["g"], ["i"], "s").collect()
    for g in ("hot", "cold"):
        ids = sorted((i for k, i in rows if k == g), key=lambda i: (md5(f"s|{i}"), i))
        assert {r.i: r.rk for r in got if r.g == g} == {i: n + 1 for n, i in enumerate(ids)}


def test_running_totals(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), s / 997, rnd.randint(0, 5)) for s in rnd.sample(range(998), 400)]
    got = RK.running_totals(spark.createDataFrame(rows, "g string, s double, n long"), ["g"], "s", ["n"], buckets=16).collect()
    for r in got:
        assert r.cum_n == sum(n for g, s, n in rows if g == r.g and s >= r.s)


def test_grouped_median(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("abc"), round(rnd.gauss(0, 100), 2)) for _ in range(1001)] + [("one", 5.0), ("two", 1.0), ("two", 2.0)]
    got = {r.g: r.median for r in RK.grouped_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 8).collect()}
    assert got == pytest.approx({g: statistics.median(v for k, v in rows if k == g) for g in {k for k, _ in rows}})


def scored_rows(n=400):
    rnd = random.Random(3)
    return [(f"i{i}", int(rnd.random() < 0.4), round(rnd.random(), 2), rnd.choice("xy")) for i in range(n)]


SCHEMA = "item_id string, label int, score double, source string"


def test_auc_ap_and_threshold(spark):
    rows = scored_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = ME.auc_ap(df, []).first()
    pos, neg = [s for _, y, s, _ in rows if y], [s for _, y, s, _ in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for t in sorted({r[2] for r in rows}, reverse=True):
        tp = sum(p >= t for p in pos)
        ap += (tp - seen) / len(pos) * tp / (tp + sum(n >= t for n in neg))
        seen = tp
    assert (got.auc, got.ap) == (pytest.approx(auc, abs=1e-6), pytest.approx(ap, abs=1e-6))
    f1 = lambda t: 2 * sum(p >= t for p in pos) / (len(pos) + sum(r[2] >= t for r in rows))
    best = ME.best_threshold(df, []).first()
    assert best.f1 == pytest.approx(max(f1(r[2]) for r in rows), abs=1e-6)


def test_topk_curve_shares_ties(spark):
    rows = [("a", 1, 0.9, "x"), ("b", 0, 0.9, "x"), ("c", 1, 0.5, "x")]
    got = sorted((r.k_before, r.n_tied, r.tp_before, r.rate) for r in ME.topk_expected(spark.createDataFrame(rows, SCHEMA), []).collect())
    assert got == [(0, 2, 0, 0.5), (2, 1, 1, 1.0)]


def test_mcnemar(spark):
    got = ME.mcnemar(spark.createDataFrame([("a", 3, 9), ("b", 0, 0), ("c", 5, 5)], "k string, n01 long, n10 long")).collect()
    exact = 2 * sum(math.comb(12, i) for i in range(4)) / 2**12
    assert got[0].p_exact == pytest.approx(exact) and got[0].chi2 == pytest.approx(25 / 12)
    assert got[0].p_chi2 == pytest.approx(math.erfc(math.sqrt(25 / 12 / 2)))
    assert (got[1].p_exact, got[1].p_chi2, got[2].p_exact) == (1.0, 1.0, 1.0)


def test_bootstrap_brackets_the_estimate(spark):
    df = spark.createDataFrame(scored_rows(600), SCHEMA)
    reps = ME.bootstrap_cells(df, [], ME.hash_unit(["item_id"], 64, "u"), F.col("score") >= 0.5, 200, "b")
    ci = ME.percentile_interval(reps, [], "f1").first()
    f1 = ME.rates(ME.confusion(df, [], F.col("score") >= 0.5)).first().f1
    assert ci.n_reps == 200 and ci.lo < f1 < ci.hi


def test_islands(spark):
    rows = [("g", i, v, float(i)) for i, v in enumerate([True, True, False, True, False, False, True])]
    got = ME.islands(spark.createDataFrame(rows, "g string, k int, f boolean, x double"), ["g"], "k", "f", "x").collect()
    assert sorted((r.first, r.last, r.n) for r in got) == [(0, 1, 2), (3, 3, 1), (6, 6, 1)]


def test_components_match_union_find(spark):
    rnd = random.Random(4)
    edges = {tuple(rnd.sample(range(120), 2)) for _ in range(70)} | {(200, i) for i in range(201, 260)} | {(i, i + 1) for i in range(300, 340)}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = sorted({x for e in edges for x in e} | {999})
    got = G.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(list(edges), "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {n: find(n) for n in nodes}


def fold(spans):
    kept = []
    for s in sorted(spans):
        if not kept or s[0] >= kept[-1][0] + kept[-1][1]:
            kept.append(s)
        elif s[1] > kept[-1][1]:
            kept[-1] = s
    return kept


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "The red wood ant and the red ant of the wood"), (2, "ant"), (3, "none here")], "doc_id int, text string")
    names = spark.createDataFrame([("red wood ant",), ("wood ant",), ("ant",), ("red ant",), ("red",), ("ant and the",)], "name string")
    hits = MT.dictionary_hits(docs, ["doc_id"], "text", names, 3)
    all_hits = {}
    for r in hits.collect():
        all_hits.setdefault(r.doc_id, []).append((r.start, r.len, r.gram))
    want = {(d, *s) for d, spans in all_hits.items() for s in fold(spans)}
    got = {(r.doc_id, r.start, r.len, r.gram) for r in MT.resolve_overlaps(hits, ["doc_id"]).collect()}
    assert got == want and (1, 1, 3, "red wood ant") in got


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_fuzzy_candidates_are_exact(spark):
    rnd = random.Random(5)
    base = ["abies alba", "abies balsamea", "abiesaria pseudolongissima occidentalis", "abietinella abietina", "abinsular tetracanthoides macrophyllum"]

    def mutate(s, n):
        for _ in range(n):
            i = rnd.randrange(3, len(s))
            s = rnd.choice([s[:i] + s[i + 1 :], s[:i] + rnd.choice("abz") + s[i:], s[:i] + "q" + s[i + 1 :]])
        return s

    queries = sorted({mutate(b, n) for b in base for n in (0, 1, 2, 3, 4, 5) for _ in range(3)})
    names = spark.createDataFrame([(b, str(i), 0, b[:3]) for i, b in enumerate(base)], "name_norm string, id string, is_syn int, prefix3 string")
    got = {(r["query"], r.name_norm) for r in TX.fuzzy_candidates(spark.createDataFrame([(q,) for q in queries], "query string"), names).collect()}
    want = {(q, b) for q in queries for b in base if len(q) >= 8 and q[:3] == b[:3] and 1 - lev(q, b) / max(len(q), len(b)) >= 0.9 - 1e-9}
    assert got == want and any(len(q) > 30 for q, _ in want)


def test_resolve_cascade(spark):
    names = spark.createDataFrame(
        [("anopheles gambiae", "1", 0, "ano"), ("african mosquito", "1", 1, "afr"), ("aedes aegypti", "2", 0, "aed"), ("culex pipiens", "3", 0, "cul"), ("coquillettidia pipiens", "4", 0, "coq")],
        "name_norm string, id string, is_syn int, prefix3 string",
    )
    q = ["anopheles gambiae", "african mosquito", "a. gambiae", "c. pipiens", "aedes aegypty", "unknown thing"]
    got = {r["query"]: (r.id, r.match_type) for r in TX.resolve(spark.createDataFrame([(x,) for x in q], "query string"), names).collect()}
    assert got == {
        "anopheles gambiae": ("1", "exact"), "african mosquito": ("1", "synonym"), "a. gambiae": ("1", "abbrev"),
        "c. pipiens": (None, None), "aedes aegypty": ("2", "fuzzy"), "unknown thing": (None, None),
    }


def test_ancestry_of_a_deep_chain_and_a_cycle(spark):
    rows = [("k", None, "kingdom", "K")] + [(f"n{i}", "k" if i == 0 else f"n{i - 1}", "clade", f"N{i}") for i in range(39)] + [("x", "y", "clade", "X"), ("y", "x", "clade", "Y")]
    c = spark.createDataFrame(rows, "id string, parent string, rank string, pref string")
    got = {r.id: r.kingdom for r in TX.kingdom_ancestors(c).collect()}
    assert got["n38"] == "K" and got["k"] == "K" and len(got) == len(rows) and got["x"] is None and got["y"] is None
    lin = TX.lineage(c)
    assert lin.where("id = 'n38'").count() == 40 and lin.where("id = 'x'").count() == 2


def cosine_by_hand(test, train):
    def grams(t):
        out = {}
        for w in t.lower().split():
            p = f" {w} "
            for n in (3, 4, 5):
                cut = [p[:n]] if len(p) <= n else [p[i : i + n] for i in range(len(p) - n + 1)]
                for g in cut:
                    out[g] = out.get(g, 0) + 1
                if len(p) <= n:
                    break
        return out

    all_grams = [grams(t) for t in (*test, *train)]
    df = {}
    for g in all_grams:
        for k in g:
            df[k] = df.get(k, 0) + 1
    n = len(all_grams)

    def unit(g):
        v = {k: c * (math.log((1 + n) / (1 + df[k])) + 1) for k, c in g.items()}
        z = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / z for k, x in v.items()}

    units = [unit(g) for g in all_grams]
    return [[sum(x * u.get(k, 0) for k, x in t.items()) for u in units[len(test) :]] for t in units[: len(test)]]


def test_near_duplicates_are_exact(spark):
    base = "the small wasp lays its eggs into the larvae of the cabbage moth every spring"
    test = [base, "a beetle eats leaves", "unrelated words only"]
    train = [base + " again", base, base, "a beetle eats many leaves", "zebra", "the small wasp lays eggs"]
    t = spark.createDataFrame(list(enumerate(test)), "tid int, text string")
    d = spark.createDataFrame(list(enumerate(train)), "did int, text string")
    sims = cosine_by_hand(test, train)
    for limit in (0.85, 0.5):
        got = {(r.tid, r.did, r.similarity) for r in L.near_duplicates(t, d, "tid", "did", "text", limit).collect()}
        want = {(i, max(range(len(train)), key=lambda j: (round(row[j], 4), -j)), round(max(row), 4)) for i, row in enumerate(sims) if round(max(row), 4) > limit}
        assert {g[:2] for g in got} == {w[:2] for w in want}
        assert dict((g[0], g[2]) for g in got) == pytest.approx(dict((w[0], w[2]) for w in want), abs=1e-4)


def test_jaccard_with_many_copies(spark):
    text = "one two three four five six seven"
    t = spark.createDataFrame([(1, text), (2, "nothing shared at all in here")], "tid int, text string")
    d = spark.createDataFrame([(i, "one two three four five six EIGHT") for i in range(500)] + [(900, "short")], "did int, text string")
    got = {r.tid: r.max_jaccard for r in L.max_jaccard(t, d, "tid", "did", "text").collect()}
    assert got == {1: pytest.approx(2 / 4), 2: 0.0}


def test_either_orientation_prefers_the_stored_one(spark):
    table = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("d", "c", 3)], "a string, b string, v int")
    q = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("x", "y")], "a string, b string")
    got = {(r.a, r.b): r.v for r in J.lookup_either_way(q, table, "a", "b", ["v"]).collect()}
    assert got == {("a", "b"): 1, ("b", "a"): 2, ("c", "d"): 3, ("x", "y"): None}


def test_one_to_one_raises_on_duplicates(spark):
    left = spark.createDataFrame([(1, "a")], "k int, x string")
    right = spark.createDataFrame([(1, "b"), (1, "c")], "k int, y string")
    with pytest.raises(Exception, match="not unique"):
        J.join_one_to_one(left, right, ["k"]).collect()


def test_partner_support_against_pairs(spark):
    rnd = random.Random(6)
    det = sorted({(rnd.randrange(6), f"s{rnd.randrange(15)}") for _ in range(60)} | {(9, "s0")})
    edges = sorted({(min(p), max(p)) for p in (rnd.sample([f"s{i}" for i in range(15)], 2) for _ in range(40))} | {("s0", f"s{i}") for i in range(10, 15)})
    sc = {e: round(rnd.random(), 2) for e in edges}
    want = {}
    for s, x in det:
        mates = [y for t, y in det if t == s and y != x and (min(x, y), max(x, y)) in sc]
        if mates:
            want[(s, x)] = (len(mates), round(sum(sc[(min(x, y), max(x, y))] for y in mates), 6))
    got = RR.partner_support(spark.createDataFrame(det, "sample_id int, species string"), spark.createDataFrame([(*e, v) for e, v in sc.items()], "a string, b string, score double"))
    assert {(r.sample_id, r.species): (r.k, round(r.score_sum, 6)) for r in got.collect()} == want


def test_near_duplicates_shuffle_no_row_per_pair(spark):
    """Texts of one small vocabulary all share grams with all items; neither their pairs nor their grams are shuffled."""
    from claimweave.operators import leakage as L

    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefg") for _ in range(6)) for _ in range(40)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(20)) for _ in range(1200)]
    items = [(f"i{k}", texts[k * 7] + " " + vocabulary[k]) for k in range(40)]
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def shuffled():
        done, n = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None).iterator(), {}
        while done.hasNext():
            x = done.next()
            n[x.stageId()] = x.shuffleWriteRecords()
        return n

    before = shuffled()
    got = L.near_duplicates(spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "item_id", "doc_id", "text", 0.8)
    assert {(r.item_id, r.doc_id) for r in got.collect()} >= {(f"i{k}", k * 7) for k in range(40)}
    assert sum(v for k, v in shuffled().items() if k not in before) < 1200 * 40


def test_flat_entries_are_cut_as_they_are_parsed(spark):
    from claimweave.sources import readers as RD

    entries = [
        '<ref id="B1"><doi>10.5/A</doi><mixed>Some. Title here. X</mixed></ref>', '<ref id="B2"><mixed>plain &amp; more</mixed></ref>', "<ref id='B3'><doi>10.5/c</doi></ref>",
        '<ref n="1" id="B4"><label>4</label><mixed>a > b</mixed><mixed>c</mixed></ref>', '<ref id="B5"><mixed>one <i>two</i> three</mixed></ref>', '<ref id="B6"><x><doi>10.5/n</doi></x></ref>',
        "<ref><doi></doi></ref>", "<ref id=\"B8\"></ref>", '<ref id="B9"><mixed><![CDATA[<doi>1</doi>]]></mixed></ref>', '<ref rid="B0" id="B10"><doi>10.5/z</doi></ref>', '<ref id="B11"><mixed>' + "w " * 3000 + "</mixed></ref>",
    ]
    df = spark.createDataFrame([(e,) for e in entries], "entry string")
    df = df.withColumn("flat", (F.length("entry") < RD.FLAT_LENGTH) & F.col("entry").rlike(RD.FLAT_ENTRY))
    for name in ("@id", "doi", "mixed"):
        got = [tuple(r) for r in df.select(RD._entry_part(name), F.expr(f"nullif(xpath_string(entry, '/ref/{name}'), '')")).collect()]
        assert all(a == b for a, b in got), (name, got)
    assert [r.flat for r in df.collect()].count(True) == 5


def test_fuzzy_names_broadcast_no_forms(spark):
    """Thousands of ids of one name are one string for the search, and deletion forms never pass through the driver."""
    names = spark.range(3000).select(F.concat(F.lit("supplier#00"), (F.col("id") % 3).cast("string")).alias("name_norm"), F.col("id").cast("string").alias("id"), F.lit(0).alias("is_syn"), F.lit("sup").alias("prefix3"))
    q = spark.createDataFrame([("supplier#002x",), ("suplier#001",)], "query string")
    near = TX.near_names(q, names)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.count() == len({(r["query"], r.name_norm) for r in near.collect()}) <= 6
    assert {(r["query"], r.name_norm, r.id) for r in TX.best_fuzzy(q, names).collect()} == {("supplier#002x", "supplier#002", "1001"), ("suplier#001", "supplier#001", "1")}
    assert TX.fuzzy_candidates(q, names).count() >= 2000


def test_support_in_arrays_makes_no_row_per_pair(spark):
    """Few names: detections are dealt once, by sample, and joined with nothing but small tables; the same results as by wedges."""
    rnd = random.Random(8)
    det = sorted({(rnd.randrange(20), f"s{rnd.randrange(15)}") for _ in range(200)})
    edges = sorted({(min(p), max(p)) for p in (rnd.sample([f"s{i}" for i in range(12)], 2) for _ in range(40))})
    d = spark.createDataFrame(det, "sample_id int, species string")
    e = spark.createDataFrame([(*x, None if i % 3 else i / 64) for i, x in enumerate(edges)], "a string, b string, score double")
    arrays, wedges = RR.with_support(d, e), RR.with_support(d, e, listed=0)
    assert arrays.count() == len(det) and sorted(arrays.collect()) == sorted(wedges.collect())
    plan = arrays._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Generate explode(array(x" not in plan and "Aggregate [sample_id" not in plan


def test_entity_split_is_disjoint(spark):
    rnd = random.Random(7)
    df = spark.createDataFrame([(f"e{rnd.randrange(40)}", f"e{rnd.randrange(40)}") for _ in range(500)], "a string, b string")
    s = S.entity_split(df, "a", "b", "seed", 0.4).collect()
    ents = {k: {x for r in s if r.split == k for x in (r.a, r.b)} for k in ("train", "test")}
    assert ents["train"] and ents["test"] and not ents["train"] & ents["test"]


def test_resampling_keeps_the_marginal(spark):
    rows = [(i, "a" if i % 4 else "b") for i in range(4000)]
    out = S.resample_column(spark.createDataFrame(rows, "i int, v string"), "v", ["i"], "s", 0.5).collect()
    assert len(out) == 4000 and 0.45 < sum(r.resampled for r in out) / 4000 < 0.55
    assert 0.20 < sum(r.v == "b" for r in out) / 4000 < 0.30


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 101 / 100.0).alias("score"), (F.col("id") % 2).cast("int").alias("label"))
    seen = set()
    for n in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        d = df.repartition(n)
        a = tuple(sorted((r.g, r.auc) for r in ME.auc_ap(d, ["g"]).collect()))
        b = tuple(sorted(r.id for r in S.first_by_hash(d, ["g"], ["id"], F.lit(50), "s").collect()))
        seen.add((a, b))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(seen) == 1


def test_broadcast_only_when_small(spark):
    df = stage(spark.range(1000), "size")
    assert "broadcast" in broadcast_if_small(df)._jdf.queryExecution().toString()
    assert "strategy=broadcast" not in broadcast_if_small(df, limit=10)._jdf.queryExecution().toString()
