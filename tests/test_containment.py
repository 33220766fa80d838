"""Containment joins and leakage measures against brute force."""

import random

import pytest

from claimweave.operators import containment as C
from claimweave.operators import graph as G
from claimweave.operators import leakage as L


def test_containment_equals_brute_force(spark):
    rnd = random.Random(3)
    word = lambda lo, hi: "".join(rnd.choice("ab é") for _ in range(rnd.randint(lo, hi)))
    inner, outer = [word(0, 5) for _ in range(120)], [word(0, 14) for _ in range(200)] + ["", None]
    got = C.contained_in(spark.createDataFrame([(x,) for x in inner], "x string"), spark.createDataFrame([(y,) for y in outer], "y string"))
    want = {(x, y) for x in inner for y in outer if x and y is not None and x in y}
    assert len(want) > 50 and {tuple(r) for r in got.collect()} == want
    assert C.contained_in(spark.createDataFrame([], "x string"), spark.createDataFrame([("a",)], "y string")).count() == 0


TERMS = [("pollinates", "pollinates", True, "RO_2"), ("preys on", "preys on", True, "RO_3"), ("eats", "eats", True, "RO_4"), ("overeats", "overeats", True, "RO_5")]


@pytest.mark.parametrize("key, predicate", [("pollinate", "pollinates"), ("ollinat", "pollinates"), ("it pollinatesit", "pollinates"), ("PREYS ON", "preys on"), ("xovereatsx", "overeats"), ("zzz", None)])
def test_partial_relation_terms(spark, key, predicate):
    raw = spark.createDataFrame([(1, "a", "ORGANISM", "Animalia", "b", "ORGANISM", "Plantae", key)], "id int, name_1 string, type_1 string, kingdom_1 string, name_2 string, type_2 string, kingdom_2 string, interaction_type string")
    r = G.infer_relations(raw, spark.createDataFrame(TERMS, "term string, predicate string, directed boolean, ro_id string")).first()
    assert (r.predicate, r.flag) == ((predicate, None) if predicate else (key, "unvalidated"))


def test_jaccard_equals_all_pairs(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 30))) for _ in range(25)]
    header = "all rights reserved by the makers of this page"
    test = [*base[:12], header + " " + base[3], header, "", None]
    train = [f"{header} {t} {rnd.choice(words)}" for t in base for _ in range(3)] + base[5:] * 2 + [header] * 40 + ["", None]

    def grams(t):
        w = "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    def best(t):
        s = grams(t)
        return max((len(s & grams(d)) / len(s | grams(d)) for d in train if d is not None), default=0.0)

    t, d = spark.createDataFrame(list(enumerate(test)), "tid int, text string"), spark.createDataFrame(list(enumerate(train)), "did int, text string")
    got = {r.tid: r.max_jaccard for r in L.max_jaccard(t, d, "tid", "did", "text").collect()}
    assert got == {i: pytest.approx(best(x) if x is not None else 0.0, abs=1e-6) for i, x in enumerate(test)}


def test_corpus_text_is_no_key(spark):
    d = spark.createDataFrame([(1, "a b c d e f g")], "did int, text string")
    t = spark.createDataFrame([(1, "a b c d e f g h")], "tid int, text string")
    plan = L.max_jaccard(t, d, "tid", "did", "text")._jdf.queryExecution().toString()
    assert "hashpartitioning(form" not in plan and "hashpartitioning(text" not in plan
