"""Polarity of alternatives, quality gates, thresholds of held-out blocks, exact tails."""

import math
import random

import pytest

from claimweave.operators import metrics as ME
from claimweave.operators import polarity as PO
from claimweave.plans.aggregates import gate_report

SURFACES = [("vector of", -1), ("hosts of", 1), ("odd link", 0), ("cleaner", 1)]


@pytest.mark.parametrize(
    "relation, concept, want",
    [
        ("infects", None, (1, "active_form")), ("something|Preying", -1, (1, "active_form")), ("eaten by", None, (-1, "patient_form")),
        ("something", -1, (-1, "concept")), ("something", 0, (0, "concept")), ("unheard of|Vector  of", None, (-1, "surface")), ("vectors of", None, (1, "agent_noun")), ("cleaners", None, (1, "surface")),
        ("host of", None, (-1, "patient_form")), ("odd link", None, (0, "surface_symmetric")), ("odd link|pathogen of", None, (0, "surface_symmetric")), ("|interacts with", None, (0, "symmetric_form")),
        ("predators of", None, (1, "agent_noun")), ("", None, (None, "none")), (" | ", None, (None, "none")), ("consumed by|x", 1, (1, "concept")),
    ],
)
def test_polarity_of_alternatives(spark, relation, concept, want):
    r = spark.createDataFrame([(relation, concept)], "relation string, concept_polarity int")
    got = PO.decided(r, spark.createDataFrame(SURFACES, "form string, polarity int")).collect()
    assert [(x.polarity, x.decided_by) for x in got] == [want]


def test_gates_of_type_coverage_and_signal(spark):
    def report(n_types, n_silent, n_loud):
        rows = [(1, f"t{i % n_types}", i < n_silent) for i in range(40)] + [(0, "none_two_species", i < n_loud) for i in range(60)]
        df = spark.createDataFrame([(y, t, False, False, False, False, y == 0, x and y == 1, x and y == 0) for y, t, x in rows], "label int, itype string, unknown boolean, violation boolean, defect boolean, false_neg boolean, hard boolean, silent boolean, loud boolean")
        return gate_report(df, [f"t{i}" for i in range(6)]).first()

    good = report(3, 8, 1)
    assert (good.missing_types, good.gate_5_types, good.silent_rate, good.gate_6_positives, good.loud_rate, good.gate_6_negatives) == ("t3,t4,t5", True, 0.2, True, pytest.approx(1 / 60, abs=1e-6), True)
    bad = report(2, 9, 2)
    assert (bad.missing_types, bad.gate_5_types, bad.gate_6_positives, bad.gate_6_negatives) == ("t2,t3,t4,t5", False, False, False)


def test_blocks_held_out_equal_plain_code(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(500):
        y = int(rnd.random() < 0.4)
        rows.append((rnd.choice("abc"), y, round(min(1.0, max(0.0, rnd.gauss(0.4 + 0.2 * y, 0.2))), 2), round(min(1.0, max(0.0, rnd.gauss(0.4 + 0.15 * y, 0.2))), 2)))

    def f1(part, m, t):
        tp = sum(r[1] and r[m] >= t for r in part)
        fp, fn = sum(not r[1] and r[m] >= t for r in part), sum(r[1] and r[m] < t for r in part)
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0

    want = {}
    for held in "abc":
        rest, own = [r for r in rows if r[0] != held], [r for r in rows if r[0] == held]
        score, m, t = min((-round(f1(rest, m, t), 9), m, t) for m in (2, 3) for t in {r[m] for r in rest})
        want[held] = ("m1" if m == 2 else "m2", t, round(-score, 6), round(f1(own, m, t), 6))
    got = ME.held_out_blocks(spark.createDataFrame(rows, "blk string, label int, m1 double, m2 double"), "blk", ["m1", "m2"]).collect()
    assert {r.blk: (r.model, r.threshold, r.rest_f1, r.f1) for r in got} == want


def test_exact_tail_of_large_counts():
    for n, k in ((12, 3), (40, 20), (7, 0)):
        assert ME.lower_tail(n, k) == pytest.approx(sum(math.comb(n, i) for i in range(k + 1)) / 2**n, rel=1e-12)
    # the normal limit: half of a standard deviation's tail
    n = 10**12
    assert ME.lower_tail(n, n // 2 - 10**6) == pytest.approx(0.5 * math.erfc(2 / math.sqrt(2)), rel=1e-3)
