"""Bootstrap counts and permutations against their definitions and plain code."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.functions import hashing as H
from claimweave.functions import maths as M
from claimweave.operators import metrics as ME
from claimweave.operators import rerank as RR


def test_normal_quantile(spark):
    us = [1e-9, 0.001, 0.02425, 0.3, 0.5, 0.77, 0.99, 1 - 1e-7]
    z = [r.z for r in spark.createDataFrame([(u,) for u in us], "u double").select(M.normal_quantile(F.col("u")).alias("z")).collect()]
    assert [0.5 * math.erfc(-x / math.sqrt(2)) for x in z] == pytest.approx(us, rel=1e-7)


@pytest.mark.parametrize("mean", [1, 4, 255, 256, 257, 1000, 40000])
def test_poisson_quantile_inverts_the_distribution(spark, mean):
    us = [(k + 0.5) / 400 for k in range(400)]
    got = [r.k for r in spark.createDataFrame([(u,) for u in us], "u double").select(M.poisson_quantile(F.lit(float(mean)), F.col("u")).alias("k")).collect()]
    top = int(mean + 12 * math.sqrt(mean) + 30)
    cdf = np.cumsum(np.exp([-mean + k * math.log(mean) - math.lgamma(k + 1) for k in range(top)]))
    want = np.searchsorted(cdf, us, "right")
    assert np.abs(np.array(got) - want).max() <= (0 if mean <= M.POISSON_SUMMED else 1) and (np.array(got) != want).mean() <= 0.01


def test_item_bootstrap_spreads_like_resampled_items(spark):
    rnd = random.Random(4)
    rows = [(i, int(rnd.random() < 0.4), round(rnd.random(), 3)) for i in range(400)]
    df = spark.createDataFrame([(i, y, min(1.0, s * 0.6 + 0.4 * y)) for i, y, s in rows], "item_id int, label int, score double")
    got = [r.f1 for r in ME.bootstrap_cells(df, [], None, F.col("score") >= 0.5, 600, "s").collect()]
    y, p = np.array([r[1] for r in rows]), np.array([min(1.0, r[2] * 0.6 + 0.4 * r[1]) >= 0.5 for r in rows])
    rng, want = np.random.default_rng(1), []
    for _ in range(2000):
        at = rng.integers(0, 400, 400)
        tp, fp, fn = (y[at] & p[at]).sum(), ((1 - y[at]) & p[at]).sum(), (y[at] & ~p[at]).sum()
        want.append(2 * tp / (2 * tp + fp + fn))
    assert np.mean(got) == pytest.approx(np.mean(want), abs=0.006) and np.std(got) == pytest.approx(np.std(want), rel=0.15)


def test_paired_bootstrap_shares_its_items(spark):
    df = spark.createDataFrame([(i % 2, (i % 7) / 7.0, (i % 5) / 5.0) for i in range(300)], "label int, a double, b double")
    same = ME.paired_bootstrap(df, [], F.col("a") >= 0.5, F.col("a") >= 0.5, 50, "s").collect()
    assert len(same) == 50 and all(r.delta == 0 for r in same)
    d = ME.delta_interval(ME.paired_bootstrap(df, [], F.col("label") == 1, F.col("b") >= 0.5, 200, "s"), []).first()
    assert d.share_positive == 1.0 and d.lo > 0
    one_class = df.where("label = 1")
    assert ME.paired_bootstrap(one_class, [], F.col("a") >= 0.5, F.col("b") >= 0.5, 20, "s").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 40, 1023])
def test_bijections(spark, n):
    one = [r.p for r in spark.range(n).select(H.permuted(F.col("id"), F.lit(n), "k").alias("p")).collect()]
    many = [r.p for r in spark.range(n).select(H.permuted_often(F.col("id"), F.lit(n), F.lit(5).cast("bigint"), 9).alias("p")).collect()]
    assert sorted(one) == list(range(n)) and all(sorted(c) == list(range(n)) for c in zip(*many, strict=True))


def test_permutation_test_equals_plain_code(spark):
    rnd = random.Random(11)
    rows = []
    for s in range(6):
        for k in range(rnd.randint(1, 12)):
            rows.append((f"s{s}", f"t{k}", rnd.randint(1, 40), round(rnd.random(), 3), rnd.random() < 0.4))
    rows += [("big", f"t{k}", rnd.randint(1, 400), round(rnd.random(), 3), k % 5 == 0) for k in range(150)]
    det = spark.createDataFrame([r[:3] for r in rows], "sample_id string, species string, reads long")
    coh = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "sample_id string, species string, coherence double")
    member = spark.createDataFrame([(r[0], r[1], r[4]) for r in rows], "sample_id string, species string, t boolean")
    ranked = RR.rerank(det, coh, 1.0).join(member, ["sample_id", "species"])
    got = RR.permutation_test(ranked, F.col("t"), 1.0, 40, "p").first()

    by = {}
    for r in ranked.collect():
        by.setdefault(r.sample_id, {})[r.original_rank - 1] = r
    sep = lambda ranks, t: np.mean([r for r, x in zip(ranks, t) if not x]) - np.mean([r for r, x in zip(ranks, t) if x])
    observed, null = [], [[] for _ in range(40)]
    for name, at in by.items():
        t = [at[i].t for i in range(len(at))]
        if all(t) or not any(t):
            continue
        n = len(t)
        before = sep(range(1, n + 1), t)
        observed.append(sep([at[i].new_rank for i in range(n)], t) - before)
        key = F.xxhash64(F.lit("p"), F.lit(name))
        moves = [r.m for r in spark.range(n).orderBy("id").select(H.permuted_often(F.col("id"), F.lit(n), key, 40).alias("m")).collect()]
        for rep in range(40):
            given = {moves[i][rep]: at[i].coherence for i in range(n)}
            order = sorted(range(n), key=lambda i: (-round(at[i].reads * (1 + given[i]), 4), i))
            rank = {i: k for k, i in enumerate(order, 1)}
            null[rep].append(sep([rank[i] for i in range(n)], t) - before)
    obs, stats = np.mean(observed), [np.mean(x) for x in null]
    assert got.observed == pytest.approx(obs, abs=1e-6) and got.null_mean == pytest.approx(np.mean(stats), abs=1e-6)
    assert got.p_value == pytest.approx((sum(x >= obs - 1e-9 for x in stats) + 1) / 41, abs=1e-6)


def test_permutation_in_tasks_equals_that_by_rows(spark):
    rnd = random.Random(12)
    rows = [(s, f"t{k:02}", rnd.randint(1, 9), rnd.randint(0, 64) / 32, rnd.random() < 0.4) for s in range(40) for k in range(rnd.randint(1, 12))]
    det = spark.createDataFrame(rows, "sample_id long, species string, reads long, coherence double, t boolean")
    ranked = RR.with_ranks(det, 1.0)
    t = F.col("t")
    arrays = RR.permutation_test(ranked, t, 1.0, 30, "q").first()
    assert arrays == RR.permutation_test(ranked, t, 1.0, 30, "q", listed=0).first() == RR.permutation_test(ranked, t, 1.0, 30, "q", listed=6).first()


def test_whole_permutations_are_those_of_rows(spark):
    for n in (1, 2, 7, 40):
        many = [r.p for r in spark.range(n).orderBy("id").select(H.permuted_often(F.col("id"), F.lit(n), F.lit(-5).cast("bigint"), 9).alias("p")).collect()]
        assert H.whole_permutations(np.array([-5]), n, 9)[0].T.tolist() == many
