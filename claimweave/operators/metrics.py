"""Evaluation of scores against labels: counts per score group first, metrics from the groups."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.hashing import fine_draw, hash_bucket, seeded_md5
from claimweave.functions.maths import f1_of, poisson_quantile
from claimweave.operators.ranking import running_totals
from claimweave.session import stage


def score_groups(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Positives and negatives per distinct score: the only pass over the items."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum((1 - F.col(label)).cast("bigint")).alias("neg")
    )


def confusion(df: DataFrame, by: list[str], pred: Column, label: str = "label") -> DataFrame:
    y = F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(y & pred).alias("tp"), F.count_if(~y & pred).alias("fp"),
        F.count_if(y & ~pred).alias("fn"), F.count_if(~y & ~pred).alias("tn"),
    )


def rates(c: DataFrame, digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and false-positive rate of confusion counts (0 where undefined)."""
    div = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), digits)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns(
        {
            "precision": div(tp, tp + fp),
            "recall": div(tp, tp + fn),
            "f1": F.round(f1_of(tp, fp, fn), digits),
            "fpr": div(fp, fp + tn),
        }
    )


def curve(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Score groups with totals above and through each score.

    The groups are written once: they are few, and the totals below read them several times.
    """
    groups = stage(score_groups(df, by, score, label), "score-groups")
    g = running_totals(groups, by, "score", ["pos", "neg"])
    if not by:
        n = groups.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
        return g.withColumns({"n_pos": n.select("p").scalar(), "n_neg": n.select("n").scalar()})
    return g.join(groups.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")), by)


def auc_ap(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """ROC-AUC and average precision; tied scores form one threshold. Null with a single class."""
    c = curve(df, by, score, label)
    above = F.col("cum_pos") - F.col("pos")
    auc = F.sum(F.col("neg") * (above + F.col("pos") / 2))
    ap = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    out = c.groupBy(*by).agg(auc.alias("_u"), ap.alias("_a"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select(
        *by, "n_pos", "n_neg",
        F.when(both, F.round(F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg")), 6)).alias("auc"),
        F.when(both, F.round(F.col("_a") / F.col("n_pos"), 6)).alias("ap"),
    )


def best_threshold(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Threshold with the best F1 (lowest such threshold on ties), predicting positive at score ≥ threshold."""
    c = curve(df, by, score, label)
    f1 = F.round(f1_of(F.col("cum_pos").cast("double"), F.col("cum_neg"), F.col("n_pos") - F.col("cum_pos")), 9)
    best = F.max_by(F.struct(F.col("score").alias("threshold"), f1.alias("f1")), F.struct(f1, -F.col("score"))).alias("b")
    out = c.groupBy(*by).agg(best) if by else c.agg(best)
    return out.select(*by, "b.threshold", F.round("b.f1", 6).alias("f1"))


def precision_target(df: DataFrame, by: list[str], target: float, score: str = "score", label: str = "label") -> DataFrame:
    """Threshold with the best recall among those reaching the target precision."""
    c = curve(df, by, score, label)
    ok = c.where(F.col("cum_pos") >= target * (F.col("cum_pos") + F.col("cum_neg")))
    best = F.max_by(F.struct("score", "cum_pos", "cum_neg", "n_pos"), F.struct("cum_pos", "score")).alias("b")
    out = ok.groupBy(*by).agg(best) if by else ok.agg(best)
    return out.select(
        *by, F.col("b.score").alias("threshold"), F.round(F.col("b.cum_pos") / (F.col("b.cum_pos") + F.col("b.cum_neg")), 6).alias("precision"),
        F.round(F.col("b.cum_pos") / F.col("b.n_pos"), 6).alias("recall"),
    )


def cum_at_grid(df: DataFrame, by: list[str], grid: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """Confusion counts at each grid threshold, in one pass: a row counts for all thresholds up to its score."""
    g = score_groups(df, by, score, label)
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col("score") >= t).alias("hit")) for t in grid])
    e = g.select(*by, "pos", "neg", F.inline(cells))
    hit = F.col("hit")
    z = F.lit(0)
    return e.groupBy(*by, "threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(z)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(z)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(z)).alias("fn"), F.sum(F.when(~hit, F.col("neg")).otherwise(z)).alias("tn"),
    )


def lower_tail(n: int, k: int) -> float:
    """P(X <= k) of a fair binomial with k <= n / 2: summed from k down until the terms vanish."""
    if n > 10**6 and k > 1000:  # differences of log-gammas lose digits there
        d = (n - 2 * k) / n
        apart = ((1 - d) * math.log1p(-d) + (1 + d) * math.log1p(d)) / 2
        log = -n * apart - 0.5 * math.log(2 * math.pi * k * (n - k) / n) + (1 / n - 1 / k - 1 / (n - k)) / 12
    else:
        log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    term = math.exp(log)
    total, i = term, k
    while i > 0 and term > 1e-18 * total:
        term *= i / (n - i + 1)
        total += term
        i -= 1
    return total


def mcnemar(counts: DataFrame) -> DataFrame:
    """χ² (continuity-corrected) and exact binomial p for rows with discordant counts ``n01`` and ``n10``.

    Runs on one row per comparison, after the items have been counted.
    """

    def tests(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                n, k = int(r.n01 + r.n10), int(min(r.n01, r.n10))
                chi2 = (abs(r.n01 - r.n10) - 1) ** 2 / n if n else 0.0
                p_chi = math.erfc(math.sqrt(chi2 / 2)) if n else 1.0
                p_exact = min(1.0, 2 * lower_tail(n, k)) if n else 1.0
                rows.append((*r, chi2, p_chi, p_exact))
            yield pd.DataFrame(rows, columns=[*pdf.columns, "chi2", "p_chi2", "p_exact"])

    schema = ", ".join(f"{c} {t}" for c, t in counts.dtypes) + ", chi2 double, p_chi2 double, p_exact double"
    return counts.mapInPandas(tests, schema)


def bootstrap_cells(df: DataFrame, by: list[str], unit: Column | None, pred: Column, reps: int, seed: str, label: str = "label") -> DataFrame:
    """F1 per replicate of a bootstrap over items, or over whole ``unit``s (clusters) where given.

    Items of one outcome are alike for the statistic, and the sum of n independent Poisson(1) weights is one Poisson(n)
    draw; so a replicate draws a count for each of the four outcomes, and its cost does not grow with the items.
    Clusters draw a weight each. Replicates with one class only are dropped.
    """
    y = F.col(label) == 1
    outcome = {"tp": y & pred, "fp": ~y & pred, "fn": y & ~pred, "tn": ~y & ~pred}
    every = F.sequence(F.lit(1), F.lit(reps))
    if unit is None:
        name = F.when(outcome["tp"], "tp").when(outcome["fp"], "fp").when(outcome["fn"], "fn").otherwise("tn")
        cells = df.groupBy(*by, name.alias("_u")).agg(F.count("*").alias("_n")).withColumn("rep", F.explode(every))
        drawn = cells.withColumn("_w", poisson_quantile(F.col("_n").cast("double"), fine_draw(seeded_md5(seed, *by, "_u", "rep"))))
        sums = [F.sum(F.when(F.col("_u") == c, F.col("_w")).otherwise(0)).alias(c) for c in outcome]
    else:
        cells = df.withColumn("_u", unit).groupBy(*by, "_u").agg(*[F.count_if(v).alias(c) for c, v in outcome.items()]).withColumn("rep", F.explode(every))
        drawn = cells.withColumn("_w", poisson_quantile(F.lit(1.0), fine_draw(seeded_md5(seed, "_u", "rep"))))
        sums = [F.sum(F.col(c) * F.col("_w")).alias(c) for c in outcome]
    kept = drawn.groupBy(*by, "rep").agg(*sums).where((F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0))
    return kept.select(*by, "rep", f1_of(F.col("tp").cast("double"), F.col("fp"), F.col("fn")).alias("f1"))


def paired_bootstrap(df: DataFrame, by: list[str], pred_a: Column, pred_b: Column, reps: int, seed: str, label: str = "label") -> DataFrame:
    """F1 of two models and their difference per replicate, both on the same resampled items.

    As ``bootstrap_cells``, over the eight joint outcomes of label and both predictions.
    """
    cell = F.concat(F.col(label).cast("string"), pred_a.cast("int").cast("string"), pred_b.cast("int").cast("string"))
    cells = df.groupBy(*by, cell.alias("_u")).agg(F.count("*").alias("_n")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    drawn = cells.withColumn("_w", poisson_quantile(F.col("_n").cast("double"), fine_draw(seeded_md5(seed, *by, "_u", "rep"))))
    total = lambda *names: F.sum(F.when(F.col("_u").isin(*names), F.col("_w")).otherwise(0)).cast("double")
    s = drawn.groupBy(*by, "rep").agg(
        total("110", "111").alias("tp_a"), total("010", "011").alias("fp_a"), total("100", "101").alias("fn_a"),
        total("101", "111").alias("tp_b"), total("001", "011").alias("fp_b"), total("100", "110").alias("fn_b"), total("000", "001", "010", "011").alias("neg"),
    )
    kept = s.where((F.col("tp_a") + F.col("fn_a") > 0) & (F.col("neg") > 0))
    f1 = lambda m: f1_of(F.col(f"tp_{m}"), F.col(f"fp_{m}"), F.col(f"fn_{m}"))
    return kept.select(*by, "rep", f1("a").alias("f1_a"), f1("b").alias("f1_b")).withColumn("delta", F.col("f1_a") - F.col("f1_b"))


def delta_interval(reps: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Mean, percentile interval and share of positive values of ``delta``."""
    g = reps.groupBy(*by) if by else reps.groupBy()
    return g.agg(
        F.count("*").alias("n_reps"), F.round(F.avg("delta"), 6).alias("delta_mean"), F.round(F.percentile("delta", alpha / 2), 6).alias("lo"),
        F.round(F.percentile("delta", 1 - alpha / 2), 6).alias("hi"), F.round(F.avg((F.col("delta") > 0).cast("double")), 6).alias("share_positive"),
    )


def percentile_interval(reps: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    lo, hi = F.percentile(value, alpha / 2), F.percentile(value, 1 - alpha / 2)
    g = reps.groupBy(*by) if by else reps.groupBy()
    return g.agg(F.count("*").alias("n_reps"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def hash_unit(key: list[str], units: int, seed: str) -> Column:
    """Random resampling unit of an item: one of ``units`` groups."""
    return hash_bucket(seeded_md5(seed, *key), 6) % units


def topk_expected(df: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Per score group: rows above, expected true positives above, and the positive rate inside.

    For any k inside a group, TP(k) = tp_before + rate · (k − k_before): the whole curve in one row per
    distinct score instead of one per item.
    """
    c = curve(df, by, score, label)
    n = F.col("pos") + F.col("neg")
    return c.select(
        *by, "score", (F.col("cum_pos") + F.col("cum_neg") - n).alias("k_before"), n.alias("n_tied"),
        (F.col("cum_pos") - F.col("pos")).alias("tp_before"), F.round(F.col("pos") / n, 6).alias("rate"), "n_pos",
    )


def islands(df: DataFrame, by: list[str], order: str, flag: str, value: str) -> DataFrame:
    """Contiguous runs (in ``order``) where ``flag`` holds, with extent and min/max of ``value``."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.when(F.lag(flag).over(w) == F.col(flag), 0).otherwise(1)
    runs = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.where(F.col(flag)).groupBy(*by, "run")
        .agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.min(value).alias("low"), F.max(value).alias("high"))
        .drop("run")
    )


def held_out_blocks(df: DataFrame, block: str, models: list[str], label: str = "label") -> DataFrame:
    """Per block: the model and threshold that are best on all other blocks, and their F1 there and on the block.

    Items are counted once per (block, model, score). The counts of the others are those of all minus the block's, so
    every block is left out from the same table. Of equal F1 the lower threshold and the first model win.
    """
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models]))
    long = df.select(F.col(block).alias("held"), F.col(label).alias("label"), each)
    g = stage(score_groups(long, ["held", "model"]), "block-scores")
    total = g.groupBy("model", "score").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    grid = total.join(g.select("held", "model").distinct(), "model").join(g, ["held", "model", "score"], "left")
    rest = grid.select("held", "model", "score", (F.col("all_pos") - F.coalesce("pos", F.lit(0))).alias("pos"), (F.col("all_neg") - F.coalesce("neg", F.lit(0))).alias("neg"))
    rest = stage(rest.where("pos + neg > 0"), "block-rest")
    c = running_totals(rest, ["held", "model"], "score", ["pos", "neg"]).join(rest.groupBy("held", "model").agg(F.sum("pos").alias("np")), ["held", "model"])
    f1 = F.round(f1_of(F.col("cum_pos").cast("double"), F.col("cum_neg"), F.col("np") - F.col("cum_pos")), 9)
    best = c.groupBy("held", "model").agg(F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("low"))).alias("b"))
    chosen = best.groupBy("held").agg(F.min(F.struct((-F.col("b.f1")).alias("f1"), "model", (-F.col("b.low")).alias("threshold"))).alias("c")).select("held", "c.model", "c.threshold", (-F.col("c.f1")).alias("rest_f1"))
    hit = F.col("score") >= F.col("threshold")
    add = lambda cond, v: F.sum(F.when(cond, F.col(v)).otherwise(0)).cast("double")
    own = g.join(chosen, ["held", "model"]).groupBy("held", "model", "threshold", "rest_f1").agg(F.round(f1_of(add(hit, "pos"), add(hit, "neg"), add(~hit, "pos")), 6).alias("f1"))
    return own.select(F.col("held").alias(block), "model", "threshold", F.round("rest_f1", 6).alias("rest_f1"), "f1")
