"""Evaluation statistics over scored items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.functions import maths as M
from claimweave.operators import metrics as ME
from claimweave.operators.corpus import ratio
from claimweave.plans.joins import MENTIONS, mentions
from claimweave.plans.registry import query
from claimweave.plans.tables import CLAIMS, SCORED, claims, load, scored

CONF = """count(*) FILTER (WHERE label = 1 AND hit) AS tp, count(*) FILTER (WHERE label = 0 AND hit) AS fp, count(*) FILTER (WHERE label = 1 AND NOT hit) AS fn, count(*) FILTER (WHERE label = 0 AND NOT hit) AS tn"""
RATES = """round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
 round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1, round(coalesce(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 0), 6) AS fpr"""
CURVE = """g AS (SELECT score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM scored GROUP BY score),
curve AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, sum(neg) OVER (ORDER BY score DESC) AS cum_neg, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM g)"""
CURVE_BY = """g AS (SELECT source, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM scored GROUP BY ALL),
curve AS (SELECT *, sum(pos) OVER (PARTITION BY source ORDER BY score DESC) AS cum_pos, sum(neg) OVER (PARTITION BY source ORDER BY score DESC) AS cum_neg, sum(pos) OVER (PARTITION BY source) AS n_pos, sum(neg) OVER (PARTITION BY source) AS n_neg FROM g)"""


@query("agg_21_confusion", f"WITH {SCORED}, c AS (SELECT source, {CONF} FROM (SELECT *, score >= 0.5 AS hit FROM scored) GROUP BY source) SELECT *, {RATES} FROM c")
def confusion(spark, sf):
    return ME.rates(ME.confusion(scored(spark, sf), ["source"], F.col("score") >= 0.5))


@query(
    "agg_22_auc_ap",
    f"""WITH {SCORED}, {CURVE_BY} SELECT source, CAST(max(n_pos) AS BIGINT) AS n_pos, CAST(max(n_neg) AS BIGINT) AS n_neg, round(sum(neg * (cum_pos - pos + pos / CAST(2 AS DOUBLE))) / (CAST(max(n_pos) AS DOUBLE) * max(n_neg)), 6) AS auc,
 round(sum(pos * cum_pos / CAST(cum_pos + cum_neg AS DOUBLE)) / max(n_pos), 6) AS ap FROM curve GROUP BY source""",
)
def auc_ap(spark, sf):
    return ME.auc_ap(scored(spark, sf), ["source"])


@query(
    "agg_23_trivial_baselines",
    f"""WITH {SCORED} SELECT source, count(*) AS n, round(2 * avg(label) / (1 + avg(label)), 6) AS all_positive_f1, CAST(0 AS DOUBLE) AS all_negative_f1, round(avg(label), 6) AS prevalence,
 CASE WHEN min(score_b) >= 0.9 THEN 'all-positive' WHEN max(score_b) < 1.5 THEN 'all-negative' END AS degenerate FROM scored GROUP BY source""",
)
def trivial_baselines(spark, sf):
    """``degenerate`` names the operating point of the second model at a threshold of 1.5."""
    pred = F.col("score_b") >= 1.5
    p = F.avg("label")
    return scored(spark, sf).groupBy("source").agg(
        F.count("*").alias("n"), F.round(2 * p / (1 + p), 6).alias("all_positive_f1"), F.lit(0.0).alias("all_negative_f1"), F.round(p, 6).alias("prevalence"),
        F.when(F.count("*") == 0, "empty").when(F.bool_and(pred), "all-positive").when(~F.bool_or(pred), "all-negative").alias("degenerate"),
    )


@query(
    "agg_24_precision_at_prevalence",
    f"""WITH {SCORED}, c AS (SELECT source, {CONF} FROM (SELECT *, score >= 0.5 AS hit FROM scored) GROUP BY source), p AS (SELECT unnest([0.085, 0.2, 0.5]) AS prevalence)
 SELECT source, CAST(prevalence AS DOUBLE) AS prevalence, round(tp / CAST(tp + fn AS DOUBLE) * prevalence / (tp / CAST(tp + fn AS DOUBLE) * prevalence + fp / CAST(fp + tn AS DOUBLE) * (1 - prevalence)), 6) AS precision FROM c, p""",
)
def precision_at_prevalence(spark, sf):
    c = ME.confusion(scored(spark, sf), ["source"], F.col("score") >= 0.5)
    tpr, fpr = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("fp", F.col("fp") + F.col("tn"))
    c = c.select("source", tpr.alias("tpr"), fpr.alias("fpr"), F.explode(F.array(F.lit(0.085), F.lit(0.2), F.lit(0.5))).alias("prevalence"))
    hit = F.col("tpr") * F.col("prevalence")
    return c.select("source", "prevalence", ratio(hit, hit + F.col("fpr") * (1 - F.col("prevalence"))).alias("precision"))


@query(
    "agg_25_source_report",
    f"""WITH {SCORED}, c AS (SELECT source, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, {CONF} FROM (SELECT *, score >= 0.5 AS hit FROM scored) GROUP BY source), r AS (SELECT *, {RATES} FROM c)
 SELECT source, n, n_pos, f1, CASE WHEN n < 20 OR n_pos = 0 OR n_pos = n THEN 'too small or single-class' END AS note, f1 > round(2 * n_pos / CAST(n + n_pos AS DOUBLE), 6) AS beats_trivial FROM r""",
)
def source_report(spark, sf):
    r = ME.rates(ME.confusion(scored(spark, sf), ["source"], F.col("score") >= 0.5))
    n_pos = F.col("tp") + F.col("fn")
    n = n_pos + F.col("fp") + F.col("tn")
    note = F.when((n < 20) | (n_pos == 0) | (n_pos == n), "too small or single-class")
    return r.select("source", n.alias("n"), n_pos.alias("n_pos"), "f1", note.alias("note"), (F.col("f1") > F.round(2.0 * n_pos / (n + n_pos), 6)).alias("beats_trivial"))


@query("agg_26_mcnemar")
def mcnemar(spark, sf):
    """Discordant counts of two models per source; the tests run on those few rows."""
    a, b = ((F.col(s) >= 0.5).cast("int") == F.col("label") for s in ("score", "score_b"))
    c = scored(spark, sf).groupBy("source").agg(F.count_if(~a & b).alias("n01"), F.count_if(a & ~b).alias("n10"))
    t = ME.mcnemar(c)
    return t.select("source", "n01", "n10", F.round("chi2", 6).alias("chi2"), F.round("p_chi2", 9).alias("p_chi2"), F.round("p_exact", 9).alias("p_exact"))


def _polynomial_sql(x: str, coefficients: list[float]) -> str:
    out = f"({coefficients[0]}::DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c}::DOUBLE))"
    return out


def poisson_sql(cells: str, key: str, seed: str, reps: int, columns: str, mean: str = "n", tag: str = "") -> str:
    """CTE ``w{tag}``: ``columns`` of the table ``cells``, rep and weight, drawn by the md5 of seed, ``key`` and rep."""
    z = (
        f"CASE WHEN u < {M.NORMAL_TAIL} THEN {_polynomial_sql('lo', M.NORMAL_TAIL_TOP)} / {_polynomial_sql('lo', M.NORMAL_TAIL_BOTTOM)} WHEN u > 1 - {M.NORMAL_TAIL} THEN -{_polynomial_sql('hi', M.NORMAL_TAIL_TOP)} / {_polynomial_sql('hi', M.NORMAL_TAIL_BOTTOM)}"
        f" ELSE {_polynomial_sql('(q * q)', M.NORMAL_CENTRE_TOP)} * q / {_polynomial_sql('(q * q)', M.NORMAL_CENTRE_BOTTOM)} END"
    )
    return f"""r{tag} AS (SELECT *, unnest(range(1, {reps} + 1)) AS rep FROM {cells}), u{tag} AS (SELECT *, {mean} AS mean, (('0x' || substr(md5(concat_ws('|', '{seed}', {key}, rep)), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM r{tag}),
 t{tag} AS (SELECT m, k, sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY m ORDER BY k) AS c FROM (SELECT DISTINCT mean::DOUBLE AS m FROM u{tag} WHERE mean <= {M.POISSON_SUMMED}), range(0, {2 * M.POISSON_SUMMED}) x(k)),
 near{tag} AS (SELECT {key}, rep, count(k) AS weight FROM u{tag} LEFT JOIN t{tag} ON m = mean AND c <= u WHERE mean <= {M.POISSON_SUMMED} GROUP BY ALL),
 z{tag} AS (SELECT *, {z} AS z FROM (SELECT *, u - 0.5 AS q, sqrt(-2 * ln(u)) AS lo, sqrt(-2 * ln(1 - u)) AS hi FROM u{tag})),
 w{tag} AS (SELECT {columns}, rep, coalesce(weight, greatest(floor(mean + sqrt(mean) * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * sqrt(mean)) + 0.5), 0))::BIGINT AS weight FROM z{tag} LEFT JOIN near{tag} USING ({key}, rep))"""


OUTCOME = "CASE WHEN label = 1 THEN CASE WHEN hit THEN 'tp' ELSE 'fn' END ELSE CASE WHEN hit THEN 'fp' ELSE 'tn' END END"


def boot_sql(by: str, seed: str, reps: int) -> str:
    """CTE ``f``: F1 per replicate of the item bootstrap over the table ``h`` (``by``, label, hit)."""
    sums = ", ".join(f"coalesce(sum(weight) FILTER (WHERE _u = '{c}'), 0) AS {c}" for c in ("tp", "fp", "fn", "tn"))
    return f"""cells AS (SELECT {by}, {OUTCOME} AS _u, count(*) AS n FROM h GROUP BY ALL), {poisson_sql("cells", f"{by}, _u", seed, reps, f"{by}, _u")},
 s AS (SELECT {by}, rep, {sums} FROM w GROUP BY ALL), f AS (SELECT {by}, rep, coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1 FROM s WHERE tp + fn > 0 AND fp + tn > 0)"""


def paired_sql(table: str, by: str | None, seed: str, reps: int) -> str:
    """CTE ``df``: F1 of both models and delta per replicate over ``table`` (``by``, label, hit_a, hit_b)."""
    lead = f"{by}, " if by else ""
    total = lambda *names: f"coalesce(sum(weight) FILTER (WHERE _u IN ({', '.join(repr(x) for x in names)})), 0)"
    f1 = lambda tp, fp, fn: f"coalesce(2 * {tp} / nullif(CAST(2 * {tp} + {fp} + {fn} AS DOUBLE), 0), 0)"
    return f"""pcells AS (SELECT {lead}label::VARCHAR || hit_a::INTEGER::VARCHAR || hit_b::INTEGER::VARCHAR AS _u, count(*) AS n FROM {table} GROUP BY ALL), {poisson_sql("pcells", f"{lead}_u", seed, reps, f"{lead}_u", tag="_p")},
 ps AS (SELECT {lead}rep, {total("110", "111")} AS ta, {total("010", "011")} AS fa, {total("100", "101")} AS na, {total("101", "111")} AS tb, {total("001", "011")} AS fb, {total("100", "110")} AS nb, {total("000", "001", "010", "011")} AS neg FROM w_p GROUP BY ALL),
 df AS (SELECT {lead}rep, {f1("ta", "fa", "na")} - {f1("tb", "fb", "nb")} AS delta FROM ps WHERE ta + na > 0 AND neg > 0)"""


DELTA = "round(avg(delta), 6) AS delta_mean, round(quantile_cont(delta, 0.025), 6) AS lo, round(quantile_cont(delta, 0.975), 6) AS hi, round(avg(CASE WHEN delta > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS share_positive"


@query(
    "agg_27_bootstrap_interval",
    f"""WITH {SCORED}, h AS (SELECT *, score >= 0.5 AS hit FROM scored), {boot_sql("arm", "boot", 200)}
 SELECT arm, count(*) AS n_reps, round(quantile_cont(f1, 0.025), 6) AS lo, round(quantile_cont(f1, 0.975), 6) AS hi FROM f GROUP BY arm""",
)
def bootstrap_interval(spark, sf):
    """Items are resampled: one count per outcome and replicate stands for all items of the outcome."""
    reps = ME.bootstrap_cells(scored(spark, sf), ["arm"], None, F.col("score") >= 0.5, 200, "boot")
    return ME.percentile_interval(reps, ["arm"], "f1")


@query(
    "agg_27_paired_item_bootstrap",
    f"""WITH {SCORED}, h AS (SELECT *, score >= 0.5 AS hit_a, score_b >= 0.5 AS hit_b FROM scored), {paired_sql("h", "source", "pair", 200)} SELECT source, count(*) AS n_reps, {DELTA} FROM df GROUP BY source""",
)
def paired_item_bootstrap(spark, sf):
    """Two models on the same resampled items, per source."""
    reps = ME.paired_bootstrap(scored(spark, sf), ["source"], F.col("score") >= 0.5, F.col("score_b") >= 0.5, 200, "pair")
    return ME.delta_interval(reps, ["source"])


@query(
    "agg_27_paired_cluster_bootstrap",
    f"""WITH {SCORED}, h AS (SELECT *, score >= 0.5 AS hit FROM scored), cells AS (SELECT arm, source AS _u, count(*) FILTER (WHERE label = 1 AND hit) AS tp, count(*) FILTER (WHERE label = 0 AND hit) AS fp, count(*) FILTER (WHERE label = 1 AND NOT hit) AS fn, count(*) FILTER (WHERE label = 0 AND NOT hit) AS tn FROM h GROUP BY ALL),
 units AS (SELECT DISTINCT _u, 1 AS n FROM cells), {poisson_sql("units", "_u", "cluster", 200, "_u")},
 s AS (SELECT arm, rep, sum(tp * weight) AS tp, sum(fp * weight) AS fp, sum(fn * weight) AS fn, sum(tn * weight) AS tn FROM cells JOIN w USING (_u) GROUP BY ALL), f AS (SELECT arm, rep, coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1 FROM s WHERE tp + fn > 0 AND fp + tn > 0),
 d AS (SELECT rep, max(CASE WHEN arm = 'F' THEN f1 END) - max(CASE WHEN arm = 'O' THEN f1 END) AS delta FROM f GROUP BY rep) SELECT count(*) AS n_reps, {DELTA} FROM d WHERE delta IS NOT NULL""",
)
def paired_cluster_bootstrap(spark, sf):
    """Whole sources are resampled; both arms share the draws, so the difference is paired."""
    reps = ME.bootstrap_cells(scored(spark, sf), ["arm"], F.col("source"), F.col("score") >= 0.5, 200, "cluster")
    d = reps.groupBy("rep").agg((F.max(F.when(F.col("arm") == "F", F.col("f1"))) - F.max(F.when(F.col("arm") == "O", F.col("f1")))).alias("delta"))
    return ME.delta_interval(d.where(F.col("delta").isNotNull()), [])


@query(
    "agg_28_wilson_kappa",
    f"""WITH {SCORED}, c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE a = label) AS k, avg(a) AS pa, avg(label) AS pl FROM (SELECT *, CAST(score >= 0.5 AS INTEGER) AS a FROM scored) GROUP BY source), z AS (SELECT *, k / CAST(n AS DOUBLE) AS p, 1.959963985 * 1.959963985 AS zz FROM c)
 SELECT source, round((p + zz / (2 * n) - 1.959963985 * sqrt(p * (1 - p) / n + zz / (4 * CAST(n AS DOUBLE) * n))) / (1 + zz / n), 6) AS lo, round((p + zz / (2 * n) + 1.959963985 * sqrt(p * (1 - p) / n + zz / (4 * CAST(n AS DOUBLE) * n))) / (1 + zz / n), 6) AS hi,
  round((p - (pa * pl + (1 - pa) * (1 - pl))) / (1 - (pa * pl + (1 - pa) * (1 - pl))), 6) AS kappa FROM z""",
)
def wilson_kappa(spark, sf):
    a = (F.col("score") >= 0.5).cast("int")
    c = scored(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.count_if(a == F.col("label")).alias("k"), F.avg(a).alias("pa"), F.avg("label").alias("pl"))
    lo, hi = M.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    chance = F.col("pa") * F.col("pl") + (1 - F.col("pa")) * (1 - F.col("pl"))
    return c.select("source", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), F.round((F.col("k") / F.col("n") - chance) / (1 - chance), 6).alias("kappa"))


@query("agg_29_max_pooling", f"WITH {SCORED} SELECT doc_id, max(score) AS score, max(label) AS label, count(*) AS n FROM scored GROUP BY doc_id")
def max_pooling(spark, sf):
    return scored(spark, sf).groupBy("doc_id").agg(F.max("score").alias("score"), F.max("label").alias("label"), F.count("*").alias("n"))


@query(
    "agg_30_set_coverage",
    f"""WITH {SCORED}, {CLAIMS}, p AS (SELECT doc_id, source_species AS a, target_species AS b, max(confidence) AS s FROM claims WHERE pos <> 2 GROUP BY ALL), gold AS (SELECT DISTINCT doc_id, source_species AS a, target_species AS b FROM claims WHERE label = 1 AND pos <= 3),
 r AS (SELECT p.doc_id, p.a, p.b, g.a IS NOT NULL AS hit FROM p LEFT JOIN gold g ON g.doc_id = p.doc_id AND g.a = p.a AND g.b = p.b WHERE s >= 0.5)
 SELECT count(*) AS n_pred, count(*) FILTER (WHERE hit) AS n_hit, (SELECT count(*) FROM gold) AS n_gold, round(count(*) FILTER (WHERE hit) / CAST(count(*) AS DOUBLE), 6) AS precision, round(count(*) FILTER (WHERE hit) / CAST((SELECT count(*) FROM gold) AS DOUBLE), 6) AS recall,
  round((SELECT count(*) FROM gold SEMI JOIN p USING (doc_id, a, b)) / CAST((SELECT count(*) FROM gold) AS DOUBLE), 6) AS recall_ceiling FROM r""",
)
def set_coverage(spark, sf):
    c = claims(spark, sf).select("doc_id", F.col("source_species").alias("a"), F.col("target_species").alias("b"), "confidence", "label", "pos")
    key = ["doc_id", "a", "b"]
    found = F.col("pos") != 2  # the candidate step misses a sentence form, which bounds the recall of all that follows
    g = c.groupBy(*key).agg(F.max(F.when(found, F.col("confidence"))).alias("s"), F.max(((F.col("label") == 1) & (F.col("pos") <= 3)).cast("int")).alias("gold"))
    pred, gold = F.coalesce(F.col("s") >= 0.5, F.lit(False)), F.col("gold") == 1
    s = g.agg(F.count_if(pred).alias("n_pred"), F.count_if(pred & gold).alias("n_hit"), F.count_if(gold).alias("n_gold"), F.count_if(gold & F.col("s").isNotNull()).alias("n_reachable"))
    return s.select("n_pred", "n_hit", "n_gold", ratio(F.col("n_hit"), F.col("n_pred")).alias("precision"), ratio(F.col("n_hit"), F.col("n_gold")).alias("recall"), ratio(F.col("n_reachable"), F.col("n_gold")).alias("recall_ceiling"))


@query(
    "agg_31_direction_accuracy",
    f"""WITH {CLAIMS}, p AS (SELECT source, CASE WHEN strpos(text, source_species) > 0 AND strpos(text, target_species) > 0 THEN CASE WHEN strpos(text, source_species) <= strpos(text, target_species) THEN 1 ELSE 2 END END AS pred, CASE WHEN label = 1 THEN 1 ELSE 2 END AS truth FROM claims)
 SELECT source, count(*) AS n, count(pred) AS fired, round(count(pred) / CAST(count(*) AS DOUBLE), 6) AS coverage, round(count(*) FILTER (WHERE pred = truth) / CAST(count(pred) AS DOUBLE), 6) AS accuracy FROM p GROUP BY source""",
)
def direction_accuracy(spark, sf):
    """First-mentioned name as the subject, abstaining when a name is missing."""
    a, b = F.expr("instr(text, source_species)"), F.expr("instr(text, target_species)")
    pred = F.when((a > 0) & (b > 0), F.when(a <= b, 1).otherwise(2))
    p = claims(spark, sf).select("source", pred.alias("pred"), F.when(F.col("label") == 1, 1).otherwise(2).alias("truth"))
    return p.groupBy("source").agg(
        F.count("*").alias("n"), F.count("pred").alias("fired"), ratio(F.count("pred"), F.count("*")).alias("coverage"),
        ratio(F.count_if(F.col("pred") == F.col("truth")), F.count("pred")).alias("accuracy"),
    )


@query(
    "agg_32_swap_consistency",
    """WITH p AS (SELECT l_partkey AS a, l_suppkey AS b, CASE WHEN avg(l_quantity) > 25 THEN 1 ELSE 0 END AS pred FROM lineitem GROUP BY ALL)
 SELECT count(*) AS n, count(*) FILTER (WHERE x.pred = y.pred) AS n_agree, round(avg(CASE WHEN x.pred = y.pred THEN 1 ELSE 0 END), 6) AS consistency FROM p x JOIN p y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
)
def swap_consistency(spark, sf):
    """Predictions under (a, b) and (b, a) compared by one grouping on the order-free key."""
    line = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_quantity")
    p = line.groupBy("a", "b").agg((F.avg("l_quantity") > 25).cast("int").alias("pred"))
    fwd, rev = F.when(F.col("a") < F.col("b"), F.col("pred")), F.when(F.col("a") > F.col("b"), F.col("pred"))
    g = p.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max(fwd).alias("f"), F.max(rev).alias("r")).where("f is not null and r is not null")
    same = F.col("f") == F.col("r")
    return g.agg(F.count("*").alias("n"), F.count_if(same).alias("n_agree"), F.round(F.avg(same.cast("int")), 6).alias("consistency"))


@query(
    "agg_33_risk_coverage",
    f"""WITH {SCORED}, s AS (SELECT round(abs(score - 0.5), 3) AS conf, (score >= 0.5) = (label = 1) AS ok FROM scored), g AS (SELECT conf, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS w FROM s GROUP BY conf),
 c AS (SELECT conf, sum(n) OVER (ORDER BY conf DESC) AS cn, sum(w) OVER (ORDER BY conf DESC) AS cw, sum(n) OVER () AS total FROM g) SELECT conf, round(cn / CAST(total AS DOUBLE), 6) AS coverage, round(cw / CAST(cn AS DOUBLE), 6) AS risk FROM c""",
)
def risk_coverage(spark, sf):
    """Error among the most confident share, at every distinct confidence."""
    s = scored(spark, sf).select(F.round(F.abs(F.col("score") - 0.5), 3).alias("score"), ((F.col("score") >= 0.5) != (F.col("label") == 1)).cast("int").alias("label"))
    c = ME.curve(s, [])
    cn = F.col("cum_pos") + F.col("cum_neg")
    return c.select(F.col("score").alias("conf"), F.round(cn / (F.col("n_pos") + F.col("n_neg")), 6).alias("coverage"), F.round(F.col("cum_pos") / cn, 6).alias("risk"))


@query(
    "agg_36_attribution_ambiguity",
    f"""WITH {MENTIONS}, ps AS (SELECT DISTINCT a.doc_id, a.sent_id, a.name AS x, b.name AS y FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND a.pos < b.pos WHERE a.type <> b.type), k AS (SELECT doc_id, least(x, y) AS lo, greatest(x, y) AS hi, count(DISTINCT sent_id) AS k FROM ps GROUP BY ALL)
 SELECT CAST(least(k, 3) AS BIGINT) AS k_bucket, count(*) AS n_pairs, round(exp(sum(CASE WHEN k > 1 THEN ln(1 - 1 / CAST(k AS DOUBLE)) ELSE 0 END) / count(*)), 6) AS mean_non_stating FROM k GROUP BY 1""",
)
def attribution_ambiguity(spark, sf):
    """How many sentences a document pair could be stated in; geometric mean of (1 - 1/k) per bucket."""
    from claimweave.operators.joins import typed_pairs

    m = mentions(spark, sf).groupBy("doc_id", "sent_id").agg(F.collect_list(F.struct("pos", "name", "type")).alias("m"))
    p = m.select("doc_id", "sent_id", F.inline(typed_pairs(F.col("m"), [("PATHOGEN", "HOST")])))
    k = p.select("doc_id", "sent_id", F.least("first", "second").alias("lo"), F.greatest("first", "second").alias("hi")).distinct()
    k = k.groupBy("doc_id", "lo", "hi").agg(F.count("*").alias("k"))
    part = F.when(F.col("k") > 1, F.log(1 - 1 / F.col("k"))).otherwise(F.lit(0.0))
    return k.groupBy(F.least("k", F.lit(3)).cast("bigint").alias("k_bucket")).agg(F.count("*").alias("n_pairs"), F.round(F.exp(F.sum(part) / F.count("*")), 6).alias("mean_non_stating"))


@query(
    "agg_40_error_decomposition",
    f"""WITH {CLAIMS}, m AS (SELECT label, CASE WHEN reads % 2 = 0 THEN 1 ELSE 0 END AS alt, CASE WHEN pos = 3 THEN 'negated' WHEN pos = 5 THEN 'methods' WHEN pos = 6 THEN 'co_mention' ELSE 'stated' END AS mechanism FROM claims WHERE confidence >= 0.5)
 SELECT mechanism, count(*) AS n, count(*) FILTER (WHERE label = 0) AS wrong_first, count(*) FILTER (WHERE alt = 0) AS wrong_second, round(avg(label), 6) AS precision_first, round(avg(alt), 6) AS precision_second FROM m GROUP BY mechanism""",
)
def error_decomposition(spark, sf):
    mech = F.when(F.col("pos") == 3, "negated").when(F.col("pos") == 5, "methods").when(F.col("pos") == 6, "co_mention").otherwise("stated")
    m = claims(spark, sf).where("confidence >= 0.5").select("label", (F.col("reads") % 2 == 0).cast("int").alias("alt"), mech.alias("mechanism"))
    return m.groupBy("mechanism").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("wrong_first"), F.count_if(F.col("alt") == 0).alias("wrong_second"),
        F.round(F.avg("label"), 6).alias("precision_first"), F.round(F.avg("alt"), 6).alias("precision_second"),
    )


GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
GRID_SQL = "t AS (SELECT unnest([" + ", ".join(f"CAST({x} AS DOUBLE)" for x in GRID) + "]) AS threshold)"


@query(
    "agg_41_operating_points",
    f"""WITH {SCORED}, {GRID_SQL}, h AS (SELECT threshold, label, score >= threshold AS hit, score_b >= 0.5 AS old FROM scored, t), c AS (SELECT threshold, {CONF}, count(*) FILTER (WHERE hit <> old AND hit = (label = 1)) AS fixes, count(*) FILTER (WHERE hit <> old AND hit <> (label = 1)) AS breaks FROM h GROUP BY threshold)
 SELECT threshold, tp, fp, fn, tn, fixes, breaks, {RATES} FROM c""",
)
def operating_points(spark, sf):
    """Counts per (score, recorded decision) once, then a fixed grid of thresholds on those groups."""
    g = scored(spark, sf).groupBy("score", (F.col("score_b") >= 0.5).alias("old")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    e = g.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in GRID]))).withColumn("hit", F.col("score") >= F.col("threshold"))
    hit, moved = F.col("hit"), F.col("hit") != F.col("old")
    add = lambda cond, v: F.sum(F.when(cond, F.col(v)).otherwise(0))
    c = e.groupBy("threshold").agg(
        add(hit, "pos").alias("tp"), add(hit, "neg").alias("fp"), add(~hit, "pos").alias("fn"), add(~hit, "neg").alias("tn"),
        (add(moved & hit, "pos") + add(moved & ~hit, "neg")).alias("fixes"), (add(moved & hit, "neg") + add(moved & ~hit, "pos")).alias("breaks"),
    )
    return ME.rates(c)


@query(
    "agg_42_score_shift",
    f"""WITH {SCORED}, g AS (SELECT 'positive' AS grp, score, score_b FROM scored WHERE label = 1 UNION ALL SELECT 'negative', score, score_b FROM scored WHERE label = 0 UNION ALL SELECT 'target', score, score_b FROM scored WHERE source = 'src1' UNION ALL SELECT 'control', score, score_b FROM scored WHERE source <> 'src1')
 SELECT grp, count(*) AS n, round(avg(score_b - score), 6) AS shift FROM g GROUP BY grp""",
)
def score_shift(spark, sf):
    groups = F.array(
        F.when(F.col("label") == 1, "positive").otherwise("negative"), F.when(F.col("source") == "src1", "target").otherwise("control")
    )
    g = scored(spark, sf).select(F.explode(groups).alias("grp"), (F.col("score_b") - F.col("score")).alias("d"))
    return g.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("shift"))


@query(
    "agg_44_metrics_by_axis",
    f"""WITH {SCORED}, h AS (SELECT *, score >= 0.5 AS hit, CASE WHEN abs(score - 0.5) < 0.1 THEN 'hard' ELSE 'easy' END AS difficulty FROM scored), c AS (SELECT coalesce(source, 'ALL') AS category, coalesce(difficulty, 'ALL') AS difficulty, {CONF} FROM h GROUP BY GROUPING SETS ((source), (difficulty)))
 SELECT *, {RATES} FROM c""",
)
def metrics_by_axis(spark, sf):
    d = F.when(F.abs(F.col("score") - 0.5) < 0.1, "hard").otherwise("easy")
    s = scored(spark, sf).withColumn("difficulty", d)
    y, hit = F.col("label") == 1, F.col("score") >= 0.5
    g = s.groupingSets([[F.col("source")], [F.col("difficulty")]], F.col("source"), F.col("difficulty")).agg(
        F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn")
    )
    c = g.select(F.coalesce("source", F.lit("ALL")).alias("category"), F.coalesce("difficulty", F.lit("ALL")).alias("difficulty"), "tp", "fp", "fn", "tn")
    return ME.rates(c)


@query(
    "win_07_topk_curve",
    f"""WITH {SCORED}, {CURVE} SELECT score, CAST(cum_pos + cum_neg - pos - neg AS BIGINT) AS k_before, pos + neg AS n_tied, CAST(cum_pos - pos AS BIGINT) AS tp_before, round(pos / CAST(pos + neg AS DOUBLE), 6) AS rate, CAST(n_pos AS BIGINT) AS n_pos FROM curve""",
)
def topk_curve(spark, sf):
    return ME.topk_expected(scored(spark, sf), [])


@query(
    "win_09_islands",
    f"""WITH {SCORED}, {CURVE}, f AS (SELECT score, cum_pos + cum_neg AS k, pos > neg AS lead FROM curve), r AS (SELECT *, sum(ch) OVER (ORDER BY k) AS run FROM (SELECT *, CASE WHEN lag(lead) OVER (ORDER BY k) = lead THEN 0 ELSE 1 END AS ch FROM f))
 SELECT 'all' AS grp, count(*) AS n, CAST(min(k) AS BIGINT) AS first, CAST(max(k) AS BIGINT) AS last, min(score) AS low, max(score) AS high FROM r WHERE lead GROUP BY run""",
)
def islands(spark, sf):
    """Runs of score groups where positives lead; one row per distinct score, so the window is small."""
    c = ME.curve(scored(spark, sf), []).select(F.lit("all").alias("grp"), "score", (F.col("cum_pos") + F.col("cum_neg")).alias("k"), (F.col("pos") > F.col("neg")).alias("lead"))
    return ME.islands(c, ["grp"], "k", "lead", "score")


@query(
    "win_13_best_threshold",
    f"""WITH {SCORED}, {CURVE_BY}, f AS (SELECT *, round(2 * cum_pos / CAST(2 * cum_pos + cum_neg + n_pos - cum_pos AS DOUBLE), 9) AS f1 FROM curve), b AS (SELECT source, score AS threshold, round(f1, 6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY f.f1 DESC, score) = 1),
 p AS (SELECT source, score AS p_threshold, round(cum_pos / CAST(cum_pos + cum_neg AS DOUBLE), 6) AS p_precision, round(cum_pos / CAST(n_pos AS DOUBLE), 6) AS p_recall FROM curve WHERE cum_pos >= 0.9 * (cum_pos + cum_neg) QUALIFY row_number() OVER (PARTITION BY source ORDER BY cum_pos DESC, score DESC) = 1)
 SELECT b.source, threshold, f1, p_threshold, p_precision, p_recall FROM b LEFT JOIN p ON p.source = b.source""",
)
def best_thresholds(spark, sf):
    s = scored(spark, sf)
    p = ME.precision_target(s, ["source"], 0.9).select("source", F.col("threshold").alias("p_threshold"), F.col("precision").alias("p_precision"), F.col("recall").alias("p_recall"))
    return ME.best_threshold(s, ["source"]).join(p, "source", "left")


@query(
    "win_14_escalation_band",
    f"""WITH {SCORED}, g AS (SELECT round(abs(score - 0.5), 3) AS u, count(*) AS n FROM scored GROUP BY 1), c AS (SELECT u, sum(n) OVER (ORDER BY u) AS through, sum(n) OVER () AS total FROM g), k AS (SELECT max(u) AS cut FROM c WHERE through <= 0.2 * total)
 SELECT source, count(*) AS n, count(*) FILTER (WHERE u <= cut) AS escalated, count(*) FILTER (WHERE (CASE WHEN u <= cut THEN score_b ELSE score END >= 0.5) = (label = 1)) AS n_right FROM (SELECT *, round(abs(score - 0.5), 3) AS u FROM scored), k GROUP BY source""",
)
def escalation_band(spark, sf):
    """The least confident 20 % take the second opinion; the cut comes from counts per distinct confidence."""
    s = scored(spark, sf).withColumn("u", F.round(F.abs(F.col("score") - 0.5), 3))
    cut = band_cut(s, "u", 0.2)
    up = F.col("u") <= cut
    final = F.when(up, F.col("score_b")).otherwise(F.col("score"))
    return s.groupBy("source").agg(F.count("*").alias("n"), F.count_if(up).alias("escalated"), F.count_if((final >= 0.5) == (F.col("label") == 1)).alias("n_right"))


def band_cut(df, col: str, share: float):
    """Largest value such that at most ``share`` of the rows lie at or below it, as a scalar column."""
    g = df.groupBy(col).agg(F.count("*").alias("n"))
    w = Window.orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy())
    return g.select(col, F.sum("n").over(w).alias("through"), total.alias("total")).where(F.col("through") <= share * F.col("total")).agg(F.max(col)).scalar()


@query(
    "win_17_weight_grid",
    f"""WITH {SCORED}, w AS (SELECT unnest([CAST(0.3 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.7 AS DOUBLE)]) AS w), s AS (SELECT w, round(w * score + (1 - w) * score_b, 2) AS m, label FROM scored, w), g AS (SELECT w, m AS score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM s GROUP BY ALL),
 c AS (SELECT *, sum(pos) OVER (PARTITION BY w ORDER BY score DESC) AS cp, sum(neg) OVER (PARTITION BY w ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY w) AS np FROM g), f AS (SELECT w, score, round(2 * cp / CAST(cp + cn + np AS DOUBLE), 9) AS f FROM c)
 SELECT CAST(w AS DOUBLE) AS weight, score AS threshold, round(f, 6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY w ORDER BY f DESC, score) = 1""",
)
def weight_grid(spark, sf):
    """Best F1 threshold per ensemble weight; a fixed grid of weights is exploded per item, then counted away."""
    s = scored(spark, sf).withColumn("weight", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))))
    mix = F.round(F.col("weight") * F.col("score") + (1 - F.col("weight")) * F.col("score_b"), 2)
    return ME.best_threshold(s.select("weight", mix.alias("score"), "label"), ["weight"])


@query(
    "mth_06_score_pooling",
    f"""WITH {SCORED}, p AS (SELECT item_id, [score, score_b, round(score * score_b, 6), round((score + score_b) / 2, 6)] AS v FROM scored)
 SELECT item_id, list_max(v) AS top, round(list_sum(list_reverse_sort(v)[1:3]) / 3, 6) AS top3, round(list_sum(v) / 4, 8) AS mean, round(len(list_filter(v, lambda x: x > 0.5)) / CAST(4 AS DOUBLE), 6) AS share_positive FROM p""",
)
def score_pooling(spark, sf):
    v = F.array("score", "score_b", F.round(F.col("score") * F.col("score_b"), 6), F.round((F.col("score") + F.col("score_b")) / 2, 6))
    p = scored(spark, sf).select("item_id", v.alias("v"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    return p.select(
        "item_id", F.array_max("v").alias("top"), F.round(total(F.slice(F.sort_array("v", asc=False), 1, 3)) / 3, 6).alias("top3"), F.round(total(F.col("v")) / 4, 8).alias("mean"),
        F.round(F.size(F.filter("v", lambda x: x > 0.5)) / 4.0, 6).alias("share_positive"),
    )


@query(
    "mth_06_rank_aggregation",
    f"""WITH {SCORED}, r AS (SELECT arm, source, avg(score) AS a, avg(score_b) AS b FROM scored GROUP BY ALL), k AS (SELECT arm, source, rank() OVER (PARTITION BY arm ORDER BY round(a, 4)) AS ra, rank() OVER (PARTITION BY arm ORDER BY round(b, 4)) AS rb, count(*) OVER (PARTITION BY arm) AS n FROM r)
 SELECT arm, source, round((ra + rb) / CAST(2 * n AS DOUBLE), 6) AS rank_score FROM k""",
)
def rank_aggregation(spark, sf):
    r = scored(spark, sf).groupBy("arm", "source").agg(F.round(F.avg("score"), 4).alias("a"), F.round(F.avg("score_b"), 4).alias("b"))
    w = Window.partitionBy("arm")
    rank = lambda c: F.rank().over(w.orderBy(c))
    return r.select("arm", "source", F.round((rank("a") + rank("b")) / (2 * F.count("*").over(w)), 6).alias("rank_score"))


@query(
    "top_06_leaderboard",
    f"""WITH {SCORED}, c AS (SELECT source, arm, {CONF} FROM (SELECT *, score >= 0.5 AS hit FROM scored) GROUP BY ALL), r AS (SELECT source, arm, {RATES} FROM c) SELECT source, arm, f1, recall FROM r ORDER BY f1 DESC, recall DESC, source, arm LIMIT 5""",
)
def leaderboard(spark, sf):
    r = ME.rates(ME.confusion(scored(spark, sf), ["source", "arm"], F.col("score") >= 0.5))
    return r.orderBy(F.desc("f1"), F.desc("recall"), "source", "arm").limit(5).select("source", "arm", "f1", "recall")


@query(
    "top_04_most_uncertain",
    f"""WITH {SCORED} SELECT item_id, score, round(1 - greatest(score, 1 - score), 6) AS uncertainty FROM scored ORDER BY round(1 - greatest(score, 1 - score), 6) DESC, item_id LIMIT 100""",
)
def most_uncertain(spark, sf):
    u = F.round(1 - F.greatest("score", 1 - F.col("score")), 6)
    return scored(spark, sf).select("item_id", "score", u.alias("uncertainty")).orderBy(F.desc("uncertainty"), "item_id").limit(100)


