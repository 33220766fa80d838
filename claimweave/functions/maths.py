"""Score arithmetic: decay, fusion, thresholds, intervals, grades, surprise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as V
from claimweave.functions.text import bind


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def temporal_score(year: Column | str) -> Column:
    """exp(-ln 2 / half-life · age), 0.4 for an unknown year (``greatest`` alone would skip the null)."""
    year = _col(year)
    age = F.greatest(F.lit(0), F.lit(V.CURRENT_YEAR) - year)
    decayed = F.round(F.exp(age * F.lit(-math.log(2) / V.HALF_LIFE_YEARS)), 4)
    return F.when(year.isNull(), V.UNKNOWN_YEAR_SCORE).otherwise(decayed)


def fuse(p: Column, q: Column) -> dict[str, Column]:
    """Fused scores of two models by strategy."""
    out = {"arithmetic": (p + q) / 2}
    for w in (0.3, 0.4, 0.5, 0.6, 0.7):
        out[f"w{int(round(w * 10))}"] = p * w + q * (1 - w)
    out["maximum"] = F.greatest(p, q)
    out["geometric"] = F.sqrt(F.least(F.greatest(p * q, F.lit(1e-12)), F.lit(1.0)))
    return out


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(p / (1 - p))


def prior_threshold(train_rate: Column, target_rate: Column) -> Column:
    """Decision boundary after moving from the training prior to the target prior."""
    return 1.0 / (1.0 + F.exp(logit(target_rate, 1e-9) - logit(train_rate, 1e-9)))


def wilson(k: Column, n: Column, z: float = 1.959963985) -> tuple[Column, Column]:
    p = k / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, centre - half), F.when(n > 0, centre + half)


def grade(score: Column | str) -> Column:
    score = _col(score)
    out = None
    for limit, letter in V.GRADES:
        out = F.when(score >= limit, letter) if out is None else out.when(score >= limit, letter)
    return out.otherwise("F")


def log_gamma(n: Column) -> Column:
    """ln Γ(n) for n ≥ 1 by the shifted Stirling series (error below 1e-10)."""

    def series(x: Column) -> Column:
        shift = F.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6))
        y = x + 7
        tail = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
        return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - shift

    return bind(n.cast("double"), series)


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def hypergeom_surprise(k: Column, big_k: Column, n: Column, population: Column) -> Column:
    """-log10 P(X ≥ k) for X ~ Hypergeometric(population, big_k, n), at most 300; 0 without support.

    The first probability is taken in log space; the later ones follow from it by their ratios.
    """
    start = F.greatest(k, n - (population - big_k))
    top = F.least(big_k, n)
    first = log_choose(big_k, start) + log_choose(population - big_k, n - start) - log_choose(population, n)
    steps = F.when(top > start, F.sequence(start, F.greatest(start, top - 1))).otherwise(F.array().cast("array<bigint>"))
    ratio = lambda i: (big_k - i) * (n - i) / ((i + 1) * (population - big_k - n + i + 1)).cast("double")

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * ratio(i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), add)["total"]
    surprise = -(first + F.log(total)) / math.log(10)
    return F.when((k == 0) | (big_k == 0) | (population <= 0), 0.0).otherwise(F.least(F.lit(300.0), F.greatest(F.lit(0.0), surprise)))


def coherence_sqrt(k: Column, degree: Column) -> Column:
    return k / F.sqrt(F.greatest(F.lit(1), degree))


def year_of(c: Column | str) -> Column:
    """Year from the first four characters, null when they are not digits."""
    return F.substring(_col(c), 1, 4).try_cast("int")


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    """Value at ``x``, by an array of coefficients, so that ``x`` is written once."""
    return F.aggregate(F.array(*[F.lit(c) for c in coefficients]), F.lit(0.0), lambda s, c: s * x + c)


# Coefficients of the rational approximation of the normal quantile (relative error below 1.2e-9), and the
# probability at which its tail form takes over.
NORMAL_CENTRE_TOP = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
NORMAL_CENTRE_BOTTOM = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
NORMAL_TAIL_TOP = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
NORMAL_TAIL_BOTTOM = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
NORMAL_TAIL = 0.02425


def normal_quantile(u: Column) -> Column:
    """Standard normal quantile of a probability inside (0, 1)."""
    tail = lambda p: bind(F.sqrt(-2 * F.log(p)), lambda x: _polynomial(x, NORMAL_TAIL_TOP) / _polynomial(x, NORMAL_TAIL_BOTTOM))
    centre = lambda q: bind(q * q, lambda r: _polynomial(r, NORMAL_CENTRE_TOP) * q / _polynomial(r, NORMAL_CENTRE_BOTTOM))
    return bind(u, lambda p: F.when(p < NORMAL_TAIL, tail(p)).when(p > 1 - NORMAL_TAIL, -tail(1 - p)).otherwise(bind(p - 0.5, centre)))


#: Means up to this one are inverted by summing probabilities, larger ones by the expansion of the quantile.
POISSON_SUMMED = 256


def poisson_quantile(mean: Column, u: Column) -> Column:
    """Poisson count at probability ``u``: as many as n items drawn n times with replacement have copies in all.

    Up to POISSON_SUMMED the distribution function is summed. Beyond, the quantile follows from the normal one with its
    corrections for skewness and curvature, whose error there is far below one count.
    """

    def near(p: Column) -> Column:
        longest = F.least(F.lit(2 * POISSON_SUMMED), (mean + 20 * F.sqrt(mean) + 40).cast("int"))
        first = F.struct(F.lit(0).cast("bigint").alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c"))
        more = lambda s: F.struct((s["k"] + 1).alias("k"), (s["p"] * mean / (s["k"] + 1)).alias("p"), (s["c"] + s["p"] * mean / (s["k"] + 1)).alias("c"))
        return F.aggregate(F.sequence(F.lit(1), longest), first, lambda s, _: F.when(s["c"] > p, s).otherwise(more(s)))["k"]

    root = F.sqrt(mean)
    far = bind(normal_quantile(u), lambda z: F.floor(mean + root * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * root) + 0.5))
    return F.when(mean <= 0, F.lit(0)).when(mean <= POISSON_SUMMED, bind(u, near)).otherwise(F.greatest(far, F.lit(0))).cast("bigint")
