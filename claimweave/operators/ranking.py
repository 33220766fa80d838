"""Ranks and running totals that never sort one large group in one task.

A total order is cut into buckets that respect it; buckets are counted first (a small table), their
offsets come from that table, and exact ranks are computed inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.hashing import seeded_md5
from claimweave.session import stage


def _offsets(df: DataFrame, strata: list[str], values: dict[str, Column]) -> DataFrame:
    """Totals of all earlier buckets, per stratum and bucket."""
    totals = df.groupBy(*strata, "_b").agg(*[v.alias(f"_t_{k}") for k, v in values.items()])
    w = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"_o_{k}": F.coalesce(F.sum(f"_t_{k}").over(w), F.lit(0)) for k in values}
    return totals.withColumns(before).select(*strata, "_b", *before)


#: Rows that a bucket of a hash order holds at most, about, if one stratum holds all rows.
BUCKET_ROWS = 1_000_000


def digits_for(rows: int) -> int:
    """Hex digits of a digest that cut so many rows into buckets of BUCKET_ROWS; two at least."""
    n = 2
    while 16**n * BUCKET_ROWS < rows:
        n += 1
    return n


def hash_rank(df: DataFrame, strata: list[str], key: list[str], seed: str, name: str = "rk", n_hex: int | None = None) -> DataFrame:
    """Rank of every row in the md5 order of ``seed|key`` within its stratum.

    Digests are uniform, so they cut a stratum that holds all rows into equal ranges; how many follows from the number
    of rows, which is counted unless ``n_hex`` says it.
    """
    n_hex = digits_for(df.count()) if n_hex is None else n_hex
    d = df.withColumn("_d", seeded_md5(seed, *key)).withColumn("_b", F.substring("_d", 1, n_hex))
    off = _offsets(d, strata, {"n": F.count("*")})
    w = Window.partitionBy(*strata, "_b").orderBy("_d", *key)
    ranked = d.withColumn("_r", F.row_number().over(w)).join(off, [*strata, "_b"])
    return ranked.withColumn(name, (F.col("_r") + F.col("_o_n")).cast("bigint")).drop("_d", "_b", "_r", "_o_n")


def running_totals(groups: DataFrame, strata: list[str], order: str, values: list[str], buckets: int = 1024) -> DataFrame:
    """Totals through each row (``cum_*``) in descending ``order`` (a score in [0, 1]), per stratum.

    Input holds one row per (stratum, score): aggregate ties first.
    """
    b = groups.withColumn("_b", -F.floor(F.col(order) * buckets))
    off = _offsets(b, strata, {v: F.sum(v) for v in values})
    w = Window.partitionBy(*strata, "_b").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    inside = b.withColumns({f"cum_{v}": F.sum(v).over(w) for v in values}).join(off, [*strata, "_b"])
    return inside.withColumns({f"cum_{v}": F.col(f"cum_{v}") + F.col(f"_o_{v}") for v in values}).drop(
        "_b", *[f"_o_{v}" for v in values]
    )


def top_n(df: DataFrame, by: list[str], order: list[Column | str], n: int, name: str = "rk") -> DataFrame:
    """First ``n`` rows per group. A fixed ``n`` lets Spark keep only n rows per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def grouped_median(df: DataFrame, by: list[str], value: str, buckets: int = 1024) -> DataFrame:
    """Exact median per group without holding a group in one task.

    Values are counted, placed in value-range buckets, and only the position inside a bucket is sorted.
    """
    h = stage(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), "value-counts")
    ends = h.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("n").alias("_all"))
    v, lo, hi = F.col(value), F.col("_lo"), F.col("_hi")
    b = h.join(ends, by).withColumn("_b", F.when(hi > lo, F.floor((v - lo) / (hi - lo) * (buckets - 1))).otherwise(0))
    w = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = b.withColumn("_c", F.sum("n").over(w)).join(_offsets(b, by, {"n": F.sum("n")}), [*by, "_b"])
    through = F.col("_c") + F.col("_o_n")
    first, second = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    low, high = F.min(F.when(through >= first, v)), F.min(F.when(through >= second, v))
    return c.groupBy(*by).agg(((low + high) / 2).alias("median"))
