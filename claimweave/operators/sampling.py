"""Seeded sampling, balancing, splitting and augmentation. Every choice is an md5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.hashing import hash_bucket, seeded_md5, unit_draw
from claimweave.operators.ranking import hash_rank


def cap_per_group(df: DataFrame, by: list[str], key: list[str], n: int, seed: str) -> DataFrame:
    """At most ``n`` rows per group in hash order; the fixed ``n`` limits every group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(seeded_md5(seed, *key), *key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def first_by_hash(df: DataFrame, strata: list[str], key: list[str], n: Column, seed: str, limits: DataFrame | None = None) -> DataFrame:
    """First ``n`` rows per stratum in hash order, where ``n`` is data: a column of ``limits`` joined on the strata,
    or a scalar."""
    ranked = hash_rank(df, strata, key, seed, "_rk")
    if limits is not None:
        ranked = ranked.join(limits, strata)
    return ranked.where(F.col("_rk") <= n).select(*df.columns)


def label_counts(df: DataFrame, by: list[str], label: str) -> DataFrame:
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))


def split_of(key: list[str], seed: str, held: float) -> Column:
    """'valid' for a hashed share of the keys, else 'train'."""
    return F.when(unit_draw(seeded_md5(seed, *key)) < held, "valid").otherwise("train")


def fold_of(key: list[str], seed: str, k: int) -> Column:
    return (hash_bucket(seeded_md5(seed, *key), 6) % k).cast("int")


def entity_split(df: DataFrame, a: str, b: str, seed: str, held: float) -> DataFrame:
    """Entity-disjoint split: 'test' needs both endpoints held out, 'train' neither; mixed rows are 'residual'."""
    out = lambda c: unit_draw(seeded_md5(seed, F.lower(c))) < held
    x, y = out(a), out(b)
    return df.withColumn("split", F.when(x & y, "test").when(~x & ~y, "train").otherwise("residual"))


def resample_column(df: DataFrame, column: str, key: list[str], seed: str, share: float) -> DataFrame:
    """For a hashed share of the rows, redraw ``column`` from its own marginal, independent of the label.

    The marginal is a small cumulative table; each draw falls in one slot of it, found by an equi-join on a
    coarse slot followed by the exact bounds.
    """
    slots = 256
    m = df.groupBy(column).agg(F.count("*").alias("n"))
    w = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy())
    cum = m.select(F.col(column).alias("_new"), (F.sum("n").over(w) / total).alias("_hi"), ((F.sum("n").over(w) - F.col("n")) / total).alias("_lo"))
    cum = cum.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_lo") * slots), F.least(F.floor(F.col("_hi") * slots), F.lit(slots - 1)))))
    picked = unit_draw(seeded_md5(seed + "-pick", *key)) < share
    d = df.withColumns({"_u": unit_draw(seeded_md5(seed, *key)), "_p": picked}).withColumn("_slot", F.floor(F.col("_u") * slots))
    j = d.join(cum, "_slot").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    value = F.when(F.col("_p"), F.col("_new")).otherwise(F.col(column))
    return j.withColumns({column: value, "resampled": F.col("_p")}).select(*df.columns, "resampled")


def symmetric_copies(df: DataFrame, a: str, b: str, key: list[str]) -> DataFrame:
    """Rows with their arguments swapped that are not already present."""
    swapped = df.select(*[F.col(b).alias(a) if c == a else F.col(a).alias(b) if c == b else F.col(c) for c in df.columns])
    return swapped.join(df.select(*key).distinct(), key, "left_anti")
