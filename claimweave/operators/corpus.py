"""Corpus building: readers to one schema, incremental deduplication, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``.

    An aggregation with map-side combine, so a key holding a large share of the rows costs no
    more than its partial results.
    """
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*key).agg(first).select(*key, "_first.*").select(*df.columns)


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in ``order``."""
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*key).agg(last).select(*key, "_last.*").select(*df.columns)


def profile(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Rows, positives, negatives and positive rate per group."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(F.col(label).cast("bigint")).alias("n_pos"),
        F.sum((1 - F.col(label)).cast("bigint")).alias("n_neg"),
        F.round(F.avg(label), 6).alias("pos_rate"),
    )


def ratio(num: Column, den: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(num, den), digits)
