"""Which strings hold which: a containment join over an index of character grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.session import stage

GRAM = 3


def _grams(c: Column, n: int) -> Column:
    """Distinct substrings of ``n`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1)))
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(starts, lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _of_length(c: Column) -> Column:
    """Grams by which a string is looked up: of three characters, or the whole of a shorter one."""
    return F.when(F.length(c) >= GRAM, _grams(c, GRAM)).otherwise(F.array(c))


def contained_in(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) for every non-empty ``inner`` that stands anywhere in an ``outer``; both tables of one column.

    Every gram of the inner string must be a gram of the outer one, so a string is looked up by the one gram of its own
    that the fewest outer strings hold; one with a gram that none holds is in none. What the gram finds is then compared
    in full. Common grams are join keys only for strings that have no rarer one.
    """
    a, b = inner.columns[0], outer.columns[0]
    i = inner.where(F.col(a) != "").distinct()
    index = stage(outer.distinct().select(b, F.explode(F.concat(*[_grams(F.col(b), n) for n in range(1, GRAM + 1)])).alias("gram")), "gram-index")
    held = index.groupBy("gram").agg(F.count("*").alias("n"))
    looked = i.select(a, F.explode(_of_length(F.col(a))).alias("gram")).join(held, "gram", "left")
    rarest = looked.groupBy(a).agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.max(F.col("n").isNull()).alias("_none")).where("not _none")
    return rarest.join(index, "gram").where(F.col(b).contains(F.col(a))).select(a, b)


def related(keys: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term) wherever one string holds the other; both tables of one column."""
    k, t = keys.columns[0], terms.columns[0]
    return contained_in(terms, keys).select(k, t).unionByName(contained_in(keys, terms).select(k, t)).distinct()
