"""Mixing sources to target weights by hash thresholds.

Tokens are summed by source and hash bucket. A source's budget falls into one bucket; only that bucket is cut again, so
a few small sums place the threshold, and documents are kept by comparing their own hash with it. Nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import numbered, small, stage, whole_text, words

BITS, LEVELS = 12, 3
WEIGHTS = (5, 2, 1)


def hash36(seed: str, doc_id: Column) -> Column:
    """36 bits of md5, alike for equal ids; a null id counts as an empty one."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 9), 16, 10).cast("bigint")


def targets(sources: DataFrame, share: tuple[int, int] = (3, 2), weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> DataFrame:
    """``sources`` (source, source_size) → with ``target``.

    ``share`` (a fraction) of all sizes is divided by weights, dealt to the sources in code point order (null last) and
    repeated. A target stops at ``most`` times its source's size; the excess goes to the others by weight until none is
    above. The level at which that settles is found from running sums over sources in the order in which they fill up.
    """
    if most * share[1] < share[0]:
        raise ValueError("the share cannot be reached within the limit")
    ranked = numbered(sources, [F.asc_nulls_last("source")], [], "mix-sources").withColumn("_i", ((F.col("rk") - 1) % len(weights)).cast("int"))
    w = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("_i") + 1).cast("bigint")).withColumn("cap", most * F.col("source_size")).drop("rk", "_i")
    full = F.col("cap") / F.col("weight")
    filled = stage(numbered(w.withColumn("_full", full), [F.asc("_full"), F.asc_nulls_last("source")], ["cap", "weight"], "mix-fill"), "mix-filled")
    total = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = share[0] * (total[0] or 0)
    rest = F.lit(total[1] or 0) - F.col("cum_weight") + F.col("weight")
    level = (F.lit(wanted) - share[1] * (F.col("cum_cap") - F.col("cap"))) / (share[1] * rest)
    first = filled.where(level <= F.col("_full")).agg(F.min_by(level, F.col("rk")).alias("level")).first().level
    reach = F.col("cap").cast("double") if first is None else F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(first))
    return filled.select("source", "source_size", reach.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``rows`` (source, size, h: 36 bits), ``budgets`` (source, budget) → source, cut: rows with h < cut are taken.

    Sums by the first 12 bits, then by the next 12 inside each source's boundary bucket, and the last 12. Of the last
    boundary bucket all or nothing is taken, whichever is nearer.
    """
    state = budgets.select("source", F.col("budget").cast("double").alias("left"), F.lit(0).cast("bigint").alias("prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        s = small(state)
        at = F.shiftright(F.col("h"), shift)
        inside = rows.join(s.withColumnRenamed("source", "_s"), rows["source"].eqNullSafe(F.col("_s")) & (F.shiftright(F.col("h"), shift + BITS) == F.col("prefix"))).drop("_s")
        sums = inside.groupBy("source", at.alias("bucket")).agg(F.sum("size").alias("n"), F.first("left").alias("left"))
        w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        over = sums.withColumn("through", F.sum("n").over(w)).where(F.col("through") > F.col("left"))
        edge = over.groupBy("source").agg(F.min_by(F.struct("bucket", "through", "n", "left"), "bucket").alias("e")).select(F.col("source").alias("_s"), "e")
        before = F.col("e.through") - F.col("e.n")
        # a source whose budget covers the whole bucket takes all of it
        last = level == LEVELS - 1
        step = F.when(F.col("e").isNull(), F.shiftleft(F.col("prefix") + 1, BITS)).otherwise(F.col("e.bucket"))
        if last:
            step = step + F.when(F.col("e").isNotNull() & (F.col("e.through") - F.col("e.left") < F.col("e.left") - before), 1).otherwise(0)
        state = stage(
            state.join(small(stage(edge, "mix-edge")), state["source"].eqNullSafe(F.col("_s")), "left").select("source", F.when(F.col("e").isNull(), F.lit(0.0)).otherwise(F.col("left") - before).alias("left"), step.cast("bigint").alias("prefix")),
            "mix-cut",
        )
    return state.select("source", F.col("prefix").alias("cut"))


def mixed(docs: DataFrame, carry: list[str], text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = "mix", share: tuple[int, int] = (3, 2), weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> DataFrame:
    """One row per input row: ``carry`` (as ``_c_<name>``), size, source_size, target, epochs, taken.

    A source's whole passes come first; the rest of its target is filled with documents below its hash threshold, so a
    smaller target always takes a part of a larger one's documents. Null texts have size 0, null ids hash alike,
    repeated rows are taken alike, a source of size 0 has target 0, an empty table gives no rows.
    """
    d = docs.select(*[F.col(c).alias(f"_c_{c}") for c in carry], F.col(source).cast("string").alias("source"), F.size(words(whole_text(text))).cast("bigint").alias("size"), hash36(seed, F.col(doc_id)).alias("h"))
    heavy = text in carry
    rows = stage(d.select("source", "size", "h") if heavy else d, "mix-sizes")
    t = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, most), "mix-targets")
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("bigint")
    t = t.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    cuts = thresholds(rows.select("source", "size", "h"), t).withColumnRenamed("source", "_s")
    plan = small(stage(t.join(small(cuts), t["source"].eqNullSafe(F.col("_s"))).select(F.col("source").alias("_p"), "source_size", "target", "passes", "cut"), "mix-plan"))
    base = d if heavy else rows
    epochs = F.least(F.col("passes") + (F.col("h") < F.col("cut")).cast("bigint"), F.lit(most).cast("bigint"))
    j = base.join(plan, base["source"].eqNullSafe(F.col("_p"))).withColumn("epochs", epochs)
    return j.select(*[f"_c_{c}" for c in carry], "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken"))


def mixture(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns."""
    m = mixed(docs, docs.columns, **kw).where("epochs > 0")
    again = m.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("epochs"))))
    return again.select(*[F.col(f"_c_{c}").alias(c) for c in docs.columns])


SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
f AS (SELECT *, cap / weight AS ratio, row_number() OVER o AS rk, sum(cap) OVER o - cap AS caps, sum(weight) OVER () - sum(weight) OVER o + weight AS rest, 3 * sum(source_size) OVER () AS wanted
  FROM s WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
l AS (SELECT min_by((wanted - 2 * caps)::DOUBLE / (2 * rest)::DOUBLE, rk) AS level FROM f WHERE (wanted - 2 * caps)::DOUBLE / (2 * rest)::DOUBLE <= ratio),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight * level) END AS target FROM f, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size)::BIGINT, 2) ELSE 0 END AS passes FROM t),
b AS (SELECT *, target - passes * source_size AS budget FROM p),
c AS (SELECT source, h, sum(size)::BIGINT AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS through FROM d GROUP BY source, h),
e AS (SELECT b.source, min_by(CASE WHEN through - budget < budget - (through - n) THEN h + 1 ELSE h END, h) AS cut FROM b JOIN c ON b.source IS NOT DISTINCT FROM c.source AND through > budget GROUP BY b.source)
SELECT doc_id, size, source_size, target, (size * least(passes + CASE WHEN cut IS NULL OR h < cut THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON b.source IS NOT DISTINCT FROM e.source
"""
