"""Name resolution and ancestry over a (concepts, names) taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as V
from claimweave.session import stage

MAX_EDITS_BY_DELETION = 2


def similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def deletion_forms(c: Column, edits: int) -> Column:
    """The string and every form with up to ``edits`` (≤ 2) characters removed.

    Two strings within ``edits`` edits always share one of these forms, and strings that share one are
    close, so joining on them finds all near names without comparing a whole block.
    """

    def drop_one(s: Column) -> Column:
        cut = lambda i: F.concat(F.substr(s, F.lit(1), i), F.substr(s, i + 2, F.length(s)))
        return F.transform(F.sequence(F.lit(0), F.length(s) - 1), cut)

    forms = F.array(c)
    for _ in range(edits):
        forms = F.array_union(forms, F.flatten(F.transform(F.filter(forms, lambda s: F.length(s) > 0), drop_one)))
    return F.array_distinct(forms)


def near_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (query, prefix3, name_norm, similarity) of distinct strings in one 3-letter block with similarity ≥ the fixed minimum.

    Up to 29 characters the minimum allows at most two edits: join on deletion forms. Longer names allow
    e more edits: cut into e + 1 pieces, one piece of a partner stands unchanged within e places, so the
    join runs on (block, length, piece). Both are exact; no block is compared with itself. A string has hundreds of forms,
    which size estimates do not see, so neither side is ever broadcast.
    """
    q = queries.select("query", F.substring("query", 1, 3).alias("prefix3")).where(F.length("query") >= V.FUZZY_MIN_LENGTH)
    n = names.select("name_norm", "prefix3").distinct()  # ids that share a name are joined to its pairs afterwards
    limit = int(1 / (1 - V.FUZZY_MIN_SIMILARITY) * (MAX_EDITS_BY_DELETION + 1)) - 1
    # forms only select pairs to be compared in full, so 64-bit digests stand for them
    form = lambda c: F.explode(F.transform(deletion_forms(F.col(c), MAX_EDITS_BY_DELETION), lambda f: F.xxhash64(f))).alias("form")
    short = (
        q.where(F.length("query") <= limit).select("query", "prefix3", form("query"))
        .join(n.where(F.length("name_norm") <= limit).select("*", form("name_norm")).hint("merge"), ["prefix3", "form"])
        .drop("form").distinct()
    )
    low, high = V.FUZZY_MIN_SIMILARITY, 1 / V.FUZZY_MIN_SIMILARITY
    edits = lambda n_: F.floor(n_ * (high - 1)).cast("int")  # noqa: E731  most edits any partner of that length allows
    long_n = n.where(F.length("name_norm") > limit * low).withColumn("len_n", F.length("name_norm"))
    width = (F.col("len_n") / (edits(F.col("len_n")) + 1)).cast("int")
    piece = lambda i: F.substr("name_norm", i * width + 1, width)
    long_n = long_n.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), edits(F.col("len_n"))), piece)).alias("part", "piece"))
    long_q = q.withColumn("len_q", F.length("query"))
    band = F.sequence(F.ceil(F.col("len_q") * low).cast("int"), F.floor(F.col("len_q") * high).cast("int"))
    long_q = long_q.select("query", "prefix3", "len_q", F.explode(band).alias("len_n")).where(F.greatest("len_q", "len_n") > limit)
    long_q = long_q.select("*", F.explode(F.sequence(F.lit(0), edits(F.col("len_n")))).alias("part"))
    shifts = F.sequence(-edits(F.col("len_n")), edits(F.col("len_n")))
    long_q = long_q.withColumn("start", F.explode(F.transform(shifts, lambda d: F.col("part") * width + 1 + d))).where(F.col("start") >= 1)
    long_q = long_q.withColumn("piece", F.substr("query", F.col("start"), width)).drop("start").distinct()
    long = long_q.join(long_n.hint("merge"), ["prefix3", "len_n", "part", "piece"]).select("query", "prefix3", "name_norm").distinct()
    pairs = short.select("query", "prefix3", "name_norm").unionByName(long)
    return pairs.withColumn("similarity", similarity(F.col("query"), F.col("name_norm"))).where(F.col("similarity") >= V.FUZZY_MIN_SIMILARITY - 1e-9)


def fuzzy_candidates(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Near pairs (query, prefix3, name_norm, similarity) with the ids that carry the name."""
    return near_names(queries, names).join(names.select("name_norm", "id", "is_syn"), "name_norm")


def best_fuzzy(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Most similar name per query; ties by name, then by id, so that the least id of a name stands for all."""
    first = names.groupBy("name_norm").agg(F.min("id").alias("id"))
    best = F.min_by(F.struct("name_norm", F.round("similarity", 3).alias("similarity")), F.struct(-F.col("similarity"), "name_norm"))
    found = near_names(queries, names).groupBy("query").agg(best.alias("b")).select("query", "b.*")
    return found.join(first, "name_norm").select("query", "name_norm", "id", "similarity")


def resolve(queries: DataFrame, names: DataFrame) -> DataFrame:
    """exact → synonym → unambiguous abbreviation → fuzzy, each step on what the former left over.

    ``queries``: distinct ``query`` strings. Returns query, id, match_type, similarity (null when unresolved).
    """
    exact = (
        queries.join(names.groupBy("name_norm").agg(F.min_by(F.struct("id", "is_syn"), F.struct("is_syn", "id")).alias("h")), F.col("query") == F.col("name_norm"))
        .select("query", "h.id", F.when(F.col("h.is_syn") == 1, "synonym").otherwise("exact").alias("match_type"), F.lit(1.0).alias("similarity"))
    )
    rest = queries.join(exact.select("query"), "query", "left_anti")
    pattern = r"^([a-z])\.?\s+([a-z][a-z-]+)$"
    abbr = rest.where(F.col("query").rlike(pattern)).select(
        "query", F.regexp_extract("query", pattern, 1).alias("initial"), F.regexp_extract("query", pattern, 2).alias("epithet")
    )
    expanded = names.where(F.col("name_norm").contains(" ")).select(
        "id", F.substring("name_norm", 1, 1).alias("initial"), F.regexp_extract("name_norm", r"([^ ]+)$", 1).alias("epithet")
    )
    unique = expanded.groupBy("initial", "epithet").agg(F.min("id").alias("id"), F.max("id").alias("_m")).where("id = _m").drop("_m")
    abbrev = abbr.join(unique, ["initial", "epithet"]).select("query", "id", F.lit("abbrev").alias("match_type"), F.lit(1.0).alias("similarity"))
    rest = rest.join(abbrev.select("query"), "query", "left_anti")
    fuzzy = best_fuzzy(rest, names).select("query", "id", F.lit("fuzzy").alias("match_type"), "similarity")
    hits = exact.unionByName(abbrev).unionByName(fuzzy)
    return queries.join(hits, "query", "left")


def kingdom_ancestors(concepts: DataFrame) -> DataFrame:
    """Nearest ancestor-or-self of kingdom rank per concept, by pointer doubling; null where there is none.

    Settled rows leave the loop, so a root that is everyone's ancestor is never a join key; each round
    is written to the shared folder, which also cuts the lineage. No path is longer than the table, so what is open
    after as many doublings as that takes runs in a cycle.
    """
    top = F.col("rank").isin(V.KINGDOM_RANKS)
    start = concepts.select("id", F.when(top | F.col("parent").isNull(), F.col("id")).otherwise(F.col("parent")).alias("up"), (top | F.col("parent").isNull()).alias("done"))
    state = stage(start, "climb")
    for _ in range(state.count().bit_length() + 1):
        if state.where("not done").isEmpty():
            break
        hop = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("done").alias("done2"))
        open_rows = state.where("not done").join(hop, "up", "left")
        moved = open_rows.select("id", F.coalesce("up2", "up").alias("up"), F.coalesce("done2", F.lit(True)).alias("done"))
        state = stage(state.where("done").unionByName(moved), "climb")
    settled = state.select("id", F.when(F.col("done"), F.col("up")).alias("ancestor"))
    kings = concepts.where(top).select(F.col("id").alias("ancestor"), F.col("pref").alias("kingdom"))
    return settled.join(kings, "ancestor", "left").select("id", "kingdom")


def lineage(concepts: DataFrame) -> DataFrame:
    """(id, ancestor, depth) for every concept and all its ancestors, itself at depth 0, however deep.

    Paths double: round k joins all paths of fewer than 2**k steps with the jumps of 2**k steps, and the jumps with
    themselves, so a chain of a million levels takes twenty rounds. An ancestor met again on a cycle keeps its least
    depth; the rounds end when no jump is left, or when nothing is reached that was not reached before.
    """
    jumps = stage(concepts.where(F.col("parent").isNotNull()).select("id", F.col("parent").alias("to")), "jumps")
    paths = stage(concepts.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")), "lineage")
    n, step = paths.count(), 1
    while not jumps.isEmpty():
        further = paths.join(jumps.withColumnRenamed("id", "ancestor"), "ancestor").select("id", F.col("to").alias("ancestor"), (F.col("depth") + step).alias("depth"))
        paths = stage(paths.unionByName(further).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")), "lineage")
        now = paths.count()
        if now == n:
            break
        n, step = now, 2 * step
        jumps = stage(jumps.join(jumps.select(F.col("id").alias("to"), F.col("to").alias("_far")), "to").select("id", F.col("_far").alias("to")), "jumps")
    return paths
