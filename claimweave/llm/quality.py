"""Quality rules at the level of hosts.

Every document is measured by column expressions. Documents that break a rule are counted per host, each host's rate is
shrunk towards the rate of all hosts by a beta prior fitted to the hosts themselves, and a host whose shrunk rate is
too high takes its documents with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import let, small, stage, whole_text, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. ``base_*`` reject a document by itself; all of them count against its host."""

    base_min_words: int = 10
    base_repeat_percent: int = 20
    symbols_percent_of_words: int = 10
    dup_lines_percent_of_words: int = 5
    min_mean_word: int = 2
    max_mean_word: int = 15
    max_host_rate: float = 0.5
    #: Bounds of the prior's weight, in documents.
    prior_weight: tuple[float, float] = (1.0, 1000.0)


def _covered(grams: Column) -> Column:
    """Words inside 5-word windows whose hash occurs twice or more."""

    def of(pairs: Column) -> Column:
        again = F.filter(pairs, lambda p, j: (p["g"] == F.get(pairs, j - 1)["g"]) | (p["g"] == F.get(pairs, j + 1)["g"]))
        starts = F.array_sort(F.transform(again, lambda p: p["i"]))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda p, j: F.least(F.lit(5), F.coalesce(F.get(s, j + 1) - p, F.lit(5)))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    return let(F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), of)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures (bigint) of the whole text; a null text has no words."""
    d = docs.withColumn("_text", whole_text(text)).withColumn("_words", words(F.col("_text")))

    def repeated(h: Column) -> Column:
        five = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 4, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))
        return let(five, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(g)))

    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t = F.col("_text")
    return d.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.aggregate("_words", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("bigint"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
            "n_repeat_words": let(F.transform("_words", lambda w: F.xxhash64(w)), repeated).cast("bigint"),
        }
    ).drop("_text", "_words")


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.base_min_words) | (100 * F.col("n_repeat_words") > rules.base_repeat_percent * F.col("n_words"))


def any_failed(rules: Rules) -> Column:
    n = F.col("n_words")
    odd = (100 * F.col("n_symbols") > rules.symbols_percent_of_words * n) | (100 * F.col("n_dup_lines") > rules.dup_lines_percent_of_words * n)
    length = (F.col("word_chars") < rules.min_mean_word * n) | (F.col("word_chars") > rules.max_mean_word * n)
    return base_failed(rules) | odd | length


def host_verdicts(failures: DataFrame, rules: Rules) -> DataFrame:
    """``failures`` (host, failed) → host, n, f, rate, host_rejected. A null host is a host of its own.

    The prior's mean is the rate of all documents; its weight comes from the hosts' spread beyond that of coin tosses.
    """
    hosts = stage(failures.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("bigint")).alias("f")), "host-counts")
    n, f = F.col("n").cast("double"), F.col("f").cast("double")
    s = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ff")).first()
    low, high = rules.prior_weight
    mean, weight = 0.0, high
    if s.n:
        mean = s.f / s.n
        room, toss = s.n - s.nn / s.n, mean * (1 - mean)
        spread = (s.ff - s.n * mean * mean - (s.k - 1) * toss) / room if room > 0 else 0.0
        weight = min(max(toss / spread - 1, low), high) if spread > 0 else high
    rate = (F.col("f") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.withColumn("rate", rate).withColumn("host_rejected", F.col("rate") > rules.max_host_rate)


def judged(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules(), carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``carry`` (all columns unless given), measures, base_failed, host_rate, kept.

    Documents are measured once for the hosts and again for the result when texts are carried; without texts, the
    measures are written once. A carried column named like a result column keeps its place as ``in_<name>``.
    Null texts and empty texts fail; repeated rows are judged alike; an empty table gives no rows.
    """
    names = docs.columns if carry is None else carry
    taken = {*MEASURES, "base_failed", "host_rate", "kept"}
    out = {c: f"in_{c}" if c in taken else c for c in names}
    d = docs.select(*[F.col(c).alias(f"_c_{c}") for c in names], F.col(text).alias("_in"), F.col(host).cast("string").alias("_host"))
    m = measured(d, "_in").drop("_in") if text not in names else measured(d, "_in")
    if text in names:
        hosts = host_verdicts(m.select(F.col("_host").alias("host"), any_failed(rules).alias("failed")), rules)
    else:
        m = stage(m, "quality-measures")
        hosts = host_verdicts(m.select(F.col("_host").alias("host"), any_failed(rules).alias("failed")), rules)
    v = small(hosts).select(F.col("host").alias("_vh"), F.col("rate").alias("host_rate"), "host_rejected")
    j = m.join(v, m["_host"].eqNullSafe(v["_vh"])).withColumn("base_failed", base_failed(rules))
    return j.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).select(*[F.col(f"_c_{c}").alias(out[c]) for c in names], *MEASURES, "base_failed", "host_rate", "kept")


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows that stay, with their own columns."""
    d = docs.select(*[F.col(c).alias(f"_c_{c}") for c in docs.columns], F.col(text).alias("_in"), F.col(host).cast("string").alias("_h"))
    j = judged(d, "_in", "_h", rules, carry=[*[f"_c_{c}" for c in docs.columns], "_in"])
    return j.where("kept").select(*[F.col(f"_c_{c}").alias(c) for c in docs.columns])


SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, list_slice(w, i, i + 4) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
again AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, i + o AS p FROM g JOIN again USING (r, g), (SELECT unnest(range(0, 5)) AS o)) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN lines USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 5 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed FROM b),
h AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (WHERE failed)::DOUBLE AS f FROM f GROUP BY host),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS mean, sum(n * n) AS nn, sum(f * f / n) AS ff FROM h),
p AS (SELECT mean, CASE WHEN n - nn / n > 0 AND ff - n * mean * mean - (k - 1) * mean * (1 - mean) > 0
  THEN least(greatest(mean * (1 - mean) / ((ff - n * mean * mean - (k - 1) * mean * (1 - mean)) / (n - nn / n)) - 1, 1.0), 1000.0) ELSE 1000.0 END AS weight FROM s),
v AS (SELECT host, (f + mean * weight) / (n + weight) > 0.5 AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
"""
