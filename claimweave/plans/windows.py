"""Window, top-k and set operators over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.functions.hashing import seeded_md5
from claimweave.operators.corpus import keep_first, keep_last
from claimweave.operators.ranking import top_n
from claimweave.plans.filters import GOOD_SQL
from claimweave.plans.joins import MENTIONS, mentions
from claimweave.plans.registry import query
from claimweave.plans.sqltext import norm_ascii_sql
from claimweave.plans.tables import CLAIMS, SENTENCES, claims, load, sentences


@query(
    "win_01_keep_first",
    f"WITH {CLAIMS} SELECT source_species, target_species, interaction_type, claim_id, doi FROM claims QUALIFY row_number() OVER (PARTITION BY source_species, target_species, interaction_type ORDER BY doc_id, claim_id) = 1",
)
def keep_first_claim(spark, sf):
    c = claims(spark, sf).select("source_species", "target_species", "interaction_type", "claim_id", "doi", "doc_id")
    return keep_first(c, ["source_species", "target_species", "interaction_type"], ["doc_id", "claim_id"]).drop("doc_id")


@query(
    "win_02_interleaved_cap",
    f"""WITH {CLAIMS}, r AS (SELECT claim_id, source_species, target_species, row_number() OVER (PARTITION BY source_species, target_species ORDER BY md5('42|' || claim_id), claim_id) AS rk FROM claims)
 SELECT claim_id, rk FROM r WHERE rk <= 3 ORDER BY rk, md5('42|' || source_species || '|' || target_species), claim_id LIMIT 2000""",
)
def interleaved_cap(spark, sf):
    """Three rows per pair, one round of pairs after the other, the first 2000 rows."""
    c = claims(spark, sf).select("claim_id", "source_species", "target_species")
    r = top_n(c, ["source_species", "target_species"], [seeded_md5("42", "claim_id"), "claim_id"], 3)
    return r.orderBy("rk", seeded_md5("42", "source_species", "target_species"), "claim_id").limit(2000).select("claim_id", F.col("rk").cast("bigint").alias("rk"))


@query(
    "win_04_group_distinct_count",
    f"WITH {CLAIMS}, g AS (SELECT doc_id, count(DISTINCT target_species) AS n_pairs FROM claims GROUP BY doc_id) SELECT claim_id, n_pairs FROM claims JOIN g USING (doc_id) WHERE n_pairs > 1",
)
def group_distinct_count(spark, sf):
    c = claims(spark, sf).select("claim_id", "doc_id", "target_species")
    g = c.groupBy("doc_id").agg(F.countDistinct("target_species").alias("n_pairs")).where("n_pairs > 1")
    return c.join(g, "doc_id").select("claim_id", "n_pairs")


@query(
    "win_05_best_support",
    f"WITH {CLAIMS} SELECT source_species, target_species, claim_id, confidence FROM claims QUALIFY row_number() OVER (PARTITION BY source_species, target_species ORDER BY confidence DESC, claim_id) = 1",
)
def best_support(spark, sf):
    best = F.min_by(F.struct("claim_id", "confidence"), F.struct(-F.col("confidence"), "claim_id")).alias("b")
    return claims(spark, sf).groupBy("source_species", "target_species").agg(best).select("source_species", "target_species", "b.*")


@query("win_06_first_mentions", f"WITH {MENTIONS} SELECT doc_id, sent_id, name, CAST(pos - 1 AS INTEGER) AS pos FROM mentions")
def first_mentions(spark, sf):
    return mentions(spark, sf).select("doc_id", "sent_id", "name", "pos")


@query(
    "win_10_tiered_top_n",
    f"""WITH {CLAIMS}, t AS (SELECT doc_id, claim_id, CASE pos WHEN 6 THEN 0 WHEN 5 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS tier FROM claims WHERE label = 0) SELECT doc_id, claim_id, tier FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tier, claim_id) <= 2""",
)
def tiered_top_n(spark, sf):
    tier = F.when(F.col("pos") == 6, 0).when(F.col("pos") == 5, 1).when(F.col("pos") == 3, 2).otherwise(3)
    t = claims(spark, sf).where("label = 0").select("doc_id", "claim_id", tier.alias("tier"))
    return top_n(t, ["doc_id"], ["tier", "claim_id"], 2).drop("rk")


@query(
    "win_11_category_quota",
    f"""WITH {CLAIMS}, p AS (SELECT claim_id, text, interaction_type, CASE interaction_type WHEN 'preysOn' THEN 0 WHEN 'parasiteOf' THEN 1 WHEN 'pathogenOf' THEN 9 ELSE 5 END AS prio FROM claims WHERE label = 1),
 d AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY md5(lower(trim(text))) ORDER BY prio, claim_id) = 1) SELECT interaction_type, claim_id FROM d QUALIFY row_number() OVER (PARTITION BY interaction_type ORDER BY claim_id) <= 500""",
)
def category_quota(spark, sf):
    """One row per text by category priority, then a quota per category."""
    prio = F.when(F.col("interaction_type") == "preysOn", 0).when(F.col("interaction_type") == "parasiteOf", 1).when(F.col("interaction_type") == "pathogenOf", 9).otherwise(5)
    p = claims(spark, sf).where("label = 1").select("claim_id", "interaction_type", prio.alias("prio"), F.md5(F.lower(F.trim("text"))).alias("h"))
    return top_n(keep_first(p, ["h"], ["prio", "claim_id"]), ["interaction_type"], ["claim_id"], 500).select("interaction_type", "claim_id")


DECISIONS = """log AS (SELECT user_id AS item_id, event_id, ts, CASE WHEN event_type = 'error' THEN -1 WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS label, least(value / 100, CAST(1 AS DOUBLE)) AS confidence FROM events)"""


def decisions(spark, sf):
    label = F.when(F.col("event_type") == "error", -1).when(F.col("event_type").isin("view", "click"), 0).otherwise(1)
    return load(spark, sf, "events").select(
        F.col("user_id").alias("item_id"), "event_id", "ts", label.alias("label"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence")
    )


@query(
    "win_15_latest_decision",
    f"""WITH {DECISIONS} SELECT item_id, event_id, label, CASE WHEN label = -1 THEN 'skipped' WHEN confidence >= 0.7 THEN 'approved' ELSE 'uncertain' END AS status FROM log QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_decision(spark, sf):
    """Append-only log → current state; everything below 0.7 is uncertain."""
    last = keep_last(decisions(spark, sf), ["item_id"], ["ts", "event_id"])
    status = F.when(F.col("label") == -1, "skipped").when(F.col("confidence") >= 0.7, "approved").otherwise("uncertain")
    return last.select("item_id", "event_id", "label", status.alias("status"))


@query(
    "win_16_running_rates",
    """WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_err FROM events GROUP BY 1)
 SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS seen, CAST(sum(n_err) OVER (ORDER BY day) AS BIGINT) AS errors, round(sum(n_err) OVER (ORDER BY day) / CAST(sum(n) OVER (ORDER BY day) AS DOUBLE), 6) AS rate FROM d""",
)
def running_rates(spark, sf):
    """Counters per day, then a running total over the days (one row each)."""
    d = load(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    seen, err = F.sum("n").over(w), F.sum("e").over(w)
    return d.select("day", seen.alias("seen"), err.alias("errors"), F.round(err / seen, 6).alias("rate"))


@query(
    "top_01_work_queue",
    f"""WITH {DECISIONS}, q AS (SELECT event_id, label, confidence, round(abs(CASE WHEN label = -1 THEN CAST(0.5 AS DOUBLE) ELSE label END - confidence), 6) AS disagreement FROM log WHERE confidence < 0.7) SELECT event_id, label, disagreement FROM q ORDER BY disagreement DESC, confidence DESC, event_id LIMIT 150""",
)
def work_queue(spark, sf):
    """Pending items by disagreement of stored label and heuristic; an unknown label (-1) counts as 0.5."""
    known = F.when(F.col("label") == -1, 0.5).otherwise(F.col("label").cast("double"))
    q = decisions(spark, sf).where("confidence < 0.7").withColumn("disagreement", F.round(F.abs(known - F.col("confidence")), 6))
    return q.orderBy(F.desc("disagreement"), F.desc("confidence"), "event_id").limit(150).select("event_id", "label", "disagreement")


@query(
    "top_02_values_per_category",
    f"WITH {CLAIMS}, c AS (SELECT interaction_type, target_species, count(*) AS n FROM claims GROUP BY ALL) SELECT interaction_type, target_species, n FROM c QUALIFY row_number() OVER (PARTITION BY interaction_type ORDER BY n DESC, target_species) <= 10",
)
def values_per_category(spark, sf):
    c = claims(spark, sf).groupBy("interaction_type", "target_species").agg(F.count("*").alias("n"))
    return top_n(c, ["interaction_type"], [F.desc("n"), "target_species"], 10).drop("rk")


@query(
    "top_05_best_sentence",
    f"""WITH {SENTENCES}, s AS (SELECT doc_id, sent_id, length(sentence) AS n, len(regexp_extract_all(sentence, '[A-Z][a-z]+ [a-z]+')) AS b FROM sentences WHERE {GOOD_SQL}),
 c AS (SELECT *, least(n / CAST(60 AS DOUBLE), CAST(1 AS DOUBLE)) * 40 + least(b, 2) * 15 + CASE WHEN n BETWEEN 100 AND 300 THEN 20 WHEN n BETWEEN 50 AND 400 THEN 10 ELSE 0 END - CASE WHEN n < 40 THEN 20 ELSE 0 END AS score FROM s)
 SELECT doc_id, sent_id, CAST(score AS DOUBLE) AS score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_id) = 1""",
)
def best_sentence(spark, sf):
    n, b = F.length("sentence"), F.regexp_count("sentence", F.lit("[A-Z][a-z]+ [a-z]+"))
    band = F.when(n.between(100, 300), 20).when(n.between(50, 400), 10).otherwise(0)
    score = F.least(n / F.lit(60.0), F.lit(1.0)) * 40 + F.least(b, F.lit(2)) * 15 + band - F.when(n < 40, 20).otherwise(0)
    s = sentences(spark, sf).where(T.good_sentence("sentence")).select("doc_id", "sent_id", score.alias("score"))
    best = F.min_by(F.struct("sent_id", "score"), F.struct(-F.col("score"), "sent_id")).alias("b")
    return s.groupBy("doc_id").agg(best).select("doc_id", "b.*")


@query("top_07_seeded_shuffle", "SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS position FROM orders")
def seeded_shuffle(spark, sf):
    """Position of every row in the seeded order, ranked by digest bucket rather than in one task."""
    from claimweave.operators.ranking import hash_rank

    o = load(spark, sf, "orders").select("o_orderkey", F.lit(0).alias("all"))
    return hash_rank(o, ["all"], ["o_orderkey"], "42", "position").select("o_orderkey", "position")


@query(
    "set_01_union_sources",
    """SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, NULL::VARCHAR AS role FROM documents UNION ALL SELECT CAST(item_id AS VARCHAR), text, NULL, NULL FROM benchmark UNION ALL SELECT conv_id || '-' || turn, text, NULL, role FROM conversations""",
)
def union_sources(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    b = load(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    c = load(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", "role")
    return d.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True).select("id", "text", "lang", "role")


def ranked_sources(spark, sf):
    c = claims(spark, sf).select("claim_id", "text", "source", F.substring("source", 4, 1).cast("int").alias("source_rank"))
    return c.withColumn("k", T.norm_space(F.lower("text")))


@query(
    "set_02_incremental_union",
    f"WITH {CLAIMS} SELECT claim_id, source FROM claims QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '[ \\t\\r\\n\\f]+', ' ', 'g')) ORDER BY source, claim_id) = 1",
)
def incremental_union(spark, sf):
    """Each source deduplicated against all earlier ones: one aggregation with a source rank, not one pass per source."""
    return keep_first(ranked_sources(spark, sf).drop("text"), ["k"], ["source_rank", "claim_id"]).select("claim_id", "source")


@query(
    "set_03_priority_merge",
    f"WITH {CLAIMS} SELECT claim_id, source FROM claims QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '[ \\t\\r\\n\\f]+', ' ', 'g')) ORDER BY source DESC, claim_id DESC) = 1",
)
def priority_merge(spark, sf):
    return keep_last(ranked_sources(spark, sf).drop("text"), ["k"], ["source_rank", "claim_id"]).select("claim_id", "source")


@query("set_04_except", f"SELECT DISTINCT {norm_ascii_sql('text')} AS k FROM documents EXCEPT SELECT {norm_ascii_sql('text')} FROM benchmark")
def except_texts(spark, sf):
    k = T.norm_ascii("text").alias("k")
    return load(spark, sf, "documents").select(k).subtract(load(spark, sf, "benchmark").select(k))


@query(
    "set_05_intersect_counts",
    """WITH s AS (SELECT DISTINCT l_suppkey % 10 AS a, l_partkey AS t FROM lineitem) SELECT 'even_odd' AS sets, count(*) AS n FROM (SELECT t FROM s WHERE a % 2 = 0 INTERSECT SELECT t FROM s WHERE a % 2 = 1)
 UNION ALL SELECT 'low_high', count(*) FROM (SELECT t FROM s WHERE a < 2 INTERSECT SELECT t FROM s WHERE a > 7)""",
)
def intersect_counts(spark, sf):
    s = load(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("a"), F.col("l_partkey").alias("t"))
    pick = lambda cond: s.where(cond).select("t")
    one = pick("a % 2 = 0").intersect(pick("a % 2 = 1")).agg(F.lit("even_odd").alias("sets"), F.count("*").alias("n"))
    two = pick("a < 2").intersect(pick("a > 7")).agg(F.lit("low_high").alias("sets"), F.count("*").alias("n"))
    return one.unionByName(two)


@query("set_06_vocabulary", f"WITH {CLAIMS} SELECT source_species AS name FROM claims UNION SELECT target_species FROM claims")
def vocabulary(spark, sf):
    return claims(spark, sf).select(F.explode(F.array("source_species", "target_species")).alias("name")).distinct()


@query(
    "set_07_symmetric_expansion",
    f"WITH {CLAIMS}, e AS (SELECT DISTINCT source_species AS s, target_species AS o FROM claims WHERE interaction_type IN ('symbioticWith', 'interactsWith')) SELECT s, o FROM e UNION SELECT o, s FROM e",
)
def symmetric_expansion(spark, sf):
    e = claims(spark, sf).where(F.col("interaction_type").isin("symbioticWith", "interactsWith")).select(F.col("source_species").alias("s"), F.col("target_species").alias("o")).distinct()
    return e.select(F.inline(F.array(F.struct(F.col("s"), F.col("o")), F.struct(F.col("o").alias("s"), F.col("s").alias("o"))))).distinct()


