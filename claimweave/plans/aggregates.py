"""Aggregations over the given tables: profiles, edges, contradictions, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.functions import evidence as E
from claimweave.functions import fixed_values as V
from claimweave.functions import relations as R
from claimweave.functions import text as T
from claimweave.operators.corpus import profile
from claimweave.operators.ranking import grouped_median
from claimweave.plans.filters import DICTIONARY, FALSE_NEG_SQL, dictionary
from claimweave.plans.registry import query
from claimweave.plans.scalar import CATEGORY_CASE, LEX
from claimweave.plans.sqltext import any_sql, any_stem_sql, list_sql, values_sql
from claimweave.plans.tables import CLAIMS, SCORED, TOKENS, TYPES, claims, load, scored, tokens
from claimweave.session import stage

LO_HI = "least(source_species, target_species) AS lo, greatest(source_species, target_species) AS hi"


@query(
    "agg_01_table_statistics",
    f"""WITH {CLAIMS} SELECT count(*) AS n, count(DISTINCT source_species) AS n_source, count(DISTINCT target_species) AS n_target, count(DISTINCT interaction_type) AS n_types,
 count(DISTINCT doi) AS n_doi, count(*) FILTER (WHERE label = 1) AS n_pos FROM claims""",
)
def table_statistics(spark, sf):
    """Distinct names are few; a huge distinct count would use ``approx_count_distinct`` instead."""
    return claims(spark, sf).agg(
        F.count("*").alias("n"), F.countDistinct("source_species").alias("n_source"), F.countDistinct("target_species").alias("n_target"),
        F.countDistinct("interaction_type").alias("n_types"), F.countDistinct("doi").alias("n_doi"), F.count_if(F.col("label") == 1).alias("n_pos"),
    )


@query(
    "agg_02_source_profile",
    f"WITH {CLAIMS} SELECT source, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg, round(avg(label), 6) AS pos_rate FROM claims GROUP BY source",
)
def source_profile(spark, sf):
    return profile(claims(spark, sf), ["source"], "label")


@query(
    "agg_03_frequent_pairs",
    f"""WITH {CLAIMS} SELECT interaction_type, source_species, target_species, count(*) AS n FROM claims GROUP BY interaction_type, source_species, target_species QUALIFY row_number() OVER (PARTITION BY interaction_type ORDER BY count(*) DESC, source_species, target_species) <= 5""",
)
def frequent_pairs(spark, sf):
    c = claims(spark, sf).groupBy("interaction_type", "source_species", "target_species").agg(F.count("*").alias("n"))
    rk = F.row_number().over(Window.partitionBy("interaction_type").orderBy(F.desc("n"), "source_species", "target_species"))
    return c.withColumn("rk", rk).where("rk <= 5").drop("rk")


EDGE_COLUMNS = """source_species, interaction_type, target_species, count(*) AS n_passages, max(confidence) AS max_confidence, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE label = 1) AS n_verified"""


@query(
    "agg_04_claim_edges",
    f"""WITH {CLAIMS} SELECT {EDGE_COLUMNS}, array_to_string(list_sort(list(DISTINCT doi))[1:20], ',') AS docs, count(*) FILTER (WHERE label = 1) > 0 AS accepted FROM claims GROUP BY source_species, interaction_type, target_species""",
)
def claim_edges(spark, sf):
    return edges_of(claims(spark, sf)).withColumn("docs", F.array_join("docs", ","))


def edges_of(c):
    """Claims → edges. The 20 listed documents are the feature (a sample shown to readers): distinct
    (edge, doc) rows are ranked with a per-group limit instead of collecting every document of an edge."""
    key = ["source_species", "interaction_type", "target_species"]
    stats = c.groupBy(*key).agg(
        F.count("*").alias("n_passages"), F.max("confidence").alias("max_confidence"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.count_if(F.col("label") == 1).alias("n_verified"),
    )
    d = c.select(*key, "doi").distinct()
    rk = F.row_number().over(Window.partitionBy(*key).orderBy("doi"))
    d = d.withColumn("rk", rk).where("rk <= 20").groupBy(*key).agg(F.array_sort(F.collect_list("doi")).alias("docs"))
    return stats.join(d, key).withColumn("accepted", F.col("n_verified") > 0)


DIRECTED_SQL = "interaction_type NOT IN ('symbioticWith', 'interactsWith')"


@query(
    "agg_05_edge_merge",
    f"""WITH {CLAIMS} SELECT CASE WHEN {DIRECTED_SQL} THEN source_species ELSE least(source_species, target_species) END AS subject, CASE WHEN {DIRECTED_SQL} THEN target_species ELSE greatest(source_species, target_species) END AS object,
 interaction_type AS predicate, round(avg(confidence), 6) AS confidence, count(*) AS n_sources, arg_min(CASE WHEN reads > 40 THEN 'ambiguous' ELSE 'none' END, claim_id) AS flag FROM claims GROUP BY ALL""",
)
def edge_merge(spark, sf):
    c = claims(spark, sf)
    directed = ~F.col("interaction_type").isin("symbioticWith", "interactsWith")
    s, o = F.col("source_species"), F.col("target_species")
    return c.groupBy(
        F.when(directed, s).otherwise(F.least(s, o)).alias("subject"), F.when(directed, o).otherwise(F.greatest(s, o)).alias("object"),
        F.col("interaction_type").alias("predicate"),
    ).agg(
        F.round(F.avg("confidence"), 6).alias("confidence"), F.count("*").alias("n_sources"),
        F.min_by(F.when(F.col("reads") > 40, "ambiguous").otherwise("none"), "claim_id").alias("flag"),
    )


@query(
    "agg_06_graph_statistics",
    f"""WITH {CLAIMS}, e AS (SELECT DISTINCT source_species AS s, interaction_type AS p, target_species AS o, {LO_HI} FROM claims)
 SELECT count(*) AS n_edges, count(*) FILTER (WHERE p NOT IN ('symbioticWith', 'interactsWith')) AS n_directed, count(DISTINCT s) AS n_subjects, count(DISTINCT o) AS n_objects,
  (SELECT count(*) FROM (SELECT s FROM e UNION SELECT o FROM e)) AS n_nodes, count(DISTINCT (lo, hi)) AS n_pairs FROM e""",
)
def graph_statistics(spark, sf):
    e = claims(spark, sf).select("source_species", "interaction_type", "target_species").distinct()
    nodes = e.select(F.explode(F.array("source_species", "target_species")).alias("x")).agg(F.countDistinct("x"))
    return e.agg(
        F.count("*").alias("n_edges"), F.count_if(~F.col("interaction_type").isin("symbioticWith", "interactsWith")).alias("n_directed"),
        F.countDistinct("source_species").alias("n_subjects"), F.countDistinct("target_species").alias("n_objects"),
        F.countDistinct(F.struct(F.least("source_species", "target_species"), F.greatest("source_species", "target_species"))).alias("n_pairs"),
    ).withColumn("n_nodes", nodes.scalar())


@query(
    "agg_07_category_coverage",
    f"""WITH {CLAIMS}, {values_sql("req", ["category", "required"], list(V.CATEGORY_MINIMUMS.items()))}, c AS (SELECT {CATEGORY_CASE} AS category, count(*) AS n FROM claims WHERE label = 1 GROUP BY 1)
 SELECT category, coalesce(n, 0) AS n, required, CAST(greatest(0, required - coalesce(n, 0)) AS BIGINT) AS deficit, CASE WHEN required <= coalesce(n, 0) THEN 'OK' WHEN n IS NULL THEN 'MISSING' ELSE 'LOW' END AS status FROM req LEFT JOIN c USING (category)""",
)
def category_coverage(spark, sf):
    req = spark.createDataFrame(list(V.CATEGORY_MINIMUMS.items()), "category string, required int")
    c = claims(spark, sf).where("label = 1").groupBy("interaction_type", "verb").agg(F.count("*").alias("n"))
    c = c.groupBy(R.category_of("interaction_type", "verb").alias("category")).agg(F.sum("n").alias("n"))
    n = F.coalesce("n", F.lit(0))
    j = req.join(c, "category", "left").select("category", n.alias("n"), "required")
    deficit = F.greatest(F.lit(0), F.col("required") - F.col("n"))
    status = F.when(deficit == 0, "OK").when(F.col("n") == 0, "MISSING").otherwise("LOW")
    return j.select("*", deficit.cast("bigint").alias("deficit"), status.alias("status"))


CONTRADICTION = f"""neg AS (SELECT *, {any_sql("text", V.SENTENCE_NEGATION, "(?i)")} AS negated FROM claims),
ix AS (SELECT lower(source_species) AS a, lower(target_species) AS b, interaction_type AS t, count(*) FILTER (WHERE label = 1 AND NOT negated) AS n_pos, count(*) FILTER (WHERE label = 0 OR negated) AS n_neg FROM neg GROUP BY ALL),
risk AS (SELECT *, CASE WHEN n_pos = 0 THEN CAST(1 AS DOUBLE) WHEN n_neg = 0 THEN CAST(0 AS DOUBLE) ELSE least(CAST(0.9 AS DOUBLE), n_neg / CAST(n_pos + n_neg AS DOUBLE)) END AS base FROM ix)"""


def contradiction_counts(negated):
    """Positive and negative claims of a group; a negated positive counts as negative."""
    return [F.count_if((F.col("label") == 1) & ~negated).alias("n_pos"), F.count_if((F.col("label") == 0) | negated).alias("n_neg")]


def base_risk():
    return (
        F.when(F.col("n_pos") == 0, 1.0).when(F.col("n_neg") == 0, 0.0)
        .otherwise(F.least(F.lit(0.9), F.col("n_neg") / (F.col("n_pos") + F.col("n_neg"))))
    )


def contradiction_index(c):
    """Positive and negative claims per (a, b, type). Claims that carry ``negated`` are not judged again."""
    neg = F.col("negated") if "negated" in c.columns else E.is_negated("text")
    ix = c.groupBy(F.lower("source_species").alias("a"), F.lower("target_species").alias("b"), F.col("interaction_type").alias("t")).agg(*contradiction_counts(neg))
    return ix.withColumn("base", base_risk())


@query(
    "agg_08_contradiction_risk",
    f"""WITH {CLAIMS}, {CONTRADICTION}, q AS (SELECT neg.claim_id, neg.negated, base, n_pos, n_neg FROM neg JOIN risk ON a = lower(source_species) AND b = lower(target_species) AND t = interaction_type)
 SELECT claim_id, n_pos, n_neg, negated, round(CASE WHEN negated THEN least(CAST(1 AS DOUBLE), base + 0.3) ELSE base END, 3) AS risk, round(CASE WHEN negated THEN least(CAST(1 AS DOUBLE), base + 0.3) ELSE base END, 9) > 0.3 AS conflict FROM q""",
)
def contradiction_risk(spark, sf):
    c = claims(spark, sf).select("claim_id", "label", "source_species", "target_species", "interaction_type", E.is_negated("text").alias("negated"))
    return with_risk(stage(c, "claims-judged")).select("claim_id", "n_pos", "n_neg", "negated", "risk", "conflict")


def with_risk(c, index=None):
    """Claims with the risk of their pair in ``index`` (by default the index of the claims themselves)."""
    index = contradiction_index(c) if index is None else index
    index = index.withColumnsRenamed({"a": "_a", "b": "_b", "t": "_t"})
    q = c if "negated" in c.columns else c.withColumn("negated", E.is_negated("text"))
    q = q.withColumns({"_a": F.lower("source_species"), "_b": F.lower("target_species"), "_t": F.col("interaction_type")}).join(index, ["_a", "_b", "_t"], "left").drop("_a", "_b", "_t")
    return risked(q)


def risked(q):
    """Claims that carry ``negated`` and the ``base`` risk of their pair (null when no index knows it)."""
    unknown, negated = F.col("base").isNull(), F.col("negated")
    risk = (
        F.when(unknown & negated, 0.1).when(unknown, 0.0).when(negated, F.least(F.lit(1.0), F.col("base") + 0.3)).otherwise(F.col("base"))
    )
    return q.withColumns({"risk": F.round(risk, 3), "conflict": F.col("base").isNotNull() & (F.round(risk, 9) > 0.3)}).drop("base")


@query(
    "agg_09_doi_index",
    f"""WITH {CLAIMS}, y AS (SELECT *, CASE WHEN reads % 4 = 0 THEN NULL ELSE pub_year END AS yr FROM claims), t AS (SELECT source_species, target_species, interaction_type, arg_min(yr, claim_id) FILTER (WHERE yr IS NOT NULL) AS first_year FROM y GROUP BY ALL),
 d AS (SELECT doi, source_species, target_species, interaction_type, arg_min(confidence, claim_id) AS citation FROM y GROUP BY ALL) SELECT d.doi, source_species, target_species, interaction_type, citation, first_year FROM d JOIN t USING (source_species, target_species, interaction_type)""",
)
def doi_index(spark, sf):
    y = claims(spark, sf).withColumn("yr", F.when(F.col("reads") % 4 != 0, F.col("pub_year")))
    key = ["source_species", "target_species", "interaction_type"]
    t = y.where(F.col("yr").isNotNull()).groupBy(*key).agg(F.min_by("yr", "claim_id").alias("first_year"))
    d = y.groupBy("doi", *key).agg(F.min_by("confidence", "claim_id").alias("citation"))
    return d.join(t, key, "left").select("doi", *key, "citation", "first_year")


NOTICES = """notices AS (SELECT user_id AS paper_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'correction' WHEN 'error' THEN 'retraction' WHEN 'purchase' THEN 'expression of concern' WHEN 'signup' THEN 'other' ELSE 'reinstatement' END AS nature FROM events WHERE event_type <> 'view' OR value > 150)"""


def notices(spark, sf):
    e = load(spark, sf, "events").where("event_type <> 'view' or value > 150")
    kind = (
        F.when(F.col("event_type") == "click", "correction").when(F.col("event_type") == "error", "retraction")
        .when(F.col("event_type") == "purchase", "expression of concern").when(F.col("event_type") == "signup", "other").otherwise("reinstatement")
    )
    return e.select(F.col("user_id").alias("paper_id"), F.col("event_id").alias("seq"), kind.alias("nature"))


def resolve_notices(n):
    """One notice per paper: the last reinstatement if any, else the most severe, first seen on ties."""
    rank = F.lit(0)
    for name, r in V.NOTICE_RANK.items():
        rank = F.when(F.col("nature") == name, r).otherwise(rank)
    worst = F.max_by(F.struct("nature", "seq"), F.when(F.col("nature") != "reinstatement", F.struct(rank, -F.col("seq"))))
    g = n.groupBy("paper_id").agg(F.max(F.when(F.col("nature") == "reinstatement", F.col("seq"))).alias("back"), worst.alias("w"))
    back = F.col("back").isNotNull()
    return g.select(
        "paper_id", F.when(back, "reinstatement").otherwise(F.col("w.nature")).alias("nature"), F.when(back, F.col("back")).otherwise(F.col("w.seq")).alias("seq")
    )


RESOLVED_SQL = """resolved AS (SELECT paper_id, nature, seq FROM notices QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY CASE nature WHEN 'reinstatement' THEN 4 WHEN 'retraction' THEN 3 WHEN 'expression of concern' THEN 2 WHEN 'correction' THEN 1 ELSE 0 END DESC,
  CASE WHEN nature = 'reinstatement' THEN -seq ELSE seq END) = 1)"""


@query("agg_10_notice_resolution", f"WITH {NOTICES}, {RESOLVED_SQL} SELECT paper_id, nature, seq FROM resolved")
def notice_resolution(spark, sf):
    return resolve_notices(notices(spark, sf))


@query(
    "agg_11_contradictory_groups",
    f"WITH {CLAIMS} SELECT text, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos FROM claims GROUP BY text HAVING count(DISTINCT label) > 1",
)
def contradictory_groups(spark, sf):
    g = claims(spark, sf).groupBy("text").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return g.where("lo <> hi").select("text", "n", "n_pos")


@query(
    "agg_12_conflict_resolutions",
    f"""WITH {CLAIMS}, g AS (SELECT text, min(label) AS lo, max(label) AS hi, count(*) AS n FROM claims GROUP BY text)
 SELECT 'set_to_max' AS resolution, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n * hi) AS BIGINT) AS n_pos FROM g UNION ALL SELECT 'drop_group', CAST(sum(n) AS BIGINT), CAST(sum(n * hi) AS BIGINT) FROM g WHERE lo = hi
 UNION ALL SELECT 'collapse', count(*), CAST(sum(hi) AS BIGINT) FROM g""",
)
def conflict_resolutions(spark, sf):
    """Sizes of the three ways to settle contradictory groups, from one aggregation by text."""
    g = claims(spark, sf).groupBy("text").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
    same = F.col("lo") == F.col("hi")
    ways = F.array(
        F.struct(F.lit("set_to_max").alias("resolution"), F.col("n").alias("r"), (F.col("n") * F.col("hi")).alias("p")),
        F.struct(F.lit("drop_group").alias("resolution"), F.when(same, F.col("n")).otherwise(0).alias("r"), F.when(same, F.col("n") * F.col("hi")).otherwise(0).alias("p")),
        F.struct(F.lit("collapse").alias("resolution"), F.lit(1).cast("bigint").alias("r"), F.col("hi").cast("bigint").alias("p")),
    )
    return g.select(F.inline(ways)).groupBy("resolution").agg(F.sum("r").alias("n_rows"), F.sum("p").alias("n_pos"))


@query(
    "agg_13_contradictory_negatives",
    f"""WITH {CLAIMS}, k AS (SELECT claim_id, label, max(label) OVER (PARTITION BY text, source_species, target_species) AS m FROM claims) SELECT claim_id, m AS label, label <> m AS flipped FROM k""",
)
def contradictory_negatives(spark, sf):
    """Negatives whose text and pair also occur as positive are flipped.

    Keyed on the whole text: map-side aggregation and a join back, so a hot text is never one window group.
    """
    c = claims(spark, sf).select("claim_id", "text", "source_species", "target_species", "label")
    key = ["text", "source_species", "target_species"]
    m = c.groupBy(*key).agg(F.max("label").alias("m"))
    return c.join(m, key).select("claim_id", F.col("m").alias("label"), (F.col("label") != F.col("m")).alias("flipped"))


@query(
    "agg_14_label_variance_share",
    f"""WITH {CLAIMS}, g AS (SELECT verb, count(*) AS n, avg(label) AS r FROM claims GROUP BY verb), o AS (SELECT avg(label) AS m, count(*) AS n FROM claims)
 SELECT round(sum(g.n * (r - m) * (r - m)) / max(o.n * m * (1 - m)), 9) AS eta_squared, round(max(CASE WHEN g.n >= 20 THEN r END) - min(CASE WHEN g.n >= 20 THEN r END), 9) AS rate_spread, count(*) AS n_terms, round(max((1 - m) / m), 9) AS pos_weight FROM g, o""",
)
def label_variance_share(spark, sf):
    g = claims(spark, sf).groupBy("verb").agg(F.count("*").alias("n"), F.avg("label").alias("r"), F.sum("label").alias("p"))
    sums = g.agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("n") * F.col("r") * F.col("r")).alias("q"),
        F.max(F.when(F.col("n") >= 20, F.col("r"))).alias("hi"), F.min(F.when(F.col("n") >= 20, F.col("r"))).alias("lo"), F.count("*").alias("n_terms"),
    ).withColumn("m", F.col("p") / F.col("n"))
    m, n = F.col("m"), F.col("n")
    return sums.select(
        F.round((F.col("q") - n * m * m) / (n * m * (1 - m)), 9).alias("eta_squared"), F.round(F.col("hi") - F.col("lo"), 9).alias("rate_spread"),
        "n_terms", F.round((1 - m) / m, 9).alias("pos_weight"),
    )


@query(
    "agg_15_cross_tabulation",
    f"WITH {CLAIMS} SELECT interaction_type, count(*) FILTER (WHERE source_kingdom = 'Animalia') AS \"Animalia\", count(*) FILTER (WHERE source_kingdom = 'Plantae') AS \"Plantae\", count(*) FILTER (WHERE source_kingdom = 'Fungi') AS \"Fungi\" FROM claims GROUP BY 1",
)
def cross_tabulation(spark, sf):
    p = claims(spark, sf).groupBy("interaction_type").pivot("source_kingdom", ["Animalia", "Plantae", "Fungi"]).agg(F.count(F.lit(1)))
    return p.na.fill(0)


@query(
    "agg_16_marginal_effects",
    """SELECT l_linestatus AS regime, CAST(CASE WHEN grouping(l_linenumber) = 0 THEN 'line=' || l_linenumber ELSE 'flag=' || l_returnflag END AS VARCHAR) AS axis, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, max(l_quantity) AS top
 FROM lineitem GROUP BY GROUPING SETS ((l_linestatus, l_linenumber), (l_linestatus, l_returnflag))""",
)
def marginal_effects(spark, sf):
    line = load(spark, sf, "lineitem").select("l_linestatus", "l_linenumber", "l_returnflag", "l_quantity")
    s, a, b = F.col("l_linestatus"), F.col("l_linenumber"), F.col("l_returnflag")
    g = line.groupingSets([[s, a], [s, b]], s, a, b).agg(
        F.grouping("l_linenumber").alias("g"), F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.max("l_quantity").alias("top"),
    )
    axis = F.when(F.col("g") == 0, F.concat(F.lit("line="), a.cast("string"))).otherwise(F.concat(F.lit("flag="), b))
    return g.select(s.alias("regime"), axis.alias("axis"), "n", "mean", "sd", "top")


@query(
    "agg_17_replicate_band",
    f"""WITH {SCORED}, r AS (SELECT source, arm, avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS acc FROM scored GROUP BY ALL)
 SELECT arm, count(*) AS n, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS sd, round(min(acc), 6) AS low, round(max(acc), 6) AS high FROM r GROUP BY arm""",
)
def replicate_band(spark, sf):
    ok = ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")
    r = scored(spark, sf).groupBy("source", "arm").agg(F.avg(ok).alias("acc"))
    return r.groupBy("arm").agg(
        F.count("*").alias("n"), F.round(F.avg("acc"), 6).alias("mean"), F.round(F.stddev_samp("acc"), 6).alias("sd"), F.round(F.min("acc"), 6).alias("low"), F.round(F.max("acc"), 6).alias("high")
    )


@query(
    "agg_18_term_document_frequency",
    f"""WITH {TOKENS}, {DICTIONARY}, d AS (SELECT token, count(DISTINCT doc_id) AS n_docs, count(*) AS n_hits FROM tokens WHERE token IN (SELECT token FROM dictionary) GROUP BY token)
 SELECT token, n_docs, n_hits, round(n_docs / CAST((SELECT count(*) FROM documents) AS DOUBLE), 6) AS share, n_docs * 100 > (SELECT count(*) FROM documents) AS common FROM d""",
)
def term_document_frequency(spark, sf):
    per = tokens(spark, sf).select("doc_id", "token").join(dictionary(spark, sf), "token").groupBy("token", "doc_id").agg(F.count("*").alias("c"))
    d = per.groupBy("token").agg(F.count("*").alias("n_docs"), F.sum("c").alias("n_hits"))
    total = load(spark, sf, "documents").agg(F.count("*")).scalar()
    return d.select("token", "n_docs", "n_hits", F.round(F.col("n_docs") / total, 6).alias("share"), (F.col("n_docs") * 100 > total).alias("common"))


@query(
    "agg_19_surface_vocabulary",
    """WITH v AS (SELECT lower(p_name) AS form FROM part UNION ALL SELECT lower(p_type || ' ' || p_brand) FROM part UNION ALL SELECT lower(p_type) FROM part) SELECT form, count(*) AS n FROM v WHERE regexp_matches(form, '^[a-z ]+$') AND length(form) >= 5 GROUP BY form HAVING count(*) >= 5""",
)
def surface_vocabulary(spark, sf):
    p = load(spark, sf, "part")
    forms = p.select(F.explode(F.array(F.lower("p_name"), F.lower(F.concat_ws(" ", "p_type", "p_brand")), F.lower("p_type"))).alias("form"))
    return forms.where(F.col("form").rlike("^[a-z ]+$") & (F.length("form") >= 5)).groupBy("form").agg(F.count("*").alias("n")).where("n >= 5")


@query(
    "agg_20_lexicon_profile",
    f"""WITH {CLAIMS}, {LEX}, p AS (SELECT source, label, CASE WHEN lex_strength > 0 THEN 1 ELSE 0 END AS sig, lex_strength AS st FROM lex)
 SELECT source, round(avg(CASE WHEN label = 1 THEN sig END), 6) AS p_sig_pos, round(avg(CASE WHEN label = 0 THEN sig END), 6) AS p_sig_neg, round(avg(CASE WHEN label = 1 THEN sig END) - avg(CASE WHEN label = 0 THEN sig END), 6) AS gap,
  round(2 * CAST(sum(sig * label) AS DOUBLE) / (sum(sig) + sum(label)), 6) AS lexicon_f1, round(avg(CASE WHEN label = 1 THEN 1 - sig END), 6) AS zero_signal_pos, round(avg(CASE WHEN label = 0 THEN CASE WHEN st >= 0.4 THEN 1 ELSE 0 END END), 6) AS strong_signal_neg FROM p GROUP BY source""",
)
def lexicon_profile(spark, sf):
    c = E.with_lexicon(claims(spark, sf).select("source", "label", "text"), "text")
    sig = (F.col("lex_strength") > 0).cast("int")
    pos, neg = F.col("label") == 1, F.col("label") == 0
    a = lambda cond, v: F.avg(F.when(cond, v))
    return c.groupBy("source").agg(
        F.round(a(pos, sig), 6).alias("p_sig_pos"), F.round(a(neg, sig), 6).alias("p_sig_neg"), F.round(a(pos, sig) - a(neg, sig), 6).alias("gap"),
        F.round(2.0 * F.sum(sig * F.col("label")) / (F.sum(sig) + F.sum("label")), 6).alias("lexicon_f1"),
        F.round(a(pos, 1 - sig), 6).alias("zero_signal_pos"), F.round(a(neg, (F.col("lex_strength") >= 0.4).cast("int")), 6).alias("strong_signal_neg"),
    )


@query(
    "agg_34_majority_vote",
    """WITH v AS (SELECT user_id AS item, CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN 1 ELSE 0 END AS vote, CASE WHEN value > 250 THEN 1 END AS gold FROM events)
 SELECT item, coalesce(CAST(max(gold) AS INTEGER), CASE WHEN avg(vote) >= 0.5 THEN 1 ELSE 0 END) AS label, min(vote) = max(vote) AS unanimous, count(*) AS n_votes FROM v GROUP BY item""",
)
def majority_vote(spark, sf):
    vote = F.col("event_type").isin("purchase", "signup", "click").cast("int")
    gold = F.max(F.when(F.col("value") > 250, 1))
    return load(spark, sf, "events").groupBy(F.col("user_id").alias("item")).agg(
        F.coalesce(gold, F.when(F.avg(vote) >= 0.5, 1).otherwise(0)).alias("label"), (F.min(vote) == F.max(vote)).alias("unanimous"), F.count("*").alias("n_votes")
    )


@query(
    "agg_35_curation_statistics",
    """WITH d AS (SELECT user_id % 40 AS item, user_id AS author, event_type, CASE WHEN value > 60 THEN 1 ELSE 0 END AS lab, event_id FROM events),
 s AS (SELECT event_type AS source, count(*) AS n, count(*) FILTER (WHERE lab = 1) AS n_pos, round(avg(lab), 6) AS pos_rate FROM d GROUP BY 1),
 l AS (SELECT item, author, event_type, lab FROM d QUALIFY row_number() OVER (PARTITION BY item, author, event_type ORDER BY event_id DESC) = 1),
 a AS (SELECT event_type AS source, item, count(*) AS k, sum(lab) AS p FROM l GROUP BY 1, 2)
 SELECT source, n, n_pos, pos_rate, CAST(sum(k * (k - 1) / 2) AS BIGINT) AS n_author_pairs, round(sum(p * (p - 1) / 2 + (k - p) * (k - p - 1) / 2) / nullif(CAST(sum(k * (k - 1) / 2) AS DOUBLE), 0), 6) AS agreement FROM s JOIN a USING (source) GROUP BY ALL""",
)
def curation_statistics(spark, sf):
    """Status counts per source, and agreement over all pairs of authors of an item.

    Agreeing pairs follow from the counts of each answer (k over 2), so no pair is ever formed.
    """
    d = load(spark, sf, "events").select(
        (F.col("user_id") % 40).alias("item"), F.col("user_id").alias("author"), F.col("event_type").alias("source"),
        (F.col("value") > 60).cast("int").alias("lab"), "event_id",
    )
    s = d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lab") == 1).alias("n_pos"), F.round(F.avg("lab"), 6).alias("pos_rate"))
    last = d.groupBy("item", "author", "source").agg(F.max_by("lab", "event_id").alias("lab"))
    a = last.groupBy("source", "item").agg(F.count("*").alias("k"), F.sum("lab").alias("p"))
    two = lambda x: x * (x - 1) / 2
    k, p = F.col("k"), F.col("p")
    g = a.groupBy("source").agg(F.sum(two(k)).alias("pairs"), F.sum(two(p) + two(k - p)).alias("same"))
    return s.join(g, "source").select("source", "n", "n_pos", "pos_rate", F.col("pairs").cast("bigint").alias("n_author_pairs"), F.round(F.try_divide("same", "pairs"), 6).alias("agreement"))


@query(
    "agg_38_trust_summary",
    f"""WITH {CLAIMS} SELECT source, count(*) AS n, round(avg(confidence), 6) AS mean, min(confidence) AS low, max(confidence) AS high, count(*) FILTER (WHERE reads = 7) AS n_retracted, count(*) FILTER (WHERE confidence < 0.4) AS n_low FROM claims GROUP BY source""",
)
def trust_summary(spark, sf):
    return claims(spark, sf).groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.min("confidence").alias("low"), F.max("confidence").alias("high"),
        F.count_if(F.col("reads") == 7).alias("n_retracted"), F.count_if(F.col("confidence") < 0.4).alias("n_low"),
    )


#: Types that the positives of a corpus should cover; the last one no claim has.
REQUIRED_TYPES = [*TYPES, "visitsFlowersOf"]


@query(
    "agg_39_quality_gates",
    f"""WITH {CLAIMS}, {LEX}, c AS (SELECT *, CASE WHEN label = 1 THEN interaction_type WHEN pos = 6 THEN 'none' ELSE 'none_two_species' END AS itype FROM lex),
 f AS (SELECT label, itype, label = 1 AND NOT lex_signal AS silent, label = 0 AND lex_strong > 0 AND NOT lex_negated AS loud, target_species LIKE '%rod' AS unknown, interaction_type = 'pollinates' AND target_kingdom <> 'Plantae' AND label = 1 AS violation, contains(text, '{{') OR NOT regexp_matches(trim(text), '[.?!]$') AS defect,
   label = 0 AND {FALSE_NEG_SQL} AS false_neg, label = 0 AND (itype IN ({list_sql(V.HARD_NEGATIVE_TYPES)}) OR (itype = 'none' AND {any_stem_sql("lower(text)", V.HARD_NEGATIVE_WORDS)})) AS hard FROM c),
 p AS (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM f WHERE label = 0 GROUP BY itype)),
 m AS (SELECT coalesce(string_agg(t, ',' ORDER BY t), '') AS missing FROM (SELECT unnest([{list_sql(REQUIRED_TYPES)}]) AS t) WHERE t NOT IN (SELECT itype FROM f WHERE label = 1))
 SELECT count(*) AS n, round(avg(CAST(unknown AS INTEGER)), 6) AS unknown_rate, round(count(*) FILTER (WHERE violation) / CAST(sum(label) AS DOUBLE), 6) AS violation_rate, count(*) FILTER (WHERE defect) AS n_defects, count(*) FILTER (WHERE false_neg) AS n_false_neg,
  round(max(top) / CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE), 6) AS top_pattern_share, round(count(*) FILTER (WHERE hard) / CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE), 6) AS hard_share, round(avg(label), 6) AS pos_ratio,
  avg(CAST(unknown AS INTEGER)) <= 0.01 AS gate_1, count(*) FILTER (WHERE violation) / CAST(sum(label) AS DOUBLE) <= 0.005 AS gate_2, count(*) FILTER (WHERE defect) = 0 AS gate_3,
  count(*) FILTER (WHERE false_neg) = 0 AND max(top) / CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) <= 0.7 AND count(*) FILTER (WHERE hard) / CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) >= 0.5 AS gate_4, avg(label) BETWEEN 0.2 AND 0.5 AS gate_5,
  max(missing) AS missing_types, len(list_filter(string_split(max(missing), ','), lambda t: t <> '')) <= 3 AS gate_5_types, round(count(*) FILTER (WHERE silent) / CAST(sum(label) AS DOUBLE), 6) AS silent_rate, count(*) FILTER (WHERE silent) / CAST(sum(label) AS DOUBLE) <= 0.2 AS gate_6_positives,
  round(count(*) FILTER (WHERE loud) / CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE), 6) AS loud_rate, count(*) FILTER (WHERE loud) / CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) <= 0.02 AS gate_6_negatives,
  count(*) FILTER (WHERE NOT (unknown OR violation OR defect OR false_neg)) AS n_clean FROM f, p, m""",
)
def quality_gates(spark, sf):
    c = E.with_lexicon(claims(spark, sf), "text")
    itype = F.when(F.col("label") == 1, F.col("interaction_type")).when(F.col("pos") == 6, "none").otherwise("none_two_species")
    neg, pos = F.col("label") == 0, F.col("label") == 1
    hard_words = T.contains_any(F.lower("text"), V.HARD_NEGATIVE_WORDS)
    f = c.withColumn("itype", itype).select(
        "label", "itype", (pos & ~F.col("lex_signal")).alias("silent"), (neg & (F.col("lex_strong") > 0) & ~F.col("lex_negated")).alias("loud"),
        F.col("target_species").endswith("rod").alias("unknown"),
        ((F.col("interaction_type") == "pollinates") & (F.col("target_kingdom") != "Plantae") & pos).alias("violation"),
        (F.col("text").contains("{") | ~F.trim("text").rlike("[.?!]$")).alias("defect"), (neg & T.false_negative("text")).alias("false_neg"),
        (neg & (F.col("itype").isin(V.HARD_NEGATIVE_TYPES) | ((F.col("itype") == "none") & hard_words))).alias("hard"),
    )
    return gate_report(f, REQUIRED_TYPES)


def gate_report(f, required):
    """Six-gate report from per-row flags: counted per (label, type) first, then one small aggregation.

    ``silent`` are positives without a lexical signal, ``loud`` negatives with a strong term that nothing negates;
    ``required`` are the types of which positives should hold nearly all.
    """
    flags = ["unknown", "violation", "defect", "false_neg", "hard", "silent", "loud"]
    clean = ~(F.col("unknown") | F.col("violation") | F.col("defect") | F.col("false_neg"))
    g = f.groupBy("label", "itype").agg(F.count("*").alias("n"), F.count_if(clean).alias("clean"), *[F.count_if(x).alias(x) for x in flags])
    neg = F.col("label") == 0
    s = g.agg(
        F.sum("n").alias("n"), F.sum(F.when(neg, F.col("n"))).alias("nn"), F.max(F.when(neg, F.col("n"))).alias("top"), F.sum("clean").alias("n_clean"),
        F.array_sort(F.array_except(F.array(*[F.lit(t) for t in required]), F.collect_set(F.when(~neg, F.col("itype"))))).alias("missing"), *[F.sum(x).alias(x) for x in flags],
    )
    n, nn = F.col("n"), F.col("nn")
    np_ = n - nn
    lim = V.GATE_LIMITS
    unknown, violation, top, hard, pos = F.col("unknown") / n, F.col("violation") / np_, F.col("top") / nn, F.col("hard") / nn, np_ / n
    return s.select(
        "n", F.round(unknown, 6).alias("unknown_rate"), F.round(violation, 6).alias("violation_rate"), F.col("defect").alias("n_defects"), F.col("false_neg").alias("n_false_neg"),
        F.round(top, 6).alias("top_pattern_share"), F.round(hard, 6).alias("hard_share"), F.round(pos, 6).alias("pos_ratio"),
        (unknown <= lim["unknown_names"]).alias("gate_1"), (violation <= lim["rule_violations"]).alias("gate_2"), (F.col("defect") == 0).alias("gate_3"),
        ((F.col("false_neg") == 0) & (top <= lim["single_pattern"]) & (hard >= lim["hard_negatives"])).alias("gate_4"),
        pos.between(lim["positive_low"], lim["positive_high"]).alias("gate_5"), "n_clean",
        F.array_join("missing", ",").alias("missing_types"), (F.size("missing") <= lim["missing_types"]).alias("gate_5_types"),
        F.round(F.col("silent") / np_, 6).alias("silent_rate"), (F.col("silent") / np_ <= lim["positives_without_signal"]).alias("gate_6_positives"),
        F.round(F.col("loud") / nn, 6).alias("loud_rate"), (F.col("loud") / nn <= lim["negatives_with_strong_term"]).alias("gate_6_negatives"),
    )


@query(
    "agg_43_grouped_description",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, max(l_extendedprice) AS top FROM lineitem GROUP BY ALL",
)
def grouped_description(spark, sf):
    """Moments by map-side aggregation, the exact median from value counts."""
    line = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    by = ["l_returnflag", "l_linestatus"]
    g = line.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.max("l_extendedprice").alias("top"))
    m = grouped_median(line, by, "l_extendedprice").select(*by, F.round("median", 4).alias("median"))
    return g.join(m, by)
