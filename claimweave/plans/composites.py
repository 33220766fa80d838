"""Corpus-level composites, and the mention and direction functions they rest on."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import evidence as E
from claimweave.functions import fixed_values as V
from claimweave.functions import mentions as MN
from claimweave.functions import relations as R
from claimweave.functions import text as T
from claimweave.operators import leakage as L
from claimweave.operators import metrics as ME
from claimweave.operators import taxonomy as TX
from claimweave.operators.build import SourceSpec, build_corpus
from claimweave.operators.corpus import keep_first
from claimweave.operators.ranking import top_n
from claimweave.plans.evaluation import DELTA, boot_sql, paired_sql
from claimweave.plans.filters import FALSE_NEG_SQL, GOOD_SQL
from claimweave.plans.joins import NEAR_SQL
from claimweave.plans.registry import query
from claimweave.plans.sampling import match_marginals
from claimweave.plans.scalar import LEX
from claimweave.plans.sources import digest_sql, taxonomy_dump
from claimweave.plans.sqltext import any_sql, list_sql, q, values_sql, words_sql
from claimweave.plans.tables import CLAIMS, SCORED, claims, load, scored
from claimweave.session import stage
from claimweave.sources.readers import explode_ontology
from claimweave.sources.writers import manifest

NAMED = f"""{CLAIMS}, named AS (SELECT claim_id, text, CASE reads % 4 WHEN 0 THEN target_species WHEN 1 THEN 'Nothing here|' || target_species WHEN 2 THEN split_part(target_species, ' ', 1) || ' alba' ELSE source_species || 's' END AS name FROM claims)"""


def named(spark, sf):
    r = F.col("reads") % 4
    name = (
        F.when(r == 0, F.col("target_species")).when(r == 1, F.concat(F.lit("Nothing here|"), "target_species"))
        .when(r == 2, F.concat(F.split_part("target_species", F.lit(" "), F.lit(1)), F.lit(" alba"))).otherwise(F.concat("source_species", F.lit("s")))
    )
    return claims(spark, sf).select("claim_id", "text", name.alias("name"))


@query(
    "str_09_mention_location",
    f"""WITH {NAMED}, a AS (SELECT claim_id, text, string_split(name, '|') AS alts FROM named), f AS (SELECT claim_id, text, list_concat(alts, flatten(list_transform(alts, lambda a: list_filter([CASE WHEN contains(a, ' ') THEN string_split(a, ' ')[1] END, CASE WHEN contains(a, ' ') THEN string_split(a, ' ')[-1] END, a || 's',
   CASE WHEN regexp_replace(a, 's+$', '') <> a THEN regexp_replace(a, 's+$', '') END], lambda x: x IS NOT NULL)))) AS forms FROM a), h AS (SELECT claim_id, text, list_filter(forms, lambda x: regexp_matches(text, '(?i)\\b' || x || '\\b'))[1] AS form FROM f)
 SELECT claim_id, form, CASE WHEN form IS NOT NULL THEN CAST(length(regexp_extract(text, '(?is)^(.*?)\\b' || form || '\\b', 1)) + 1 AS INTEGER) END AS start FROM h""",
)
def mention_location(spark, sf):
    n = named(spark, sf).withColumn("l", MN.locate("name", "text"))
    return n.select("claim_id", "l.form", "l.start")


@query(
    "str_15_direction_baselines",
    f"""WITH {CLAIMS}, p AS (SELECT claim_id, strpos(text, source_species) AS a, strpos(text, source_species) + length(source_species) AS ae, strpos(text, target_species) AS b, strpos(text, target_species) + length(target_species) AS be, strpos(text, verb) AS r, verb FROM claims),
 g AS (SELECT *, CASE WHEN a > 0 AND r > 0 AND ae <= r THEN r - ae END AS ga, CASE WHEN b > 0 AND r > 0 AND be <= r THEN r - be END AS gb FROM p), l AS (SELECT *, CASE WHEN ga IS NOT NULL AND (gb IS NULL OR ga < gb) THEN 1 WHEN gb IS NOT NULL THEN 2 END AS lf FROM g)
 SELECT claim_id, 1 AS stored, CASE WHEN a > 0 AND b > 0 THEN CASE WHEN a <= b THEN 1 ELSE 2 END END AS by_order, CASE WHEN a > 0 AND b > 0 AND r > 0 AND lf IS NOT NULL THEN CASE WHEN regexp_matches(lower(verb), '\\bby\\b') THEN 3 - lf ELSE lf END END AS by_syntax FROM l""",
)
def direction_baselines(spark, sf):
    at = lambda c: F.expr(f"instr(text, {c})")
    a, b, r = at("source_species"), at("target_species"), at("verb")
    syntax = MN.subject_by_syntax(a, a + F.length("source_species"), b, b + F.length("target_species"), r, R.voice("verb"))
    return claims(spark, sf).select("claim_id", F.lit(1).alias("stored"), MN.subject_by_order(a, b).alias("by_order"), syntax.alias("by_syntax"))


CLADES = {"AFRICA": "Insecta", "AMERICA": "Fungi", "ASIA": "Bacteria", "EUROPE": "Vertebrata", "MIDDLE EAST": "Viruses"}


@query(
    "str_16_clade_roles",
    f"""WITH {CLAIMS}, {values_sql("prior", ["clade", "score"], list(V.CLADE_PRIOR.items()))}, {values_sql("m", ["r_name", "clade"], list(CLADES.items()))},
 lin AS (SELECT 's' || s_suppkey AS id, m.clade FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN m USING (r_name) UNION ALL SELECT 's' || s_suppkey, 'Nematoda' FROM supplier WHERE s_nationkey % 5 = 0),
 sc AS (SELECT id, max(score) AS score FROM lin JOIN prior USING (clade) GROUP BY id)
 SELECT id, CAST(score AS INTEGER) AS role_score, CAST(CASE WHEN score = 50 THEN 0 WHEN score > 50 THEN 1 ELSE 2 END AS INTEGER) AS subject FROM sc""",
)
def clade_roles(spark, sf):
    """Best clade prior over the lineage of a name; the subject against an insect under an agent-first relation."""
    concepts, _ = explode_ontology(taxonomy_dump(spark, sf))
    lin = TX.lineage(concepts)
    names = spark.createDataFrame(list(CLADES.items()), "pref string, clade string")
    by_region = concepts.join(names, "pref").select(F.col("id").alias("ancestor"), "clade")
    by_nation = concepts.where("rank = 'genus'").where(F.substring("id", 2, 9).cast("int") % 5 == 0).select(F.col("id").alias("ancestor"), F.lit("Nematoda").alias("clade"))
    prior = spark.createDataFrame(list(V.CLADE_PRIOR.items()), "clade string, score int")
    clades = by_region.unionByName(by_nation).join(F.broadcast(prior), "clade")
    s = lin.join(clades, "ancestor").where(F.col("id").startswith("s")).groupBy("id").agg(F.max("score").alias("role_score"))
    return s.select("id", "role_score", R.subject_from_role(F.col("role_score"), F.lit(V.CLADE_PRIOR["Insecta"]), F.lit(1)).alias("subject"))


@query(
    "str_32_abbreviated_mentions",
    f"""WITH {CLAIMS}, t AS (SELECT claim_id, replace(text, target_species, CASE WHEN reads % 2 = 0 THEN substr(target_species, 1, 1) || '. ' || split_part(target_species, ' ', 2) ELSE target_species END) AS text, target_species FROM claims)
 SELECT claim_id, regexp_matches(text, '(?i)\\b' || substr(target_species, 1, 1) || '\\.\\s*' || split_part(target_species, ' ', 2) || '\\b') AS abbreviated FROM t""",
)
def abbreviated_mentions(spark, sf):
    short = F.concat(F.substring("target_species", 1, 1), F.lit(". "), F.split_part("target_species", F.lit(" "), F.lit(2)))
    text = F.replace("text", "target_species", F.when(F.col("reads") % 2 == 0, short).otherwise(F.col("target_species")))
    return claims(spark, sf).select("claim_id", F.regexp_like(text, MN.abbreviated_pattern("target_species")).alias("abbreviated"))


@query(
    "str_33_species_mentions",
    f"""WITH {CLAIMS}, known AS (SELECT DISTINCT split_part(source_species, ' ', 1) AS genus FROM claims), m AS (SELECT claim_id, string_split_regex(text, {q(V.BINOMIAL_CAP.replace("([A-Z][a-z]{2,})", "(?:[A-Z][a-z]{2,})").replace("([a-z]{4,})", "(?:[a-z]{4,})"))}) AS gaps, regexp_extract_all(text, {q(V.BINOMIAL_CAP)}) AS ms, regexp_extract_all(text, {q(V.BINOMIAL_CAP)}, 1) AS gs FROM claims),
 u AS (SELECT claim_id, gaps, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM m), o AS (SELECT claim_id, ms[i] AS mention, gs[i] AS genus, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS start FROM u)
 SELECT claim_id, CAST(start AS INTEGER) AS start, mention, genus IN (SELECT genus FROM known) AS valid FROM o WHERE genus NOT IN ({list_sql(V.GENUS_STOPWORDS)})""",
)
def species_mentions(spark, sf):
    c = claims(spark, sf)
    known = c.select(F.split_part("source_species", F.lit(" "), F.lit(1)).alias("genus")).distinct().withColumn("valid", F.lit(True))
    m = c.select("claim_id", F.inline(MN.binomial_mentions("text")))
    return m.join(known, "genus", "left").select("claim_id", "start", "mention", F.coalesce("valid", F.lit(False)).alias("valid"))


@query(
    "comp_01_corpus_build",
    f"""WITH {CLAIMS}, {LEX}, b AS (SELECT claim_id, text, label, interaction_type, 'base' AS source, 0 AS sr FROM claims WHERE pos = 1),
 h AS (SELECT claim_id, text, label, interaction_type, lex_strength FROM lex WHERE pos <> 1 AND pos <= 4 AND regexp_matches(trim(text), '[.!?)]$') AND NOT (label = 0 AND {FALSE_NEG_SQL})),
 hp AS (SELECT * FROM h WHERE label = 1 AND lex_strength > 0 QUALIFY row_number() OVER (PARTITION BY interaction_type ORDER BY md5('42|' || claim_id), claim_id) <= 300), hn AS (SELECT * FROM h WHERE label = 0 QUALIFY row_number() OVER (ORDER BY md5('42|' || claim_id), claim_id) <= 500),
 x AS (SELECT claim_id, text, label, interaction_type FROM claims WHERE pos >= 5 AND regexp_matches(trim(text), '[.!?)]$')),
 u AS (SELECT * FROM b UNION ALL SELECT claim_id, text, label, interaction_type, 'harvest', 1 FROM hp UNION ALL SELECT claim_id, text, label, interaction_type, 'harvest', 1 FROM hn UNION ALL SELECT *, 'extra', 2 FROM x),
 k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY trim(lower(text)) ORDER BY sr, claim_id) = 1) SELECT claim_id, label, interaction_type, source, row_number() OVER (ORDER BY md5('42|' || claim_id), claim_id) AS position FROM k""",
)
def corpus_build(spark, sf):
    c = claims(spark, sf).select("claim_id", "text", "label", "interaction_type", "pos")
    rows = lambda cond: c.where(cond).select("claim_id", "text", "label", "interaction_type")
    harvest = SourceSpec("harvest", signal_only=True, cap_per_type=300, negative_budget=500, complete_only=True, drop_false_negatives=True)
    out = build_corpus(
        [(rows("pos = 1"), SourceSpec("base")), (rows("pos > 1 and pos <= 4"), harvest), (rows("pos >= 5"),SourceSpec("extra", complete_only=True))],
        "42",
    )
    return out.select("claim_id", "label", "interaction_type", "source", "position")


@query(
    "comp_02_stage_counts",
    f"""WITH {CLAIMS}, g AS (SELECT *, text AS sentence FROM claims), ok AS (SELECT * FROM g WHERE {GOOD_SQL}), k AS (SELECT source, least(count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0)) AS n FROM ok GROUP BY source)
 SELECT 'interactions' AS stage, count(*) AS n FROM claims UNION ALL SELECT 'with_names', count(*) FROM claims WHERE strpos(text, source_species) > 0 AND strpos(text, target_species) > 0 UNION ALL SELECT 'good', count(*) FROM ok UNION ALL SELECT 'balanced', CAST(sum(2 * n) AS BIGINT) FROM k""",
)
def stage_counts(spark, sf):
    """Rows surviving each stage from interactions to the balanced corpus, in one pass over flags."""
    named_ = (F.expr("instr(text, source_species)") > 0) & (F.expr("instr(text, target_species)") > 0)
    f = claims(spark, sf).select("source", "label", named_.alias("named"), T.good_sentence("text").alias("good"))
    by = f.groupBy("source").agg(
        F.count("*").alias("interactions"), F.count_if("named").alias("with_names"), F.count_if("good").alias("good"),
        (2 * F.least(F.count_if(F.col("good") & (F.col("label") == 1)), F.count_if(F.col("good") & (F.col("label") == 0)))).alias("balanced"),
    )
    stages = ["interactions", "with_names", "good", "balanced"]
    return by.unpivot([], stages, "stage", "n").groupBy("stage").agg(F.sum("n").alias("n"))


@query(
    "comp_03_matched_corpus",
    f"""WITH {CLAIMS}, {LEX}, b AS (SELECT DISTINCT trim(lower(text)) AS k FROM claims WHERE reads = 50 AND pos = 4), s AS (SELECT claim_id, label, text, CASE WHEN lex_strength > 0 THEN 1 ELSE 0 END AS sig FROM lex WHERE source <> 'src3' AND trim(lower(text)) NOT IN (SELECT k FROM b)),
 c AS (SELECT count(*) FILTER (WHERE label = 1 AND sig = 0) AS pz, count(*) FILTER (WHERE label = 0 AND sig = 1) AS nh FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY label, sig ORDER BY md5('c3|' || claim_id), claim_id) AS rk FROM s),
 o AS (SELECT * FROM r, c WHERE (label = 1 AND sig = 0) OR (label = 0 AND sig = 1) OR (label = 1 AND rk <= round(pz / CAST(0.4 AS DOUBLE) * 0.6)) OR (label = 0 AND rk <= round(nh / CAST(0.3 AS DOUBLE) * 0.7)))
 SELECT count(*) AS n_rows, round(avg(label), 4) AS pos_rate, round(avg(CASE WHEN label = 1 THEN sig END), 4) AS p_signal_pos, round(avg(CASE WHEN label = 0 THEN sig END), 4) AS p_signal_neg, CAST(sum({digest_sql("claim_id", "label", "sig")}) AS BIGINT) AS content_sum, 'c3' AS seed FROM o""",
)
def matched_corpus(spark, sf):
    """Flagged source and benchmark texts out, signal rates matched per class, manifest of the result."""
    c = claims(spark, sf)
    bench = c.where("reads = 50 and pos = 4").select(F.trim(F.lower("text")).alias("k")).distinct()
    s = c.where("source <> 'src3'").withColumn("k", F.trim(F.lower("text"))).join(bench, "k", "left_anti").select("claim_id", "label", "text")
    s = E.with_lexicon(s, "text").select("claim_id", "label", (F.col("lex_strength") > 0).cast("int").alias("sig"))
    return manifest(match_marginals(stage(s, "matched"), "c3", 0.6, 0.3), "label", "sig", ["claim_id", "label", "sig"], "c3")


SIGNAL_RE = any_sql("lower(text)", V.STRONG_TERMS + V.WEAK_TERMS)


@query(
    "comp_04_harvest_tiers",
    f"""WITH {CLAIMS}, rec AS (SELECT DISTINCT doc_id, source_species AS a, target_species AS b FROM claims WHERE pos IN (1, 3, 5)), s AS (SELECT claim_id, doc_id, text, source_species AS x, target_species AS y, text AS sentence FROM claims),
 g AS (SELECT * FROM s WHERE {GOOD_SQL}), j AS (SELECT claim_id, max(CASE WHEN a = x AND b = y THEN 2 WHEN a = x OR b = y OR a = y OR b = x THEN 1 ELSE 0 END) AS found FROM g LEFT JOIN rec USING (doc_id) GROUP BY claim_id),
 t AS (SELECT g.claim_id, doc_id, CASE WHEN found = 2 AND {SIGNAL_RE} THEN 'positive' WHEN found = 2 THEN 'both_species' WHEN found = 1 THEN 'single_species' WHEN regexp_matches(text, '[A-Z][a-z]+\\s[a-z]{{3,}}') THEN 'other_species' WHEN len({words_sql("text")}) >= 12 THEN 'no_species' END AS tier FROM g JOIN j USING (claim_id))
 SELECT claim_id, doc_id, tier FROM t WHERE tier = 'positive' UNION ALL SELECT claim_id, doc_id, tier FROM t WHERE tier <> 'positive' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE tier WHEN 'both_species' THEN 0 WHEN 'other_species' THEN 1 WHEN 'single_species' THEN 2 ELSE 3 END, claim_id) <= 3""",
)
def harvest_tiers(spark, sf):
    """Sentences of an article against its records: positives, and the three hardest negatives.

    Names of sentence and record meet in equi-joins on (article, name); sentences and records are never paired. A text is judged
    where it is read and not shuffled; the tiers are written once for both branches.
    """
    c = claims(spark, sf)
    rec = c.where(F.col("pos").isin(1, 3, 5)).select("doc_id", F.col("source_species").alias("a"), F.col("target_species").alias("b")).distinct()
    signal = T.has_pattern(F.lower("text"), V.STRONG_TERMS + V.WEAK_TERMS)
    s = c.where(T.good_sentence("text")).select(
        "claim_id", "doc_id", "source_species", "target_species", signal.alias("signal"), F.col("text").rlike(r"[A-Z][a-z]+\s[a-z]{3,}").alias("other"), (F.size(T.words("text")) >= 12).alias("long")
    )
    both = rec.select("doc_id", F.col("a").alias("source_species"), F.col("b").alias("target_species"), F.lit(True).alias("both"))
    one = rec.select("doc_id", F.explode(F.array("a", "b")).alias("name")).distinct()
    j = s.join(both, ["doc_id", "source_species", "target_species"], "left")
    for side in ("source_species", "target_species"):
        j = j.join(one.select("doc_id", F.col("name").alias(side), F.lit(True).alias(f"known_{side}")), ["doc_id", side], "left")
    tier = (
        F.when(F.col("both") & F.col("signal"), "positive").when(F.col("both"), "both_species")
        .when(F.coalesce("known_source_species", "known_target_species"), "single_species").when(F.col("other"), "other_species").when(F.col("long"), "no_species")
    )
    t = stage(j.select("claim_id", "doc_id", tier.alias("tier")).where("tier is not null"), "tiers")
    order = F.when(F.col("tier") == "both_species", 0).when(F.col("tier") == "other_species", 1).when(F.col("tier") == "single_species", 2).otherwise(3)
    neg = top_n(t.where("tier <> 'positive'"), ["doc_id"], [order, "claim_id"], 3).drop("rk")
    return t.where("tier = 'positive'").unionByName(neg)


@query(
    "comp_05_passage_mining",
    f"""WITH {CLAIMS}, p AS (SELECT claim_id, CASE WHEN regexp_matches(text, 'preys on|predator') THEN 'PREDATION' WHEN regexp_matches(text, 'parasite') THEN 'PARASITISM' WHEN regexp_matches(text, 'infect|pathogen') THEN 'INFECTION' WHEN regexp_matches(text, 'pollinat') THEN 'POLLINATION' END AS category,
   pos IN (1, 2, 4, 7) AS middle, {any_sql("text", V.PASSAGE_METHOD, "(?i)")} AS method FROM claims WHERE length(text) BETWEEN 50 AND 800),
 k AS (SELECT claim_id, category, CASE WHEN middle AND NOT method THEN 1 ELSE 0 END AS label FROM p WHERE category IS NOT NULL) SELECT claim_id, category, label FROM k QUALIFY row_number() OVER (PARTITION BY category, label ORDER BY md5('c5|' || claim_id), claim_id) <= 400""",
)
def passage_mining(spark, sf):
    """First matching category; in position and free of methods wording → positive, else hard negative; 400 of each."""
    cat = (
        F.when(F.col("text").rlike("preys on|predator"), "PREDATION").when(F.col("text").rlike("parasite"), "PARASITISM")
        .when(F.col("text").rlike("infect|pathogen"), "INFECTION").when(F.col("text").rlike("pollinat"), "POLLINATION")
    )
    good = F.col("pos").isin(1, 2, 4, 7) & ~F.col("text").rlike(T.any_of(V.PASSAGE_METHOD, "(?i)"))
    p = claims(spark, sf).where(F.length("text").between(V.PASSAGE_MIN, V.PASSAGE_MAX)).select("claim_id", cat.alias("category"), good.cast("int").alias("label"))
    from claimweave.operators.sampling import cap_per_group

    return cap_per_group(p.where("category is not null"), ["category", "label"], ["claim_id"], 400, "c5")


@query(
    "comp_06_contamination_report",
    f"""WITH {NEAR_SQL}, b AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')) AS k FROM benchmark),
 e AS (SELECT lang, count(*) AS n_rows, count(*) FILTER (WHERE trim(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')) IN (SELECT k FROM b)) AS n_exact FROM documents GROUP BY lang),
 d AS (SELECT lang, count(DISTINCT item_id) AS n_near FROM near JOIN documents USING (doc_id) WHERE similarity > 0.6 AND (item_id, similarity) IN (SELECT (item_id, max(similarity)) FROM near GROUP BY item_id) GROUP BY lang)
 SELECT lang, n_rows, n_exact, coalesce(n_near, 0) AS n_near FROM e LEFT JOIN d USING (lang)""",
)
def contamination_report(spark, sf):
    """Per training set (language): rows equal to a benchmark text, benchmark rows whose best near match lies in it."""
    docs, bench = load(spark, sf, "documents").select("doc_id", "text", "lang"), load(spark, sf, "benchmark")
    keys = bench.select(T.norm_match("text").alias("k")).distinct().withColumn("hit", F.lit(1))
    e = docs.withColumn("k", T.norm_match("text")).join(keys, "k", "left").groupBy("lang").agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_exact"))
    near = L.near_duplicates(bench, docs.select("doc_id", "text"), "item_id", "doc_id", "text", threshold=0.6)
    d = near.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.countDistinct("item_id").alias("n_near"))
    return e.join(d, "lang", "left").na.fill(0, ["n_near"])


@query(
    "comp_07_stratified_report",
    f"""WITH {SCORED}, d AS (SELECT doc_id, round(max(score), 3) AS score, round(max(score_b), 3) AS score_b, max(label) AS label, least(count(*), 3) AS stratum FROM scored GROUP BY doc_id), h AS (SELECT *, score >= 0.5 AS hit, score >= 0.5 AS hit_a, score_b >= 0.5 AS hit_b FROM d),
 g AS (SELECT stratum, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM d GROUP BY ALL), c AS (SELECT *, sum(pos) OVER (PARTITION BY stratum ORDER BY score DESC) AS cp, sum(neg) OVER (PARTITION BY stratum ORDER BY score DESC) AS cn FROM g),
 ap AS (SELECT stratum, CAST(sum(pos) AS BIGINT) AS n_pos, round(sum(pos * cp / CAST(cp + cn AS DOUBLE)) / sum(pos), 6) AS ap FROM c GROUP BY stratum), {boot_sql("stratum", "s7", 100)}, {paired_sql("h", "stratum", "p7", 100)},
 b AS (SELECT stratum, round(quantile_cont(f1, 0.025), 6) AS f1_lo, round(quantile_cont(f1, 0.975), 6) AS f1_hi FROM f GROUP BY stratum), e AS (SELECT stratum, {DELTA} FROM df GROUP BY stratum)
 SELECT CAST(stratum AS BIGINT) AS stratum, n_pos, ap, f1_lo, f1_hi, delta_mean, lo, hi, share_positive FROM ap JOIN b USING (stratum) JOIN e USING (stratum)""",
)
def stratified_report(spark, sf):
    """Candidates pooled to documents, strata by candidate count: average precision, F1 interval, and the paired interval
    of the difference between two models, per stratum."""
    d = scored(spark, sf).groupBy("doc_id").agg(F.round(F.max("score"), 3).alias("score"), F.round(F.max("score_b"), 3).alias("score_b"), F.max("label").alias("label"), F.least(F.count("*"), F.lit(3)).cast("bigint").alias("stratum"))
    d = stage(d, "strata")
    ap = ME.auc_ap(d, ["stratum"]).select("stratum", "n_pos", "ap")
    reps = ME.bootstrap_cells(d, ["stratum"], None, F.col("score") >= 0.5, 100, "s7")
    own = ME.percentile_interval(reps, ["stratum"], "f1").select("stratum", F.col("lo").alias("f1_lo"), F.col("hi").alias("f1_hi"))
    pair = ME.delta_interval(ME.paired_bootstrap(d, ["stratum"], F.col("score") >= 0.5, F.col("score_b") >= 0.5, 100, "p7"), ["stratum"]).drop("n_reps")
    return ap.join(own, "stratum").join(pair, "stratum")


@query(
    "comp_08_error_report",
    f"""WITH {SCORED} SELECT CASE WHEN label = 0 AND score >= 0.5 THEN 'FP' WHEN label = 1 AND score < 0.5 THEN 'FN' ELSE 'ok' END AS error, source, count(*) AS n, round(max(abs(score - 0.5)), 6) AS worst, count(*) FILTER (WHERE (score >= 0.5) = (label = 1) AND (score_b >= 0.5) <> (label = 1)) AS fixed,
 count(*) FILTER (WHERE (score >= 0.5) <> (label = 1) AND (score_b >= 0.5) = (label = 1)) AS broken FROM scored GROUP BY ALL""",
)
def error_report(spark, sf):
    """Errors by type and source with the most confident one, and the fixes and breaks against the second model."""
    y, a, b = F.col("label") == 1, F.col("score") >= 0.5, F.col("score_b") >= 0.5
    kind = F.when(~y & a, "FP").when(y & ~a, "FN").otherwise("ok")
    return scored(spark, sf).groupBy(kind.alias("error"), "source").agg(
        F.count("*").alias("n"), F.round(F.max(F.abs(F.col("score") - 0.5)), 6).alias("worst"), F.count_if((a == y) & (b != y)).alias("fixed"), F.count_if((a != y) & (b == y)).alias("broken")
    )


@query(
    "comp_09_negative_triage",
    f"""WITH {CLAIMS}, {LEX}, n AS (SELECT claim_id, CASE WHEN lex_strength = 0 THEN 'zero' WHEN lex_strength < 0.4 THEN 'weak' ELSE 'strong' END AS stratum, CASE WHEN reads % 5 = 0 THEN 1 WHEN reads % 5 < 4 THEN 0 END AS answer FROM lex WHERE label = 0)
 SELECT stratum, CASE WHEN stratum = 'zero' OR answer = 0 THEN 'clean' WHEN answer = 1 THEN 'flipped' ELSE 'unclear' END AS outcome, count(*) AS n FROM n GROUP BY ALL""",
)
def negative_triage(spark, sf):
    """Negatives by signal stratum; second answers, joined by id, confirm, flip or leave them open."""
    c = claims(spark, sf).where("label = 0")
    answers = c.where("reads % 5 < 4").select("claim_id", (F.col("reads") % 5 == 0).cast("int").alias("answer"))
    n = E.with_lexicon(c.select("claim_id", "text"), "text").join(answers, "claim_id", "left")
    stratum = F.when(F.col("lex_strength") == 0, "zero").when(F.col("lex_strength") < 0.4, "weak").otherwise("strong")
    n = n.withColumn("stratum", stratum)
    outcome = F.when((F.col("stratum") == "zero") | (F.col("answer") == 0), "clean").when(F.col("answer") == 1, "flipped").otherwise("unclear")
    return n.groupBy("stratum", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "comp_10_evaluation_audit",
    f"""WITH {CLAIMS}, u AS (SELECT text, label, CASE WHEN confidence >= 0.5 THEN 1 ELSE 0 END AS second, pos, claim_id FROM claims WHERE pos IN (1, 2, 7)), d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY trim(lower(text)) ORDER BY pos, claim_id) = 1),
 s AS (SELECT count(*) AS n, avg(label) AS pl, avg(second) AS ps, avg(CASE WHEN label = second THEN 1 ELSE 0 END) AS po, count(*) FILTER (WHERE label = 1 AND second = 0) AS to_check_pos, count(*) FILTER (WHERE label = 0 AND second = 1) AS to_check_neg FROM d)
 SELECT n, round(po, 6) AS agreement, round((po - (pl * ps + (1 - pl) * (1 - ps))) / (1 - (pl * ps + (1 - pl) * (1 - ps))), 6) AS kappa, to_check_pos, to_check_neg FROM s""",
)
def evaluation_audit(spark, sf):
    """Three evaluation files to one schema, deduplicated by text in order, agreement with a second annotator."""
    c = claims(spark, sf).where(F.col("pos").isin(1, 2, 7))
    u = c.select(F.trim(F.lower("text")).alias("k"), "label", (F.col("confidence") >= 0.5).cast("int").alias("second"), "pos", "claim_id")
    d = keep_first(u, ["k"], ["pos", "claim_id"])
    y, z = F.col("label"), F.col("second")
    s = d.agg(
        F.count("*").alias("n"), F.avg(y).alias("pl"), F.avg(z).alias("ps"), F.avg((y == z).cast("int")).alias("po"),
        F.count_if((y == 1) & (z == 0)).alias("to_check_pos"), F.count_if((y == 0) & (z == 1)).alias("to_check_neg"),
    )
    chance = F.col("pl") * F.col("ps") + (1 - F.col("pl")) * (1 - F.col("ps"))
    return s.select("n", F.round("po", 6).alias("agreement"), F.round((F.col("po") - chance) / (1 - chance), 6).alias("kappa"), "to_check_pos", "to_check_neg")


