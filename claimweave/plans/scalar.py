"""Scalar functions over the given tables: text, names, relations, evidence, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import evidence as E
from claimweave.functions import fixed_values as V
from claimweave.functions import maths as M
from claimweave.functions import names as N
from claimweave.functions import relations as R
from claimweave.functions import text as T
from claimweave.operators import polarity as PO
from claimweave.operators.containment import related
from claimweave.plans.registry import query
from claimweave.plans.sqltext import (
    any_sql, any_stem_sql, case_sql, count_sql, first_sql, list_sql, norm_ascii_sql, q, stems_sql, values_sql, words_sql,
)
from claimweave.plans.tables import CLAIMS, SCORED, SENTENCES, claims, load, scored, sentences, spread

LEX = f"""lex0 AS (SELECT *, lower(text) AS low FROM claims),
lex1 AS MATERIALIZED (SELECT *, {count_sql("low", V.STRONG_TERMS)} AS lex_strong, {count_sql("low", V.WEAK_TERMS)} AS lex_weak,
  {any_sql("low", V.LEXICON_NEGATION)} AS lex_negated, {count_sql("low", V.LEXICON_METHOD)} AS lex_method FROM lex0),
lex2 AS (SELECT *, least(CAST(1.0 AS DOUBLE), lex_strong * CAST(0.40 AS DOUBLE) + lex_weak * CAST(0.15 AS DOUBLE)) AS base FROM lex1),
lex3 AS (SELECT *, CASE WHEN lex_negated THEN base * CAST(0.35 AS DOUBLE) ELSE base END AS damped FROM lex2),
lex4 AS (SELECT *, CASE WHEN lex_strong + lex_weak = 0 THEN CAST(0 AS DOUBLE)
  WHEN lex_method >= 2 THEN greatest(CAST(0.05 AS DOUBLE), damped - CAST(0.25 AS DOUBLE)) ELSE damped END AS raw FROM lex3),
lex AS (SELECT *, round(raw, 3) AS lex_strength, (lex_strong + lex_weak > 0) AND (raw >= 0.15 OR lex_strong >= 2) AS lex_signal FROM lex4)"""

SPECIES_SQL = f"""CASE WHEN len(list_filter(regexp_extract_all(text, {q(V.BINOMIAL_CAP)}, 1), lambda g: g NOT IN ({list_sql(V.GENUS_STOPWORDS)}))) > 0
 THEN len(list_filter(regexp_extract_all(text, {q(V.BINOMIAL_CAP)}, 1), lambda g: g NOT IN ({list_sql(V.GENUS_STOPWORDS)})))
 ELSE len(list_filter(list_zip(regexp_extract_all(text, {q(V.BINOMIAL_LOWER)}, 1), regexp_extract_all(text, {q(V.BINOMIAL_LOWER)}, 2)),
   lambda p: p[1] NOT IN ({list_sql(V.LOWER_STOPWORDS)}) AND p[2] NOT IN ({list_sql(V.LOWER_STOPWORDS)}))) END"""


@query(
    "str_01_normalisers",
    f"""SELECT doc_id,
 md5(trim(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'))) AS match_form,
 md5({norm_ascii_sql("text")}) AS ascii_form, md5(trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g'))) AS space_form FROM documents""",
)
def normalisers(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id",
        F.md5(T.norm_match("text")).alias("match_form"),
        F.md5(T.norm_ascii("text")).alias("ascii_form"),
        F.md5(T.norm_space("text")).alias("space_form"),
    )


def _peel_sql(c: str) -> str:
    for _ in range(N.PEEL_PASSES):
        for p in (V.TRAILING_PARENTHESIS, V.TRAILING_YEAR, V.TRAILING_AUTHOR, V.TRAILING_PARTICLE):
            c = f"regexp_replace({c}, {q(p)}, '')"
    return f"trim({c})"


@query(
    "str_02_name_normaliser",
    f"""WITH {CLAIMS}, d AS (SELECT DISTINCT target_species || CASE pub_year % 4 WHEN 0 THEN ' (L.) Merr. ' || pub_year
   WHEN 1 THEN ' van Tieghém, ' || pub_year WHEN 2 THEN ' subsp. alba' ELSE '' END AS name FROM claims),
 p AS (SELECT name, {_peel_sql(f"trim(translate(name, {q(V.ACCENTED)}, {q(V.UNACCENTED)}))")} AS bare FROM d)
 SELECT name, trim(regexp_replace(regexp_replace(regexp_replace(lower(bare), {q(V.RANK_TAGS)}, ' ', 'g'), '[^a-z0-9\\s.]', ' ', 'g'), '\\s+', ' ', 'g')) AS name_norm FROM p""",
)
def name_normaliser(spark, sf):
    y = F.col("pub_year")
    tail = (
        F.when(y % 4 == 0, F.concat(F.lit(" (L.) Merr. "), y.cast("string")))
        .when(y % 4 == 1, F.concat(F.lit(" van Tieghém, "), y.cast("string")))
        .when(y % 4 == 2, F.lit(" subsp. alba"))
        .otherwise(F.lit(""))
    )
    names = claims(spark, sf).select(F.concat("target_species", tail).alias("name")).distinct()
    return names.select("name", N.normalize_name("name").alias("name_norm"))


@query(
    "str_03_name_variants",
    f"""WITH {CLAIMS}, n AS (SELECT DISTINCT target_species || CASE WHEN reads % 3 = 0 THEN ' alba' ELSE '' END AS name FROM claims),
 w AS (SELECT name, string_split(name, ' ') AS p FROM n)
 SELECT name, unnest(list_distinct(list_filter([name, p[1] || ' ' || p[2], CASE WHEN length(p[1]) > 1 THEN p[1][1] || '. ' || p[2] END,
   CASE WHEN length(p[1]) > 3 THEN p[1] END, p[1] || ' ' || p[2] || ' ' || p[3], p[1][1] || '. ' || p[2] || ' ' || p[3]], lambda x: x IS NOT NULL))) AS variant FROM w""",
)
def name_variants(spark, sf):
    names = claims(spark, sf).select(
        F.concat("target_species", F.when(F.col("reads") % 3 == 0, " alba").otherwise("")).alias("name")
    ).distinct()
    return names.select("name", F.explode(N.name_variants("name")).alias("variant"))


@query(
    "str_04_term_variants",
    f"""WITH {CLAIMS}, t AS (SELECT DISTINCT interaction_type, lower(regexp_replace(interaction_type, '([a-z])([A-Z])', '\\1 \\2', 'g')) AS term FROM claims),
 b AS (SELECT DISTINCT lower(verb) AS form FROM claims), v AS (SELECT form FROM b UNION SELECT substr(form, 1, length(form) - 1) FROM b UNION SELECT 'hyper' || form || 'ward' FROM b)
 SELECT interaction_type, term, form FROM t JOIN v ON contains(form, term) OR contains(term, form)
 UNION SELECT interaction_type, term, term FROM t UNION SELECT interaction_type, term, lower(interaction_type) FROM t
 UNION SELECT interaction_type, term, replace(term, ' ', '-') FROM t WHERE contains(term, ' ')""",
)
def term_variants(spark, sf):
    """Type codes and verb phrases, the phrases also cut short and lengthened, by what holds what."""
    c = claims(spark, sf)
    types = c.select("interaction_type", R.spaced("interaction_type").alias("term")).distinct()
    verb = F.lower("verb")
    made = F.explode(F.array(verb, F.substr(verb, F.lit(1), F.length(verb) - 1), F.concat(F.lit("hyper"), verb, F.lit("ward"))))
    forms = c.select("verb").distinct().select(made.alias("form")).distinct()
    near = related(forms, types.select("term")).join(types, "term").select("interaction_type", "term", "form")
    own = types.select(
        "interaction_type",
        "term",
        F.explode(
            F.array_compact(
                F.array(
                    F.col("term"),
                    F.lower("interaction_type"),
                    F.when(F.col("term").contains(" "), F.translate("term", " ", "-")),
                )
            )
        ).alias("form"),
    )
    return near.union(own).distinct()


@query(
    "str_05_binomials",
    f"""WITH {CLAIMS} SELECT claim_id, CAST({SPECIES_SQL} AS INTEGER) AS n_species,
 regexp_matches(target_species, '^([A-Z][a-z]+|[A-Z]\\.)\\s+[a-z]+(\\s|$)') AS is_binomial FROM claims""",
)
def binomials(spark, sf):
    return claims(spark, sf).select(
        "claim_id", N.count_species("text").alias("n_species"), N.is_binomial("target_species").alias("is_binomial")
    )


@query(
    "str_06_identifiers",
    """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || (1000000 + o_orderkey) || '/'
  WHEN 1 THEN 'Smith et al. Cited as doi:10.1234/AB.' || o_orderkey || '.' WHEN 2 THEN 'see pmc' || (500000 + o_orderkey) || ' for text'
  ELSE CAST(7000000 + o_orderkey AS VARCHAR) END AS ref FROM orders)
 SELECT o_orderkey AS ref_id, coalesce(nullif(regexp_extract(ref, '(?i)(?:pubmed\\.ncbi\\.nlm\\.nih\\.gov/|PMID:)(\\d+)', 1), ''),
   CASE WHEN regexp_matches(trim(ref), '^\\d+$') THEN trim(ref) END) AS pmid,
  nullif(lower(regexp_replace(regexp_extract(ref, '10\\.\\d{4,}/\\S+'), '[.,;)]+$', '')), '') AS doi,
  nullif(upper(regexp_extract(ref, '(?i)PMC\\d+')), '') AS pmcid FROM r""",
)
def identifiers(spark, sf):
    refs = _references(spark, sf)
    return refs.select(
        "ref_id", N.pmid_of("ref").alias("pmid"), N.doi_of("ref").alias("doi"), N.pmcid_of("ref").alias("pmcid")
    )


def _references(spark, sf):
    k = F.col("o_orderkey")
    ref = (
        F.when(k % 4 == 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), (k + 1000000).cast("string"), F.lit("/")))
        .when(k % 4 == 1, F.concat(F.lit("Smith et al. Cited as doi:10.1234/AB."), k.cast("string"), F.lit(".")))
        .when(k % 4 == 2, F.concat(F.lit("see pmc"), (k + 500000).cast("string"), F.lit(" for text")))
        .otherwise((k + 7000000).cast("string"))
    )
    return load(spark, sf, "orders").select(k.alias("ref_id"), ref.alias("ref"), "o_custkey")


@query(
    "str_07_reference_kind",
    """WITH r AS (SELECT o_orderkey AS ref_id, CASE o_orderkey % 5 WHEN 0 THEN 'https://doi.org/10.1000/' || o_orderkey WHEN 1 THEN 'PMC' || o_orderkey
   WHEN 2 THEN CAST(100000 + o_orderkey AS VARCHAR) WHEN 3 THEN ' ' ELSE 'On the ' || lower(o_orderpriority) || ' of things' END AS ref FROM orders)
 SELECT ref_id, CASE WHEN trim(ref) = '' THEN 'empty' WHEN regexp_matches(trim(ref), '(?i)^(https?://(dx\\.)?doi\\.org/)?10\\.\\d{4,9}/\\S+$') THEN 'doi'
   WHEN regexp_matches(trim(ref), '(?i)^PMC\\d+$') THEN 'pmcid' WHEN regexp_matches(trim(ref), '^\\d{5,9}$') THEN 'pmid' ELSE 'title' END AS kind FROM r""",
)
def reference_kinds(spark, sf):
    k = F.col("o_orderkey")
    ref = (
        F.when(k % 5 == 0, F.concat(F.lit("https://doi.org/10.1000/"), k.cast("string")))
        .when(k % 5 == 1, F.concat(F.lit("PMC"), k.cast("string")))
        .when(k % 5 == 2, (k + 100000).cast("string"))
        .when(k % 5 == 3, F.lit(" "))
        .otherwise(F.concat(F.lit("On the "), F.lower("o_orderpriority"), F.lit(" of things")))
    )
    return load(spark, sf, "orders").select(k.alias("ref_id"), N.reference_kind(ref).alias("kind"))


@query(
    "str_08_sentence_split",
    f"WITH {SENTENCES} SELECT doc_id, sent_id, md5(sentence) AS digest, CAST(length(sentence) AS INTEGER) AS n_chars FROM sentences",
)
def sentence_split(spark, sf):
    return sentences(spark, sf).select(
        "doc_id", "sent_id", F.md5("sentence").alias("digest"), F.length("sentence").alias("n_chars")
    )


@query(
    "str_10_input_formats",
    f"""WITH {CLAIMS}, p AS (SELECT *, strpos(lower(text), lower(source_species)) AS i1, strpos(lower(text), lower(target_species)) AS i2 FROM claims),
 m AS (SELECT *, CASE WHEN i1 > 0 AND i2 > 0 AND i1 < i2 THEN substr(text, 1, i1 - 1) || '<e1>' || substr(text, i1, length(source_species)) || '</e1>'
    || substr(text, i1 + length(source_species), i2 - i1 - length(source_species)) || '<e2>' || substr(text, i2, length(target_species)) || '</e2>'
    || substr(text, i2 + length(target_species)) ELSE text END AS marked FROM p)
 SELECT claim_id, source_species || ' [SEP] ' || verb || ' [SEP] ' || target_species AS triple_form, marked,
  least(source_species, target_species) || ' [SEP] ' || greatest(source_species, target_species) AS canonical_form,
  source_species || ' | ' || target_species || ' | ' || text AS prefixed FROM m""",
)
def input_formats(spark, sf):
    c = claims(spark, sf)
    i1 = F.expr("instr(lower(text), lower(source_species))")
    i2 = F.expr("instr(lower(text), lower(target_species))")
    c = c.withColumns({"i1": i1, "i2": i2})
    marked = F.when(
        (F.col("i1") > 0) & (F.col("i2") > 0) & (F.col("i1") < F.col("i2")),
        F.expr(
            "concat(substring(text, 1, i1 - 1), '<e1>', substring(text, i1, length(source_species)), '</e1>', "
            "substring(text, i1 + length(source_species), i2 - i1 - length(source_species)), '<e2>', "
            "substring(text, i2, length(target_species)), '</e2>', substring(text, i2 + length(target_species)))"
        ),
    ).otherwise(F.col("text"))
    sep = F.lit(" [SEP] ")
    s, t = F.col("source_species"), F.col("target_species")
    return c.select(
        "claim_id",
        F.concat(s, sep, F.col("verb"), sep, t).alias("triple_form"),
        marked.alias("marked"),
        F.concat(F.least(s, t), sep, F.greatest(s, t)).alias("canonical_form"),
        F.concat_ws(" | ", s, t, F.col("text")).alias("prefixed"),
    )


@query(
    "str_11_pair_keys",
    f"""WITH {CLAIMS} SELECT least(lower(source_species), lower(target_species)) || ';' || greatest(lower(source_species), lower(target_species)) AS pair_key,
 CASE WHEN interaction_type NOT IN ('symbioticWith', 'interactsWith') THEN source_species || ';' || target_species || ';' || interaction_type
  ELSE least(source_species, target_species) || ';' || greatest(source_species, target_species) || ';' || interaction_type END AS triple_key, count(*) AS n
 FROM claims GROUP BY ALL""",
)
def pair_keys(spark, sf):
    directed = ~F.col("interaction_type").isin("symbioticWith", "interactsWith")
    return (
        claims(spark, sf)
        .groupBy(
            N.pair_key("source_species", "target_species").alias("pair_key"),
            N.triple_key("source_species", "target_species", "interaction_type", directed).alias("triple_key"),
        )
        .agg(F.count("*").alias("n"))
    )


@query(
    "str_12_relation_concept",
    f"""WITH {CLAIMS}, rel AS (SELECT DISTINCT regexp_replace(verb, '^(is an?|lives in) ', '') || CASE WHEN pos % 2 = 0 THEN 's' ELSE '' END AS relation FROM claims),
 terms AS (SELECT DISTINCT lower(regexp_replace(verb, '^(is an?|lives in) ', '')) AS form, interaction_type AS concept FROM claims),
 f AS (SELECT relation, unnest([struct_pack(p := 0, form := lower(relation)), struct_pack(p := 100, form := regexp_replace(lower(relation), 's+$', '')),
   struct_pack(p := 101, form := lower(relation) || ' of'), struct_pack(p := 102, form := regexp_replace(lower(relation), 's+$', '') || ' of'),
   struct_pack(p := 103, form := lower(relation) || 's')], recursive := true) FROM rel)
 SELECT relation, arg_min(concept, (p, concept)) AS concept FROM f LEFT JOIN terms USING (form) WHERE concept IS NOT NULL GROUP BY relation
 UNION ALL SELECT relation, NULL FROM f LEFT JOIN terms USING (form) GROUP BY relation HAVING count(concept) = 0""",
)
def relation_concept(spark, sf):
    c = claims(spark, sf)
    bare = F.regexp_replace("verb", "^(is an?|lives in) ", "")
    rel = c.select(F.concat(bare, F.when(F.col("pos") % 2 == 0, "s").otherwise("")).alias("relation")).distinct()
    terms = c.select(F.lower(bare).alias("form"), F.col("interaction_type").alias("concept")).distinct()
    forms = rel.select("relation", F.inline(R.concept_forms("relation")))
    return (
        forms.join(terms, "form", "left")
        .groupBy("relation")
        .agg(F.min_by("concept", F.when(F.col("concept").isNotNull(), F.struct("priority", "concept"))).alias("concept"))
    )


SURFACES = [("endoparasite of", 1), ("vector", -1), ("hosts of", -1), ("grazes on", 1), ("lives in symbiosis with", 0), ("symbiosis with", 0), ("odd link", 0), ("strange links", -1)]
_K = "trim(regexp_replace(lower(part), '\\s+', ' ', 'g'))"


@query(
    "str_13_polarity",
    f"""WITH {CLAIMS}, b AS (SELECT DISTINCT regexp_replace(verb, '^(is an?|lives in) ', '') || CASE pos WHEN 1 THEN ' by' WHEN 2 THEN 'ing' ELSE '' END AS form, pos, interaction_type FROM claims),
 r AS (SELECT DISTINCT CASE pos WHEN 3 THEN 'odd  link|' || form WHEN 4 THEN 'nothing known| Strange Link |' || form WHEN 5 THEN form || '|is seen by' WHEN 6 THEN 'odd link' WHEN 7 THEN '' ELSE form END AS relation, CAST(CASE WHEN pos = 5 AND interaction_type = 'hasHost' THEN -1 WHEN pos = 5 AND interaction_type = 'interactsWith' THEN 0 END AS INTEGER) AS concept FROM b),
 {values_sql("surfaces", ["form", "p"], SURFACES)},
 parts AS (SELECT relation, i AS nth, {_K} AS k FROM (SELECT relation, unnest(range(1, len(string_split(relation, '|')) + 1)) AS i, string_split(relation, '|') AS alternatives FROM r), LATERAL (SELECT alternatives[i] AS part) y WHERE {_K} <> ''),
 variants AS (SELECT relation, nth, k, 0 AS v, k AS form FROM parts UNION ALL SELECT relation, nth, k, 1, regexp_replace(k, 's+$', '') FROM parts UNION ALL SELECT relation, nth, k, 2, k || 's' FROM parts),
 per AS (SELECT relation, nth, k, min_by(p, v) FILTER (WHERE p <> 0) AS told, bool_or(v = 0 AND coalesce(p, 1) = 0) AS zero FROM variants LEFT JOIN surfaces USING (form) GROUP BY ALL),
 one AS (SELECT *, NOT contains(k, ' by') AND regexp_matches(k, {q(V.ACTIVE_FORM)}) AS active, CASE WHEN told IS NOT NULL THEN 'surface' WHEN regexp_matches(k, {q(V.SYMMETRIC_FORM)}) THEN 'symmetric_form' WHEN regexp_matches(k, {q(V.PATIENT_FORM)}) THEN 'patient_form'
   WHEN regexp_matches(k, {q(V.AGENT_NOUN)}) THEN 'agent_noun' WHEN regexp_matches(k, {q(V.AGENT_VERB)}) THEN 'agent_verb' WHEN zero THEN 'surface_symmetric' END AS way FROM per),
 best AS (SELECT relation, bool_or(active) AS active, min_by(way, nth) FILTER (WHERE way IS NOT NULL) AS way, min_by(coalesce(told, CASE way WHEN 'patient_form' THEN -1 WHEN 'agent_noun' THEN 1 WHEN 'agent_verb' THEN 1 ELSE 0 END), nth) FILTER (WHERE way IS NOT NULL) AS p FROM one GROUP BY relation)
 SELECT r.relation, CAST(CASE WHEN active THEN 1 WHEN concept IS NOT NULL THEN concept ELSE p END AS INTEGER) AS polarity, CASE WHEN active THEN 'active_form' WHEN concept IS NOT NULL THEN 'concept' ELSE coalesce(way, 'none') END AS decided_by FROM r LEFT JOIN best USING (relation)""",
)
def polarity(spark, sf):
    """Verb phrases, some with alternatives before or after them and some with a concept whose polarity is known."""
    c = claims(spark, sf).select(_form().alias("form"), "pos", "interaction_type").distinct()
    p, form = F.col("pos"), F.col("form")
    relation = (
        F.when(p == 3, F.concat(F.lit("odd  link|"), form)).when(p == 4, F.concat(F.lit("nothing known| Strange Link |"), form)).when(p == 5, F.concat(form, F.lit("|is seen by")))
        .when(p == 6, "odd link").when(p == 7, "").otherwise(form)
    )
    concept = F.when((p == 5) & (F.col("interaction_type") == "hasHost"), -1).when((p == 5) & (F.col("interaction_type") == "interactsWith"), 0)
    return PO.decided(c.select(relation.alias("relation"), concept.cast("int").alias("concept_polarity")), spark.createDataFrame(SURFACES, "form string, polarity int"))


def _form():
    bare = F.regexp_replace("verb", "^(is an?|lives in) ", "")
    return F.concat(bare, F.when(F.col("pos") == 1, " by").when(F.col("pos") == 2, "ing").otherwise(""))


def _relations(spark, sf):
    return claims(spark, sf).select(_form().alias("relation")).distinct()


@query(
    "str_14_surface_class",
    f"""WITH {CLAIMS}, r AS (SELECT DISTINCT regexp_replace(verb, '^(is an?|lives in) ', '') || CASE pos WHEN 1 THEN ' by' WHEN 2 THEN 'ing' ELSE '' END AS relation FROM claims)
 SELECT relation, CASE WHEN regexp_matches(lower(relation), '\\bby\\b') THEN 'C_passive_by' WHEN regexp_matches(lower(relation), '\\b(of|on|for|to|with|in)\\s*$') THEN 'B_prep_headed'
  WHEN relation LIKE '%ing' THEN 'D_present_participle' WHEN relation LIKE '%ed' THEN 'E_past_participle_bare' ELSE 'A_bare_noun' END AS surface_class,
  CASE WHEN regexp_matches(lower(relation), '\\bby\\b') THEN -1 ELSE 1 END AS voice FROM r""",
)
def surface_class(spark, sf):
    return _relations(spark, sf).select(
        "relation", R.surface_class("relation").alias("surface_class"), R.voice("relation").alias("voice")
    )


@query(
    "str_17_kingdom",
    f"""WITH {CLAIMS}, n AS (SELECT DISTINCT target_species || CASE pos WHEN 1 THEN 'aceae' WHEN 2 THEN 'idae' WHEN 3 THEN 'mycetes' WHEN 4 THEN 'coccus' WHEN 5 THEN '9' ELSE '' END AS name FROM claims),
 known AS (SELECT lower(split_part(target_species, ' ', 1)) AS term, min(target_kingdom) AS kingdom FROM claims WHERE target_kingdom = 'Fungi' GROUP BY 1),
 j AS (SELECT name, coalesce(a.kingdom, b.kingdom) AS known FROM n LEFT JOIN known a ON a.term = lower(name) LEFT JOIN known b ON b.term = split_part(lower(name), ' ', 1)),
 s AS (SELECT *, CASE WHEN {" OR ".join(f"name LIKE '%{x}'" for x in V.PLANT_SUFFIXES)} THEN 'Plantae' WHEN {" OR ".join(f"name LIKE '%{x}'" for x in V.FUNGI_SUFFIXES)} THEN 'Fungi'
   WHEN {" OR ".join(f"name LIKE '%{x}'" for x in V.ANIMAL_SUFFIXES)} THEN 'Animalia' WHEN {" OR ".join(f"name LIKE '%{x}'" for x in V.BACTERIA_SUFFIXES)} THEN 'Bacteria' END AS suffix,
   regexp_matches(name, '^[A-Z][a-z]+\\s+[a-z]+$') AS guess FROM j)
 SELECT name, coalesce(known, suffix, CASE WHEN guess THEN 'Animalia' END) AS kingdom,
  CASE WHEN known IS NOT NULL THEN 'high' WHEN suffix IS NOT NULL THEN 'medium' WHEN guess THEN 'low' END AS confidence FROM s""",
)
def kingdoms(spark, sf):
    c = claims(spark, sf)
    tail = F.element_at(
        F.array(*[F.lit(x) for x in ("aceae", "idae", "mycetes", "coccus", "9", "", "")]), F.col("pos").cast("int")
    )
    names = c.select(F.concat("target_species", tail).alias("name")).distinct()
    known = (
        c.where(F.col("target_kingdom") == "Fungi")
        .groupBy(F.lower(F.split_part("target_species", F.lit(" "), F.lit(1))).alias("term"))
        .agg(F.min("target_kingdom").alias("kingdom"))
    )
    by_name = known.select(F.col("term").alias("t1"), F.col("kingdom").alias("k1"))
    by_genus = known.select(F.col("term").alias("t2"), F.col("kingdom").alias("k2"))
    j = names.join(by_name, F.lower("name") == F.col("t1"), "left").join(
        by_genus, F.split_part(F.lower("name"), F.lit(" "), F.lit(1)) == F.col("t2"), "left"
    )
    kingdom, confidence = N.kingdom_of("name", F.col("k1"), F.col("k2"))
    return j.select("name", kingdom.alias("kingdom"), confidence.alias("confidence"))


CATEGORY_CASE = case_sql(
    [(f"interaction_type = '{k}'", f"'{v}'") for k, v in V.CATEGORY_OF_TYPE.items()]
    + [(f"regexp_matches(verb, {q('(?i)' + p)})", f"'{c}'") for p, c in V.CATEGORY_RULES],
    "'GENERIC'",
)


@query(
    "str_18_category",
    f"""WITH {CLAIMS} SELECT interaction_type, verb, {CATEGORY_CASE} AS category,
 {case_sql([(f"regexp_matches(verb, {q('(?i)' + p)})", f"'{c}'") for p, c in V.CATEGORY_RULES], "'GENERIC'")} AS category_by_rule, count(*) AS n
 FROM claims GROUP BY ALL""",
)
def categories(spark, sf):
    return (
        claims(spark, sf)
        .groupBy("interaction_type", "verb")
        .agg(F.count("*").alias("n"))
        .select(
            "interaction_type",
            "verb",
            R.category_of("interaction_type", "verb").alias("category"),
            R.category_by_rule("verb").alias("category_by_rule"),
            "n",
        )
    )


@query(
    "str_20_negation",
    f"""WITH {CLAIMS} SELECT claim_id, {any_sql("text", V.SENTENCE_NEGATION, "(?i)")} AS negated, {first_sql("text", V.SENTENCE_NEGATION)} AS matched FROM claims""",
)
def negation(spark, sf):
    return claims(spark, sf).select(
        "claim_id", E.is_negated("text").alias("negated"), E.negation_match("text").alias("matched")
    )


EVIDENCE_CASE = case_sql(
    [(any_sql("text", ps, "(?i)"), f"'{k}'") for k, ps in V.EVIDENCE_PATTERNS.items()], "'unknown'"
)
PUBTYPE_CASE = case_sql([(f"contains(ptype, {q(n)})", f"'{k}'") for n, k in V.PUBLICATION_TYPES], "NULL")
EVIDENCE_SCORE_CASE = case_sql(
    [(f"evidence_type = '{k}'", f"CAST({v} AS DOUBLE)") for k, v in V.EVIDENCE_WEIGHTS.items()], "CAST(0.3 AS DOUBLE)"
)


@query(
    "str_21_evidence_type",
    f"""WITH {CLAIMS}, t AS (SELECT claim_id, text, CASE reads % 5 WHEN 0 THEN 'case reports' WHEN 1 THEN 'systematic review' ELSE 'journal article' END AS ptype FROM claims),
 e AS (SELECT claim_id, coalesce({PUBTYPE_CASE}, {EVIDENCE_CASE}) AS evidence_type,
   {first_sql("text", [p for ps in V.EVIDENCE_PATTERNS.values() for p in ps])} AS matched FROM t)
 SELECT claim_id, evidence_type, matched, {EVIDENCE_SCORE_CASE} AS evidence_score FROM e""",
)
def evidence_types(spark, sf):
    r = F.col("reads") % 5
    ptypes = F.array(F.lit("Journal Article"), F.when(r == 0, "Case Reports").when(r == 1, " Systematic Review").otherwise("Letter"))
    return (
        claims(spark, sf)
        .withColumn("evidence_type", E.evidence_type("text", ptypes))
        .select(
            "claim_id",
            "evidence_type",
            E.evidence_match("text").alias("matched"),
            E.evidence_score("evidence_type").alias("evidence_score"),
        )
    )


@query(
    "str_22_lexicon_signal",
    f"""WITH {CLAIMS}, {LEX} SELECT claim_id, CAST(lex_strong AS INTEGER) AS lex_strong, CAST(lex_weak AS INTEGER) AS lex_weak, lex_negated,
 CAST(lex_method AS INTEGER) AS lex_method, lex_strength, lex_signal FROM lex""",
)
def lexicon_signal(spark, sf):
    return E.with_lexicon(claims(spark, sf).select("claim_id", "text"), "text").drop("text")


@query(
    "str_23_rule_classifier",
    f"""WITH {CLAIMS}, {LEX}, s AS (SELECT *, {SPECIES_SQL} AS n_species FROM lex)
 SELECT claim_id, CASE WHEN lex_signal AND n_species >= 2 THEN 1 ELSE 0 END AS rule_label,
  CASE WHEN NOT lex_signal THEN 'no_interaction_verb' WHEN n_species < 2 THEN 'insufficient_species' ELSE 'rule_positive' END AS rule_reason,
  CASE WHEN NOT lex_signal THEN CAST(0.90 AS DOUBLE) WHEN n_species < 2 THEN CAST(0.85 AS DOUBLE)
   ELSE round(least(CAST(0.95 AS DOUBLE), CAST(0.60 AS DOUBLE) + lex_strength * CAST(0.40 AS DOUBLE)), 3) END AS rule_confidence FROM s""",
)
def rule_classifier(spark, sf):
    c = E.with_lexicon(claims(spark, sf).select("claim_id", "text"), "text").withColumn(
        "n_species", N.count_species("text")
    )
    label, confidence, reason = E.rule_decision(F.col("lex_signal"), F.col("lex_strength"), F.col("n_species"))
    return c.select(
        "claim_id", label.alias("rule_label"), reason.alias("rule_reason"), confidence.alias("rule_confidence")
    )


OUTCOME_SQL = """CASE WHEN lex_method >= 2 AND NOT (has_term AND score >= 0.5) THEN 'METHODOLOGY' WHEN n_species = 0 THEN 'NO_SPECIES' WHEN n_species = 1 THEN 'ONE_SPECIES'
 WHEN lex_negated AND (lex_strength > 0 OR has_term) THEN 'NEGATED' WHEN score >= 0.5 AND (has_term OR lex_strength >= 0.15) THEN 'INTERACTION'
 WHEN score >= 0.5 AND n_species >= 2 THEN 'IMPLICIT' WHEN score >= 0.5 THEN 'INTERACTION_WEAK' WHEN lex_strength >= 0.4 OR has_term THEN 'BORDERLINE'
 ELSE 'TWO_SPECIES_NO_VERB' END"""


@query(
    "str_24_outcome_code",
    f"""WITH {CLAIMS}, {LEX}, s AS (SELECT *, {SPECIES_SQL} AS n_species, contains(low, verb) AS has_term, confidence AS score, source_species || ', ' || target_species AS subjects FROM lex),
 o AS (SELECT *, {OUTCOME_SQL} AS outcome, CAST(CAST(round(score * 100) AS INTEGER) AS VARCHAR) || '%' AS pct FROM s)
 SELECT claim_id, outcome, CASE outcome WHEN 'INTERACTION' THEN subjects || ' are linked by ''' || verb || ''' (' || interaction_type || ', ' || pct || ').'
  WHEN 'INTERACTION_WEAK' THEN 'Predicted at ' || pct || ' without interaction vocabulary.' WHEN 'NO_SPECIES' THEN 'No species names found.'
  WHEN 'ONE_SPECIES' THEN 'Only one organism found: ' || subjects || '.' WHEN 'TWO_SPECIES_NO_VERB' THEN 'Organisms found (' || subjects || ') but no interaction vocabulary.'
  WHEN 'NEGATED' THEN '''' || verb || ''' is negated.' WHEN 'METHODOLOGY' THEN 'Methods or statistics wording.'
  WHEN 'BORDERLINE' THEN 'Score ' || pct || ' and signal ' || printf('%.2f', lex_strength) || ' disagree.' ELSE subjects || ' co-occur without interaction vocabulary.' END AS explanation FROM o""",
)
def outcome_codes(spark, sf):
    c = with_outcome(claims(spark, sf))
    text = E.outcome_text(
        F.col("outcome"),
        F.concat_ws(", ", "source_species", "target_species"),
        F.col("verb"),
        F.col("interaction_type"),
        F.col("confidence"),
        F.col("lex_strength"),
    )
    return c.select("claim_id", "outcome", text.alias("explanation"))


def with_outcome(c):
    c = E.with_lexicon(c, "text").withColumns(
        {"n_species": N.count_species("text"), "has_term": F.lower("text").contains(F.col("verb"))}
    )
    return c.withColumn(
        "outcome",
        E.outcome_code(
            F.col("n_species"), F.col("lex_strength"), F.col("lex_negated"), F.col("lex_method") >= 2,
            F.col("confidence"), F.col("has_term"),
        ),
    )


def _specificity_sql(t: str) -> str:
    exact = case_sql([(f"{t} = {q(k)}", repr(v)) for k, v in V.TERM_SPECIFICITY.items()], "NULL")
    near = case_sql(
        [(f"contains({t}, {q(k)}) OR contains({q(k)}, {t})", repr(v)) for k, v in V.TERM_SPECIFICITY.items()], "NULL"
    )
    return f"CAST(coalesce({exact}, {near}, 0.5) AS DOUBLE)"


@query(
    "str_25_match_quality",
    f"""WITH {CLAIMS}, m AS (SELECT *, length(source_species) + length(target_species) + length(verb) AS mlen FROM claims),
 p AS (SELECT claim_id, text, CASE WHEN mlen < 15 THEN mlen / CAST(30 AS DOUBLE) ELSE least(mlen / CAST(60 AS DOUBLE), CAST(1 AS DOUBLE)) END * 40 AS ls,
   CASE WHEN regexp_matches(source_species, '^[A-Z][a-z]+ [a-z]+') THEN 15 ELSE 0 END + CASE WHEN regexp_matches(target_species, '^[A-Z][a-z]+ [a-z]+') THEN 15 ELSE 0 END AS bs,
   {_specificity_sql("lower(verb)")} * 20 AS ss, CASE WHEN length(text) BETWEEN 80 AND 250 THEN 5 WHEN length(text) BETWEEN 50 AND 350 THEN 3 ELSE 0 END
    + CASE WHEN regexp_matches(substr(text, 1, 1), '^\\p{{Lu}}') THEN 2 ELSE 0 END + CASE WHEN text LIKE '%.' THEN 2 ELSE 0 END
    - CASE WHEN length(regexp_replace(text, '[a-zA-Z0-9\\s.,;:''"()-]', '', 'g')) / greatest(length(text), 1) > 0.1 THEN 3 ELSE 0 END AS fs FROM m)
 SELECT claim_id, round(ls, 4) AS length_score, CAST(bs AS DOUBLE) AS binomial_score, round(ss, 4) AS specificity_score,
  CAST(greatest(0, least(10, fs)) AS DOUBLE) AS form_score, round(ls + bs + ss + greatest(0, least(10, fs)), 4) AS total_score FROM p""",
)
def match_quality(spark, sf):
    c = claims(spark, sf).withColumn(
        "match_length", F.length("source_species") + F.length("target_species") + F.length("verb")
    )
    parts = E.match_quality("text", "source_species", "target_species", "verb", "match_length")
    return c.select("claim_id", *[F.round(v, 4).alias(k) for k, v in parts.items()])


@query(
    "str_27_wrong_accepts",
    f"""WITH {CLAIMS}, p AS (SELECT claim_id, text, lower(text) AS low, NOT {any_stem_sql("lower(text)", V.INTERACTION_STEMS)} AS no_verb,
   {stems_sql("lower(text)", V.WRONG_ACCEPT_CUES)} AS cues, len(regexp_extract_all(text, '[A-Z][a-z]+(?:\\s+[a-z]+)?')) AS heads,
   lower(regexp_extract(text, '(?s)[A-Z][a-z]+(?:\\s+[a-z]+)?(.*)[A-Z][a-z]+(?:\\s+[a-z]+)?', 1)) AS mid, len(regexp_extract_all(text, '\\b[A-Z][a-z]+\\s+[a-z]{{3,}}\\b')) AS n FROM claims),
 s AS (SELECT *, heads < 2 OR NOT {any_stem_sql("mid", V.INTERACTION_STEMS)} AS no_struct FROM p),
 f AS (SELECT *, list_filter([CASE WHEN cues > 0 THEN 'wrong_accept_cues' END, CASE WHEN no_verb THEN 'no_interaction_verb' END,
   CASE WHEN no_struct THEN 'no_interaction_structure' END, CASE WHEN n > 4 THEN 'many_species' WHEN n < 2 THEN 'few_species' END], lambda x: x IS NOT NULL) AS flags FROM s)
 SELECT claim_id, array_to_string(flags, ',') AS flags, round(least(CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) + CASE WHEN no_verb THEN 0.4 ELSE 0 END + least(len(flags) * CAST(0.15 AS DOUBLE), CAST(0.4 AS DOUBLE))
   + CASE WHEN length(text) < 50 THEN 0.1 ELSE 0 END + CASE WHEN length(text) > 300 THEN 0.1 ELSE 0 END + CASE WHEN no_struct THEN 0.2 ELSE 0 END
   + CASE WHEN n > 4 THEN 0.15 ELSE 0 END), 4) AS probability FROM f""",
)
def wrong_accepts(spark, sf):
    flags, prob = E.wrong_accept_parts("text")
    return claims(spark, sf).select(
        "claim_id", F.array_join(flags, ",").alias("flags"), F.round(prob, 4).alias("probability")
    )


@query(
    "str_28_keyword_quality",
    f"""WITH {CLAIMS}, k AS (SELECT claim_id, label, {stems_sql("lower(text)", V.KEYWORDS_L1)} AS l1, {stems_sql("lower(text)", V.KEYWORDS_L2)} AS l2,
  {stems_sql("lower(text)", V.KEYWORDS_L3)} AS l3, {any_stem_sql("lower(text)", V.INTERACTION_PHRASES)} AS ph, {stems_sql("lower(text)", V.NON_INTERACTION)} AS ot FROM claims)
 SELECT claim_id, CAST(l1 * 4 + l2 * 2 + l3 + CASE WHEN ph THEN 3 ELSE 0 END - greatest(0, ot - 2) AS INTEGER) AS as_positive,
  CAST(ot * 2 - l1 * 5 - l2 * 3 - CASE WHEN ph THEN 5 ELSE 0 END AS INTEGER) AS as_negative FROM k""",
)
def keyword_quality(spark, sf):
    pos, neg = E.keyword_quality("text")
    return claims(spark, sf).select("claim_id", pos.cast("int").alias("as_positive"), neg.cast("int").alias("as_negative"))


_STRONG = V.INFECTION_PATTERNS + V.HOST_PARASITE_PATTERNS + V.PREDATION_PATTERNS


@query(
    "str_29_sentence_class",
    f"""WITH {CLAIMS}, p AS (SELECT claim_id, text, lower(text) AS low, {count_sql("lower(text)", _STRONG + V.OTHER_INTERACTION_PATTERNS)} AS tp,
  {count_sql("lower(text)", V.NO_INTERACTION_PATTERNS)} AS fp FROM claims),
 r AS (SELECT claim_id, CASE WHEN length(text) < 15 THEN 'false_positive|high|too_short' WHEN tp >= 2 AND fp = 0 THEN 'true_positive|high|strong_interaction_evidence'
  WHEN tp = 1 AND fp = 0 THEN 'true_positive|high|clear_interaction_pattern' WHEN fp >= 2 AND tp = 0 THEN 'false_positive|high|methodology_focused'
  WHEN fp = 1 AND tp = 0 THEN 'false_positive|medium|methodology_pattern_present' WHEN tp > fp AND fp >= 1 THEN 'true_positive|medium|interaction_despite_methodology'
  WHEN fp > tp AND tp >= 1 THEN 'false_positive|medium|methodology_despite_interaction' WHEN tp >= 1 AND {any_sql("low", _STRONG)} THEN 'true_positive|low|strong_interaction_in_mixed_context'
  WHEN tp >= 1 THEN 'false_positive|low|unclear_mixed_context' WHEN regexp_matches(low, {q(V.DISEASE_CONTEXT)}) THEN 'true_positive|medium|disease_context'
  WHEN regexp_matches(low, {q(V.TREATED_ANIMALS)}) THEN 'true_positive|medium|experimental_organism_context'
  WHEN regexp_matches(low, {q(V.ORGANISM_IN_ORGANISM)}) THEN 'true_positive|medium|organism_in_organism' WHEN regexp_matches(low, {q(V.CAUSATION)}) THEN 'true_positive|low|causation_language'
  WHEN {any_stem_sql("low", V.BIOLOGY_WORDS)} THEN 'true_positive|low|biological_interaction_term' WHEN {stems_sql("low", V.MOLECULE_WORDS)} >= 2 THEN 'false_positive|low|molecular_focus'
  WHEN regexp_matches(low, {q(V.COMPARISON)}) AND NOT regexp_matches(low, {q(V.COMPARISON_EXCEPTION)}) THEN 'false_positive|low|comparative_statement'
  WHEN {any_stem_sql("low", V.CONTEXT_HINTS)} THEN 'true_positive|low|interaction_context_hint' ELSE 'true_positive|low|default_assumed_interaction' END AS r FROM p)
 SELECT claim_id, split_part(r, '|', 1) AS class, split_part(r, '|', 2) AS confidence, split_part(r, '|', 3) AS reason FROM r""",
)
def sentence_classes(spark, sf):
    c = E.with_sentence_class(claims(spark, sf).select("claim_id", "text"), "text")
    return c.select("claim_id", "class", "confidence", "reason")


@query(
    "str_30_list_cells",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '|' || 'u' || user_id ELSE event_type || '|' || user_id || '|x' END AS parsed FROM events""",
)
def list_cells(spark, sf):
    """Half of the cells hold a JSON list, half a comma list with stray blanks."""
    e = load(spark, sf, "events").select(
        "event_id",
        F.when(
            F.col("event_id") % 2 == 0,
            F.concat(F.lit('["'), F.col("event_type"), F.lit('", "u'), F.col("user_id").cast("string"), F.lit('", " "]')),
        )
        .otherwise(F.concat(F.col("event_type"), F.lit(" , "), F.col("user_id").cast("string"), F.lit(",, x")))
        .alias("cell"),
    )
    return e.select("event_id", F.array_join(parse_list_cell("cell"), "|").alias("parsed"))


def parse_list_cell(c):
    """JSON list or comma list in one cell → trimmed non-empty items."""
    c = F.col(c)
    items = F.coalesce(F.from_json(c, "array<string>"), F.split(c, ","))
    empty = c.isNull() | F.trim(c).isin("", "nan", "[]")
    return F.when(empty, F.array().cast("array<string>")).otherwise(
        F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    )


@query(
    "str_31_covering_window",
    f"""WITH {SENTENCES}, d AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS flat FROM documents),
 sp AS (SELECT doc_id, flat, strpos(flat, ' the ') AS p1, length(flat) - strpos(reverse(flat), ' ') AS p2 FROM d WHERE strpos(flat, ' the ') > 0),
 parts AS (SELECT doc_id, p1 AS lo, p1 + 5 AS hi, string_split(regexp_replace(flat, '([.!?]) ([A-Z])', '\\1§\\2', 'g'), '§') AS ps FROM sp),
 u AS (SELECT doc_id, lo, hi, i, ps[i] AS part, list_sum(list_transform(ps[1:i-1], lambda x: length(x) + 1)) AS st FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM parts)),
 k AS (SELECT doc_id, i, part FROM u WHERE NOT (coalesce(st, 0) + length(part) < lo - 1 OR coalesce(st, 0) > hi - 1))
 SELECT doc_id, string_agg(part, ' ' ORDER BY i) AS covering FROM k GROUP BY doc_id""",
)
def covering_window(spark, sf):
    """Smallest run of whole sentences covering the span of the first " the "."""
    d = load(spark, sf, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")).alias("flat"))
    d = d.withColumn("lo", F.instr("flat", " the ") - 1).where(F.col("lo") >= 0).withColumn("hi", F.col("lo") + 5)
    return d.select("doc_id", covering_sentences("flat", F.col("lo"), F.col("hi")).alias("covering"))


def covering_sentences(text, lo, hi):
    parts = F.split(F.regexp_replace(text, r"([.!?]) ([A-Z])", "$1§$2"), "§")
    empty = F.array().cast("array<struct<s:int,e:int,p:string>>")
    spans = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + 1).alias("at"),
            F.when(
                (acc["at"] + F.length(p) >= lo) & (acc["at"] <= hi),
                F.concat(
                    acc["out"],
                    F.array(F.struct(acc["at"].alias("s"), (acc["at"] + F.length(p)).alias("e"), p.alias("p"))),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )
    return F.array_join(F.transform(spans["out"], lambda s: s["p"]), " ")


@query(
    "str_34_shingles",
    f"""WITH n AS (SELECT doc_id, string_split({norm_ascii_sql("text")}, ' ') AS w FROM documents),
 s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i+4], ' ')))) AS g FROM n)
 SELECT doc_id, count(*) AS n_shingles, min(md5(g)) AS min_digest, max(md5(g)) AS max_digest FROM s GROUP BY doc_id""",
)
def shingle_profile(spark, sf):
    """Profiles are made where a text lies, so no shingle is sorted or shuffled; rows of one id are then added up."""
    d = spread(load(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.array_compact(F.transform(T.shingles("text", 5), lambda x: F.md5(x))).alias("h"))
    d = d.select("doc_id", T.bind(F.col("h"), lambda h: F.struct(F.when(F.size(h) > 0, F.size(h)).alias("n"), F.array_min(h).alias("lo"), F.array_max(h).alias("hi"))).alias("s"))
    out = d.groupBy("doc_id").agg(F.sum(F.col("s.n").cast("bigint")).alias("n_shingles"), F.min("s.lo").alias("min_digest"), F.max("s.hi").alias("max_digest"))
    return out.where("n_shingles is not null")  # documents without a text have none


@query(
    "str_35_pair_position",
    f"""WITH {CLAIMS}, p AS (SELECT claim_id, text, strpos(lower(text), lower(source_species)) AS a, length(source_species) AS la,
   strpos(lower(text), lower(target_species)) AS b, length(target_species) AS lb, contains(lower(text), lower(verb)) AS has_term FROM claims),
 o AS (SELECT *, CASE WHEN a > 0 AND b > 0 AND a < b THEN substr(text, a + la, greatest(b - a - la, 0)) WHEN a > 0 AND b > 0 THEN substr(text, b + lb, greatest(a - b - lb, 0)) END AS mid FROM p)
 SELECT claim_id, CAST(len({words_sql("mid")}) AS INTEGER) AS tokens_between, NOT regexp_matches(mid, '[;.]|\\)\\s*[A-Z]') AS same_clause,
  a > 0 AS has_source, b > 0 AS has_target, has_term, CAST(CAST(a = 0 AS INTEGER) + CAST(b = 0 AS INTEGER) + CAST(NOT has_term AS INTEGER) AS INTEGER) AS n_missing FROM o""",
)
def pair_position(spark, sf):
    c = claims(spark, sf).withColumns(
        {
            "a": F.expr("instr(lower(text), lower(source_species))"),
            "b": F.expr("instr(lower(text), lower(target_species))"),
            "has_term": F.lower("text").contains(F.lower("verb")),
        }
    )
    mid = F.expr(
        "case when a > 0 and b > 0 and a < b then substring(text, a + length(source_species), greatest(b - a - length(source_species), 0)) "
        "when a > 0 and b > 0 then substring(text, b + length(target_species), greatest(a - b - length(target_species), 0)) end"
    )
    c = c.withColumn("mid", mid)
    missing = (F.col("a") == 0).cast("int") + (F.col("b") == 0).cast("int") + (~F.col("has_term")).cast("int")
    return c.select(
        "claim_id",
        F.when(F.col("mid").isNotNull(), F.size(T.words("mid"))).alias("tokens_between"),
        (~F.col("mid").rlike(r"[;.]|\)\s*[A-Z]")).alias("same_clause"),
        (F.col("a") > 0).alias("has_source"),
        (F.col("b") > 0).alias("has_target"),
        "has_term",
        missing.alias("n_missing"),
    )


@query(
    "mth_01_temporal_decay",
    f"""WITH {CLAIMS}, y AS (SELECT claim_id, CASE WHEN reads % 10 = 0 THEN NULL ELSE pub_year END AS y FROM claims)
 SELECT claim_id, CASE WHEN y IS NULL THEN CAST(0.4 AS DOUBLE) ELSE round(exp(-(ln(2) / 15) * greatest(0, 2026 - y)), 4) END AS temporal FROM y""",
)
def temporal_decay(spark, sf):
    year = F.when(F.col("reads") % 10 != 0, F.col("pub_year"))
    return claims(spark, sf).select("claim_id", M.temporal_score(year).alias("temporal"))


@query(
    "mth_02_score_fusion",
    f"""WITH {SCORED} SELECT item_id, round((score + score_b) / 2, 6) AS arithmetic, {", ".join(f"round(score * CAST({w} AS DOUBLE) + score_b * (1 - CAST({w} AS DOUBLE)), 6) AS w{int(w * 10)}" for w in (0.3, 0.4, 0.5, 0.6, 0.7))},
 greatest(score, score_b) AS maximum, round(sqrt(least(greatest(score * score_b, 1e-12), CAST(1 AS DOUBLE))), 6) AS geometric FROM scored""",
)
def score_fusion(spark, sf):
    fused = M.fuse(F.col("score"), F.col("score_b"))
    return scored(spark, sf).select("item_id", *[F.round(v, 6).alias(k) for k, v in fused.items()])


@query(
    "mth_03_prior_threshold",
    f"""WITH {SCORED}, g AS (SELECT source, avg(label) AS p, count(*) AS n FROM scored GROUP BY source), o AS (SELECT avg(label) AS p0 FROM scored)
 SELECT source, round(1 / (1 + exp(ln(p0 / (1 - p0)) - ln(p / (1 - p)))), 6) AS threshold, round(ln(p / (1 - p)), 6) AS logit_rate FROM g, o""",
)
def prior_thresholds(spark, sf):
    s = scored(spark, sf)
    by = s.groupBy("source").agg(F.avg("label").alias("p"))
    overall = s.agg(F.avg("label"))
    return by.select(
        "source",
        F.round(M.prior_threshold(F.col("p"), overall.scalar()), 6).alias("threshold"),
        F.round(M.logit(F.col("p"), 1e-9), 6).alias("logit_rate"),
    )


@query(
    "mth_05_grades",
    f"""WITH {CLAIMS} SELECT claim_id, round(confidence * (reads / CAST(50 AS DOUBLE)), 3) AS weighted,
 CASE WHEN confidence >= 0.85 THEN 'A' WHEN confidence >= 0.7 THEN 'B' WHEN confidence >= 0.55 THEN 'C' WHEN confidence >= 0.4 THEN 'D' ELSE 'F' END AS grade FROM claims""",
)
def grades(spark, sf):
    return claims(spark, sf).select(
        "claim_id",
        F.round(F.col("confidence") * (F.col("reads") / F.lit(50.0)), 3).alias("weighted"),
        M.grade("confidence").alias("grade"),
    )


@query(
    "dat_01_years",
    """WITH y AS (SELECT o_custkey AS group_id, CASE WHEN o_orderkey % 9 = 0 THEN 'n.d.' ELSE strftime(o_orderdate, '%Y-%m') END AS d FROM orders),
 a AS (SELECT group_id, 2026 - TRY_CAST(substr(d, 1, 4) AS INTEGER) AS age FROM y)
 SELECT group_id, count(age) AS n_dated, CAST(median(age) AS DOUBLE) AS median_age, round(100 * CAST(count(*) FILTER (WHERE age <= 28) AS DOUBLE) / nullif(count(age), 0), 4) AS pct_recent FROM a GROUP BY group_id""",
)
def years(spark, sf):
    d = F.when(F.col("o_orderkey") % 9 == 0, "n.d.").otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    age = F.lit(V.CURRENT_YEAR) - M.year_of(d)
    return (
        load(spark, sf, "orders")
        .select(F.col("o_custkey").alias("group_id"), age.alias("age"))
        .groupBy("group_id")
        .agg(
            F.count("age").alias("n_dated"),
            F.median("age").alias("median_age"),
            F.round(F.try_divide(100.0 * F.count_if(F.col("age") <= 28), F.count("age")), 4).alias("pct_recent"),
        )
    )


@query(
    "arr_01_alternatives",
    """WITH c AS (SELECT conv_id, turn, string_split(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' ') AS w FROM conversations),
 n AS (SELECT conv_id, turn, w, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM c)
 SELECT conv_id, turn, w[1] AS first_item, list_filter(w, lambda x: x <> '')[1] AS first_filled, CAST(len(w) AS INTEGER) AS n_items,
  CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct, list_has_any(w, nxt) AS shares_next FROM n""",
)
def alternatives(spark, sf):
    from pyspark.sql import Window

    c = load(spark, sf, "conversations").select(
        "conv_id", "turn", F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")), " ").alias("w")
    )
    c = c.withColumn("nxt", F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select(
        "conv_id",
        "turn",
        F.try_element_at("w", F.lit(1)).alias("first_item"),
        F.try_element_at(F.filter("w", lambda x: x != ""), F.lit(1)).alias("first_filled"),
        F.size("w").alias("n_items"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.arrays_overlap("w", "nxt").alias("shares_next"),
    )


@query(
    "map_01_histogram",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
 SELECT user_id, string_agg(event_type || '=' || n, ';' ORDER BY event_type) AS histogram, CAST(max(n) AS BIGINT) AS most FROM c GROUP BY user_id""",
)
def histogram(spark, sf):
    c = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    rows = F.array_sort(F.map_entries("m"))
    return m.select(
        "user_id",
        F.array_join(F.transform(rows, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("histogram"),
        F.array_max(F.map_values("m")).alias("most"),
    )


@query(
    "jsn_01_flatten",
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, coalesce(json_extract_string(props, '$.note'), 'none') AS note,
 '{"event":"' || event_type || '","user":' || user_id || '}' AS record FROM events""",
)
def flatten(spark, sf):
    e = load(spark, sf, "events").withColumn("p", F.from_json("props", "k int, note string"))
    return e.select(
        "event_id",
        F.coalesce("p.k", F.lit(-1)).alias("k"),
        F.coalesce("p.note", F.lit("none")).alias("note"),
        F.to_json(F.struct(F.col("event_type").alias("event"), F.col("user_id").alias("user"))).alias("record"),
    )


