"""Graph building and re-ranking over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as V
from claimweave.functions import maths as M
from claimweave.functions import relations as R
from claimweave.operators import graph as G
from claimweave.operators import rerank as RR
from claimweave.plans.registry import query
from claimweave.plans.scalar import CATEGORY_CASE
from claimweave.plans.sqltext import list_sql, values_sql
from claimweave.plans.tables import CLAIMS, KNOWN_PAIRS, SAMPLES, claims, known_pairs, load, samples, spread
from claimweave.session import broadcast_if_small, stage


@query(
    "grf_01_claim_graph",
    f"""WITH {CLAIMS}, l AS (SELECT interaction_type, verb, source_species, unnest(CASE WHEN reads % 4 = 0 THEN [target_species, source_species] ELSE [target_species] END) AS object FROM claims WHERE label = 1)
 SELECT source_species AS subject, object, {CATEGORY_CASE} AS category, count(*) AS n FROM l WHERE lower(source_species) <> lower(object) GROUP BY ALL""",
)
def claim_graph(spark, sf):
    """Every fourth claim lists two targets, one of them the source itself (a self-loop to drop)."""
    c = claims(spark, sf).where("label = 1")
    both = F.array("target_species", "source_species")
    c = c.select("interaction_type", "verb", F.array("source_species").alias("s"), F.when(F.col("reads") % 4 == 0, both).otherwise(F.array("target_species")).alias("t"))
    e = G.exploded_edges(c, "s", "t", ["interaction_type", "verb"]).groupBy("subject", "object", "interaction_type", "verb").agg(F.count("*").alias("n"))
    return e.groupBy("subject", "object", R.category_of("interaction_type", "verb").alias("category")).agg(F.sum("n").alias("n"))


@query(
    "grf_02_node_table",
    """WITH n AS (SELECT DISTINCT lower(p_name) AS node FROM part UNION SELECT lower(s_name) FROM supplier), a AS (SELECT lower(p_name) AS node, min(p_brand) AS grp FROM part WHERE p_size < 25 GROUP BY 1)
 SELECT n.node, grp, grp IS NOT NULL AS matched FROM n LEFT JOIN a ON a.node = n.node""",
)
def node_table(spark, sf):
    part = load(spark, sf, "part")
    n = part.select(F.lower("p_name").alias("node")).union(load(spark, sf, "supplier").select(F.lower("s_name"))).distinct()
    a = part.where("p_size < 25").groupBy(F.lower("p_name").alias("node")).agg(F.min("p_brand").alias("grp"))
    return n.join(a, "node", "left").withColumn("matched", F.col("grp").isNotNull())


TERMS = [
    ("preys on", "preys on", True, "RO_0002439"),
    ("parasite of", "parasite of", True, "RO_0002444"),
    ("endoparasite of", "endoparasite of", True, "RO_0002634"),
    ("pollinates", "pollinates", True, "RO_0002455"),
    ("grazes on", "grazes on", True, "RO_0002470"),
    ("interacts with", "interacts with", False, "RO_0002434"),
]
ETYPE1 = ["PATHOGEN", "HOST", "VECTOR", "ORGANISM", "ORGANISM", "DISEASE", "ORGANISM"]
ETYPE2 = ["HOST", "VECTOR", "PATHOGEN", "ORGANISM", "HOST", "PATHOGEN", "ORGANISM"]
RAW_EDGES = f"""raw AS (SELECT claim_id AS id, source_species AS name_1, ([{list_sql(ETYPE1)}])[pos] AS type_1, source_kingdom AS kingdom_1, target_species AS name_2, ([{list_sql(ETYPE2)}])[pos] AS type_2, target_kingdom AS kingdom_2,
  CASE WHEN reads % 9 = 0 THEN 'strange tie' WHEN reads % 9 = 1 THEN 'symbioticWith' WHEN reads % 9 = 2 THEN ''
   WHEN reads % 9 = 3 THEN substr(regexp_replace(verb, '^is an? ', ''), 1, length(regexp_replace(verb, '^is an? ', '')) - 1) WHEN reads % 9 = 4 THEN 'hyper' || regexp_replace(verb, '^is an? ', '') || 'ward' ELSE regexp_replace(verb, '^is an? ', '') END AS interaction_type FROM claims)"""


def raw_edges(spark, sf):
    pick = lambda vals: F.element_at(F.array(*[F.lit(v) for v in vals]), F.col("pos").cast("int"))
    r = F.col("reads") % 9
    form = F.regexp_replace("verb", "^is an? ", "")
    # cut short and lengthened forms: known terms inside them, and they inside known terms, away from word bounds
    term = (
        F.when(r == 0, "strange tie").when(r == 1, "symbioticWith").when(r == 2, "")
        .when(r == 3, F.substr(form, F.lit(1), F.length(form) - 1)).when(r == 4, F.concat(F.lit("hyper"), form, F.lit("ward"))).otherwise(form)
    )
    return claims(spark, sf).select(
        F.col("claim_id").alias("id"), F.col("source_species").alias("name_1"), pick(ETYPE1).alias("type_1"), F.col("source_kingdom").alias("kingdom_1"),
        F.col("target_species").alias("name_2"), pick(ETYPE2).alias("type_2"), F.col("target_kingdom").alias("kingdom_2"), term.alias("interaction_type"),
    )


_listed = {(a, b) for a, b, *_ in V.ENTITY_TYPE_RELATIONS}
TYPE_ROWS = [(a, b, p, d, r, False) for a, b, p, d, r in V.ENTITY_TYPE_RELATIONS] + [
    (b, a, p, d, r, True) for a, b, p, d, r in V.ENTITY_TYPE_RELATIONS if (b, a) not in _listed
]
INFER = f"""{RAW_EDGES}, {values_sql("types", ["type_1", "type_2", "pred", "dir", "rid", "swap"], TYPE_ROWS)}, {values_sql("terms", ["term", "predicate", "directed", "ro_id"], TERMS)},
keys AS (SELECT DISTINCT lower(trim(interaction_type)) AS key FROM raw), near AS (SELECT key, predicate, directed, ro_id FROM keys JOIN terms ON key <> '' AND (contains(key, term) OR contains(term, key)) QUALIFY row_number() OVER (PARTITION BY key ORDER BY length(term) DESC, term) = 1),
j AS (SELECT raw.*, lower(trim(interaction_type)) AS key, pred, dir, rid, swap, coalesce(e.predicate, n.predicate) AS tp, coalesce(e.directed, n.directed) AS td, coalesce(e.ro_id, n.ro_id) AS tr FROM raw LEFT JOIN types t ON t.type_1 = raw.type_1 AND t.type_2 = raw.type_2
  LEFT JOIN terms e ON e.term = lower(trim(interaction_type)) LEFT JOIN near n ON n.key = lower(trim(interaction_type))),
s AS (SELECT *, CASE WHEN pred IS NOT NULL THEN swap ELSE coalesce(tp IS NOT NULL AND contains(lower(tp), 'pollinat') AND NOT (kingdom_2 IN ('Plantae', 'Viridiplantae') OR type_2 = 'HOST') AND (kingdom_1 IN ('Plantae', 'Viridiplantae') OR type_1 = 'HOST'), FALSE) END AS turn FROM j),
edges AS (SELECT id, CASE WHEN turn THEN name_2 ELSE name_1 END AS subject, CASE WHEN turn THEN name_1 ELSE name_2 END AS object, CASE WHEN pred IS NOT NULL THEN pred WHEN tp IS NOT NULL THEN tp WHEN interaction_type = '' THEN 'interactsWith' ELSE interaction_type END AS predicate,
  CASE WHEN pred IS NOT NULL THEN dir WHEN tp IS NOT NULL THEN td ELSE FALSE END AS directed, CASE WHEN pred IS NOT NULL THEN rid ELSE tr END AS ro_id,
  CASE WHEN pred IS NOT NULL OR tp IS NOT NULL THEN NULL WHEN key = '' OR key IN ({list_sql([x.lower() for x in V.SYMMETRIC_RELATIONS])}) THEN 'ambiguous' ELSE 'unvalidated' END AS flag FROM s)"""


@query("grf_03_relation_inference", f"WITH {CLAIMS}, {INFER} SELECT id, subject, object, predicate, directed, ro_id, flag FROM edges")
def relation_inference(spark, sf):
    terms = spark.createDataFrame(TERMS, "term string, predicate string, directed boolean, ro_id string")
    return G.infer_relations(raw_edges(spark, sf), terms)


@query(
    "grf_04_plausibility_gate",
    f"""WITH {CLAIMS}, v AS (SELECT claim_id, interaction_type, list_filter([CASE WHEN interaction_type = 'pollinates' AND target_kingdom <> 'Plantae' THEN 'required taxon' END, CASE WHEN interaction_type = 'preysOn' AND source_kingdom IN ('Plantae', 'Virus') THEN 'forbidden source' END,
   CASE WHEN interaction_type = 'grazesOn' AND target_kingdom <> 'Plantae' THEN 'required taxon' END, CASE WHEN source_species = target_species THEN 'same species' END], lambda x: x IS NOT NULL) AS violations FROM claims)
 SELECT claim_id, array_to_string(violations, ',') AS violations, CASE WHEN len(violations) > 0 THEN 'kingdom_mismatch' END AS flag FROM v""",
)
def plausibility_gate(spark, sf):
    """A rule table joined on the relation; violations set a flag and the edge stays."""
    v = violations(claims(spark, sf), domain_rules(spark))
    return v.select("claim_id", F.array_join("violations", ",").alias("violations"), F.when(F.size("violations") > 0, "kingdom_mismatch").alias("flag"))


RULES = [
    ("pollination", "pollinat", ["Plantae"], "target", []),
    ("predation", "prey", [], None, ["Plantae", "Virus"]),
    ("herbivory", "graze", ["Plantae"], "target", []),
]


def domain_rules(spark):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(RULES)], "seq int, rule string, pattern string, required array<string>, role string, forbidden array<string>"
    )


def violations(c, rules):
    """First matching rule of the interaction type, then the list of what it finds wrong.

    ``rules`` is a table of rules written by hand, read once; the rule of a row is chosen in place, so no row is dealt out
    by its interaction type, of which there are few.
    """
    fields = ["required", "role", "forbidden"]
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    rule = None
    for r in rules.orderBy("seq").collect():
        found = F.struct(texts(r.required).alias("required"), F.lit(r.role).cast("string").alias("role"), texts(r.forbidden).alias("forbidden"))
        hit = F.lower("interaction_type").rlike(r.pattern)
        rule = F.when(hit, found) if rule is None else rule.when(hit, found)
    j = c.withColumn("_rule", rule).select("*", *[F.col("_rule")[f].alias(f) for f in fields])
    inside = lambda k: F.exists("required", lambda t: F.contains(F.lower(k), F.lower(t)))
    need = F.size("required") > 0
    banned = F.exists("forbidden", lambda t: F.contains(F.lower("source_kingdom"), F.lower(t)))
    same = F.lower(F.trim("source_species")) == F.lower(F.trim("target_species"))
    out = F.array_compact(
        F.array(
            F.when(need & (F.col("role") == "target") & ~inside("target_kingdom"), "required taxon"),
            F.when(need & (F.col("role") == "source") & ~inside("source_kingdom"), "required taxon"),
            F.when(banned, "forbidden source"),
            F.when(same, "same species"),
        )
    )
    return j.withColumn("violations", out)


@query(
    "str_26_domain_rules",
    f"""WITH {CLAIMS}, v AS (SELECT interaction_type, CASE WHEN interaction_type IN ('pollinates', 'grazesOn') AND target_kingdom <> 'Plantae' THEN 1 WHEN interaction_type = 'preysOn' AND source_kingdom IN ('Plantae', 'Virus') THEN 1 ELSE 0 END AS bad,
  CASE WHEN length(source_species) + length(target_species) + length(verb) < 30 THEN 1 ELSE 0 END AS short FROM claims) SELECT interaction_type, count(*) AS n, CAST(sum(bad) AS BIGINT) AS n_violations, CAST(sum(short) AS BIGINT) AS n_short FROM v GROUP BY 1""",
)
def domain_rule_report(spark, sf):
    v = violations(claims(spark, sf), domain_rules(spark))
    short = F.length("source_species") + F.length("target_species") + F.length("verb") < 30
    return v.groupBy("interaction_type").agg(F.count("*").alias("n"), F.count_if(F.size("violations") > 0).alias("n_violations"), F.count_if(short).alias("n_short"))


@query(
    "grf_05_pair_list_edges",
    """WITH p AS (SELECT DISTINCT s_suppkey % 30 AS sp, p_name AS partner FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey)
 SELECT partner AS subject, 'sp' || sp AS object, CASE WHEN sp % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE sp / CAST(30 AS DOUBLE) END AS confidence FROM p""",
)
def pair_list_edges(spark, sf):
    """Semicolon lists of partners per species and order, exploded to distinct edges with a default confidence of 0.5."""
    line = load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    part = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    rows = line.join(part, "l_partkey").select("l_orderkey", (F.col("l_suppkey") % 30).alias("sp"), "p_name")
    lists = rows.groupBy("sp", "l_orderkey").agg(F.array_join(F.collect_list("p_name"), " ; ").alias("partners")).withColumn("score", F.when(F.col("sp") % 2 == 0, 0.0).otherwise(F.col("sp") / F.lit(30.0)))
    e = lists.select("sp", "score", F.explode(F.split("partners", ";")).alias("p")).where(F.trim("p") != "")
    return e.select(F.trim("p").alias("subject"), F.concat(F.lit("sp"), F.col("sp").cast("string")).alias("object"), F.when(F.col("score") > 0, F.col("score")).otherwise(0.5).alias("confidence")).distinct()


@query(
    "grf_06_degrees_hubs",
    f"""WITH {CLAIMS}, e AS (SELECT DISTINCT source_species AS s, target_species AS o FROM claims), x AS (SELECT s AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT o, 0, 1 FROM e)
 SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM x GROUP BY node ORDER BY sum(o) + sum(i) DESC, node LIMIT 20""",
)
def degrees_hubs(spark, sf):
    e = claims(spark, sf).select(F.col("source_species").alias("subject"), F.col("target_species").alias("object"))
    return G.degrees(e).orderBy(F.desc(F.col("out_degree") + F.col("in_degree")), "node").limit(20)


@query(
    "grf_06_multi_host_targets",
    f"WITH {CLAIMS} SELECT interaction_type, target_species, count(DISTINCT source_species) AS n_hosts FROM claims GROUP BY ALL HAVING count(DISTINCT source_species) >= 55",
)
def multi_host_targets(spark, sf):
    return claims(spark, sf).groupBy("interaction_type", "target_species").agg(F.countDistinct("source_species").alias("n_hosts")).where("n_hosts >= 55")


COMP = """e AS (SELECT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem), nodes AS (SELECT 'p' || p_partkey AS node FROM part UNION SELECT a FROM e), both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e)"""
#: Rounds of least labels in the check, more than the distance of any two nodes of the test tables.
COMP_ROUNDS = 16


def _least_labels() -> str:
    step = "m{} AS MATERIALIZED (SELECT x.node, least(x.m, coalesce(min(y.m), x.m)) AS m FROM m{} x LEFT JOIN both_ways ON a = x.node LEFT JOIN m{} y ON y.node = b GROUP BY x.node, x.m)"
    return ", ".join(["m0 AS (SELECT node, node AS m FROM nodes)", *(step.format(k + 1, k, k) for k in range(COMP_ROUNDS))])


@query("grf_07_components", f"WITH {COMP}, {_least_labels()} SELECT node, m AS component FROM m{COMP_ROUNDS}")
def components(spark, sf):
    e = load(spark, sf, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b")
    )
    nodes = load(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node")).union(e.select("a")).distinct()
    return G.components(nodes, e)


@query(
    "grf_08_pair_categories",
    f"""WITH {CLAIMS}, p AS (SELECT lower(source_species) AS a, lower(target_species) AS b, {CATEGORY_CASE} AS category, claim_id AS seq FROM claims), r AS (SELECT a, b, category, seq FROM p WHERE category IN ('PREDATION', 'PARASITISM', 'INFECTION')), x AS (SELECT * FROM r UNION ALL SELECT b, a, category, seq FROM r)
 SELECT a, b, arg_min(category, seq) AS category FROM x GROUP BY a, b""",
)
def pair_categories(spark, sf):
    p = claims(spark, sf).select(
        F.lower("source_species").alias("a"), F.lower("target_species").alias("b"), R.category_of("interaction_type", "verb").alias("category"), F.col("claim_id").alias("seq")
    )
    return G.first_category(p, ["PREDATION", "PARASITISM", "INFECTION"])


@query(
    "grf_09_partner_index",
    f"""WITH {KNOWN_PAIRS}, x AS (SELECT DISTINCT least(p_name, p_type) AS a, greatest(p_name, p_type) AS b FROM part), e AS (SELECT a, b FROM known_pairs UNION SELECT b, a FROM known_pairs UNION SELECT a, b FROM x UNION SELECT b, a FROM x) SELECT a AS species, count(*) AS degree FROM e GROUP BY a""",
)
def partner_index(spark, sf):
    """Two edge sources united, both directions, degree per name."""
    x = load(spark, sf, "part").select(F.least("p_name", "p_type").alias("a"), F.greatest("p_name", "p_type").alias("b")).distinct()
    return G.symmetric(known_pairs(spark, sf).unionByName(x)).groupBy(F.col("a").alias("species")).agg(F.count("*").alias("degree"))


SCORES = """scored_pairs AS (SELECT a, b, ('0x' || substr(md5('bx|' || a || '|' || b), 1, 2))::BIGINT AS h FROM known_pairs), prim AS (SELECT a, b, round(h / CAST(256 AS DOUBLE), 4) AS score FROM scored_pairs WHERE h % 3 = 0),
deg AS (SELECT n, count(*) AS degree FROM (SELECT a AS n FROM known_pairs UNION ALL SELECT b FROM known_pairs) GROUP BY n),
ends AS (SELECT a AS x, b AS y FROM known_pairs UNION ALL SELECT b, a FROM known_pairs), pends AS (SELECT a AS x, b AS y, score FROM prim UNION ALL SELECT b, a, score FROM prim),
fall AS (SELECT s.sample_id, s.species, count(*) AS k FROM samples s JOIN ends ON x = s.species JOIN samples t ON t.sample_id = s.sample_id AND t.species = y GROUP BY ALL),
first AS (SELECT s.sample_id, s.species, sum(score) AS bx, count(*) AS bk FROM samples s JOIN pends ON x = s.species JOIN samples t ON t.sample_id = s.sample_id AND t.species = y GROUP BY ALL),
coh AS (SELECT f.sample_id, f.species, k, coalesce(bk, 0) AS bk, CASE WHEN coalesce(bx, 0) > 0 THEN bx ELSE k / sqrt(greatest(1, degree)) END AS coherence FROM fall f LEFT JOIN first p ON p.sample_id = f.sample_id AND p.species = f.species JOIN deg ON n = f.species)"""


def scored_pairs(spark, sf):
    """Known pairs, every third with a primary score."""
    from claimweave.functions.hashing import hash_bucket, seeded_md5

    h = hash_bucket(seeded_md5("bx", "a", "b"), 2)
    return known_pairs(spark, sf).select("a", "b", F.when(h % 3 == 0, F.round(h / 256.0, 4)).alias("score"))


def coherence(spark, sf):
    """All detections, each with its support in its sample.

    Primary score where any primary partner is present, else the degree-normalised count of known partners; 0 without partners."""
    s = RR.with_support(samples(spark, sf), scored_pairs(spark, sf))
    c = F.when(F.col("score_sum") > 0, F.col("score_sum")).when(F.col("k") > 0, M.coherence_sqrt(F.col("k"), F.col("degree"))).otherwise(0.0)
    return s.select("sample_id", "species", "reads", "k", F.col("n_scored").alias("bk"), c.alias("coherence"))


@query("grf_10_partner_support", f"WITH {SAMPLES}, {KNOWN_PAIRS}, {SCORES} SELECT sample_id, species, k, bk, round(coherence, 6) AS coherence FROM coh")
def partner_support(spark, sf):
    return coherence(spark, sf).where("k > 0").select("sample_id", "species", "k", "bk", F.round("coherence", 6).alias("coherence"))


@query(
    "mth_04_coherence_surprise",
    f"""WITH {SAMPLES}, {KNOWN_PAIRS}, {SCORES}, sizes AS (SELECT sample_id, count(*) AS size FROM samples GROUP BY 1), u AS (SELECT count(*) AS pop FROM deg),
 t AS (SELECT f.sample_id, f.species, k, degree AS bk, size AS n, pop, unnest(range(k, greatest(k, least(degree, least(size, pop))) + 1)) AS i FROM fall f JOIN deg ON deg.n = f.species JOIN sizes USING (sample_id), u),
 lc AS (SELECT *, lgamma(CAST(bk + 1 AS DOUBLE)) - lgamma(CAST(i + 1 AS DOUBLE)) - lgamma(CAST(bk - i + 1 AS DOUBLE)) AS c1, CASE WHEN least(n, pop) - i <= pop - bk THEN lgamma(CAST(pop - bk + 1 AS DOUBLE)) - lgamma(CAST(least(n, pop) - i + 1 AS DOUBLE)) - lgamma(CAST(pop - bk - least(n, pop) + i + 1 AS DOUBLE)) END AS c2,
   lgamma(CAST(pop + 1 AS DOUBLE)) - lgamma(CAST(least(n, pop) + 1 AS DOUBLE)) - lgamma(CAST(pop - least(n, pop) + 1 AS DOUBLE)) AS c3 FROM t)
 SELECT sample_id, species, round(-log10(greatest(sum(CASE WHEN c2 IS NOT NULL THEN exp(c1 + c2 - c3) ELSE 0 END), 1e-300)) + 0.0, 5) AS surprise FROM lc GROUP BY ALL""",
)
def coherence_surprise(spark, sf):
    """The probability of a support depends on four counts only, so it is computed once for each that occurs."""
    pairs = stage(known_pairs(spark, sf), "pairs")
    pop = pairs.select(F.explode(F.array("a", "b")).alias("n")).agg(F.countDistinct("n")).scalar()
    s = RR.with_support(samples(spark, sf).drop("reads"), pairs.withColumn("score", F.lit(None).cast("double")))
    s = s.withColumn("n", F.count("*").over(Window.partitionBy("sample_id"))).where("k > 0")
    s = stage(s.select("sample_id", "species", "k", "degree", "n"), "supports")
    counts = stage(s.select("k", "degree", "n").distinct(), "support-counts").withColumn("pop", pop)
    surprise = M.hypergeom_surprise(F.col("k"), F.col("degree"), F.least("n", "pop"), F.col("pop"))
    table = broadcast_if_small(stage(counts.select("k", "degree", "n", F.round(surprise, 5).alias("surprise")), "surprises"))
    return s.join(table, ["k", "degree", "n"]).select("sample_id", "species", "surprise")


RERANKED = f"""{SAMPLES}, {KNOWN_PAIRS}, {SCORES}, fin AS (SELECT s.sample_id, s.species, reads, coalesce(coherence, 0) AS coherence, round(reads * (1 + coalesce(coherence, 0)), 4) AS final_score FROM samples s LEFT JOIN coh c ON c.sample_id = s.sample_id AND c.species = s.species),
reranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY reads DESC, species) AS original_rank, row_number() OVER (PARTITION BY sample_id ORDER BY final_score DESC, species) AS new_rank FROM fin)"""


def reranked(spark, sf):
    return RR.with_ranks(coherence(spark, sf).drop("k", "bk"), 1.0)


@query("win_03_rerank_samples", f"WITH {RERANKED} SELECT sample_id, species, reads, final_score, CAST(original_rank AS INTEGER) AS original_rank, CAST(new_rank AS INTEGER) AS new_rank, CAST(original_rank - new_rank AS INTEGER) AS delta_rank FROM reranked")
def rerank_samples(spark, sf):
    return reranked(spark, sf).select("sample_id", "species", "reads", "final_score", "original_rank", "new_rank", "delta_rank")


@query("top_03_top_per_sample", f"WITH {RERANKED} SELECT sample_id, species, CAST(new_rank AS INTEGER) AS new_rank FROM reranked WHERE new_rank <= 3")
def top_per_sample(spark, sf):
    return reranked(spark, sf).where("new_rank <= 3").select("sample_id", "species", "new_rank")


@query(
    "agg_37_rank_change_summary",
    f"WITH {RERANKED} SELECT species, round(avg(original_rank - new_rank), 6) AS mean_delta, count(*) AS n_samples, count(*) FILTER (WHERE original_rank > new_rank) AS n_boosted, round(avg(coherence), 6) AS mean_coherence FROM reranked GROUP BY species",
)
def rank_change_summary(spark, sf):
    return reranked(spark, sf).groupBy("species").agg(
        F.round(F.avg("delta_rank"), 6).alias("mean_delta"), F.count("*").alias("n_samples"), F.count_if(F.col("delta_rank") > 0).alias("n_boosted"), F.round(F.avg("coherence"), 6).alias("mean_coherence")
    )


def _metrics_sql(r: str, tag: str) -> str:
    return f"""round(CASE WHEN count(*) FILTER (WHERE t) > 0 THEN 1 / CAST(min(CASE WHEN t THEN {r} END) AS DOUBLE) ELSE 0 END, 6) AS rr_{tag}, round(CASE WHEN count(*) FILTER (WHERE t) > 0 THEN sum(CASE WHEN t AND {r} <= 10 THEN 1 / log2({r} + 1) ELSE 0 END)
  / list_sum(list_transform(range(1, least(count(*) FILTER (WHERE t), 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_{tag}, round(count(*) FILTER (WHERE t AND {r} <= 10) / nullif(CAST(count(*) FILTER (WHERE t) AS DOUBLE), 0), 6) AS recall_{tag}, round(avg(CASE WHEN t THEN {r} END), 6) AS mean_rank_{tag}"""


@query(
    "win_12_ranking_metrics",
    f"""WITH {RERANKED}, l AS (SELECT *, species LIKE 'red%' OR species LIKE 'hot%' AS t FROM reranked) SELECT sample_id, {_metrics_sql("original_rank", "before")}, {_metrics_sql("new_rank", "after")}, count(*) FILTER (WHERE NOT t AND new_rank <= 10) AS fp_at_k,
 round(avg(CASE WHEN NOT t THEN original_rank END) - avg(CASE WHEN t THEN original_rank END), 6) AS sep_before, round(avg(CASE WHEN NOT t THEN new_rank END) - avg(CASE WHEN t THEN new_rank END), 6) AS sep_after FROM l GROUP BY sample_id""",
)
def ranking_metrics(spark, sf):
    t = F.col("species").startswith("red") | F.col("species").startswith("hot")
    r = reranked(spark, sf)
    return r.groupBy("sample_id").agg(
        *RR.ranking_metrics(r, t, 10, "original_rank", "before"), *RR.ranking_metrics(r, t, 10, "new_rank", "after"), F.count_if(~t & (F.col("new_rank") <= 10)).alias("fp_at_k"),
        *[F.round(RR.separation(t, r), 6).alias(f"sep_{tag}") for r, tag in (("original_rank", "before"), ("new_rank", "after"))],
    )


@query("smp_21_permutation_test")
def permutation_test(spark, sf):
    """Coherence shuffled inside each sample, 100 times over all rows; p of the gain in separation."""
    t = F.col("species").startswith("red") | F.col("species").startswith("hot")
    return RR.permutation_test(reranked(spark, sf), t, 1.0, 100, "perm")


@query(
    "grf_11_association_triples",
    f"""WITH {CLAIMS}, a AS (SELECT target_species AS host, source_species AS pathogen, CASE WHEN reads % 3 = 0 THEN interaction_type END AS disease, CASE pos WHEN 1 THEN 'Resistance seen' WHEN 2 THEN 'more susceptible' END AS phenotype FROM claims)
 SELECT host AS head, 'HOST' AS head_type, CASE WHEN lower(phenotype) LIKE '%resistance%' THEN 'RESISTANT_TO' WHEN lower(phenotype) LIKE '%suscept%' THEN 'SUSCEPTIBLE_TO' ELSE 'INFECTED_BY' END AS relation, pathogen AS tail FROM a
 UNION SELECT pathogen, 'PATHOGEN', 'CAUSES_DISEASE', disease FROM a WHERE disease IS NOT NULL""",
)
def association_triples(spark, sf):
    c = claims(spark, sf)
    ph = F.lower(F.when(F.col("pos") == 1, "Resistance seen").when(F.col("pos") == 2, "more susceptible"))
    rel = F.when(ph.contains("resistance"), "RESISTANT_TO").when(ph.contains("suscept"), "SUSCEPTIBLE_TO").otherwise("INFECTED_BY")
    row = lambda h, t, r, o: F.struct(h.alias("head"), F.lit(t).alias("head_type"), r.alias("relation"), o.alias("tail"))
    disease = F.when(F.col("reads") % 3 == 0, F.col("interaction_type"))
    rows = F.array(row(F.col("target_species"), "HOST", rel, F.col("source_species")), row(F.col("source_species"), "PATHOGEN", F.lit("CAUSES_DISEASE"), disease))
    return c.select(F.inline(rows)).where(F.col("tail").isNotNull()).distinct()


@query(
    "grf_12_verified_summary",
    f"""WITH {CLAIMS}, e AS (SELECT source_species, interaction_type, target_species, count(*) AS n, count(DISTINCT doi) AS d FROM claims WHERE label = 1 GROUP BY ALL)
 SELECT count(*) AS n_edges, count(DISTINCT interaction_type) AS n_predicates, (SELECT count(*) FROM (SELECT source_species FROM e UNION SELECT target_species FROM e)) AS n_nodes, (SELECT count(DISTINCT doi) FROM claims WHERE label = 1) AS n_documents,
  round(avg(CASE WHEN n > 1 THEN 1 ELSE 0 END), 6) AS multi_passage_share, round(avg(CASE WHEN d > 1 THEN 1 ELSE 0 END), 6) AS multi_document_share FROM e""",
)
def verified_summary(spark, sf):
    c = claims(spark, sf).where("label = 1")
    e = c.groupBy("source_species", "interaction_type", "target_species", "doi").agg(F.count("*").alias("m"))
    e = e.groupBy("source_species", "interaction_type", "target_species").agg(F.sum("m").alias("n"), F.count("*").alias("d"))
    nodes = e.select(F.explode(F.array("source_species", "target_species")).alias("x")).agg(F.countDistinct("x")).scalar()
    return e.agg(
        F.count("*").alias("n_edges"), F.countDistinct("interaction_type").alias("n_predicates"),
        F.round(F.avg((F.col("n") > 1).cast("int")), 6).alias("multi_passage_share"), F.round(F.avg((F.col("d") > 1).cast("int")), 6).alias("multi_document_share"),
    ).withColumns({"n_nodes": nodes, "n_documents": c.agg(F.countDistinct("doi")).scalar()})


