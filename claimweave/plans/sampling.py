"""Sampling, balancing, splits and augmentation over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.functions import evidence as E
from claimweave.functions import fixed_values as V
from claimweave.functions import rules as RU
from claimweave.functions.hashing import hash_bucket, seeded_md5
from claimweave.functions.maths import f1_of
from claimweave.functions.text import bind
from claimweave.operators import metrics as ME
from claimweave.operators import sampling as S
from claimweave.operators.ranking import hash_rank, top_n
from claimweave.plans.registry import query
from claimweave.plans.scalar import LEX
from claimweave.plans.sqltext import q
from claimweave.plans.tables import CLAIMS, KNOWN_PAIRS, SCORED, claims, known_pairs, load, scored
from claimweave.session import stage

DRAW = "('0x' || substr(md5({x}), 1, 4))::BIGINT / CAST(65536 AS DOUBLE)"


def draw(x: str) -> str:
    return DRAW.format(x=x)


@query(
    "smp_01_stratified_sample",
    f"""WITH {CLAIMS}, r AS (SELECT claim_id, interaction_type, row_number() OVER (PARTITION BY interaction_type ORDER BY md5('s1|' || claim_id), claim_id) AS rk FROM claims), k AS (SELECT greatest(5000 // count(DISTINCT interaction_type), 100) AS n FROM claims)
 SELECT claim_id, interaction_type FROM r, k WHERE rk <= n""",
)
def stratified_sample(spark, sf):
    """Equal share of the total per category, at least 100."""
    c = claims(spark, sf).select("claim_id", "interaction_type")
    per = c.agg(F.greatest(F.floor(F.lit(5000) / F.countDistinct("interaction_type")), F.lit(100)))
    return S.first_by_hash(c, ["interaction_type"], ["claim_id"], per.scalar(), "s1")


@query(
    "smp_02_cap_positives",
    f"WITH {CLAIMS} SELECT claim_id, interaction_type FROM claims WHERE label = 1 QUALIFY row_number() OVER (PARTITION BY interaction_type ORDER BY md5('42|' || claim_id), claim_id) <= 300",
)
def cap_positives(spark, sf):
    return S.cap_per_group(claims(spark, sf).where("label = 1").select("claim_id", "interaction_type"), ["interaction_type"], ["claim_id"], 300, "42")


@query(
    "smp_03_negative_budget",
    f"""WITH {CLAIMS}, n AS (SELECT claim_id, CASE WHEN pos = 6 THEN 'other' WHEN pos IN (3, 5) THEN 'signal' ELSE 'rest' END AS tier FROM claims WHERE label = 0), r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5('42|' || claim_id), claim_id) AS rk FROM n),
 c AS (SELECT least(count(*) FILTER (WHERE tier = 'other'), 900) AS bo, least(count(*) FILTER (WHERE tier = 'signal'), 450) AS bs FROM n) SELECT claim_id, tier FROM r, c WHERE rk <= CASE tier WHEN 'other' THEN bo WHEN 'signal' THEN bs ELSE 1500 - bo - bs END""",
)
def negative_budget(spark, sf):
    """60 % / 30 % / what is left of a budget of 1500 over three tiers."""
    tier = F.when(F.col("pos") == 6, "other").when(F.col("pos").isin(3, 5), "signal").otherwise("rest")
    n = claims(spark, sf).where("label = 0").select("claim_id", tier.alias("tier"))
    c = n.groupBy("tier").agg(F.count("*").alias("n"))
    b = c.agg(F.least(F.sum(F.when(F.col("tier") == "other", F.col("n"))), F.lit(900)).alias("o"), F.least(F.sum(F.when(F.col("tier") == "signal", F.col("n"))), F.lit(450)).alias("s"))
    b = b.select("o", "s", F.explode(F.array(F.lit("other"), F.lit("signal"), F.lit("rest"))).alias("tier"))
    limits = b.select("tier", F.when(F.col("tier") == "other", F.col("o")).when(F.col("tier") == "signal", F.col("s")).otherwise(1500 - F.col("o") - F.col("s")).alias("_n"))
    return S.first_by_hash(n, ["tier"], ["claim_id"], F.col("_n"), "42", limits)


@query(
    "smp_04_proportional_negatives",
    f"""WITH {CLAIMS}, p AS (SELECT count(*) AS n FROM claims WHERE label = 1 AND pos = 1), r AS (SELECT claim_id, row_number() OVER (ORDER BY md5('s4|' || claim_id), claim_id) AS rk FROM claims WHERE label = 0) SELECT claim_id FROM r, p WHERE rk <= CAST(floor(n * 1.5) AS BIGINT)""",
)
def proportional_negatives(spark, sf):
    c = claims(spark, sf).select("claim_id", "label", "pos")
    n = c.where("label = 1 and pos = 1").agg(F.floor(F.count("*") * 1.5)).scalar()
    neg = c.where("label = 0").select("claim_id", F.lit(0).alias("all"))
    return S.first_by_hash(neg, ["all"], ["claim_id"], n, "s4").select("claim_id")


@query(
    "smp_05_balanced_classes",
    f"""WITH {CLAIMS}, k AS (SELECT source, least(count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0), 2000) AS n FROM claims GROUP BY source), r AS (SELECT claim_id, source, label, row_number() OVER (PARTITION BY source, label ORDER BY md5('s5|' || claim_id), claim_id) AS rk FROM claims)
 SELECT claim_id, source, label FROM r JOIN k USING (source) WHERE rk <= n""",
)
def balanced_classes(spark, sf):
    c = claims(spark, sf).select("claim_id", "source", "label")
    k = S.label_counts(c, ["source"], "label").select("source", F.least("n_pos", "n_neg", F.lit(2000)).alias("_n"))
    limits = k.select("source", F.explode(F.array(F.lit(0), F.lit(1))).alias("label"), "_n")
    return S.first_by_hash(c, ["source", "label"], ["claim_id"], F.col("_n"), "s5", limits)


@query(
    "smp_06_marginal_matching",
    f"""WITH {CLAIMS}, {LEX}, s AS (SELECT claim_id, label, CASE WHEN lex_strength > 0 THEN 1 ELSE 0 END AS sig FROM lex), c AS (SELECT count(*) FILTER (WHERE label = 1 AND sig = 0) AS pz, count(*) FILTER (WHERE label = 0 AND sig = 1) AS nh FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY label, sig ORDER BY md5('s6|' || claim_id), claim_id) AS rk FROM s) SELECT claim_id, label, sig FROM r, c WHERE (label = 1 AND sig = 0) OR (label = 0 AND sig = 1) OR (label = 1 AND rk <= round(pz / CAST(0.3 AS DOUBLE) * 0.7)) OR (label = 0 AND rk <= round(nh / CAST(0.4 AS DOUBLE) * 0.6))""",
)
def marginal_matching(spark, sf):
    """Drop signal-bearing positives and zero-signal negatives until P(signal|class) is 0.7 and 0.4."""
    c = E.with_lexicon(claims(spark, sf).select("claim_id", "label", "text"), "text")
    s = stage(c.select("claim_id", "label", (F.col("lex_strength") > 0).cast("int").alias("sig")), "signal")
    return match_marginals(s, "s6", 0.7, 0.4)


def match_marginals(s, seed, p_pos, p_neg):
    counts = s.groupBy("label", "sig").agg(F.count("*").alias("n"))
    n_of = lambda lab, sig: F.sum(F.when((F.col("label") == lab) & (F.col("sig") == sig), F.col("n")))
    base = counts.agg(n_of(1, 0).alias("pz"), n_of(0, 1).alias("nh"))
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("sig")) for a in (0, 1) for b in (0, 1)])
    keep = (
        F.when((F.col("label") == 1) & (F.col("sig") == 1), F.round(F.col("pz") / (1 - p_pos) * p_pos))
        .when((F.col("label") == 0) & (F.col("sig") == 0), F.round(F.col("nh") / p_neg * (1 - p_neg)))
        .otherwise(F.lit(float(2**62)))
    )
    limits = base.select("pz", "nh", F.inline(cells)).select("label", "sig", keep.alias("_n"))
    return S.first_by_hash(s, ["label", "sig"], ["claim_id"], F.col("_n"), seed, limits)


@query("smp_07_stratified_split", f"WITH {CLAIMS} SELECT label, CASE WHEN {draw(q('s7|') + ' || claim_id')} < 0.1 THEN 'valid' ELSE 'train' END AS split, count(*) AS n FROM claims GROUP BY ALL")
def stratified_split(spark, sf):
    return claims(spark, sf).groupBy("label", S.split_of(["claim_id"], "s7", 0.1).alias("split")).agg(F.count("*").alias("n"))


@query(
    "smp_08_group_split",
    f"""WITH {CLAIMS} SELECT claim_id, CASE WHEN {draw("'s8|' || least(lower(source_species), lower(target_species)) || ';' || greatest(lower(source_species), lower(target_species))")} < 0.2 THEN 'valid' ELSE 'train' END AS split FROM claims""",
)
def group_split(spark, sf):
    """All rows of an unordered pair on one side."""
    from claimweave.functions.names import pair_key

    c = claims(spark, sf).withColumn("pair", pair_key("source_species", "target_species"))
    return c.select("claim_id", S.split_of(["pair"], "s8", 0.2).alias("split"))


@query(
    "smp_09_entity_split",
    f"""WITH {CLAIMS}, s AS (SELECT claim_id, {draw("'s9|' || lower(source_species)")} < 0.3 AS x, {draw("'s9|' || lower(target_species)")} < 0.3 AS y FROM claims) SELECT claim_id, CASE WHEN x AND y THEN 'test' WHEN NOT x AND NOT y THEN 'train' ELSE 'residual' END AS split FROM s""",
)
def entity_split(spark, sf):
    return S.entity_split(claims(spark, sf).select("claim_id", "source_species", "target_species"), "source_species", "target_species", "s9", 0.3).select("claim_id", "split")


@query(
    "smp_10_text_split_subset",
    f"""WITH {CLAIMS}, d AS (SELECT DISTINCT text FROM claims WHERE pos <= 4 AND {draw("'s10|' || text")} < 0.15) SELECT claim_id FROM claims WHERE pos > 1 AND text IN (SELECT text FROM d)""",
)
def text_split_subset(spark, sf):
    """Development texts of one corpus, and the rows of another corpus with those texts."""
    c = claims(spark, sf).select("claim_id", "text", "pos")
    dev = c.where("pos <= 4").where(S.split_of(["text"], "s10", 0.15) == "valid").select("text").distinct()
    return c.where("pos > 1").join(dev, "text", "left_semi").select("claim_id")


@query(
    "smp_11_block_held_out",
    f"""WITH {SCORED}, l AS (SELECT source, label, 'score' AS model, score AS s FROM scored UNION ALL SELECT source, label, 'score_b', score_b FROM scored), k AS (SELECT DISTINCT source AS held FROM scored),
 g AS (SELECT held, model, s, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM l JOIN k ON source <> held GROUP BY ALL),
 c AS (SELECT *, sum(pos) OVER (PARTITION BY held, model ORDER BY s DESC) AS cp, sum(neg) OVER (PARTITION BY held, model ORDER BY s DESC) AS cn, sum(pos) OVER (PARTITION BY held, model) AS np FROM g),
 b AS (SELECT held, model, s AS thr, round(2 * cp / CAST(cp + cn + np AS DOUBLE), 9) AS f FROM c QUALIFY row_number() OVER (PARTITION BY held ORDER BY round(2 * cp / CAST(cp + cn + np AS DOUBLE), 9) DESC, model, s) = 1),
 e AS (SELECT held, b.model, thr, f, count(*) FILTER (WHERE label = 1 AND s >= thr) AS tp, count(*) FILTER (WHERE label = 0 AND s >= thr) AS fp, count(*) FILTER (WHERE label = 1 AND s < thr) AS fn FROM b JOIN l ON l.source = held AND l.model = b.model GROUP BY ALL)
 SELECT held AS source, model, thr AS threshold, round(f, 6) AS rest_f1, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM e""",
)
def block_held_out(spark, sf):
    """Each source held out: model and threshold chosen on all others, both F1 side by side."""
    return ME.held_out_blocks(scored(spark, sf), "source", ["score", "score_b"])


FOLD = "('0x' || substr(md5('s11|' || item_id), 1, 6))::BIGINT % 5"


@query(
    "smp_11_fold_thresholds",
    f"""WITH {SCORED}, f AS (SELECT *, CAST({FOLD} AS INTEGER) AS fold FROM scored), k AS (SELECT unnest(range(0, 5)) AS held), g AS (SELECT held, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM f, k WHERE fold <> held GROUP BY ALL),
 c AS (SELECT *, sum(pos) OVER (PARTITION BY held ORDER BY score DESC) AS cp, sum(neg) OVER (PARTITION BY held ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY held) AS np FROM g), b AS (SELECT held, score AS thr FROM c QUALIFY row_number() OVER (PARTITION BY held ORDER BY round(2 * cp / CAST(cp + cn + np AS DOUBLE), 9) DESC, score) = 1),
 e AS (SELECT fold, thr, count(*) FILTER (WHERE label = 1 AND score >= thr) AS tp, count(*) FILTER (WHERE label = 0 AND score >= thr) AS fp, count(*) FILTER (WHERE label = 1 AND score < thr) AS fn FROM f JOIN b ON held = fold GROUP BY ALL)
 SELECT fold, thr AS threshold, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM e""",
)
def fold_thresholds(spark, sf):
    """Threshold of each fold chosen on the other folds; counts per (fold, score) are exploded, not the items."""
    s = scored(spark, sf).withColumn("fold", S.fold_of(["item_id"], "s11", 5))
    g = ME.score_groups(s, ["fold"])
    others = g.select(F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda h: h != F.col("fold"))).alias("held"), "score", "pos", "neg")
    ranked = others.groupBy("held", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    from claimweave.operators.ranking import running_totals

    c = running_totals(ranked, ["held"], "score", ["pos", "neg"])
    tot = ranked.groupBy("held").agg(F.sum("pos").alias("np"))
    f1 = F.round(f1_of(F.col("cum_pos").cast("double"), F.col("cum_neg"), F.col("np") - F.col("cum_pos")), 9)
    best = c.join(tot, "held").groupBy("held").agg(F.max_by("score", F.struct(f1, -F.col("score"))).alias("threshold"))
    j = g.join(best, F.col("fold") == F.col("held"))
    hit = F.col("score") >= F.col("threshold")
    add = lambda cond, v: F.sum(F.when(cond, F.col(v)).otherwise(0)).cast("double")
    return j.groupBy("fold", "threshold").agg(F.round(f1_of(add(hit, "pos"), add(hit, "neg"), add(~hit, "pos")), 6).alias("f1"))


@query("smp_12_oversample_gold", "SELECT doc_id, CAST(unnest(range(1, CASE WHEN quality = 1 THEN 3 ELSE 1 END + 1)) AS INTEGER) AS copy FROM labels")
def oversample_gold(spark, sf):
    times = F.when(F.col("quality") == 1, 3).otherwise(1)
    return load(spark, sf, "labels").select("doc_id", F.explode(F.sequence(F.lit(1), times)).alias("copy"))


@query(
    "smp_13_column_resampling",
    f"""WITH {CLAIMS}, m AS (SELECT verb, count(*) AS n FROM claims GROUP BY verb), c AS (SELECT verb AS new_verb, sum(n) OVER (ORDER BY verb) / CAST(sum(n) OVER () AS DOUBLE) AS hi, (sum(n) OVER (ORDER BY verb) - n) / CAST(sum(n) OVER () AS DOUBLE) AS lo FROM m),
 d AS (SELECT claim_id, verb, {draw("'s13|' || claim_id")} AS u, {draw("'s13-pick|' || claim_id")} < 0.4 AS p FROM claims) SELECT claim_id, CASE WHEN p THEN new_verb ELSE verb END AS verb, p AS resampled FROM d JOIN c ON u >= lo AND u < hi""",
)
def column_resampling(spark, sf):
    return S.resample_column(claims(spark, sf).select("claim_id", "verb"), "verb", ["claim_id"], "s13", 0.4)


@query(
    "smp_14_order_retarget",
    f"""WITH {CLAIMS}, r AS (SELECT claim_id, source_species AS s, target_species AS t, row_number() OVER (ORDER BY md5('s14|' || claim_id), claim_id) AS rk, count(*) OVER () AS n FROM claims) SELECT claim_id, CASE WHEN rk <= 0.3 * n THEN s ELSE t END AS first, CASE WHEN rk <= 0.3 * n THEN t ELSE s END AS second FROM r""",
)
def order_retarget(spark, sf):
    """Exactly a share of 0.3 of the rows presents the subject first."""
    c = claims(spark, sf).select("claim_id", "source_species", "target_species", F.lit(0).alias("all"))
    n = c.agg(F.count("*")).scalar()
    r = hash_rank(c, ["all"], ["claim_id"], "s14", "rk")
    keep = F.col("rk") <= 0.3 * n
    s, t = F.col("source_species"), F.col("target_species")
    return r.select("claim_id", F.when(keep, s).otherwise(t).alias("first"), F.when(keep, t).otherwise(s).alias("second"))


@query(
    "smp_15_symmetric_augmentation",
    """WITH p AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b, l_returnflag AS t FROM lineitem) SELECT b AS a, a AS b, t FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.a = p.b AND o.b = p.a AND o.t = p.t)""",
)
def symmetric_augmentation(spark, sf):
    p = load(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b"), F.col("l_returnflag").alias("t")
    ).distinct()
    return S.symmetric_copies(p, "a", "b", ["a", "b", "t"])


@query(
    "smp_16_reversal_negatives",
    f"""WITH {CLAIMS}, d AS (SELECT DISTINCT target_species AS source_species, source_species AS target_species, interaction_type FROM claims WHERE label = 1 AND interaction_type IN ('preysOn', 'pathogenOf', 'parasiteOf')) SELECT source_species, target_species, interaction_type, 0 AS label FROM d""",
)
def reversal_negatives(spark, sf):
    """A directed relation read backwards is a negative."""
    c = claims(spark, sf).where((F.col("label") == 1) & F.col("interaction_type").isin("preysOn", "pathogenOf", "parasiteOf"))
    r = c.select(F.col("target_species").alias("source_species"), F.col("source_species").alias("target_species"), "interaction_type").distinct()
    return r.withColumn("label", F.lit(0))


@query(
    "smp_17_kind_flip_rates",
    f"""WITH {CLAIMS}, k AS (SELECT claim_id, label, CASE pos WHEN 3 THEN 'negated' WHEN 5 THEN 'methods' WHEN 6 THEN 'co_mention' ELSE 'stated' END AS kind FROM claims), r AS (SELECT kind, avg(label) AS rate FROM k WHERE kind <> 'stated' GROUP BY kind)
 SELECT claim_id, kind, CASE WHEN rate IS NULL OR label = 0 THEN label WHEN rate < 0.6663 THEN 0 WHEN rate < 0.668 THEN NULL ELSE label END AS label FROM k LEFT JOIN r USING (kind)""",
)
def kind_flip_rates(spark, sf):
    """Positives of a kind are relabelled, dropped (null) or kept by the kind's measured rate."""
    kind = F.when(F.col("pos") == 3, "negated").when(F.col("pos") == 5, "methods").when(F.col("pos") == 6, "co_mention").otherwise("stated")
    k = claims(spark, sf).select("claim_id", "label", kind.alias("kind"))
    r = k.where("kind <> 'stated'").groupBy("kind").agg(F.avg("label").alias("rate"))
    new = F.when(F.col("rate").isNull() | (F.col("label") == 0), F.col("label")).when(F.col("rate") < 0.6663, 0).when(F.col("rate") >= 0.668, F.col("label"))
    return k.join(F.broadcast(r), "kind", "left").select("claim_id", "kind", new.alias("label"))  # one row per kind


@query(
    "smp_18_synthetic_communities",
    f"""WITH {KNOWN_PAIRS}, e AS (SELECT a, b FROM known_pairs UNION SELECT b, a FROM known_pairs), d AS (SELECT a, count(*) AS k FROM e GROUP BY a HAVING count(*) >= 5), f AS (SELECT a AS focal, row_number() OVER (ORDER BY md5('foc|' || a), a) AS community FROM d QUALIFY community <= 20),
 p AS (SELECT community, focal, b AS member, 'partner' AS role FROM f JOIN e ON a = focal QUALIFY row_number() OVER (PARTITION BY community ORDER BY md5(concat_ws('|', 'par', community, b)), b) <= 5),
 n AS (SELECT community, focal, p_name AS member, 'noise' AS role FROM f, (SELECT DISTINCT p_name FROM part) WHERE p_name <> focal AND NOT EXISTS (SELECT 1 FROM e WHERE e.a = focal AND e.b = p_name) QUALIFY row_number() OVER (PARTITION BY community ORDER BY md5(concat_ws('|', 'noi', community, p_name)), p_name) <= 5)
 SELECT community, focal, member, role FROM p UNION ALL SELECT community, focal, focal, 'focal' FROM f UNION ALL SELECT * FROM n""",
)
def synthetic_communities(spark, sf):
    """20 focal names with ≥ 5 known partners, 5 of the partners and 5 strangers each.

    The 20 communities are the feature; strangers come from one hash-ordered candidate list per community.
    """
    k = known_pairs(spark, sf)
    e = k.unionByName(k.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    d = e.groupBy("a").agg(F.count("*").alias("k")).where("k >= 5")
    f = d.select(F.col("a").alias("focal"), seeded_md5("foc", "a").alias("o")).orderBy("o", "focal").limit(20)
    f = f.select("focal", F.row_number().over(Window.orderBy("o", "focal")).cast("bigint").alias("community"))
    p = f.join(e, F.col("focal") == F.col("a")).select("community", "focal", F.col("b").alias("member"))
    p = top_n(p, ["community"], [seeded_md5("par", "community", "member"), "member"], 5).select("community", "focal", "member", F.lit("partner").alias("role"))
    names = load(spark, sf, "part").select(F.col("p_name").alias("member")).distinct()
    every = F.sequence(F.lit(1), F.lit(20)).cast("array<bigint>")
    cand = names.select("member", F.explode(every).alias("community")).join(f, "community").where(F.col("member") != F.col("focal"))
    cand = cand.join(e.select(F.col("a").alias("focal"), F.col("b").alias("member")), ["focal", "member"], "left_anti")
    n = top_n(cand, ["community"], [seeded_md5("noi", "community", "member"), "member"], 5).select("community", "focal", "member", F.lit("noise").alias("role"))
    own = f.select("community", "focal", F.col("focal").alias("member"), F.lit("focal").alias("role"))
    return p.unionByName(n).unionByName(own)


TEMPLATES = [
    "{source} {verb} {target}.",
    "We observed that {source} {verb} {target} in spring.",
    "In this area, {target} and {source} meet: {source} {verb} {target}.",
    "No trace of {target} was seen near {source}.",
]


@query(
    "smp_19_template_rendering",
    f"""WITH {CLAIMS}, t AS (SELECT claim_id, source_species, verb, target_species, ([{", ".join(q(t) for t in TEMPLATES)}])[(('0x' || substr(md5('tpl|' || claim_id), 1, 4))::BIGINT % 4) + 1] AS tpl FROM claims)
 SELECT claim_id, replace(replace(replace(tpl, '{{source}}', source_species), '{{verb}}', verb), '{{target}}', target_species) AS rendered FROM t""",
)
def template_rendering(spark, sf):
    """A template chosen by hash, its slots filled."""
    idx = (hash_bucket(seeded_md5("tpl", "claim_id"), 4) % len(TEMPLATES) + 1).cast("int")
    text = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), idx)
    for slot, col in (("{source}", "source_species"), ("{verb}", "verb"), ("{target}", "target_species")):
        text = F.replace(text, F.lit(slot), F.col(col))
    return claims(spark, sf).select("claim_id", text.alias("rendered"))


@query("smp_20_pattern_negatives")
def pattern_negatives(spark, sf):
    """Negatives read off the wording: synonym by apposition, own clade in parentheses, author of a name."""
    from claimweave.plans.filters import candidates

    none = F.array().cast("array<struct<kind:string,first:string,second:string>>")
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("first"), b.alias("second"))
    head = r"([A-Z][a-z]+ [a-z]{3,})\s{0,3}" + V.CLADE_IN_PARENTHESES

    def pairs(p, kind, sign, pattern, i, j):
        """Two groups of every match; the sign, which every match holds, is tested first."""
        two = F.arrays_zip(F.regexp_extract_all(p, F.lit(pattern), F.lit(i)).alias("a"), F.regexp_extract_all(p, F.lit(pattern), F.lit(j)).alias("b"))
        return F.when(sign & p.rlike(pattern), F.transform(two, lambda x: row(kind, x["a"], x["b"]))).otherwise(none)

    def found(p):
        the, year, opens = p.contains("the"), p.rlike(RU.AUTHOR_YEAR), p.contains("(")
        clades = pairs(p, "ancestor", opens & p.contains(":"), head, 1, 2)
        return F.concat(
            pairs(p, "synonym", the & p.contains(RU.APPOSITION_SIGNS[0]), V.APPOSITION[0], 1, 2),
            pairs(p, "synonym", the & p.contains(RU.APPOSITION_SIGNS[1]), V.APPOSITION[1], 2, 1),
            pairs(p, "author", year, V.AUTHOR_AND_YEAR, 1, 2),
            pairs(p, "author", opens, V.AUTHOR_IN_PARENTHESES, 1, 2),
            F.flatten(F.transform(clades, lambda x: F.transform(F.split(x["second"], r"\s*:\s*"), lambda y: row("ancestor", x["first"], y)))),
        )

    def ok(x):
        second = F.lower(x["second"])
        return (F.lower(x["first"]) != second) & ~second.isin(V.AUTHOR_STOPWORDS) & (F.length(x["second"]) >= 4)

    rows = bind(F.col("passage"), lambda p: F.filter(found(p), ok))
    return candidates(spark, sf).select("claim_id", F.inline(rows)).distinct()
