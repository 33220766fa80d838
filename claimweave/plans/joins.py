"""Joins over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.functions.text import TOKEN_SPLIT
from claimweave.operators import joins as J
from claimweave.operators import leakage as L
from claimweave.operators import matching as MT
from claimweave.operators import taxonomy as TX
from claimweave.plans.filters import DICTIONARY, NAME_CHARS, dictionary
from claimweave.plans.registry import query
from claimweave.plans.sources import taxonomy_dump
from claimweave.plans.sqltext import norm_ascii_sql
from claimweave.plans.tables import CLAIMS, SENTENCES, TOKENS, claims, load, sentences
from claimweave.session import broadcast_if_small
from claimweave.sources.readers import explode_ontology


@query("join_01_verified_positives", "SELECT d.doc_id, source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 AND toxic = 0")
def verified_positives(spark, sf):
    lab = load(spark, sf, "labels").where("quality = 1 and toxic = 0").select("doc_id", "quality")
    return load(spark, sf, "documents").select("doc_id", "source").join(lab, "doc_id")


@query(
    "join_02_label_overlay",
    f"""WITH {CLAIMS}, a AS (SELECT doc_id, pos, (reads % 3) - 1 AS ans, claim_id FROM claims), l AS (SELECT doc_id, pos, ans FROM a WHERE ans IN (0, 1) QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY claim_id DESC) = 1)
 SELECT claim_id, CAST(coalesce(ans, label) AS INTEGER) AS label, coalesce(ans <> label, FALSE) AS flipped FROM claims LEFT JOIN l USING (doc_id, pos)""",
)
def label_overlay(spark, sf):
    c = claims(spark, sf).select("claim_id", "doc_id", "pos", "label", "reads")
    answers = c.select("doc_id", "pos", ((F.col("reads") % 3) - 1).cast("int").alias("label"), "claim_id")
    out = J.overlay(c.drop("reads"), answers, ["doc_id", "pos"], "label", ["claim_id"], F.col("label").isin(0, 1))
    return out.select("claim_id", "label", "flipped")


@query(
    "join_03_soft_scores",
    f"""WITH {CLAIMS}, s AS (SELECT text, max(confidence) AS soft FROM claims WHERE pos <> 2 GROUP BY text) SELECT claim_id, soft, soft IS NOT NULL AS covered FROM claims LEFT JOIN s USING (text)""",
)
def soft_scores(spark, sf):
    c = claims(spark, sf).select("claim_id", "text", "pos", "confidence")
    soft = c.where("pos <> 2").select("text", F.col("confidence").alias("soft"))
    return J.attach_scores(c.select("claim_id", "text"), soft, ["text"], "soft").select("claim_id", "soft", "covered")


@query("join_04_one_to_one", "SELECT o_orderkey, c_name, c_acctbal FROM (SELECT max(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey")
def one_to_one(spark, sf):
    last = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"))
    cust = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return J.join_one_to_one(last, cust, ["c_custkey"]).select("o_orderkey", "c_name", "c_acctbal")


@query(
    "join_05_exclude_texts",
    f"SELECT doc_id, source FROM documents WHERE {norm_ascii_sql('text')} NOT IN (SELECT {norm_ascii_sql('text')} FROM benchmark)",
)
def exclude_texts(spark, sf):
    b = load(spark, sf, "benchmark").select(T.norm_ascii("text").alias("k")).distinct()
    d = load(spark, sf, "documents").select("doc_id", "source", T.norm_ascii("text").alias("k"))
    return d.join(broadcast_if_small(b), "k", "left_anti").select("doc_id", "source")


@query(
    "join_06_exclude_pairs",
    f"""WITH {CLAIMS}, b AS (SELECT DISTINCT least(lower(source_species), lower(target_species)) AS lo, greatest(lower(source_species), lower(target_species)) AS hi FROM claims WHERE reads = 50 AND pos = 1)
 SELECT claim_id FROM claims WHERE NOT EXISTS (SELECT 1 FROM b WHERE lo = least(lower(source_species), lower(target_species)) AND hi = greatest(lower(source_species), lower(target_species)))""",
)
def exclude_pairs(spark, sf):
    c = claims(spark, sf).select("claim_id", "source_species", "target_species", "reads", "pos")
    held = c.where("reads = 50 and pos = 1").select(F.col("target_species").alias("source_species"), F.col("source_species").alias("target_species"))
    return J.exclude_pairs(c, held, "source_species", "target_species").select("claim_id")


@query(
    "join_07_membership",
    f"""WITH {CLAIMS}, v AS (SELECT lower(p_name) AS k FROM part WHERE p_size < 3) SELECT claim_id, lower(target_species) IN (SELECT k FROM v) AS known FROM claims""",
)
def membership(spark, sf):
    names = load(spark, sf, "part").where("p_size < 3").select(F.col("p_name").alias("name"))
    return J.member_flag(claims(spark, sf).select("claim_id", "target_species"), "target_species", names, "known").select("claim_id", "known")


@query(
    "join_08_either_orientation",
    """WITH t AS (SELECT l_partkey AS a, l_suppkey AS b, min(l_orderkey) AS v FROM lineitem GROUP BY 1, 2), q AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem)
 SELECT q.a, q.b, coalesce(f.v, r.v) AS v FROM q LEFT JOIN t f ON f.a = q.a AND f.b = q.b LEFT JOIN t r ON r.a = q.b AND r.b = q.a""",
)
def either_orientation(spark, sf):
    line = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_orderkey")
    t = line.groupBy("a", "b").agg(F.min("l_orderkey").alias("v"))
    q = line.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct()
    return J.lookup_either_way(q, t, "a", "b", ["v"])


@query(
    "join_09_canonical_difference",
    """WITH b AS (SELECT l_partkey::VARCHAR AS x, l_suppkey::VARCHAR AS y, l_returnflag AS r FROM lineitem), k AS (SELECT l_suppkey::VARCHAR AS x, l_partkey::VARCHAR AS y, l_returnflag AS r FROM lineitem WHERE l_quantity > 10),
 bc AS (SELECT DISTINCT concat_ws(';', least(x, y), greatest(x, y), r) AS key FROM b), kc AS (SELECT DISTINCT concat_ws(';', least(x, y), greatest(x, y), r) AS key FROM k)
 SELECT key, 'removed' AS kind FROM bc WHERE key NOT IN (SELECT key FROM kc)
 UNION ALL SELECT key, 'phantom' FROM (SELECT DISTINCT concat_ws(';', x, y, r) AS key FROM k) WHERE key NOT IN (SELECT concat_ws(';', x, y, r) FROM b)""",
)
def canonical_difference(spark, sf):
    line = load(spark, sf, "lineitem")
    s = lambda c: F.col(c).cast("string")
    base = line.select(s("l_partkey").alias("x"), s("l_suppkey").alias("y"), F.col("l_returnflag").alias("r"))
    kept = line.where("l_quantity > 10").select(s("l_suppkey").alias("x"), s("l_partkey").alias("y"), F.col("l_returnflag").alias("r"))
    return J.canonical_difference(base, kept, "x", "y", "r")


@query(
    "join_10_agent_lookup",
    f"""WITH {CLAIMS}, o AS (SELECT lower(CASE WHEN label = 1 AND reads > 2 THEN source_species ELSE target_species END) AS a, lower(CASE WHEN label = 1 AND reads > 2 THEN target_species ELSE source_species END) AS p FROM claims WHERE pos <= 2),
 g AS (SELECT least(a, p) AS lo, greatest(a, p) AS hi, min(CASE WHEN a <= p THEN 1 ELSE 2 END) AS v FROM o GROUP BY 1, 2 HAVING min(CASE WHEN a <= p THEN 1 ELSE 2 END) = max(CASE WHEN a <= p THEN 1 ELSE 2 END)),
 c AS (SELECT claim_id, lower(source_species) AS s, lower(target_species) AS t, CASE WHEN regexp_matches(verb, 'symbiosis|interacts') THEN 0 WHEN regexp_matches(verb, 'host') THEN -1 ELSE 1 END AS pol FROM claims)
 SELECT claim_id, CAST(CASE WHEN v IS NULL OR pol = 0 THEN 0 WHEN (pol > 0) = ((v = 1) = (lo = s)) THEN 1 ELSE 2 END AS INTEGER) AS subject FROM c LEFT JOIN g ON lo = least(s, t) AND hi = greatest(s, t)""",
)
def agent_lookup(spark, sf):
    c = claims(spark, sf).select("claim_id", "source_species", "target_species", "verb", "label", "reads", "pos")
    as_is = (F.col("label") == 1) & (F.col("reads") > 2)
    seen = c.where("pos <= 2").select(
        F.when(as_is, F.col("source_species")).otherwise(F.col("target_species")).alias("agent"),
        F.when(as_is, F.col("target_species")).otherwise(F.col("source_species")).alias("patient"),
    )
    pol = F.when(F.col("verb").rlike("symbiosis|interacts"), 0).when(F.col("verb").contains("host"), -1).otherwise(1)
    lookup = J.agent_lookup(seen, "agent", "patient")
    return J.subject_by_lookup(c.withColumn("pol", pol), lookup, "source_species", "target_species", "pol").select("claim_id", "subject")


@query(
    "join_11_article_sentences",
    f"""WITH {SENTENCES}, i AS (SELECT DISTINCT l_orderkey % (SELECT count(*) FROM documents) AS doc_id, l_partkey AS interaction_id FROM lineitem)
 SELECT interaction_id, doc_id, sent_id FROM i JOIN sentences USING (doc_id) WHERE length(sentence) BETWEEN 80 AND 250
 QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY doc_id, sent_id) <= 3""",
)
def article_sentences(spark, sf):
    """First three fitting sentences per interaction from the articles it refers to.

    No more than an article's own first three can be among them, so articles are cut to those before the join.
    """
    n = load(spark, sf, "documents").agg(F.count("*")).scalar()
    i = load(spark, sf, "lineitem").select((F.col("l_orderkey") % n).alias("doc_id"), F.col("l_partkey").alias("interaction_id")).distinct()
    s = sentences(spark, sf).where(F.length("sentence").between(80, 250)).groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list("sent_id")), 1, 3).alias("s"))
    j = i.join(s.select("doc_id", F.explode("s").alias("sent_id")), "doc_id")
    w = Window.partitionBy("interaction_id").orderBy("doc_id", "sent_id")
    return j.withColumn("rk", F.row_number().over(w)).where("rk <= 3").select("interaction_id", "doc_id", "sent_id")


_B = f"bt AS (SELECT item_id, ws[i] AS token, i AS pos FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '{TOKEN_SPLIT}'), lambda w: w <> '') AS ws FROM benchmark)))"
_TWO = "SELECT a.token || ' ' || b.token{0} FROM {1} a JOIN {1} b ON b.{2} = a.{2} AND b.pos = a.pos + 1"
_THREE = "SELECT a.token || ' ' || b.token || ' ' || c.token{0} FROM {1} a JOIN {1} b ON b.{2} = a.{2} AND b.pos = a.pos + 1 JOIN {1} c ON c.{2} = a.{2} AND c.pos = a.pos + 2"


def _hits_sql(names: str, longest: int) -> str:
    runs = ["SELECT doc_id, pos AS start, 1 AS len, token AS gram FROM tokens", *[f"SELECT doc_id, start, {n}, gram FROM (" + run.format(" AS gram, a.doc_id, a.pos AS start", "tokens", "doc_id") + ")" for n, run in ((2, _TWO), (3, _THREE)) if n <= longest]]
    return f"{TOKENS}, {_B}, names AS ({names}), g AS ({' UNION ALL '.join(runs)}), hits AS MATERIALIZED (SELECT * FROM g WHERE gram IN (SELECT name FROM names))"


#: Words of six characters or more and all runs of two; and all runs of one to three tokens, however short.
HITS = _hits_sql(f"SELECT token AS name FROM bt WHERE length(token) >= {NAME_CHARS} UNION {_TWO.format('', 'bt', 'item_id')}", 2)
ALL_HITS = _hits_sql(f"SELECT token AS name FROM bt UNION {_TWO.format('', 'bt', 'item_id')} UNION {_THREE.format('', 'bt', 'item_id')}", 3)
#: CTE ``kept``: the longest match over ``hits``, island of overlapping hits by island.
KEPT = """m AS (SELECT *, max(start + len) OVER (PARTITION BY doc_id ORDER BY start, len, gram ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, len, gram ROWS UNBOUNDED PRECEDING) AS island FROM m),
 n AS MATERIALIZED (SELECT doc_id, island, start, len, gram, row_number() OVER (PARTITION BY doc_id, island ORDER BY start, len, gram) AS k, count(*) OVER (PARTITION BY doc_id, island) AS size FROM i),
 f AS (SELECT doc_id, island, k, start, len, gram, size, CAST(NULL AS INTEGER) AS es, CAST(NULL AS INTEGER) AS el, CAST(NULL AS VARCHAR) AS eg FROM n WHERE k = 1
  UNION ALL SELECT n.doc_id, n.island, n.k, CASE WHEN apart OR longer THEN n.start ELSE f.start END, CASE WHEN apart OR longer THEN n.len ELSE f.len END, CASE WHEN apart OR longer THEN n.gram ELSE f.gram END, n.size,
   CASE WHEN apart THEN f.start END, CASE WHEN apart THEN f.len END, CASE WHEN apart THEN f.gram END
  FROM f JOIN n ON n.doc_id = f.doc_id AND n.island = f.island AND n.k = f.k + 1, LATERAL (SELECT n.start >= f.start + f.len AS apart, n.len > f.len AS longer) x),
 kept AS (SELECT doc_id, es AS start, el AS len, eg AS gram FROM f WHERE es IS NOT NULL UNION ALL SELECT doc_id, start, len, gram FROM f WHERE k = size)"""
PER_DOCUMENT = "SELECT doc_id, count(*) AS n_hits, CAST(sum(len) AS BIGINT) AS n_words, md5(string_agg(start || ':' || len || ':' || gram, ',' ORDER BY start || ':' || len || ':' || gram)) AS digest"


def name_hits(spark, sf, longest=2, chars=NAME_CHARS):
    """Hits of the ``benchmark`` texts' runs of up to ``longest`` tokens, of one token from ``chars`` characters on."""
    grams = load(spark, sf, "benchmark").select(F.inline(MT.token_grams(F.col("text"), longest)))
    names = grams.where((F.col("len") > 1) | (F.length("gram") >= chars)).select(F.col("gram").alias("name")).distinct()
    return MT.dictionary_hits(load(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text", names, longest)


def per_document(hits):
    """Hits of each document as their number, words and digest: a text's hits are bounded by its length."""
    one = F.concat_ws(":", "start", "len", "gram")
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_hits"), F.sum("len").alias("n_words"), F.md5(F.array_join(F.array_sort(F.collect_list(one)), ",").cast("binary")).alias("digest"))


@query("join_12_dictionary_hits", f"WITH {HITS} SELECT doc_id, start, len, gram FROM hits")
def dictionary_hits(spark, sf):
    return name_hits(spark, sf)


@query("join_12_all_runs", f"WITH {ALL_HITS} {PER_DOCUMENT} FROM hits GROUP BY doc_id")
def dictionary_hits_of_all_runs(spark, sf):
    return per_document(name_hits(spark, sf, 3, 1))


@query("win_08_longest_match", f"WITH RECURSIVE {HITS}, {KEPT} SELECT doc_id, start, len, gram FROM kept")
def longest_match(spark, sf):
    return MT.resolve_overlaps(name_hits(spark, sf), ["doc_id"])


@query("win_08_all_runs", f"WITH RECURSIVE {ALL_HITS}, {KEPT} {PER_DOCUMENT} FROM kept GROUP BY doc_id")
def longest_match_of_all_runs(spark, sf):
    return per_document(MT.resolve_overlaps(name_hits(spark, sf, 3, 1), ["doc_id"]))


@query(
    "str_19_terms_found",
    f"""WITH {SENTENCES}, {DICTIONARY}, t AS (SELECT DISTINCT doc_id, sent_id, token FROM (SELECT doc_id, sent_id, unnest(string_split_regex(lower(sentence), '{TOKEN_SPLIT}')) AS token FROM sentences) WHERE token IN (SELECT token FROM dictionary))
 SELECT doc_id, sent_id, string_agg(token, ',' ORDER BY token) AS terms FROM t GROUP BY ALL""",
)
def terms_found(spark, sf):
    s = sentences(spark, sf).select("doc_id", "sent_id", "sentence")
    names = dictionary(spark, sf).select(F.col("token").alias("name"))
    hits = MT.dictionary_hits(s, ["doc_id", "sent_id"], "sentence", names, 1)
    return hits.groupBy("doc_id", "sent_id").agg(F.array_join(F.array_sort(F.collect_set("gram")), ",").alias("terms"))


@query(
    "join_13_containment",
    f"""WITH {CLAIMS}, v AS (SELECT claim_id, text, verb, source_species AS a1, split_part(source_species, ' ', 1) AS a2, target_species AS b1, split_part(target_species, ' ', 1) AS b2 FROM claims),
 m AS (SELECT *, CASE WHEN strpos(lower(text), lower(a1)) > 0 THEN a1 WHEN strpos(lower(text), lower(a2)) > 0 THEN a2 END AS s_match, CASE WHEN strpos(lower(text), lower(b1)) > 0 THEN b1 WHEN strpos(lower(text), lower(b2)) > 0 THEN b2 END AS t_match FROM v)
 SELECT claim_id, s_match, t_match, CAST(length(s_match) + length(t_match) + length(verb) AS INTEGER) AS match_length FROM m WHERE s_match IS NOT NULL AND t_match IS NOT NULL AND contains(lower(text), lower(verb))
  AND NOT (strpos(lower(text), lower(s_match)) < strpos(lower(text), lower(t_match)) + length(t_match) AND strpos(lower(text), lower(t_match)) < strpos(lower(text), lower(s_match)) + length(s_match))""",
)
def containment(spark, sf):
    """Longest variant of each name that the sentence of the same record holds, with the relation term, spans apart."""
    from claimweave.functions.names import name_variants

    c = claims(spark, sf).select("claim_id", F.lower("text").alias("low"), "verb", "source_species", "target_species")

    def longest(name):
        forms = F.filter(name_variants(name), lambda v: F.contains(F.col("low"), F.lower(v)))
        return F.element_at(F.array_sort(F.transform(forms, lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))), -1)["v"]

    c = c.where(F.contains("low", F.lower("verb"))).withColumns({"s_match": longest("source_species"), "t_match": longest("target_species")})
    c = c.where(F.col("s_match").isNotNull() & F.col("t_match").isNotNull())
    at = lambda m: F.expr(f"instr(low, lower({m}))")
    overlap = (at("s_match") < at("t_match") + F.length("t_match")) & (at("t_match") < at("s_match") + F.length("s_match"))
    n = F.length("s_match") + F.length("t_match") + F.length("verb")
    return c.where(~overlap).select("claim_id", "s_match", "t_match", n.alias("match_length"))


@query(
    "join_14_overlapping_spans",
    """WITH a AS (SELECT l_orderkey AS k, CAST(l_quantity AS INTEGER) AS s, CAST(l_quantity AS INTEGER) + 5 AS e FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT l_orderkey AS k, CAST(l_quantity AS INTEGER) AS s, CAST(l_quantity AS INTEGER) + 8 AS e FROM lineitem WHERE l_linenumber > 3)
 SELECT a.k AS row_id, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2 FROM a JOIN b ON a.k = b.k AND a.s < b.e AND b.s < a.e""",
)
def overlapping(spark, sf):
    line = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_quantity").cast("int").alias("start"), "l_linenumber")
    a = line.where("l_linenumber <= 3").withColumn("stop", F.col("start") + 5)
    b = line.where("l_linenumber > 3").withColumn("stop", F.col("start") + 8)
    return J.overlapping_spans(a, b, ["row_id"])


MENTIONS = f"""{SENTENCES}, {DICTIONARY}, mentions AS MATERIALIZED (SELECT doc_id, sent_id, min(i) AS pos, w[i] AS name, CASE WHEN length(w[i]) % 2 = 0 THEN 'HOST' ELSE 'PATHOGEN' END AS type FROM (
 SELECT doc_id, sent_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, sent_id, list_filter(string_split_regex(lower(sentence), '{TOKEN_SPLIT}'), lambda x: x <> '') AS w FROM sentences))
 WHERE w[i] IN (SELECT token FROM dictionary) GROUP BY doc_id, sent_id, w[i])"""


def mentions(spark, sf):
    """First mention of each dictionary name per sentence, of whatever length."""
    s = sentences(spark, sf).select("doc_id", "sent_id", "sentence")
    names = dictionary(spark, sf).select(F.col("token").alias("name"))
    hits = MT.dictionary_hits(s, ["doc_id", "sent_id"], "sentence", names, 1)
    first = hits.groupBy("doc_id", "sent_id", F.col("gram").alias("name")).agg(F.min("start").alias("pos"))
    return first.withColumn("type", F.when(F.length("name") % 2 == 0, "HOST").otherwise("PATHOGEN"))


@query(
    "join_15_typed_pairs",
    f"WITH {MENTIONS} SELECT a.doc_id, a.sent_id, a.name AS first, b.name AS second FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND a.pos < b.pos WHERE a.type <> b.type",
)
def typed_pairs(spark, sf):
    """Ordered pairs of a pathogen and a host of one sentence, by a join on the sentence and the other type."""
    m = mentions(spark, sf)
    b = m.select("doc_id", "sent_id", F.col("name").alias("second"), F.col("pos").alias("pos_2"), F.when(F.col("type") == "HOST", "PATHOGEN").otherwise("HOST").alias("type"))
    return m.join(b, ["doc_id", "sent_id", "type"]).where("pos < pos_2").select("doc_id", "sent_id", F.col("name").alias("first"), "second")


def name_table(spark, sf):
    return explode_ontology(taxonomy_dump(spark, sf))[1]


FUZZY_NAMES = """names AS (SELECT DISTINCT lower(s_name) AS name_norm, 's' || s_suppkey AS id FROM supplier UNION SELECT lower(n_name), 'n' || n_nationkey FROM nation),
queries AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'supplier#' || lpad(CAST(c_custkey % 130 AS VARCHAR), 9, '0') || 'x' WHEN c_custkey % 3 = 1 THEN 'nation_' || (c_custkey % 27) ELSE lower(c_name) END AS query FROM customer)"""


def fuzzy_queries(spark, sf):
    k = F.col("c_custkey")
    q = (
        F.when(k % 3 == 0, F.concat(F.lit("supplier#"), F.lpad((k % 130).cast("string"), 9, "0"), F.lit("x")))
        .when(k % 3 == 1, F.concat(F.lit("nation_"), (k % 27).cast("string")))
        .otherwise(F.lower("c_name"))
    )
    return load(spark, sf, "customer").select(q.alias("query")).distinct()


@query(
    "join_16_fuzzy_names",
    f"""WITH {FUZZY_NAMES}, s AS (SELECT query, name_norm, id, 1 - levenshtein(query, name_norm) / CAST(greatest(length(query), length(name_norm)) AS DOUBLE) AS sim FROM queries JOIN names ON substr(query, 1, 3) = substr(name_norm, 1, 3) WHERE length(query) >= 8)
 SELECT query, name_norm, id, round(sim, 3) AS similarity FROM s WHERE sim >= 0.9 - 1e-9 QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, name_norm, id) = 1""",
)
def fuzzy_names(spark, sf):
    names = name_table(spark, sf).where("is_syn = 0")
    return TX.best_fuzzy(fuzzy_queries(spark, sf), names)


@query(
    "join_17_name_cascade",
    f"""WITH names AS (SELECT lower(s_name) AS name_norm, 's' || s_suppkey AS id, 0 AS is_syn FROM supplier UNION SELECT lower(n_name), 'n' || n_nationkey, 0 FROM nation UNION SELECT lower(r_name), 'r' || r_regionkey, 0 FROM region
   UNION SELECT 'sup. ' || s_suppkey, 's' || s_suppkey, 1 FROM supplier UNION SELECT lower(n_name), 'n' || n_nationkey, 1 FROM nation UNION SELECT lower(r_name), 'r' || r_regionkey, 1 FROM region),
 q AS (SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN 'supplier#' || lpad(CAST(c_custkey % 130 AS VARCHAR), 9, '0') WHEN 1 THEN 'sup. ' || (c_custkey % 90) WHEN 2 THEN 'm. east' WHEN 3 THEN 'suplier#' || lpad(CAST(c_custkey % 130 AS VARCHAR), 9, '0') ELSE lower(c_mktsegment) END AS query FROM customer),
 e AS (SELECT query, id, CASE WHEN is_syn = 1 THEN 'synonym' ELSE 'exact' END AS match_type, CAST(1 AS DOUBLE) AS similarity FROM q JOIN names ON query = name_norm QUALIFY row_number() OVER (PARTITION BY query ORDER BY is_syn, id) = 1),
 r1 AS (SELECT query FROM q WHERE query NOT IN (SELECT query FROM e)),
 u AS (SELECT substr(name_norm, 1, 1) AS i, regexp_extract(name_norm, '([^ ]+)$', 1) AS ep, min(id) AS id FROM names WHERE contains(name_norm, ' ') GROUP BY 1, 2 HAVING min(id) = max(id)),
 a AS (SELECT query, id, 'abbrev' AS match_type, CAST(1 AS DOUBLE) AS similarity FROM r1 JOIN u ON regexp_matches(query, '^([a-z])\\.?\\s+([a-z][a-z-]+)$') AND i = substr(query, 1, 1) AND ep = regexp_extract(query, '([^ ]+)$', 1)),
 r2 AS (SELECT query FROM r1 WHERE query NOT IN (SELECT query FROM a)),
 f AS (SELECT query, id, 'fuzzy' AS match_type, round(sim, 3) AS similarity FROM (SELECT query, name_norm, id, 1 - levenshtein(query, name_norm) / CAST(greatest(length(query), length(name_norm)) AS DOUBLE) AS sim
   FROM r2 JOIN names ON substr(query, 1, 3) = substr(name_norm, 1, 3) WHERE length(query) >= 8) WHERE sim >= 0.9 - 1e-9 QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, name_norm, id) = 1)
 SELECT q.query, id, match_type, similarity FROM q LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM a UNION ALL SELECT * FROM f) h ON q.query = h.query""",
)
def name_cascade(spark, sf):
    k = F.col("c_custkey")
    padded = F.lpad((k % 130).cast("string"), 9, "0")
    q = (
        F.when(k % 5 == 0, F.concat(F.lit("supplier#"), padded)).when(k % 5 == 1, F.concat(F.lit("sup. "), (k % 90).cast("string")))
        .when(k % 5 == 2, "m. east").when(k % 5 == 3, F.concat(F.lit("suplier#"), padded)).otherwise(F.lower("c_mktsegment"))
    )
    return TX.resolve(load(spark, sf, "customer").select(q.alias("query")).distinct(), name_table(spark, sf))


CONCEPTS = """concepts AS (SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS parent, 'species' AS rank, s_name AS pref FROM supplier UNION ALL
 SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'genus', n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, 'kingdom', r_name FROM region)"""


@query(
    "join_18_kingdom_climb",
    f"""WITH RECURSIVE {CONCEPTS}, c AS (SELECT id, id AS anc, 0 AS d FROM concepts UNION ALL SELECT c.id, p.parent, d + 1 FROM c JOIN concepts p ON p.id = c.anc WHERE p.parent IS NOT NULL AND d < 40)
 SELECT o.id, k.kingdom FROM concepts o LEFT JOIN (SELECT c.id, k.pref AS kingdom FROM c JOIN concepts k ON k.id = c.anc WHERE k.rank = 'kingdom') k ON k.id = o.id""",
)
def kingdom_climb(spark, sf):
    return TX.kingdom_ancestors(explode_ontology(taxonomy_dump(spark, sf))[0])


@query(
    "join_18_lineage",
    f"""WITH RECURSIVE {CONCEPTS}, c AS (SELECT id, id AS ancestor, 0 AS depth FROM concepts UNION ALL SELECT c.id, p.parent, depth + 1 FROM c JOIN concepts p ON p.id = c.ancestor WHERE p.parent IS NOT NULL AND depth < 60)
 SELECT id, ancestor, depth FROM c""",
)
def lineage(spark, sf):
    return TX.lineage(explode_ontology(taxonomy_dump(spark, sf))[0])


def shingle_sql(table: str, k: str) -> str:
    return f"""(SELECT {k}, unnest(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i+4], ' ')))) AS g
  FROM (SELECT {k}, string_split({norm_ascii_sql("text")}, ' ') AS w FROM {table}))"""


@query(
    "join_19_shingle_jaccard",
    f"""WITH t AS {shingle_sql("benchmark", "item_id")}, d AS {shingle_sql("documents", "doc_id")}, nt AS (SELECT item_id, count(*) AS n FROM t GROUP BY 1), nd AS (SELECT doc_id, count(*) AS n FROM d WHERE doc_id IN (SELECT doc_id FROM d SEMI JOIN t USING (g)) GROUP BY 1),
 o AS (SELECT item_id, doc_id, count(*) AS ov FROM t JOIN d USING (g) GROUP BY 1, 2), j AS (SELECT item_id, max(ov / CAST(nt.n + nd.n - ov AS DOUBLE)) AS j FROM o JOIN nt USING (item_id) JOIN nd USING (doc_id) GROUP BY 1)
 SELECT b.item_id, round(coalesce(j, CAST(0 AS DOUBLE)), 6) AS max_jaccard FROM benchmark b LEFT JOIN j ON j.item_id = b.item_id""",
)
def shingle_jaccard(spark, sf):
    return L.max_jaccard(load(spark, sf, "benchmark"), load(spark, sf, "documents"), "item_id", "doc_id", "text")


def _wb_sql(table: str, k: str) -> str:
    g = " UNION ALL ".join(
        f"SELECT {k}, w, n, unnest(list_transform(range(1, greatest(1, length(p) - {m} + 1) + 1), lambda i: substr(p, i, {m}))) AS gram FROM {table}_w WHERE {m} = 3 OR length(p) >= {m}"
        for m in (3, 4, 5)
    )
    return f"""{table}_w AS (SELECT {k}, w, ' ' || w || ' ' AS p, count(*) AS n FROM (SELECT {k}, unnest(list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '')) AS w FROM {table}) GROUP BY ALL),
 {table}_g AS (SELECT {k}, gram, sum(n) AS tf FROM ({g}) GROUP BY ALL)"""


NEAR_SQL = f"""{_wb_sql("benchmark", "item_id")}, {_wb_sql("documents", "doc_id")},
 df AS (SELECT gram, count(*) AS df FROM (SELECT gram FROM benchmark_g UNION ALL SELECT gram FROM documents_g) GROUP BY gram),
 idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM benchmark) + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM df),
 tw AS (SELECT item_id, gram, tf * idf AS w FROM benchmark_g JOIN idf USING (gram)), dw AS (SELECT doc_id, gram, tf * idf AS w FROM documents_g JOIN idf USING (gram)),
 tn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM tw GROUP BY 1), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY 1),
 dots AS (SELECT item_id, doc_id, sum(tw.w * dw.w) AS dot FROM tw JOIN dw USING (gram) GROUP BY 1, 2),
 near AS (SELECT item_id, doc_id, round(dot / tn.n / dn.n, 4) AS similarity FROM dots JOIN tn USING (item_id) JOIN dn USING (doc_id))"""


@query(
    "join_20_near_duplicates",
    f"WITH {NEAR_SQL} SELECT item_id, doc_id, similarity FROM near WHERE similarity > 0.6 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) = 1",
)
def near_duplicates(spark, sf):
    """At 0.6: the passages sit inside longer documents, so the default of 0.85 finds none on these tables."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return L.near_duplicates(load(spark, sf, "benchmark"), docs, "item_id", "doc_id", "text", threshold=0.6)


@query(
    "join_21_reference_star",
    """SELECT l_orderkey, l_linenumber, s_name AS node_1, p_name AS node_2, c_name AS network, '10.1/' || o_custkey AS doi FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
)
def reference_star(spark, sf):
    """interaction → network → dataset → reference; each dimension is broadcast only while it is small."""
    line = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    dims = {
        "l_orderkey": load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"),
        "o_custkey": load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"),
        "l_suppkey": load(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"),
        "l_partkey": load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"),
    }
    for key, dim in dims.items():
        line = line.join(broadcast_if_small(dim), key)
    doi = F.concat(F.lit("10.1/"), F.col("o_custkey").cast("string"))
    return line.select("l_orderkey", "l_linenumber", F.col("s_name").alias("node_1"), F.col("p_name").alias("node_2"), F.col("c_name").alias("network"), doi.alias("doi"))


@query(
    "join_22_context_prefix",
    f"""WITH {MENTIONS}, p AS (SELECT a.doc_id, a.sent_id, a.pos AS pa, b.pos AS pb, a.name AS a, b.name AS b FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND a.pos < b.pos WHERE a.type <> b.type),
 pc AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 2),
 f AS (SELECT doc_id, sent_id, a, b, n, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pa, pb) AS rk FROM p JOIN pc ON lo = least(a, b) AND hi = greatest(a, b))
 SELECT s.doc_id, s.sent_id, md5('[KG: ' || a || ' ' || CASE WHEN n % 2 = 0 THEN 'PARASITISM' ELSE 'PREDATION' END || ' ' || b || '] ' || sentence) AS enriched FROM f JOIN sentences s ON s.doc_id = f.doc_id AND s.sent_id = f.sent_id WHERE rk = 1""",
)
def context_prefix(spark, sf):
    """Sentence prefixed with the first known pair among its names; known = co-mentioned at least twice."""
    m = mentions(spark, sf).groupBy("doc_id", "sent_id").agg(F.collect_list(F.struct("pos", "name", "type")).alias("m"))
    pairs = m.select("doc_id", "sent_id", F.posexplode(J.typed_pairs(F.col("m"), [("PATHOGEN", "HOST")])).alias("i", "p")).select("doc_id", "sent_id", "i", "p.first", "p.second")
    keyed = pairs.withColumns({"lo": F.least("first", "second"), "hi": F.greatest("first", "second")})
    known = keyed.groupBy("lo", "hi").agg(F.count("*").alias("n")).where("n >= 2")
    category = F.when(F.col("n") % 2 == 0, "PARASITISM").otherwise("PREDATION")
    hit = keyed.join(known, ["lo", "hi"]).groupBy("doc_id", "sent_id").agg(F.min_by(F.struct("first", category.alias("category"), "second"), "i").alias("h"))
    s = sentences(spark, sf).select("doc_id", "sent_id", "sentence")
    prefix = F.concat(F.lit("[KG: "), F.concat_ws(" ", "h.first", "h.category", "h.second"), F.lit("] "))
    return s.join(hit, ["doc_id", "sent_id"]).select("doc_id", "sent_id", F.md5(F.concat(prefix, "sentence")).alias("enriched"))


@query(
    "join_23_shared_targets",
    """SELECT DISTINCT l_partkey AS target FROM lineitem WHERE l_suppkey = 3 AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 7)""",
)
def shared_targets(spark, sf):
    line = load(spark, sf, "lineitem")
    one = line.where("l_suppkey = 3").select(F.col("l_partkey").alias("target"))
    return one.intersect(line.where("l_suppkey = 7").select(F.col("l_partkey").alias("target")))


@query(
    "join_24_graph_recall",
    f"""WITH {CLAIMS}, g AS (SELECT DISTINCT least(source_species, target_species) AS lo, greatest(source_species, target_species) AS hi FROM claims WHERE pos = 1 AND label = 1 AND reads > 30),
 e AS (SELECT interaction_type, g.lo IS NOT NULL AS hit FROM claims LEFT JOIN g ON lo = least(source_species, target_species) AND hi = greatest(source_species, target_species))
 SELECT coalesce(interaction_type, 'ALL') AS category, count(*) AS n_total, count(*) FILTER (WHERE hit) AS n_covered, round(avg(CAST(hit AS INTEGER)), 6) AS recall, avg(CAST(hit AS INTEGER)) < 0.2 AS gap FROM e GROUP BY GROUPING SETS ((interaction_type), ())""",
)
def graph_recall(spark, sf):
    c = claims(spark, sf).select("interaction_type", F.least("source_species", "target_species").alias("lo"), F.greatest("source_species", "target_species").alias("hi"), "pos", "label", "reads")
    g = c.where("pos = 1 and label = 1 and reads > 30").select("lo", "hi").distinct().withColumn("hit", F.lit(1))
    e = c.join(g, ["lo", "hi"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    r = e.groupingSets([[F.col("interaction_type")], []], F.col("interaction_type")).agg(F.count("*").alias("n_total"), F.sum(F.col("hit").cast("bigint")).alias("n_covered"), F.avg("hit").alias("r"))
    return r.select(F.coalesce("interaction_type", F.lit("ALL")).alias("category"), "n_total", "n_covered", F.round("r", 6).alias("recall"), (F.col("r") < 0.2).alias("gap"))


@query(
    "join_25_stored_decisions",
    f"""WITH {CLAIMS}, k AS (SELECT claim_id, pos, label, trim(lower(regexp_replace(text, '[^A-Za-z0-9_]+', ' ', 'g'))) || '||' || lower(source_species) || '||' || lower(target_species) AS key FROM claims),
 s AS (SELECT key, max(label) AS d FROM k WHERE pos IN (1, 4) GROUP BY key) SELECT claim_id, CAST(coalesce(d, -1) AS INTEGER) AS decision FROM k LEFT JOIN s USING (key)""",
)
def stored_decisions(spark, sf):
    """Decisions by normalised text and names; digests of these are joined."""
    norm = lambda c: F.trim(F.lower(F.regexp_replace(c, r"\W+", " ")))
    key = F.unhex(F.md5(F.concat_ws("||", norm("text"), norm("source_species"), norm("target_species"))))
    k = claims(spark, sf).select("claim_id", "pos", "label", key.alias("key"))
    stored = k.where("pos in (1, 4)").groupBy("key").agg(F.max("label").alias("d"))
    return k.join(stored, "key", "left").select("claim_id", F.coalesce("d", F.lit(-1)).alias("decision"))


@query(
    "join_26_distractors",
    f"""WITH {MENTIONS}, c AS (SELECT doc_id, sent_id, min_by(name, pos) AS a, max_by(name, pos) AS b FROM mentions GROUP BY 1, 2 HAVING count(*) >= 3), kp AS (SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi FROM c)
 SELECT c.doc_id, c.sent_id, a AS source, m.name AS distractor FROM c JOIN mentions m ON m.doc_id = c.doc_id AND m.sent_id = c.sent_id WHERE m.name <> a AND m.name <> b AND NOT contains(a, m.name) AND NOT contains(b, m.name) AND NOT contains(m.name, a) AND NOT contains(m.name, b)
  AND NOT EXISTS (SELECT 1 FROM kp WHERE lo = least(a, m.name) AND hi = greatest(a, m.name)) QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.sent_id ORDER BY m.pos) <= 2""",
)
def distractors(spark, sf):
    """Up to two third names of the sentence per claim, none overlapping the claim's names, no known pair."""
    m = mentions(spark, sf).groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("m")).where(F.size("m") >= 3)
    c = m.select("doc_id", "sent_id", F.element_at("m", 1)["name"].alias("a"), F.element_at("m", -1)["name"].alias("b"), "m")
    known = c.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    third = c.select("doc_id", "sent_id", "a", "b", F.inline("m"))
    n, a, b = F.col("name"), F.col("a"), F.col("b")
    apart = ~a.contains(n) & ~b.contains(n) & ~n.contains(a) & ~n.contains(b)
    open_pairs = third.where(apart).withColumns({"lo": F.least("a", "name"), "hi": F.greatest("a", "name")}).join(known, ["lo", "hi"], "left_anti")
    rk = F.row_number().over(Window.partitionBy("doc_id", "sent_id").orderBy("pos"))
    return open_pairs.withColumn("rk", rk).where("rk <= 2").select("doc_id", "sent_id", F.col("a").alias("source"), F.col("name").alias("distractor"))
