"""Filters, thresholds and rejection rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import evidence as E
from claimweave.functions import fixed_values as V
from claimweave.functions import names as N
from claimweave.functions import rules as RU
from claimweave.functions import text as T
from claimweave.functions.text import TOKEN_SPLIT
from claimweave.operators.corpus import keep_first
from claimweave.plans.registry import query
from claimweave.plans.scalar import LEX
from claimweave.plans.sqltext import any_sql, list_sql, norm_ascii_sql, q, words_sql
from claimweave.plans.tables import CLAIMS, SCORED, SENTENCES, claims, load, scored, sentences
from claimweave.session import broadcast_if_small

REFS_SQL = """refs AS (SELECT o_orderkey AS ref_id, CASE WHEN o_orderkey % 3 = 0 THEN '10.1000/' || o_orderkey WHEN o_orderkey % 3 = 1 THEN '' END AS doi,
  CASE WHEN o_orderkey % 5 < 2 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || (1000000 + o_orderkey) ELSE 'http://x.org/' || o_orderkey END AS url FROM orders)"""


@query(
    "flt_01_with_reference",
    f"""WITH {REFS_SQL}, p AS (SELECT *, nullif(regexp_extract(url, 'pubmed\\.ncbi\\.nlm\\.nih\\.gov/(\\d+)', 1), '') AS pmid FROM refs)
 SELECT ref_id, nullif(doi, '') AS doi, pmid FROM p WHERE (doi IS NOT NULL AND doi <> '') OR pmid IS NOT NULL""",
)
def with_reference(spark, sf):
    k = F.col("o_orderkey")
    refs = load(spark, sf, "orders").select(
        k.alias("ref_id"),
        F.when(k % 3 == 0, F.concat(F.lit("10.1000/"), k.cast("string"))).when(k % 3 == 1, "").alias("doi"),
        F.when(k % 5 < 2, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), (k + 1000000).cast("string")))
        .otherwise(F.concat(F.lit("http://x.org/"), k.cast("string"))).alias("url"),
    )
    refs = refs.select("ref_id", T.nullify("doi").alias("doi"), N.pmid_of("url").alias("pmid"))
    return refs.where(F.col("doi").isNotNull() | F.col("pmid").isNotNull())


@query(
    "flt_02_type_list",
    f"WITH {CLAIMS} SELECT claim_id, interaction_type FROM claims WHERE interaction_type IN ('preysOn', 'pathogenOf', 'vectorOf')",
)
def type_list(spark, sf):
    wanted = [x.lower().strip() for x in (" PreysOn", "pathogenof ", "VECTOROF")]
    return claims(spark, sf).where(F.lower(F.trim("interaction_type")).isin(wanted)).select("claim_id", "interaction_type")


@query(
    "flt_03_valid_pairs",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part p ON l_partkey = p.p_partkey JOIN part s ON s.p_partkey = l_suppkey
 WHERE len(string_split(p.p_name, ' ')) >= 2 AND lower(p.p_name) <> lower(s.p_name) AND l_returnflag IN ('A', 'N')""",
)
def valid_pairs(spark, sf):
    part = load(spark, sf, "part").select("p_partkey", "p_name")
    line = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    a = broadcast_if_small(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("a")))
    b = broadcast_if_small(part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("b")))
    ok = (
        (F.size(T.words("a")) >= 2) & (F.size(T.words("b")) >= 2) & (F.lower("a") != F.lower("b"))
        & F.col("l_returnflag").isin("A", "N")
    )
    return line.join(a, "l_partkey").join(b, "l_suppkey").where(ok).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


GOOD_SQL = f"""length(sentence) BETWEEN 40 AND 600 AND len({words_sql("sentence")}) >= 8 AND length(regexp_replace(sentence, '[^\\p{{L}}]', '', 'g')) >= 30
 AND NOT regexp_matches(sentence, '(?i)^(Fig(ure)?|Table|Supplementary)\\s') AND (length(sentence) - length(regexp_replace(sentence, '[\\[\\]()0-9]', '', 'g'))) / length(sentence) <= 0.3
 AND NOT (len(regexp_extract_all(sentence, '[A-Z][a-z]+\\s[a-z]+')) > 3 AND len({words_sql("sentence")}) < 20)"""


@query("flt_04_good_sentences", f"WITH {SENTENCES} SELECT doc_id, sent_id, md5(sentence) AS digest FROM sentences WHERE {GOOD_SQL}")
def good_sentences(spark, sf):
    return sentences(spark, sf).where(T.good_sentence("sentence")).select("doc_id", "sent_id", F.md5("sentence").alias("digest"))


@query(
    "flt_05_valid_passages",
    f"""WITH {CLAIMS} SELECT claim_id FROM claims WHERE length(text) BETWEEN 50 AND 800 AND len({words_sql("text")}) >= 8
 AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 30 AND NOT {any_sql("text", V.PASSAGE_METHOD, "(?i)")}""",
)
def valid_passages(spark, sf):
    return claims(spark, sf).where(T.valid_passage("text")).select("claim_id")


@query(
    "flt_06_complete_sentences",
    f"WITH {CLAIMS} SELECT source, count(*) AS n FROM claims WHERE regexp_matches(trim(text), '[.!?)]$') AND NOT contains(text, '{{') GROUP BY source",
)
def complete_sentences(spark, sf):
    return claims(spark, sf).where(T.complete_sentence("text")).groupBy("source").agg(F.count("*").alias("n"))


#: A one-word name has at least so many characters.
NAME_CHARS = 6
DICTIONARY = f"""dictionary AS (SELECT DISTINCT token FROM (SELECT unnest(string_split_regex(lower(text), '{TOKEN_SPLIT}')) AS token FROM benchmark) WHERE length(token) >= {NAME_CHARS})"""


def dictionary(spark, sf):
    """One-word names: the words of the ``benchmark`` texts, however often documents use them."""
    words = F.explode(F.split(F.lower("text"), TOKEN_SPLIT)).alias("token")
    return load(spark, sf, "benchmark").select(words).where(F.length("token") >= NAME_CHARS).distinct()


@query(
    "flt_07_recall_prefilter",
    f"""WITH {SENTENCES}, {DICTIONARY}, h AS (SELECT DISTINCT doc_id, sent_id FROM
   (SELECT doc_id, sent_id, unnest(string_split_regex(lower(sentence), '{TOKEN_SPLIT}')) AS token FROM sentences) WHERE token IN (SELECT token FROM dictionary))
 SELECT s.doc_id, s.sent_id, {any_sql("lower(sentence)", V.STRONG_TERMS + V.WEAK_TERMS)} AS by_term, h.doc_id IS NOT NULL AS by_name
 FROM sentences s LEFT JOIN h ON h.doc_id = s.doc_id AND h.sent_id = s.sent_id WHERE {any_sql("lower(sentence)", V.STRONG_TERMS + V.WEAK_TERMS)} OR h.doc_id IS NOT NULL""",
)
def recall_prefilter(spark, sf):
    """Interaction term by one alternation scan; name by a join of the sentence tokens with the dictionary."""
    s = sentences(spark, sf).select("doc_id", "sent_id", "sentence")
    names = dictionary(spark, sf)
    low = F.lower("sentence")
    words = s.select("doc_id", "sent_id", F.explode(F.array_distinct(F.split(low, TOKEN_SPLIT))).alias("token"))
    hits = words.join(names, "token").groupBy("doc_id", "sent_id").agg(F.lit(True).alias("by_name"))
    flagged = s.select("doc_id", "sent_id", T.has_pattern(low, V.STRONG_TERMS + V.WEAK_TERMS).alias("by_term"))
    out = flagged.join(hits, ["doc_id", "sent_id"], "left").withColumn("by_name", F.coalesce("by_name", F.lit(False)))
    return out.where(F.col("by_term") | F.col("by_name"))


FALSE_NEG_SQL = f"({any_sql('lower(text)', V.FALSE_NEGATIVE_PATTERNS)} AND NOT {any_sql('lower(text)', V.FALSE_NEGATIVE_NEGATION)})"


@query("flt_08_false_negatives", f"WITH {CLAIMS} SELECT claim_id, label FROM claims WHERE NOT (label = 0 AND {FALSE_NEG_SQL})")
def false_negatives(spark, sf):
    return claims(spark, sf).where(~((F.col("label") == 0) & T.false_negative("text"))).select("claim_id", "label")


TOPIC = ["parasite", "pathogen", "vector", "host", "infect"]


@query(
    "flt_09_topical_subset",
    f"""WITH {CLAIMS}, k AS (SELECT claim_id, list_filter([{list_sql(TOPIC)}], lambda k: contains(lower(text), k)) AS ks FROM claims)
 SELECT claim_id, array_to_string(ks, ',') AS keywords FROM k WHERE len(ks) > 0""",
)
def topical_subset(spark, sf):
    low = F.lower("text")
    c = claims(spark, sf).where(low.rlike("|".join(TOPIC)))
    found = F.filter(F.array(*[F.lit(k) for k in TOPIC]), lambda k: low.contains(k))
    return c.select("claim_id", F.array_join(found, ",").alias("keywords"))


@query(
    "flt_10_contaminated_rows",
    f"""WITH b AS (SELECT DISTINCT {norm_ascii_sql("text")} AS k FROM benchmark) SELECT doc_id, source FROM documents
 WHERE source <> 'src3' AND {norm_ascii_sql("text")} NOT IN (SELECT k FROM b)""",
)
def contaminated_rows(spark, sf):
    b = load(spark, sf, "benchmark").select(T.norm_ascii("text").alias("k"))
    d = load(spark, sf, "documents").where("source <> 'src3'").select("doc_id", "source", T.norm_ascii("text").alias("k"))
    return d.join(broadcast_if_small(b), "k", "left_anti").select("doc_id", "source")


@query(
    "flt_11_uncertainty_band",
    f"""WITH {SCORED} SELECT doc_id, source, item_id, score FROM scored WHERE score BETWEEN 0.15 AND 0.85
 QUALIFY row_number() OVER (PARTITION BY doc_id, source ORDER BY score, item_id) = 1""",
)
def uncertainty_band(spark, sf):
    s = scored(spark, sf).where(F.col("score").between(0.15, 0.85)).select("doc_id", "source", "item_id", "score")
    return keep_first(s, ["doc_id", "source"], ["score", "item_id"])


@query(
    "flt_12_decision_listing",
    """SELECT event_id, event_type, user_id, value FROM events WHERE event_type IN ('error', 'view') AND user_id < 75 ORDER BY value, event_id LIMIT 200""",
)
def decision_listing(spark, sf):
    """The 200 least confident decisions of the chosen statuses and authors."""
    e = load(spark, sf, "events").where(F.col("event_type").isin("error", "view") & (F.col("user_id") < 75))
    return e.select("event_id", "event_type", "user_id", "value").orderBy("value", "event_id").limit(200)


@query(
    "flt_13_auto_decisions",
    f"""WITH {SCORED}, d AS (SELECT CASE WHEN score >= 0.8 THEN 'approve_positive' WHEN score <= 0.05 THEN 'approve_negative' WHEN score >= 0.5 THEN 'hint_positive' ELSE 'hint_negative' END AS decision, label FROM scored)
 SELECT decision, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos FROM d GROUP BY decision""",
)
def auto_decisions(spark, sf):
    s = F.col("score")
    d = (
        F.when(s >= 0.8, "approve_positive").when(s <= 0.05, "approve_negative").when(s >= 0.5, "hint_positive").otherwise("hint_negative")
    )
    return scored(spark, sf).groupBy(d.alias("decision")).agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"))


@query(
    "flt_14_teacher_decisions",
    f"""WITH {CLAIMS}, {LEX}, t AS (SELECT *, contains(low, verb) AS has_term, length(text) < 200 AND text LIKE '%.' AND length(text) - length(replace(text, '.', '')) = 1
   AND NOT (contains(low, 'we ') OR contains(low, 'our ') OR contains(low, 'this study') OR contains(low, 'here we') OR contains(low, 'was ') OR contains(low, 'were ')) AS title FROM lex)
 SELECT claim_id, CASE WHEN confidence >= 0.92 THEN 1 WHEN confidence >= 0.8 AND NOT title THEN 1 WHEN confidence <= 0.08 THEN 0 WHEN confidence <= 0.2 AND NOT has_term AND lex_strength = 0 THEN 0 END AS teacher_label,
  CASE WHEN confidence >= 0.92 THEN 'very_high' WHEN confidence >= 0.8 AND NOT title THEN 'high_not_title' WHEN confidence <= 0.08 THEN 'very_low' WHEN confidence <= 0.2 AND NOT has_term AND lex_strength = 0 THEN 'low_no_signals' ELSE 'uncertain' END AS reason FROM t""",
)
def teacher_decisions(spark, sf):
    c = E.with_lexicon(claims(spark, sf).select("claim_id", "text", "confidence", "verb"), "text")
    label, reason = E.teacher_decision(F.col("confidence"), F.lower("text").contains(F.col("verb")), F.col("lex_strength"), F.col("text"))
    return c.select("claim_id", label.alias("teacher_label"), reason.alias("reason"))


CANDIDATES = f"""{CLAIMS}, candidates AS (
SELECT claim_id, CASE WHEN pos = 3 THEN 'similar to|' || verb ELSE verb END AS relation,
 source_species || CASE WHEN reads % 13 = 0 THEN '| ' || target_species ELSE '' END AS s1,
 CASE WHEN reads % 11 = 5 THEN 'leaves' WHEN reads % 11 = 6 THEN 'avian' ELSE target_species END
   || CASE reads % 11 WHEN 1 THEN '|' || split_part(target_species, ' ', 1) WHEN 2 THEN '|Linne' ELSE '' END AS s2,
 CASE reads % 11 WHEN 0 THEN text || ' We saw the ' || lower(target_species) || ', ' || source_species || ' there.'
  WHEN 1 THEN 'It is ' || source_species || ' (Clade: ' || split_part(target_species, ' ', 1) || ') ' || verb || ' them.'
  WHEN 2 THEN text || ' See ' || source_species || ' Linne, 1758.' WHEN 4 THEN text || ' There were no infections with ' || lower(target_species) || ' at all.'
  WHEN 6 THEN text || ' Here avian influenza was seen.' WHEN 7 THEN 'We saw ' || source_species || ', many beetles and ' || target_species || '.'
  WHEN 8 THEN text || ' It lives on non-' || lower(target_species) || ' hosts.' ELSE text END AS passage FROM claims)"""


def candidates(spark, sf):
    c = claims(spark, sf)
    r = F.col("reads") % 11
    s, t, txt = F.col("source_species"), F.col("target_species"), F.col("text")
    genus, low = F.split_part(t, F.lit(" "), F.lit(1)), F.lower(t)
    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    passage = (
        F.when(r == 0, cat(txt, " We saw the ", low, ", ", s, " there."))
        .when(r == 1, cat("It is ", s, " (Clade: ", genus, ") ", F.col("verb"), " them."))
        .when(r == 2, cat(txt, " See ", s, " Linne, 1758."))
        .when(r == 4, cat(txt, " There were no infections with ", low, " at all."))
        .when(r == 6, cat(txt, " Here avian influenza was seen."))
        .when(r == 7, cat("We saw ", s, ", many beetles and ", t, "."))
        .when(r == 8, cat(txt, " It lives on non-", low, " hosts."))
        .otherwise(txt)
    )
    s2 = F.concat(
        F.when(r == 5, "leaves").when(r == 6, "avian").otherwise(t),
        F.when(r == 1, cat("|", genus)).when(r == 2, "|Linne").otherwise(""),
    )
    return c.select(
        "claim_id",
        F.when(F.col("pos") == 3, cat("similar to|", F.col("verb"))).otherwise(F.col("verb")).alias("relation"),
        F.concat(s, F.when(F.col("reads") % 13 == 0, cat("| ", t)).otherwise("")).alias("s1"),
        s2.alias("s2"),
        passage.alias("passage"),
    )


ALT = "list_filter(list_transform(string_split({c}, '|'), lambda x: lower(trim(x))), lambda x: x <> '')"
A, B = ALT.format(c="s1"), ALT.format(c="s2")
WORD = "'(?i:\\b' || {n} || '\\b)'"


def _apposition_sql(p: str) -> str:
    pairs = f"list_zip(regexp_extract_all(passage, {q(p)}, 1), regexp_extract_all(passage, {q(p)}, 2))"
    has = lambda i, side: f"len(list_filter({side}, lambda n: contains(lower(pr[{i}]), n))) > 0"
    return f"len(list_filter({pairs}, lambda pr: ({has(1, A)} AND {has(2, B)}) OR ({has(2, A)} AND {has(1, B)}))) > 0"


def _clade_sql(x: str, y: str) -> str:
    notes = f"regexp_extract_all(passage, {WORD.format(n='n')} || {q('.{0,3}?' + V.CLADE_IN_PARENTHESES)}, 1)"
    clades = f"list_filter(flatten(list_transform({notes}, lambda z: string_split_regex(lower(z), '\\s*:\\s*'))), lambda z: length(z) >= 5)"
    return f"len(list_filter({x}, lambda n: list_has_any({clades}, {y}))) > 0"


AUTHORS_SQL = f"""list_filter(list_transform(list_concat(regexp_extract_all(passage, {q(V.AUTHOR_AND_YEAR)}, 2), regexp_extract_all(passage, {q(V.AUTHOR_IN_PARENTHESES)}, 2)),
  lambda x: lower(x)), lambda x: x NOT IN ({list_sql(V.AUTHOR_STOPWORDS)}))"""
BOTH = f"list_concat({A}, {B})"
RULE_SQL = {
    "same_organism": f"(list_has_any({A}, {B}) OR {_apposition_sql(V.APPOSITION[0])} OR {_apposition_sql(V.APPOSITION[1])})",
    "own_clade": f"({_clade_sql(A, B)} OR {_clade_sql(B, A)})",
    "authority": f"list_has_any({BOTH}, {AUTHORS_SQL})",
    "non_biotic_relation": f"len(list_filter({ALT.format(c='relation')}, lambda r: regexp_matches(r, {q(V.NON_BIOTIC_RELATION)}))) > 0",
    "negated": f"""(len(list_filter({BOTH}, lambda n: regexp_matches(passage, '(?i)\\bnon-?' || n || '\\s+hosts?\\b'))) > 0
  OR len(list_filter(regexp_extract_all(passage, {q("(?i)" + V.DENIAL_SCOPE)}, 1), lambda s: len(list_filter({BOTH}, lambda n: regexp_matches(s, {WORD.format(n="n")}))) > 0)) > 0)""",
    "not_an_organism": f"len(list_filter({BOTH}, lambda n: n IN ({list_sql(V.NOT_ORGANISM)}))) > 0",
    "pathogen_modifier": f"""len(list_filter(list_filter({BOTH}, lambda a: a IN ({list_sql(V.HOST_ADJECTIVES)})), lambda n: len(regexp_extract_all(passage, {WORD.format(n="n")})) > 0
   AND len(regexp_extract_all(passage, {WORD.format(n="n")})) = len(regexp_extract_all(passage, {WORD.format(n="n")} || {q("(?i:\\s*" + V.PATHOGEN_HEAD + ")")})))) > 0""",
}


def _rule_query(number: int, name: str, build):
    @query(f"rule_{number}_{name}", f"WITH {CANDIDATES} SELECT claim_id FROM candidates WHERE {RULE_SQL[name]}")
    def run(spark, sf):
        return candidates(spark, sf).where(build(F.col("passage"), F.col("s1"), F.col("relation"), F.col("s2"))).select("claim_id")

    return run


_rule_query(1, "same_organism", lambda p, a, r, b: RU.same_organism(p, a, b))
_rule_query(2, "own_clade", lambda p, a, r, b: RU.own_clade(p, a, b))
_rule_query(3, "authority", lambda p, a, r, b: RU.authority(p, a, b))
_rule_query(4, "non_biotic_relation", lambda p, a, r, b: RU.non_biotic(r))
_rule_query(5, "negated", lambda p, a, r, b: RU.denied(p, a, b))
_rule_query(6, "not_an_organism", lambda p, a, r, b: RU.not_organism(a, b))
_rule_query(7, "pathogen_modifier", lambda p, a, r, b: RU.pathogen_modifier(p, a, b))


@query("rule_8_co_listed")
def co_listed(spark, sf):
    return candidates(spark, sf).where(RU.co_listed(F.col("passage"), F.col("s1"), F.col("s2"))).select("claim_id")


@query(
    "rule_0_first_reason",
    f"WITH {CANDIDATES} SELECT claim_id, CASE {' '.join(f'WHEN {sql} THEN {q(name)}' for name, sql in RULE_SQL.items())} END AS reason FROM candidates",
)
def first_reason(spark, sf):
    reason = RU.reject_reason(F.col("passage"), F.col("s1"), F.col("relation"), F.col("s2"))
    return candidates(spark, sf).select("claim_id", reason.alias("reason"))
