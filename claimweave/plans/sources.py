"""Sources and sinks, each run over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions import evidence as E
from claimweave.functions.text import good_sentence, norm_space, sentences_of
from claimweave.plans.registry import query
from claimweave.plans.scalar import LEX
from claimweave.plans.sqltext import words_sql
from claimweave.plans.tables import CLAIMS, LINE_ID, claims, line_id, load, spread
from claimweave.session import stage_path
from claimweave.sources import readers as R
from claimweave.sources import writers as W

WIDE = {
    "source_species": "sourceTaxonName", "source_kingdom": "sourceTaxonKingdomName", "target_species": "targetTaxonName",
    "target_kingdom": "targetTaxonKingdomName", "interaction_type": "interactionTypeName", "doi": "referenceDoi", "text": "referenceCitation",
}


def _interaction_file(spark, sf):
    path = stage_path(spark, "interactions")
    claims(spark, sf).withColumnsRenamed(WIDE).write.csv(path, sep="\t", header=True, compression="gzip", quote="")
    return path


@query(
    "src_01_interaction_scan",
    f"""WITH {CLAIMS} SELECT interaction_type AS "interactionTypeName", source_kingdom AS "sourceTaxonKingdomName", count(*) AS n,
 count(DISTINCT source_species) AS n_source, count(DISTINCT target_species) AS n_target, count(DISTINCT doi) AS n_doi FROM claims GROUP BY ALL""",
)
def interaction_scan(spark, sf):
    df = R.read_interactions(spark, _interaction_file(spark, sf))
    return df.groupBy("interactionTypeName", "sourceTaxonKingdomName").agg(
        F.count("*").alias("n"), F.countDistinct("sourceTaxonName").alias("n_source"),
        F.countDistinct("targetTaxonName").alias("n_target"), F.countDistinct("referenceDoi").alias("n_doi"),
    )


@query(
    "src_02_tolerant_scan",
    """SELECT event_id % 10 <> 3 AS accepted, count(*) AS n, count(DISTINCT CASE WHEN event_id % 10 <> 3 THEN event_type END) AS n_types,
 CAST(sum(CASE WHEN event_id % 10 = 3 THEN length(CAST(event_id AS VARCHAR)) + 1 + length(event_type) ELSE 0 END) AS BIGINT) AS rejected_chars FROM events GROUP BY 1""",
)
def tolerant_scan(spark, sf):
    """Every tenth line of the events, written as text, lacks its last field."""
    path = stage_path(spark, "events-tsv")
    e = load(spark, sf, "events")
    full = F.concat_ws("\t", F.col("event_id").cast("string"), "event_type", "props")
    short = F.concat_ws("\t", F.col("event_id").cast("string"), "event_type")
    e.select(F.when(F.col("event_id") % 10 == 3, short).otherwise(full).alias("value")).write.text(path)
    df = R.read_tolerant(spark, path, ["event_id", "event_type", "props"])
    return df.groupBy("accepted").agg(
        F.count("*").alias("n"),
        F.countDistinct("event_type").alias("n_types"),
        F.coalesce(F.sum(F.length("rejected_line").cast("bigint")), F.lit(0)).alias("rejected_chars"),
    )


@query(
    "src_03_corpus_reader",
    f"""WITH {CLAIMS} SELECT text, label, interaction_type, NULL::VARCHAR AS source_species, target_species, 'harvest' AS source FROM claims WHERE pos <= 3
 UNION ALL SELECT text, 0, CASE WHEN reads % 2 = 0 THEN NULL ELSE interaction_type END, source_species, NULL, source FROM claims WHERE pos > 3""",
)
def corpus_reader(spark, sf):
    c = claims(spark, sf)
    a = c.where("pos <= 3").select(F.col("text").alias("sentence"), F.col("label").cast("string").alias("hard_label"), "interaction_type", "target_species")
    b = c.where("pos > 3").select(
        "text", F.concat(F.lit("n"), F.col("label").cast("string")).alias("label"),
        F.when(F.col("reads") % 2 == 0, "nan").otherwise(F.col("interaction_type")).alias("interaction_type"), "source_species", "source",
    )
    return R.normalise_columns(a, "harvest").unionByName(R.normalise_columns(b))


@query(
    "src_04_dialects",
    "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g'))) AS digest, lang FROM documents",
)
def dialects(spark, sf):
    path = stage_path(spark, "dialect")
    d = load(spark, sf, "documents").select("doc_id", norm_space("text").alias("text"), "lang")
    d.write.csv(path, sep=";", header=True, encoding="UTF-8", escape='"')
    df = R.read_dialect(spark, path, sep=";", encoding="UTF-8")
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("digest"), "lang")


@query("src_05_text_folder", "SELECT CAST(item_id AS VARCHAR) AS article_id, md5(text) AS digest FROM benchmark")
def text_folder(spark, sf):
    path = stage_path(spark, "folder")
    load(spark, sf, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(path)
    docs = R.read_text_folder(spark, path, r"item_id=(\d+)/")
    return docs.select("article_id", F.md5(F.regexp_replace("text", r"\n$", "")).alias("digest"))


@query("src_06_articles_csv", "SELECT CAST(doc_id AS VARCHAR) AS article_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM documents")
def articles_csv(spark, sf):
    path = stage_path(spark, "articles")
    load(spark, sf, "documents").select("doc_id", "text").write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = R.read_articles_csv(spark, path, "doc_id", "text")
    return df.select("article_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    "src_07_array_pool",
    f"""WITH {CLAIMS} SELECT claim_id, source_species AS species1_form, target_species AS species2_form, verb AS interaction_form FROM claims WHERE reads % 6 <> 0 AND reads % 7 <> 0""",
)
def array_pool(spark, sf):
    """Pool with array slots; some slots are empty arrays or blank strings."""
    path = stage_path(spark, "pool")
    c = claims(spark, sf)
    none = F.array().cast("array<string>")
    c.select(
        "claim_id",
        F.when(F.col("reads") % 6 == 0, none).otherwise(F.array("source_species", F.lit("alt"))).alias("species1_form"),
        F.when(F.col("reads") % 7 == 0, F.array(F.lit(" "))).otherwise(F.array("target_species")).alias("species2_form"),
        F.array("verb", "interaction_type").alias("interaction_form"),
    ).write.parquet(path)
    return R.first_forms(spark.read.parquet(path), ["species1_form", "species2_form", "interaction_form"])


PASSAGE_SCHEMA = (
    "passage string, species1_form array<string>, species2_form array<string>, interaction_form array<string>, doc_id bigint, "
    "score struct<int_middle:int,size:int>"
)


@query(
    "src_08_passage_scan",
    f"""WITH {CLAIMS} SELECT doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS size FROM claims WHERE pos <= 3 AND reads % 5 <> 0 GROUP BY doc_id""",
)
def passage_scan(spark, sf):
    path = stage_path(spark, "passages")
    claims(spark, sf).select(
        F.col("text").alias("passage"), F.array("source_species").alias("species1_form"),
        F.when(F.col("reads") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("target_species")).alias("species2_form"),
        F.array("verb").alias("interaction_form"), "doc_id",
        F.struct((F.col("pos") <= 3).cast("int").alias("int_middle"), F.length("text").alias("size")).alias("score"),
    ).write.json(path)
    df = R.scan_passages(spark, path, PASSAGE_SCHEMA)
    return df.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("score.size").cast("bigint")).alias("size"))


def taxonomy_dump(spark, sf):
    """One nested record per nation holding its suppliers as concepts, with links to nation and region."""
    n = load(spark, sf, "nation")
    s = load(spark, sf, "supplier")
    term = lambda t, rel=True: F.struct(t.alias("term"), F.lit(rel).alias("relevance"))
    con = lambda i, parent, rank, pref, syn: F.struct(
        i.alias("id"), parent.alias("parent"), F.lit(rank).alias("rank"), pref.alias("preferred_term"), syn.alias("synonyms")
    )
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    sup = s.select(
        con(
            k("s", "s_suppkey"), k("n", "s_nationkey"), "species", term(F.col("s_name")),
            F.array(term(F.concat(F.lit("Sup. "), F.col("s_suppkey").cast("string"))), term(F.lit("unused"), False)),
        ).alias("c")
    )
    nat = n.select(con(k("n", "n_nationkey"), k("r", "n_regionkey"), "genus", term(F.col("n_name")), F.array(term(F.lower("n_name")))).alias("c"))
    reg = load(spark, sf, "region").select(
        con(k("r", "r_regionkey"), F.lit(None).cast("string"), "kingdom", term(F.col("r_name")), F.array(term(F.initcap("r_name")))).alias("c")
    )
    both = sup.unionByName(nat).unionByName(reg)
    return both.select(F.array("c").alias("concepts"))


@query(
    "src_09_ontology_names",
    """WITH c AS (SELECT 's' || s_suppkey AS id, s_name AS pref, 'Sup. ' || s_suppkey AS syn FROM supplier UNION ALL
  SELECT 'n' || n_nationkey, n_name, lower(n_name) FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, r_name FROM region)
 SELECT DISTINCT name_norm, id, is_syn, substr(name_norm, 1, 3) AS prefix3 FROM (SELECT lower(trim(pref)) AS name_norm, id, 0 AS is_syn FROM c UNION ALL SELECT lower(trim(syn)), id, 1 FROM c)""",
)
def ontology_names(spark, sf):
    path = stage_path(spark, "ontology")
    taxonomy_dump(spark, sf).write.json(path)
    _, names = R.explode_ontology(spark.read.schema(R.ONTOLOGY_SCHEMA).json(path))
    return names


@query(
    "src_10_annotations",
    f"""WITH {CLAIMS} SELECT claim_id AS sentence_id, source_species AS head, interaction_type AS relation, target_species AS tail FROM claims""",
)
def annotations(spark, sf):
    """Annotations appended in two writes, read as one table of relations."""
    path = stage_path(spark, "annotations")
    c = claims(spark, sf)
    ent = lambda i, col: F.struct(F.lit(i).alias("id"), F.col(col).alias("text"), F.lit("ORGANISM").alias("type"))
    rec = c.select(
        F.col("claim_id").alias("sentence_id"), "text", F.array(ent(1, "target_species"), ent(0, "source_species")).alias("entities"),
        F.array(F.struct(F.lit(0).alias("head"), F.col("interaction_type").alias("relation"), F.lit(1).alias("tail"))).alias("relations"), "label",
    )
    rec.where("label = 1").drop("label").write.mode("append").json(path)
    rec.where("label = 0").drop("label").write.mode("append").json(path)
    return R.annotation_relations(R.read_annotations(spark, path))


@query(
    "src_11_annotation_blocks",
    """WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS t, o_custkey AS c FROM orders), l AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1)
 SELECT CAST(k AS VARCHAR) AS doc_id, 'Title ' || t AS title, coalesce(n, 0) AS n_mentions, coalesce(parts, 0) AS n_concepts, CAST(1 AS BIGINT) AS n_relations FROM o LEFT JOIN l USING (k)""",
)
def annotation_blocks(spark, sf):
    path = stage_path(spark, "blocks")
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority", "o_custkey")
    k = F.col("k").cast("string")
    mention = F.concat_ws(
        "\t", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), (F.col("l_linenumber") + 5).cast("string"),
        F.lit("m"), F.lit("Part"), F.col("l_partkey").cast("string"),
    )
    lines = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(mention)).alias("m"))
    block = F.concat_ws(
        "\n", F.concat(k, F.lit("|t|Title "), F.col("o_orderpriority")), F.concat(k, F.lit("|a|Abstract of "), k),
        F.array_join("m", "\n"), F.concat_ws("\t", k, F.lit("Assoc"), F.lit("c1"), F.col("o_custkey").cast("string")),
    )
    o.join(lines, "k", "left").select(block.alias("value")).write.option("lineSep", "\n\n").text(path)
    docs, mentions, relations = R.read_annotation_blocks(spark, path)
    m = mentions.groupBy("doc_id").agg(F.count("*").alias("n_mentions"), F.countDistinct("concept").alias("n_concepts"))
    r = relations.groupBy("doc_id").agg(F.count("*").alias("n_relations"))
    return (
        docs.join(m, "doc_id", "left").join(r, "doc_id", "left").select("doc_id", "title", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_mentions", "n_concepts", "n_relations")])
    )


@query(
    "src_12_html_text",
    """SELECT page_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT page_id, trim(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav[^>]*>.*?</nav>', ' ', 'g'),
  '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS t FROM pages)""",
)
def html_text(spark, sf):
    p = load(spark, sf, "pages").select("page_id", R.html_to_text("html").alias("t"))
    return p.select("page_id", F.md5("t").alias("digest"), F.length("t").alias("n_chars"))


@query(
    "src_13_citation_passages",
    f"""SELECT {LINE_ID} AS doc_id, 'B1' AS rid, 't' || l_partkey AS target_id, CAST(CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS INTEGER) AS matched_by,
  'Quantity ' || CAST(l_quantity AS BIGINT) || ' was reported ⟦B1⟧ in that year.' AS sentence FROM lineitem""",
)
def citation_passages(spark, sf):
    """An article per order line whose second of three references names its part by DOI, DOI in text, title, or author and year.

    The references around it are cited too, name no part, and have no DOI or an unknown one.
    """
    p = F.col("l_partkey").cast("string")
    way = F.col("l_linenumber") % 4
    doi = F.when(way == 0, F.concat(F.lit("<doi>10.5555/P"), p, F.lit("</doi>"))).otherwise(F.lit(""))
    mixed = (
        F.when(way == 1, F.concat(F.lit("Unknown. Some title. See 10.5555/p"), p, F.lit(".")))
        .when(way == 2, F.concat(F.lit("Someone. Catalogue entry "), p, F.lit(". Journal.")))
        .when(way == 3, F.concat(F.lit("Author"), F.translate(p, "0123456789", "abcdefghij"), F.lit(" 1999 no title")))
        .otherwise(F.lit("plain"))
    )
    xml = F.concat(
        F.lit('<article><body><p>A first remark stands here <xref rid="B0">0</xref>. Quantity '), F.col("l_quantity").cast("bigint").cast("string"),
        F.lit(' was reported <xref rid="B1">1</xref> in that year. Nothing else is said <xref rid="B2">2</xref>.</p></body>'),
        F.lit('<ref-list><ref id="B0"><mixed>plain</mixed></ref><ref id="B1">'),
        doi, F.lit("<mixed>"), mixed, F.lit('</mixed></ref><ref id="B2"><doi>10.5555/none</doi></ref></ref-list></article>'),
    )
    articles = spread(load(spark, sf, "lineitem")).select(line_id().alias("doc_id"), xml.alias("xml"))
    k = F.col("p_partkey").cast("string")
    targets = load(spark, sf, "part").select(
        F.concat(F.lit("t"), k).alias("target_id"), F.concat(F.lit("10.5555/P"), k).alias("doi"),
        F.concat(F.lit("Catalogue entry "), k).alias("title"),
        F.concat(F.lit("Author"), F.translate(k, "0123456789", "abcdefghij")).alias("surname"), F.lit(1999).alias("year"),
    )
    return R.citing_passages(articles, targets, sentences_of).select("doc_id", "rid", "target_id", "matched_by", "sentence")


@query(
    "src_14_assignments",
    """SELECT layout, asv_id, species FROM (
 SELECT 'bold' AS layout, 'a' || p_partkey AS asv_id, p_name AS species FROM part WHERE p_size % 2 = 0
 UNION ALL SELECT 'silva', 'a' || p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_type ELSE p_brand END FROM part
 UNION ALL SELECT 'blast', 'a' || p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) FROM part WHERE p_size % 5 <> 0)""",
)
def assignment_tables(spark, sf):
    p = load(spark, sf, "part")
    asv = F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("ASV_ID")
    bold = p.select(F.when(F.col("p_size") % 2 == 0, " OK").otherwise("conflict").alias("Status"), asv, F.col("p_name").alias("Species"))
    silva = p.select(
        asv, F.col("p_brand").alias("Family"), F.when(F.col("p_size") % 3 == 1, F.col("p_type")).otherwise("").alias("Genus"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("nan").alias("Species"),
    )
    binomial = F.concat(F.lit("uncultured "), F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.lit(" isolate X"))
    blast = p.select(asv, F.when(F.col("p_size") % 5 != 0, binomial).otherwise("no hit").alias("species_blast"))
    out = None
    for layout, df in (("bold", bold), ("silva", silva), ("blast", blast)):
        a = R.assignments(df, layout).select(F.lit(layout).alias("layout"), "asv_id", "species")
        out = a if out is None else out.unionByName(a)
    return out


@query(
    "src_15_abundance_long",
    """SELECT r_name AS sample_id, p_name AS species, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS reads FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE p_size % 2 = 0 GROUP BY ALL""",
)
def abundance(spark, sf):
    """Regions as sample columns of a wide table; only parts of even size are assigned."""
    line = load(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    where = (
        load(spark, sf, "supplier").join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    )
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = (
        line.join(where, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.concat(F.lit("a"), F.col("l_partkey").cast("string")).alias("ASV"))
        .pivot("r_name", regions).agg(F.sum(F.col("l_quantity").cast("bigint")))
    )
    assigned = load(spark, sf, "part").where("p_size % 2 = 0").select(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("asv_id"), F.col("p_name").alias("species"))
    return R.abundance_long(wide, "ASV", assigned)


@query(
    "src_16_result_metrics",
    """WITH m AS (SELECT o_orderpriority AS arm, o_orderstatus AS seed, count(*) AS n, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS top FROM orders GROUP BY ALL)
 SELECT arm, seed, metric, value FROM (SELECT arm, seed, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM m UNION ALL SELECT arm, seed, 'mean', mean FROM m UNION ALL SELECT arm, seed, 'top', top FROM m)""",
)
def result_metrics(spark, sf):
    path = stage_path(spark, "results")
    o = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("seed"))
    m = o.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("top"))
    m.select("arm", "seed", F.struct("n", "mean", "top").alias("metrics")).write.json(path)
    df = spark.read.schema("arm string, seed string, metrics struct<n:bigint,mean:double,top:double>").json(path)
    return R.flatten_metrics(df, ["arm", "seed"], "metrics")


DIGEST = "('0x' || substr(md5(concat_ws(chr(1), {cells})), 1, 8))::BIGINT"


def digest_sql(*cells: str) -> str:
    return DIGEST.format(cells=", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cells))


@query(
    "snk_01_manifest",
    f"""WITH {CLAIMS}, {LEX} SELECT count(*) AS n_rows, round(avg(label), 4) AS pos_rate, round(avg(CASE WHEN label = 1 THEN CAST(lex_signal AS INTEGER) END), 4) AS p_signal_pos,
 round(avg(CASE WHEN label = 0 THEN CAST(lex_signal AS INTEGER) END), 4) AS p_signal_neg, CAST(sum({digest_sql("claim_id", "text", "label")}) AS BIGINT) AS content_sum, '42' AS seed FROM lex""",
)
def dataset_manifest(spark, sf):
    path = stage_path(spark, "dataset")
    c = E.with_lexicon(claims(spark, sf).select("claim_id", "text", "label"), "text")
    c.write.parquet(f"{path}/data")
    written = spark.read.parquet(f"{path}/data")
    W.manifest(written, "label", "lex_signal", ["claim_id", "text", "label"], "42").coalesce(1).write.json(f"{path}/manifest")
    schema = "n_rows bigint, pos_rate double, p_signal_pos double, p_signal_neg double, content_sum bigint, seed string"
    return spark.read.schema(schema).json(f"{path}/manifest")


@query(
    "snk_02_resumable",
    """SELECT user_id, event_type AS answer, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
)
def resumable(spark, sf):
    """Answers written in two runs with an overlap; the second run appends only keys not yet written."""
    path = stage_path(spark, "answers")
    e = load(spark, sf, "events").select(F.col("event_id").alias("seq"), "user_id", F.col("event_type").alias("answer"))
    W.write_remaining(e.where("seq % 3 <> 0"), path, ["seq"], spark)
    W.write_remaining(e, path, ["seq"], spark)
    return W.read_answers(spark, path, ["user_id"], ["seq"]).select("user_id", "answer", "seq")


@query(
    "snk_03_accept_reject",
    f"""WITH {CLAIMS}, r AS (SELECT CASE WHEN length(text) NOT BETWEEN 40 AND 600 OR len({words_sql("text")}) < 8 OR length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 30
  OR (len(regexp_extract_all(text, '[A-Z][a-z]+\\s[a-z]+')) > 3 AND len({words_sql("text")}) < 20) THEN 'shape' WHEN label = 0 THEN 'negative' WHEN confidence < 0.3 THEN 'confidence' END AS rejection_reason, text FROM claims)
 SELECT rejection_reason, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM r GROUP BY 1""",
)
def accept_reject(spark, sf):
    acc, rej = stage_path(spark, "accepted"), stage_path(spark, "rejected")
    c = claims(spark, sf).select("claim_id", "text", "label", "confidence")
    reason = F.when(~good_sentence("text"), "shape").when(F.col("label") == 0, "negative").when(F.col("confidence") < 0.3, "confidence")
    W.split_by_reason(c, reason, acc, rej)
    both = spark.read.parquet(acc).withColumn("rejection_reason", F.lit(None).cast("string")).unionByName(spark.read.parquet(rej))
    return both.groupBy("rejection_reason").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("n_chars"))


@query(
    "snk_04_edge_export",
    f"""WITH {CLAIMS}, e AS (SELECT source_species AS subject, interaction_type AS predicate, target_species AS object, interaction_type NOT IN ('symbioticWith', 'interactsWith') AS directed,
   CASE WHEN interaction_type = 'pathogenOf' THEN 'RO_0002556' WHEN interaction_type = 'vectorOf' THEN 'RO_0002459' END AS ro_id, round(avg(confidence), 4) AS confidence, count(*) AS n_sources FROM claims GROUP BY ALL)
 SELECT kind, count(*) AS n, min(shape) AS shape FROM (SELECT 'edge' AS kind, 'Association' AS shape FROM e UNION ALL SELECT 'context', '["RO_0002459","RO_0002556"]') GROUP BY kind""",
)
def edge_export(spark, sf):
    path = stage_path(spark, "edges")
    e = claims(spark, sf).groupBy(
        F.col("source_species").alias("subject"), F.col("interaction_type").alias("predicate"), F.col("target_species").alias("object")
    ).agg(F.round(F.avg("confidence"), 4).alias("confidence"), F.count("*").alias("n_sources"))
    e = e.withColumns(
        {
            "directed": ~F.col("predicate").isin("symbioticWith", "interactsWith"),
            "ro_id": F.when(F.col("predicate") == "pathogenOf", "RO_0002556").when(F.col("predicate") == "vectorOf", "RO_0002459"),
        }
    )
    W.edges_jsonld(e).write.json(path)
    docs = spark.read.schema("kind string, document string").json(path)
    shape = F.coalesce(F.get_json_object("document", "$['@type']"), F.get_json_object("document", "$['@context'].relations"))
    return docs.groupBy("kind").agg(F.count("*").alias("n"), F.min(shape).alias("shape"))


@query(
    "snk_05_approved_export",
    """SELECT event_id AS item_id, event_type AS status, least(value / 100, CAST(1 AS DOUBLE)) AS confidence, 'u' || user_id AS author FROM events WHERE event_type = 'purchase' AND value / 100 >= 0.7""",
)
def approved_export(spark, sf):
    d = load(spark, sf, "events").select(
        F.col("event_id").alias("item_id"), F.when(F.col("event_type") == "purchase", "approved").otherwise("pending").alias("status"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"),
    )
    path = stage_path(spark, "approved")
    W.export_approved(d, 0.7).write.parquet(path)
    return spark.read.parquet(path).withColumn("status", F.lit("purchase"))


@query(
    "snk_06_content_gate",
    f"SELECT item_id, md5(text) AS digest, (SELECT CAST(sum({digest_sql('item_id', 'text')}) AS BIGINT) FROM benchmark) AS content_sum FROM benchmark",
)
def content_gate(spark, sf):
    """Register the benchmark's content hash, then load it through the gate that compares it again."""
    b = load(spark, sf, "benchmark")
    registered = W.fingerprint(b, ["item_id", "text"]).first()
    gated = W.require_fingerprint(b, ["item_id", "text"], registered["n_rows"], registered["content_sum"])
    return gated.select("item_id", F.md5("text").alias("digest"), F.lit(registered["content_sum"]).alias("content_sum"))


