"""Base relations: the given tables, and records derived from them.

``claims`` renders every order line as a statement about two named taxa (supplier → source name,
part → target name, line number → sentence form); ``sentences`` splits every document.
Each relation has a DataFrame form and the same definition as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.text import TOKEN_SPLIT, sentences_of
from claimweave.session import broadcast_if_small


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core for heavy per-row work when a table arrives in fewer pieces than there are cores.

    Large inputs already come in many splits and are left alone, so no shuffle is added for them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


TYPES = [
    "preysOn", "parasiteOf", "endoparasiteOf", "pathogenOf", "vectorOf",
    "pollinates", "grazesOn", "symbioticWith", "interactsWith", "hasHost",
]
VERBS = [
    "preys on", "is a parasite of", "is an endoparasite of", "infects", "is a vector of",
    "pollinates", "grazes on", "lives in symbiosis with", "interacts with", "is a host of",
]
SOURCE_KINGDOMS = ["Animalia", "Plantae", "Fungi", "Bacteria", "Virus"]
TARGET_KINGDOMS = ["Plantae", "Animalia", "Fungi"]


def _pick(index, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _pick_sql(index: str, values: list[str]) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"([{items}])[CAST({index} AS BIGINT) + 1]"


def letters(col):
    return F.translate(col.cast("string"), "0123456789", "abcdefghij")


def line_id():
    """Identity of an order line: its keys, day and price (the keys alone repeat)."""
    day, cents = F.date_format("l_shipdate", "yyyyMMdd"), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day, cents)


LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(round(l_extendedprice * 100) AS BIGINT))"


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """One statement per order line; dimension sides are joined by key and sized by the optimiser."""
    line = spread(load(spark, sf, "lineitem").drop("l_tax", "l_linestatus"))
    supplier, nation = load(spark, sf, "supplier"), load(spark, sf, "nation")
    sup = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    sup = broadcast_if_small(sup.select("s_suppkey", "s_nationkey", "n_regionkey"), [supplier, nation])
    part = load(spark, sf, "part")
    part = broadcast_if_small(part.select("p_partkey", "p_name"), [part])
    j = line.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    kind = (F.col("l_partkey") + F.col("l_suppkey")) % 10
    j = j.select(
        line_id().alias("claim_id"),
        F.concat(F.lit("10.1000/"), F.col("l_orderkey").cast("string")).alias("doi"),
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("pos"),
        F.concat(F.lit("Sup"), letters(F.col("s_nationkey")), F.lit("us "), letters(F.col("l_suppkey")), F.lit("ensis")).alias(
            "source_species"
        ),
        F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)")).alias("target_species"),
        _pick(kind, TYPES).alias("interaction_type"),
        _pick(kind, VERBS).alias("verb"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("label"),
        F.year("l_shipdate").alias("pub_year"),
        F.round(F.col("l_discount") * 10, 2).alias("confidence"),
        F.concat(F.lit("src"), (F.col("l_suppkey") % 7).cast("string")).alias("source"),
        _pick(F.col("n_regionkey"), SOURCE_KINGDOMS).alias("source_kingdom"),
        _pick(F.ascii(F.substring("p_name", 1, 1)) % 3, TARGET_KINGDOMS).alias("target_kingdom"),
        F.col("l_quantity").cast("bigint").alias("reads"),
    )
    s, v, t = F.col("source_species"), F.col("verb"), F.col("target_species")
    text = (
        F.when(F.col("pos") == 1, F.concat(s, F.lit(" "), v, F.lit(" "), t, F.lit(" and both were collected from the river bank.")))
        .when(F.col("pos") == 2, F.concat(F.lit("In vitro assays show that "), s, F.lit(" "), v, F.lit(" "), t, F.lit(" under laboratory conditions.")))
        .when(F.col("pos") == 3, F.concat(s, F.lit(" does not infect "), t, F.lit(" in any of the samples that we examined here.")))
        .when(F.col("pos") == 4, F.concat(F.lit("A review of previous studies reported that "), s, F.lit(" "), v, F.lit(" "), t, F.lit(".")))
        .when(F.col("pos") == 5, F.concat(F.lit("We used a statistical protocol and table 3 to test if "), s, F.lit(" "), v, F.lit(" "), t, F.lit(".")))
        .when(F.col("pos") == 6, F.concat(s, F.lit(" and "), t, F.lit(" were seen near the river in the same week of May")))
        .otherwise(F.concat(s, F.lit(" "), v, F.lit(" "), t, F.lit(", a known predator of Homo sapiens and a pathogen of "), s, F.lit(".")))
    )
    return j.withColumn("text", text)


CLAIMS = f"""claims AS (
SELECT claim_id, doi, doc_id, pos, source_species, target_species, interaction_type, verb, label, pub_year, confidence,
       source, source_kingdom, target_kingdom, reads,
       CASE pos WHEN 1 THEN source_species || ' ' || verb || ' ' || target_species || ' and both were collected from the river bank.'
        WHEN 2 THEN 'In vitro assays show that ' || source_species || ' ' || verb || ' ' || target_species || ' under laboratory conditions.'
        WHEN 3 THEN source_species || ' does not infect ' || target_species || ' in any of the samples that we examined here.'
        WHEN 4 THEN 'A review of previous studies reported that ' || source_species || ' ' || verb || ' ' || target_species || '.'
        WHEN 5 THEN 'We used a statistical protocol and table 3 to test if ' || source_species || ' ' || verb || ' ' || target_species || '.'
        WHEN 6 THEN source_species || ' and ' || target_species || ' were seen near the river in the same week of May'
        ELSE source_species || ' ' || verb || ' ' || target_species || ', a known predator of Homo sapiens and a pathogen of ' || source_species || '.' END AS text
FROM (SELECT {LINE_ID} AS claim_id,
    '10.1000/' || l_orderkey AS doi, l_orderkey AS doc_id, l_linenumber AS pos,
    'Sup' || translate(CAST(s_nationkey AS VARCHAR), '0123456789', 'abcdefghij') || 'us '
      || translate(CAST(l_suppkey AS VARCHAR), '0123456789', 'abcdefghij') || 'ensis' AS source_species,
    upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS target_species,
    {_pick_sql("(l_partkey + l_suppkey) % 10", TYPES)} AS interaction_type,
    {_pick_sql("(l_partkey + l_suppkey) % 10", VERBS)} AS verb,
    CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS label,
    CAST(year(l_shipdate) AS INTEGER) AS pub_year, round(l_discount * 10, 2) AS confidence,
    'src' || (l_suppkey % 7) AS source,
    {_pick_sql("n_regionkey", SOURCE_KINGDOMS)} AS source_kingdom,
    {_pick_sql("ascii(substr(p_name, 1, 1)) % 3", TARGET_KINGDOMS)} AS target_kingdom,
    CAST(l_quantity AS BIGINT) AS reads
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey))"""


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Every document split into sentences longer than 10 characters."""
    docs = spread(load(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return sentences_of(docs, "text", keep=["doc_id", "lang", "source"])


SENTENCES = """sentences AS (
SELECT doc_id, lang, source, CAST(i - 1 AS INTEGER) AS sent_id, trim(parts[i]) AS sentence
FROM (SELECT doc_id, lang, source, parts, unnest(range(1, len(parts) + 1)) AS i
  FROM (SELECT doc_id, lang, source,
    string_split(regexp_replace(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), '([.!?]) ([A-Z])', '\\1§\\2', 'g'), '§') AS parts
    FROM documents))
WHERE length(trim(parts[i])) > 10)"""


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, pos, token) over whole documents; tokens are runs of letters, marks and digits of any script."""
    docs = spread(load(spark, sf, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", F.posexplode(F.filter(F.split(F.lower("text"), TOKEN_SPLIT), lambda w: w != "")).alias("pos", "token")
    )


TOKENS = f"""tokens AS (
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, ws[i] AS token FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (
    SELECT doc_id, list_filter(string_split_regex(lower(text), '{TOKEN_SPLIT}'), lambda w: w <> '') AS ws FROM documents)))"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Items with a gold label and the scores of two models, one per order line."""
    line = load(spark, sf, "lineitem")
    return line.select(
        line_id().alias("item_id"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.concat(F.lit("src"), (F.col("l_suppkey") % 7).cast("string")).alias("source"),
        F.col("l_linestatus").alias("arm"),
        F.col("l_orderkey").alias("doc_id"),
        F.when(
            F.col("l_returnflag") == "R", F.round((F.col("l_quantity") + 25) / 75.0, 3)
        ).otherwise(F.round(F.col("l_quantity") / 75.0, 3)).alias("score"),
        F.round(((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % 1000) / 1000.0, 3).alias("score_b"),
    )


SCORED = f"""scored AS (
SELECT {LINE_ID} AS item_id,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  'src' || (l_suppkey % 7) AS source, l_linestatus AS arm, l_orderkey AS doc_id,
  CASE WHEN l_returnflag = 'R' THEN round((l_quantity + 25) / 75.0, 3) ELSE round(l_quantity / 75.0, 3) END AS score,
  round(CAST((l_partkey * 7919 + l_suppkey * 104729) % 1000 AS DOUBLE) / 1000.0, 3) AS score_b
FROM lineitem)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Reads per (sample, species): customer × part name."""
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    line = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = broadcast_if_small(load(spark, sf, "part").select("p_partkey", "p_name"))
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").alias("sample_id"), F.col("p_name").alias("species"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("reads"))
    )


SAMPLES = """samples AS (
SELECT o_custkey AS sample_id, p_name AS species, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS reads
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def known_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Known partner pairs (a < b): part names whose parts are adjacent in the catalogue and share a brand parity."""
    p = load(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    q = p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("n2"), F.col("p_size").alias("s2"))
    return (
        p.join(q, F.col("p_partkey") == F.col("k"))
        .where((F.col("p_name") != F.col("n2")) & (F.abs(F.col("p_size") - F.col("s2")) < 5))
        .select(F.least("p_name", "n2").alias("a"), F.greatest("p_name", "n2").alias("b"))
        .distinct()
    )


KNOWN_PAIRS = """known_pairs AS (
SELECT DISTINCT least(p.p_name, q.p_name) AS a, greatest(p.p_name, q.p_name) AS b
FROM part p JOIN part q ON p.p_partkey = q.p_partkey - 1
WHERE p.p_name <> q.p_name AND abs(p.p_size - q.p_size) < 5)"""
