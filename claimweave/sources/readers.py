"""Readers: interaction tables, articles, annotations, ontologies, assignments, abundances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.functions.text import bind, nullify
from claimweave.session import stage

INTERACTION_COLUMNS = [
    "sourceTaxonName", "sourceTaxonKingdomName", "targetTaxonName", "targetTaxonKingdomName",
    "interactionTypeName", "referenceDoi", "referenceCitation", "referenceUrl",
]
CLAIM_COLUMNS = {
    "text": "string", "label": "int", "interaction_type": "string",
    "source_species": "string", "target_species": "string", "source": "string",
}
CLAIM_ALIASES = {"sentence": "text", "passage": "text", "hard_label": "label"}


def read_interactions(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Tab-separated interactions, all strings; the wanted columns that exist, nothing else is parsed.

    A gzip file cannot be split: land it once as parquet (:func:`land_parquet`) before heavy use.
    """
    wanted = columns or INTERACTION_COLUMNS
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    return raw.select(*[c for c in wanted if c in raw.columns])


def land_parquet(df: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Spread an unsplittable scan over the cluster once and keep it as parquet."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    df.repartition(n).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read_tolerant(spark: SparkSession, path: str, columns: list[str], max_field: int = 1_000_000) -> DataFrame:
    """Tab-separated lines split by hand: ``accepted`` tells rows of the right shape, rejects keep their line."""
    lines = spark.read.text(path)
    parts = F.split("value", "\t", -1)
    ok = (F.size("parts") == len(columns)) & ~F.exists("parts", lambda p: F.length(p) > max_field)
    rows = lines.withColumn("parts", parts).withColumn("accepted", ok)
    fields = [F.when(F.col("accepted"), F.get("parts", F.lit(i))).alias(c) for i, c in enumerate(columns)]
    return rows.select(*fields, "accepted", F.when(~F.col("accepted"), F.col("value")).alias("rejected_line"))


def normalise_columns(df: DataFrame, source_tag: str | None = None) -> DataFrame:
    """One claim schema: aliases renamed, missing columns added, label cast, source tagged."""
    df = df.withColumnsRenamed({a: b for a, b in CLAIM_ALIASES.items() if a in df.columns and b not in df.columns})
    out = []
    for name, kind in CLAIM_COLUMNS.items():
        if name == "label":
            value = F.coalesce(F.col("label").try_cast("int"), F.lit(0)) if "label" in df.columns else F.lit(0)
        elif name == "source" and source_tag is not None:
            value = F.lit(source_tag)
        elif name in df.columns:
            value = nullify(F.col(name).cast(kind))
        else:
            value = F.lit(None).cast(kind)
        out.append(value.alias(name))
    return df.select(*out)


def read_dialect(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """CSV with its own separator and encoding; a byte-order mark on the first header is removed."""
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, escape='"')
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip("﻿"))


def read_text_folder(spark: SparkSession, path: str, id_pattern: str = r"([^/]+)\.txt$") -> DataFrame:
    """One row per text file: id taken from its path, whole content."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).alias("article_id"), F.col("value").alias("text"))


def read_articles_csv(spark: SparkSession, path: str, id_col: str, text_col: str) -> DataFrame:
    """Articles from a CSV whose cells may hold line breaks."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.select(F.col(id_col).alias("article_id"), F.col(text_col).alias("text")).where(nullify("text").isNotNull())


def first_forms(df: DataFrame, array_columns: list[str]) -> DataFrame:
    """First element of each array column; rows with an empty slot are dropped."""
    firsts = {c: F.try_element_at(c, F.lit(1)) for c in array_columns}
    out = df.withColumns(firsts)
    keep = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.trim(c) != "") for c in array_columns])
    return out.where(keep)


def scan_passages(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Nested passages with a relation between the mentions and no empty slot.

    Only the nested fields named here are read; the predicates reach the scan where the format allows.
    """
    df = spark.read.schema(schema).json(path)
    return df.where(
        (F.col("score.int_middle") == 1)
        & (F.size("species1_form") > 0)
        & (F.size("species2_form") > 0)
        & (F.size("interaction_form") > 0)
    )


ONTOLOGY_SCHEMA = (
    "concepts array<struct<id:string,parent:string,rank:string,preferred_term:struct<term:string,relevance:boolean>,"
    "synonyms:array<struct<term:string,relevance:boolean>>>>"
)


def explode_ontology(dump: DataFrame, relevant_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nested dump → (concepts, names); names hold preferred terms and synonyms with a 3-letter block key."""
    c = dump.select(F.explode("concepts").alias("c")).select("c.*")
    concepts = c.select("id", F.col("preferred_term.term").alias("pref"), "rank", "parent")
    own = c.select("id", F.struct(F.col("preferred_term.*"), F.lit(0).alias("is_syn")).alias("t"))
    syn = c.select("id", F.explode("synonyms").alias("s")).select("id", F.struct("s.*", F.lit(1).alias("is_syn")).alias("t"))
    names = own.unionByName(syn).select("id", "t.*")
    if relevant_only:
        names = names.where(F.coalesce("relevance", F.lit(True)))
    names = names.select(F.lower(F.trim("term")).alias("name_norm"), "id", "is_syn").distinct()
    return concepts, names.withColumn("prefix3", F.substring("name_norm", 1, 3))


ANNOTATION_SCHEMA = (
    "sentence_id string, text string, entities array<struct<id:int,text:string,type:string,start:int,end:int>>, "
    "relations array<struct<head:int,relation:string,tail:int>>, annotator string"
)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATION_SCHEMA).json(path)


def annotation_relations(annotations: DataFrame) -> DataFrame:
    """One row per annotated relation with the texts of its two entities."""
    ent = lambda ref: F.filter("entities", lambda e: e["id"] == ref)[0]
    r = annotations.select("sentence_id", "entities", F.explode("relations").alias("r"))
    return r.select(
        "sentence_id", ent(F.col("r.head"))["text"].alias("head"), F.col("r.relation").alias("relation"),
        ent(F.col("r.tail"))["text"].alias("tail"),
    )


def read_annotation_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blank-line separated blocks (``id|t|``, ``id|a|``, tabbed mentions and relations) → three tables."""
    blocks = spark.read.text(path, lineSep="\n\n").where(F.trim("value") != "")
    lines = blocks.select(F.split(F.trim("value"), "\n").alias("lines"))
    doc_id = F.regexp_extract(F.get("lines", F.lit(0)), r"^(\d+)\|t\|", 1)
    text_of = lambda tag: F.regexp_replace(
        F.get(F.filter("lines", lambda x: x.rlike(rf"^\d+\|{tag}\|")), F.lit(0)), rf"^\d+\|{tag}\|", ""
    )
    docs = lines.select(doc_id.alias("doc_id"), text_of("t").alias("title"), text_of("a").alias("abstract"))
    tabbed = lines.select(
        F.explode(F.transform(F.filter("lines", lambda x: x.contains("\t")), lambda x: F.split(x, "\t"))).alias("f")
    )
    field = lambda i: F.get("f", F.lit(i))
    mentions = tabbed.where(F.size("f") >= 6).select(
        field(0).alias("doc_id"), field(1).cast("int").alias("start"), field(2).cast("int").alias("end"),
        field(3).alias("mention"), field(4).alias("type"), field(5).alias("concept"),
    )
    relations = tabbed.where(F.size("f") == 4).select(
        field(0).alias("doc_id"), field(1).alias("relation"), field(2).alias("concept_1"), field(3).alias("concept_2")
    )
    return docs, mentions, relations


def html_to_text(html: Column | str) -> Column:
    """Tags stripped and whitespace collapsed; scripts, styles and navigation dropped with their content."""
    c = F.col(html) if isinstance(html, str) else html
    for tag in ("script", "style", "nav"):
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"[ \t\r\n\f]+", " "))


#: An entry of elements that hold text only, without references to characters, whose parts can be cut out by a pattern.
FLAT_ENTRY = r'^<ref( [a-z]+="[^"<&\t\r\n]*")*>(<([a-z]+)>[^<&\r]*</\3>)*</ref>$'
#: Longer entries are parsed; a pattern recurses on every element.
FLAT_LENGTH = 4000


def _entry_part(name: str, entry: Column | None = None, flat: Column | None = None) -> Column:
    """``/ref/@id`` or the first ``/ref/name`` of ``entry``, null when missing or empty.

    Building a document costs far more than a pattern, so only entries that are not ``flat`` are parsed.
    """
    entry, flat = F.col("entry") if entry is None else entry, F.col("flat") if flat is None else flat
    cut = rf' {name[1:]}="([^"]*)"' if name.startswith("@") else f"<{name}>([^<]*)</{name}>"
    head = F.substring_index(entry, ">", 1) if name.startswith("@") else entry
    parsed = F.xpath_string(entry, F.lit(f"/ref/{name}"))
    return F.nullif(F.when(flat, F.regexp_extract(head, cut, 1)).otherwise(parsed), F.lit(""))


def _ranked(keys: list[Column]) -> Column:
    """Keys with their rank, from 1; those that are null or empty are none."""
    return F.filter(F.array(*[F.struct(F.lit(rank).alias("rank"), k.alias("key")) for rank, k in enumerate(keys, 1)]), lambda k: k["key"] != "")


def _reference(entry: Column) -> Column:
    """(rid, keys) of an entry: DOI, DOI in its text, title, surname and year."""

    def keys(r: Column) -> Column:
        text_doi = F.regexp_replace(F.regexp_extract(r["text"], r"10\.\d{4,}/\S+", 0), r"[.,;)]+$", "")
        title, year = F.regexp_extract(r["text"], r"\. ([^.]+)\. ", 1), F.regexp_extract(r["text"], r"\b((?:19|20)\d\d)\b", 1)
        author_year = F.when(year != "", F.concat_ws("|", F.lower(F.regexp_extract(r["text"], r"^(\p{L}+)", 1)), year))
        return F.struct(r["rid"].alias("rid"), _ranked([r["doi"], F.lower(text_doi), F.lower(title), author_year]).alias("keys"))

    def parts(e: Column) -> Column:
        part = lambda name: _entry_part(name, e["entry"], e["flat"])
        return bind(F.struct(part("@id").alias("rid"), F.lower(part("doi")).alias("doi"), part("mixed").alias("text")), keys)

    return bind(F.struct(entry.alias("entry"), ((F.length(entry) < FLAT_LENGTH) & entry.rlike(FLAT_ENTRY)).alias("flat")), parts)


def citing_passages(articles: DataFrame, targets: DataFrame, sentences) -> DataFrame:
    """Sentences that cite a target reference.

    ``articles``: doc_id, xml. A reference list entry is matched on DOI, then DOI in its text, then title,
    then surname and year; in the body each ``<xref rid=…>`` becomes the marker ``⟦rid⟧`` and the sentence
    holding the marker is returned. ``targets``: target_id, doi, title, surname, year.

    Sentences and the references they cite meet inside the article, so only keys of cited references are shuffled, with
    their sentence, and only those that name a target again.
    """
    # entry by entry, so that one without a part does not take it from the next
    entries = F.regexp_extract_all("xml", F.lit(r"(?s)<ref(?:\s[^>]*)?>.*?</ref>"), F.lit(0))
    body = F.regexp_extract("xml", r"(?s)<body>(.*)</body>", 1)
    marked = F.regexp_replace(body, r"<xref rid=\"([^\"]+)\"[^>]*>[^<]*</xref>", "⟦$1⟧")
    plain = F.trim(F.regexp_replace(F.regexp_replace(marked, "<[^>]+>", " "), r"\s+", " "))
    read = articles.select("doc_id", F.transform(entries, _reference).alias("refs"), plain.alias("text"))
    cited = sentences(read, "text", ["doc_id", "refs"]).select(
        "doc_id", "sent_id", "sentence", "refs", F.explode(F.regexp_extract_all("sentence", F.lit("⟦([^⟧]+)⟧"), F.lit(1))).alias("rid")
    )
    own = F.flatten(F.transform(F.filter("refs", lambda r: r["rid"] == F.col("rid")), lambda r: r["keys"]))
    asked = cited.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "rid", "sent_id", "sentence", own.alias("own"))
    asked = asked.select("_row", "doc_id", "rid", "sent_id", "sentence", F.inline("own"))
    names = _ranked([F.lower("doi"), F.lower("doi"), F.lower("title"), F.concat_ws("|", F.lower("surname"), F.col("year").cast("string"))])
    index = targets.select("target_id", F.inline(names)).groupBy("rank", "key").agg(F.min("target_id").alias("target_id"))
    # written, so that its size is known: guessed from the columns read, a large table would be broadcast
    best = asked.join(stage(index, "citation-keys"), ["rank", "key"]).groupBy("_row", "doc_id", "rid", "sent_id", "sentence").agg(F.min(F.struct("rank", "target_id")).alias("b"))
    return best.select("doc_id", "rid", "sent_id", "sentence", F.col("b.target_id").alias("target_id"), F.col("b.rank").alias("matched_by"))


def assignments(df: DataFrame, layout: str) -> DataFrame:
    """Taxonomic assignments of three layouts → (asv_id, species)."""
    if layout == "bold":
        out = df.where(F.lower(F.trim("Status")).isin("ok", "match")).select(F.col("ASV_ID").alias("asv_id"), F.col("Species").alias("species"))
    elif layout == "silva":
        best = F.coalesce(nullify("Species"), nullify("Genus"), nullify("Family"))
        out = df.select(F.col("ASV_ID").alias("asv_id"), best.alias("species"))
    elif layout == "blast":
        first = F.nullif(F.regexp_extract("species_blast", r"([A-Z][a-z]+ [a-z]+)", 1), F.lit(""))
        out = df.select(F.col("ASV_ID").alias("asv_id"), first.alias("species"))
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return out.where(nullify("species").isNotNull())


def abundance_long(wide: DataFrame, id_col: str, assigned: DataFrame) -> DataFrame:
    """Wide (one column per sample) → (sample_id, species, reads): assigned rows only, same names summed."""
    samples = [c for c in wide.columns if c != id_col]
    long = wide.unpivot(id_col, samples, "sample_id", "reads").where(F.col("reads") > 0)
    return (
        long.join(assigned, F.col(id_col) == F.col("asv_id"))
        .groupBy("sample_id", "species")
        .agg(F.sum(F.col("reads").cast("bigint")).alias("reads"))
    )


def flatten_metrics(df: DataFrame, id_cols: list[str], nested: str) -> DataFrame:
    """A struct of metrics per row → (ids, metric, value)."""
    fields = df.schema[nested].dataType.fieldNames()
    pairs = F.array(*[F.struct(F.lit(f).alias("metric"), F.col(f"{nested}.{f}").cast("double").alias("value")) for f in fields])
    return df.select(*id_cols, F.inline(pairs)).where(F.col("value").isNotNull())
