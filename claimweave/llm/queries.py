"""The operators of this subpackage on the tables of TESTDATA.md: one query each, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import alignment, html_text, leaks, lines, mixing, near_dups, phrases, quality, sharding, substrings, urls, vectors, warc
from claimweave.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_substrings", substrings.SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    d = substrings.without_repeats(read(spark, sf, "documents"), ["doc_id"])
    return d.select(F.col("_c_doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query("op2_host_quality", quality.SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    j = quality.judged(read(spark, sf, "documents"), carry=["doc_id"])
    return j.select("doc_id", *quality.MEASURES, "base_failed", "kept")


@query("op3_bag_minhash")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    c = near_dups.with_class(read(spark, sf, "documents").select("doc_id", "text"))
    return c.select(F.col("_c_doc_id").alias("doc_id"), "class_id", "class_size")


@query("op4_block_labeller", html_text.SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages")
    t = html_text.extracted(pages, html_text.fit_labeller(pages), ["page_id", "url"])
    return t.select(F.col("_c_page_id").alias("page_id"), F.col("_c_url").alias("url"), "text", "n_chars")


@query("op5_line_chunks", lines.SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    kept = lines.without_repeats(read(spark, sf, "documents").select("doc_id", "text"))
    return kept.select(F.col("_c_doc_id").alias("doc_id"), "n_lines", "n_removed_lines", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query("op6_matrix_shuffle")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    narrow = read(spark, sf, "documents").select("doc_id", sharding.row_size("text").alias("size"), sharding.row_crc("text").alias("text_crc32"))
    s = sharding.shuffled(narrow)
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_url_trees")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").select("page_id", "url")
    j = urls.judged(pages, urls.fit(urls.seed_labelled(pages)))
    return j.select(F.col("_c_page_id").alias("page_id"), "host", "path", "rule", "verdict")


@query("op8_zip_archives", warc.SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    records = warc.read_back(warc.written(read(spark, sf, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_threshold_mix", mixing.SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    m = mixing.mixed(read(spark, sf, "documents"), ["doc_id"])
    return m.select(F.col("_c_doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op10_leaks")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    found = leaks.leaks(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 4).alias("score"), "start", "end")


@query("op11_pivots", vectors.SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors.linked(read(spark, sf, "embeddings"), ["vec_id"])
    return v.select(F.col("_c_vec_id").alias("vec_id"), "n_links", "component_id", "kept")


@query("op12_lockstep")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.counted(read(spark, sf, "documents").select("doc_id", "text"))


@query("op13_stripes", phrases.SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(read(spark, sf, "documents").select("text", "lang"))
