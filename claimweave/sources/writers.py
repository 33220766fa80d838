"""Sinks: manifests, resumable output, accept/reject split, edge exports, content gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.hashing import hash_bucket
from claimweave.operators.corpus import keep_last


def row_digest(columns: list[str]) -> Column:
    """32-bit digest of a row; nulls count as empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return hash_bucket(F.md5(F.concat_ws("\u0001", *cells)), 8)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-insensitive content hash: rows and the sum of row digests, in one aggregation."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(row_digest(columns)).alias("content_sum"))


def manifest(df: DataFrame, label: str, signal: str, columns: list[str], seed: str) -> DataFrame:
    """Row count, positive rate, signal profile, content hash and seed of a dataset, as one row."""
    pos, neg = F.col(label) == 1, F.col(label) == 0
    return df.agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg(label), 4).alias("pos_rate"),
        F.round(F.avg(F.when(pos, F.col(signal).cast("int"))), 4).alias("p_signal_pos"),
        F.round(F.avg(F.when(neg, F.col(signal).cast("int"))), 4).alias("p_signal_neg"),
        F.sum(row_digest(columns)).alias("content_sum"),
        F.lit(seed).alias("seed"),
    )


def write_with_manifest(df: DataFrame, info: DataFrame, path: str) -> None:
    """Dataset as parquet, manifest as a JSON sidecar."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    info.coalesce(1).write.json(f"{path}/manifest")


def write_remaining(work: DataFrame, path: str, key: list[str], spark: SparkSession) -> int:
    """Append the rows whose key is not yet in the sink; returns the number of rows appended.

    The written keys are read back from storage, so a job that lost its executors resumes where it stopped.
    """
    try:
        done = spark.read.parquet(path).select(*key).distinct()
        before = spark.read.parquet(path).count()  # from the files' footers
        todo = work.join(done, key, "left_anti")
    except Exception as e:  # the sink does not exist on the first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo, before = work, 0
    todo.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def read_answers(spark: SparkSession, path: str, key: list[str], order: list[str]) -> DataFrame:
    """Last answer per key of a resumable sink."""
    return keep_last(spark.read.parquet(path), key, order)


def split_by_reason(df: DataFrame, reason: Column, accepted: str, rejected: str) -> DataFrame:
    """Write accepted and rejected rows from one pass (partitioned by outcome) and return them tagged."""
    tagged = df.withColumn("rejection_reason", reason).withColumn("accepted", F.col("rejection_reason").isNull())
    tagged.where("accepted").drop("accepted", "rejection_reason").write.parquet(accepted)
    tagged.where("not accepted").drop("accepted").write.parquet(rejected)
    return tagged


def edges_jsonld(edges: DataFrame) -> DataFrame:
    """One JSON-LD document per edge, and one context row naming every relation id in use."""
    doc = F.to_json(
        F.struct(
            F.lit("Association").alias("@type"), "subject", "predicate", "object", "directed", "ro_id", "confidence", "n_sources"
        )
    )
    docs = edges.select(F.lit("edge").alias("kind"), doc.alias("document"))
    ids = edges.where(F.col("ro_id").isNotNull()).agg(F.array_sort(F.collect_set("ro_id")).alias("ids"))
    context = ids.select(F.lit("context").alias("kind"), F.to_json(F.struct(F.struct(F.col("ids").alias("relations")).alias("@context"))).alias("document"))
    return docs.unionByName(context)


def export_approved(decisions: DataFrame, min_confidence: float, author: str | None = None) -> DataFrame:
    """Approved rows of at least the given confidence, optionally of one author, most confident first."""
    out = decisions.where((F.col("status") == "approved") & (F.col("confidence") >= min_confidence))
    if author is not None:
        out = out.where(F.col("author") == author)
    return out.orderBy(F.desc("confidence"), "item_id")


def require_fingerprint(df: DataFrame, columns: list[str], expected_rows: int, expected_sum: int) -> DataFrame:
    """The input, or an error raised inside the job when its content moved."""
    got = fingerprint(df, columns)
    ok = got.select(
        F.when(
            (F.col("n_rows") == expected_rows) & (F.col("content_sum") == expected_sum), F.lit(True)
        ).otherwise(F.raise_error(F.lit("content hash of the benchmark moved")).cast("boolean"))
    )
    return df.where(ok.scalar())
