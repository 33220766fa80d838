"""Column helpers and staging shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.session import stage_path

WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A table of at most this many narrow rows may be broadcast.
SMALL_ROWS = 50_000


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


@contextmanager
def shuffles_removed(spark: SparkSession):
    """While open, an execution's shuffle files go when it ends: what follows reads the written result."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Lists that take the folders written while they are open.
_open: list[list[str]] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back; the shuffle files that made it are removed."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    for paths in _open:
        paths.append(path)
    return spark.read.parquet(path)


@contextmanager
def made() -> Iterator[list[str]]:
    """While open, the folders that ``stage`` writes are listed, in order."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open.pop(next(k for k, p in enumerate(_open) if p is paths))


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Remove written stages that nothing reads any more."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()``; of the stages written meanwhile, those that its result does not read are removed."""
    with made() as paths:
        out = build()
    files = out.inputFiles()
    removed(spark, [p for p in paths if not any(p.rpartition("/")[2] in f for f in files)])
    return out


def small(staged: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint for a written table of few rows, by count; a larger one is joined by shuffle."""
    return F.broadcast(staged) if staged.limit(rows + 1).count() <= rows else staged


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas use it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def text_digest(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text.cast("binary")))


def doc_ref(doc_id: Column, text: Column) -> Column:
    """16 bytes that sort by doc_id (nulls last), then by 56 bits of the text's digest.

    Rows equal in id and text share it and count as one document.
    """
    offset = doc_id.cast("bigint").bitwiseXOR(F.lit(-(2**63)))
    ordered = F.when(doc_id.isNull(), F.lit("f" * 17)).otherwise(F.concat(F.lit("0"), F.lpad(F.hex(offset), 16, "0")))
    return F.unhex(F.lower(F.concat(F.lit("0"), ordered, F.substring(F.md5(text.cast("binary")), 1, 14))))


def numbered(df: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """``df`` written in ranges of ``order``, with ``rk`` (from 1) and running ``cum_*`` of ``sums`` in that order.

    Ranges are ranked apart and shifted by the totals of the earlier ones, of which there are as many as partitions.
    """
    cut = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    totals = cut.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inside = Window.partitionBy("_range").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = cut.withColumns({"rk": F.row_number().over(inside), **{f"cum_{s}": F.sum(s).over(so_far) for s in sums}}).join(shift, "_range")
    return ranked.withColumns({"rk": F.col("rk") + F.col("_n0"), **{f"cum_{s}": F.col(f"cum_{s}") + F.col(f"_o_{s}") for s in sums}}).drop(
        "_range", "_n0", *[f"_o_{s}" for s in sums]
    )
