"""The uniform shuffle: whole rows, clashing names, exact sizes and uniform places."""

import collections
import zlib

from pyspark.sql import functions as F

from claimweave.llm import common, sharding
from claimweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_all_columns_come_back_in_order(spark):
    names = ["shard", "doc_id", "_g", "_n", "_part", "_row", "_local", "_bounds", "_shift", "slot", "text"]
    rows = [tuple(f"{c}{i}" for c in names) for i in range(101)]
    out = sharding.shuffled(spark.createDataFrame(rows, names).repartition(7), 4)
    kept = [c for c in names if c not in ("shard", "slot")]
    assert out.columns == [*kept, "shard", "slot"]
    got = out.collect()
    assert sorted(tuple(r[c] for c in kept) for r in got) == sorted(tuple(f"{c}{i}" for c in kept) for i in range(101))
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values())) == [25, 25, 25, 26] and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_places_are_uniform(spark):
    d = spark.range(40, numPartitions=3)
    met = collections.Counter()
    for seed in range(16):
        met.update((r.id, r.shard) for r in sharding.shuffled(d, 4, seed).collect())
    # 16 draws a row, 4 a shard expected; 120 free cells: the 1-in-100000 point of chi-square is 192
    assert sum((met[i, k] - 4) ** 2 / 4 for i in range(40) for k in range(4)) < 192


def test_query_rows(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op6_matrix_shuffle"](spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        t = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)


def test_scratch_is_removed(spark):
    with common.made() as paths:
        out = common.tidy(spark, lambda: common.stage(common.stage(spark.range(5), "a").select(F.col("id") + 1), "b"))
    assert out.count() == 5 and len(paths) == 2
    there = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    assert [p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in there] == [False, True]
