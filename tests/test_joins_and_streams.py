"""Lineage of any depth, longest match in one pass, tokens of any script, keyed state in streams."""

import random
import time
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimweave.operators import matching as MT
from claimweave.operators import ranking as RK
from claimweave.operators import taxonomy as TX
from claimweave.streaming import jobs as SJ


def by_walking(parent):
    out = set()
    for x in parent:
        seen, at, depth = set(), x, 0
        while at is not None and at not in seen:
            out.add((x, at, depth))
            seen.add(at)
            at, depth = parent.get(at), depth + 1
    return out


def lineage_of(spark, parent):
    rows = TX.lineage(spark.createDataFrame(list(parent.items()), "id string, parent string")).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_lineage_of_a_long_chain(spark):
    chain = {f"n{i}": f"n{i + 1}" if i < 79 else None for i in range(80)}
    got = lineage_of(spark, chain)
    assert len(got) == 3240 and got == by_walking(chain)


def test_lineage_of_trees_and_cycles(spark):
    rnd = random.Random(2)
    tree = {str(i): str(rnd.randrange(i)) if i else None for i in range(60)}
    tree |= {"a": "b", "b": "c", "c": "a", "d": "a", "e": "e", "f": "d", "g": "unknown"}
    # a parent without a row of its own is an ancestor, and the end
    assert lineage_of(spark, tree) == by_walking(tree)


def test_longest_match_of_many_hits_in_one_text(spark):
    rnd = random.Random(1)
    spans = sorted({(s, n, f"g{s}.{n}") for s in range(9000) for n in (1, 2, 3) if rnd.random() < 0.75})
    assert len(spans) > 20_000
    frame = pd.DataFrame([("d", *s) for s in spans], columns=["doc_id", "start", "len", "gram"])
    t = time.perf_counter()
    got = pd.concat(MT._fold()(iter([frame[k : k + 500] for k in range(0, len(frame), 500)])))
    assert time.perf_counter() - t < 1
    kept = []
    for s in spans:
        if not kept or s[0] >= kept[-1][0] + kept[-1][1]:
            kept.append(s)
        elif s[1] > kept[-1][1]:
            kept[-1] = s
    assert [tuple(r) for r in got.itertuples(index=False)] == [("d", *k) for k in kept]


def test_names_with_letters_of_any_script(spark):
    docs = spark.createDataFrame([(1, "Der Großer-Hecht und die äußere Straße; é éx Хищник ест рыбу")], "doc_id int, text string")
    names = spark.createDataFrame([("großer hecht",), ("straße",), ("stra",), ("хищник ест",), ("ußere",), ("éx",)], "name string")
    got = {r.gram for r in MT.dictionary_hits(docs, ["doc_id"], "text", names, 2).collect()}
    assert got == {"großer hecht", "straße", "хищник ест", "éx"}


def batches(spark, path, first, last):
    """Lands one file per call: so many, one batch each."""
    for k in range(first, last):
        spark.createDataFrame([(f"k{i % 7}", k, datetime(2024, 1, 1, k)) for i in range(k + 3)], "key string, batch int, at timestamp").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("event_time", [None, "at"])
def test_unseen_keys_by_state(spark, tmp_path, event_time):
    path, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    batches(spark, path, 0, 3)
    schema = spark.read.parquet(path).schema

    def run():
        with SJ.state_on_disk(spark):
            SJ.run_append(SJ.unseen(SJ.file_stream(spark, path, schema), "key", event_time), sink, checkpoint)
        return sorted(r.key for r in spark.read.parquet(sink).collect())

    assert run() == [f"k{i}" for i in range(5)]
    assert run() == [f"k{i}" for i in range(5)]  # a restart adds nothing
    batches(spark, path, 3, 6)
    assert run() == [f"k{i}" for i in range(7)]
    assert spark.conf.get(SJ.STORE, None) != SJ.ROCKS


def test_ranks_over_more_buckets(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 2).alias("g"))
    a = {r.id: r.rk for r in RK.hash_rank(df, ["g"], ["id"], "s").collect()}
    b = {r.id: r.rk for r in RK.hash_rank(df, ["g"], ["id"], "s", n_hex=4).collect()}
    assert a == b and sorted(v for k, v in a.items() if k % 2) == list(range(1, 1501))
    assert [RK.digits_for(n) for n in (0, 10**6, 256 * 10**6, 256 * 10**6 + 1, 10**12)] == [2, 2, 2, 3, 5]
