"""Queries on larger tables: what is judged once per row, what is not dealt out by a key of few values."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from claimweave.functions import fixed_values as V
from claimweave.functions import rules as RU
from claimweave.functions import text as T
from tools.check import TABLES, rows_of

QUERIES = entry.queries()
SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["rule_1_same_organism", "rule_8_co_listed", "smp_20_pattern_negatives"])
def test_passage_is_made_once(spark, name):
    assert plan(QUERIES[name](spark, SF)).count("In vitro assays show that") <= 7  # once in each form of the passage that holds a text


def test_rules_share_the_forms_of_names(spark):
    assert plan(QUERIES["rule_0_first_reason"](spark, SF)).count("|, -1)") <= 3  # each name once, and the relation


def test_co_listed_by_brute_force(spark):
    rows = [
        ("We saw Aus bus, many ants and Cus dus.", "Aus bus", "Cus dus", True),
        ("Cus dus and Aus bus; then Aus bus infects Cus dus.", "Aus bus", "Cus dus", True),
        ("Aus bus infects Cus dus and others.", "Aus bus", "Cus dus", False),
        ("Aus bus eats Cus dus. Aus bus, Cus dus", "Aus bus", "Cus dus", True),
        ("Über Aus bus, Cus dus", "Aus bus", "Cus dus", True),
        ("Aus busy, Cus dus", "Aus bus", "Cus dus", False),
        (None, "Aus bus", "Cus dus", False),
    ]
    df = spark.createDataFrame(rows, "p string, a string, b string, want boolean")
    got = df.select("want", F.coalesce(RU.co_listed(F.col("p"), F.col("a"), F.col("b")), F.lit(False)).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


@pytest.mark.parametrize("name", ["grf_04_plausibility_gate", "smp_17_kind_flip_rates"])
def test_few_keys_deal_out_no_rows(spark, name):
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    key = "interaction_type" if name.startswith("grf") else "kind"
    assert not re.search(rf"(SortMerge|ShuffledHash)Join \[{key}", p)


def test_stored_decisions_join_digests(spark):
    assert "unhex(md5" in plan(QUERIES["join_25_stored_decisions"](spark, SF))


def test_shingle_profiles_make_no_rows_of_shingles(spark, tmp_path):
    rows = [(1, "a b c d e f"), (1, "a b c d e"), (2, None), (3, "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["str_34_shingles"](spark, str(tmp_path))
    assert "Generate" not in plan(df)
    assert {(r.doc_id, r.n_shingles) for r in df.collect()} == {(1, 3), (3, 1)}


def test_texts_of_tiers_are_not_joined(spark, monkeypatch):
    from claimweave.plans import composites

    seen = []
    monkeypatch.setattr(composites, "stage", lambda df, name: seen.append(plan(df)) or df)
    QUERIES["comp_04_harvest_tiers"](spark, SF)
    top = seen[0].split("Join")[0]
    assert len(seen) == 1 and "text" not in top


def test_each_batch_of_articles_has_a_file_per_core(spark):
    from claimweave.plans.streams import files_per_batch

    assert 4 * files_per_batch(spark, spark.range(10).repartition(90)) >= 90


def test_tree_models_have_few_partitions(spark):
    from claimweave.operators import learning as LN

    assert LN.for_trees(spark.range(1000).repartition(500)).rdd.getNumPartitions() == LN.TREE_PARTITIONS


def test_beginnings_are_needed_by_every_pattern():
    assert T.leading_literals(r"\b(?:not?|never)\b") == ("no", "never")
    assert T.leading_literals(r"\b(16S|rbcL)\b.{0,40}\bidentif\w+\b") == ("16s", "rbcl")
    assert T.leading_literals(r"\b(?:sample\s+size|n\s*=\s*\d+)\b") == ()
    assert T.leading_literals(r"\b(in)? vivo\b") == ()
    assert T.leading_literals(r"\b(field|wild)? type\b") == ()


def test_evidence_patterns_with_and_without_the_first_test(spark):
    texts = ["Field survey of X", "IN VITRO assays", "MICE were then infected", "16S rRNA identified it", "a petri dish", "nothing here", "Naturally infected", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for patterns in V.EVIDENCE_PATTERNS.values():
        rows = df.select(T.any_gated(F.lower("t"), F.col("t"), patterns, "(?i)").alias("a"), F.col("t").rlike(T.any_of(patterns, "(?i)")).alias("b")).collect()
        assert [bool(r.a) for r in rows] == [bool(r.b) for r in rows]


def rows_read_by_one_task(spark, group: str) -> int:
    """Most shuffled rows that one task of the group's jobs read."""
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    most = 0
    for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
        tasks = store.taskList(stage, 0, 1000)
        for k in range(tasks.size()):
            metrics = tasks.apply(k).taskMetrics()
            if metrics.isDefined():
                most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    return most


def test_hub_of_a_component_is_dealt_to_all_tasks(spark, monkeypatch):
    from claimweave.operators import graph as G

    monkeypatch.setattr(G, "HUB_ROWS", 500, raising=False)
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in held}
    n = 8000
    # a star whose leaves hang together in pairs, and a star apart from it
    edges = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.range(1, n, 2).selectExpr("id", "id + 1"))
    edges = edges.union(spark.range(2 * n + 1, 3 * n).select(F.col("id"), F.lit(2 * n).cast("long")))
    nodes = spark.range(0, 3 * n).where(f"id < {n} or id >= {2 * n}").withColumnRenamed("id", "node")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("hub", "components of stars")
        got = {r.node: r.component for r in G.components(nodes, edges).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: 0 if k < n else 2 * n for k in [*range(n), *range(2 * n, 3 * n)]}
    assert 0 < rows_read_by_one_task(spark, "hub") < n


@pytest.mark.parametrize("name, joins", [("tru_01_claim_trust", 2), ("tru_05_triple_trust", 0), ("tru_06_document_pairs", 2)])
def test_claims_are_shuffled_once_for_all_of_a_pair(spark, name, joins):
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert p.count("SortMergeJoin") <= joins and "SortMergeJoin [paper" not in p  # papers are few values, and null
    assert joins or p.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["tru_01_claim_trust", "tru_05_triple_trust", "tru_06_document_pairs"])
def test_trust_of_odd_tables(spark, tmp_path, name):
    """Orders listed twice, parts and line keys without a value: as the SQL has it."""
    con, sf = duckdb.connect(), str(tmp_path)
    odd = {"orders": "select * from t union all select * from t where o_orderkey % 9 = 0", "part": "select * replace (case when p_partkey % 5 <> 0 then p_name end as p_name) from t",
           "lineitem": "select * replace (case when l_linenumber <> 4 then l_orderkey end as l_orderkey) from t"}
    for t in TABLES:
        con.execute(f"copy (with t as (select * from '{SF}/{t}.parquet') {odd.get(t, 'select * from t')}) to '{sf}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    df = QUERIES[name](spark, sf)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_articles_are_read_once_for_references_and_sentences(spark):
    p = plan(QUERIES["src_13_citation_passages"](spark, SF))
    assert p.count("<ref-list>") == 1 and p.count("Join") == 1


def test_keys_of_citation_targets_have_a_measured_size(spark, monkeypatch):
    from claimweave.sources import readers as RD

    put, seen = RD.stage, []
    monkeypatch.setattr(RD, "stage", lambda df, name: seen.append(put(df, name)) or seen[-1])
    QUERIES["src_13_citation_passages"](spark, SF)
    assert len(seen) == 1 and seen[0].columns == ["rank", "key", "target_id"]


def test_citations_of_odd_articles(spark):
    from claimweave.functions.text import sentences_of
    from claimweave.sources import readers as RD

    entry_of = lambda rid, rest: f'<ref id="{rid}">{rest}</ref>'
    body = 'One thing was seen <xref rid="a">1</xref> and again <xref rid="a">1</xref> here. Another was not <xref rid="b">2</xref> seen, <xref rid="z">9</xref>.'
    twice = entry_of("a", "<mixed>See 10.5555/two.</mixed>") + entry_of("a", "<doi>10.5555/ONE</doi>") + entry_of("b", "<mixed>Plain &amp; no year</mixed>") + "<ref><doi>10.5555/one</doi></ref>"
    other = entry_of("b", "<mixed>Someone 1999. A title here. Journal.</mixed>")
    rows = [(k, f"<article><body><p>{body}</p></body><ref-list>{refs}</ref-list></article>") for k, refs in (("x", twice), ("x", twice), ("y", other), ("none", ""))] + [("null", None)]
    targets = [("t2", "10.5555/One", None, None, None), ("t1", "10.5555/one", "No title", "Someone", 1999), ("t3", "10.5555/two", "A title here", None, None), ("t4", None, None, "Plain", None)]
    df = RD.citing_passages(spark.createDataFrame(rows, "doc_id string, xml string"), spark.createDataFrame(targets, "target_id string, doi string, title string, surname string, year int"), sentences_of)
    got = sorted((r.doc_id, r.rid, r.target_id, r.matched_by, r.sent_id) for r in df.collect())
    assert got == [("x", "a", "t1", 1, 0)] * 4 + [("y", "b", "t3", 3, 1)]


@pytest.mark.parametrize("name", ["join_20_near_duplicates", "comp_06_contamination_report"])
def test_words_and_grams_of_texts_are_no_rows(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "Generate" not in p and "CoGroup" in p


def test_near_duplicates_in_small_parts(spark, monkeypatch):
    from claimweave.operators import leakage as L
    from tests.test_operators import cosine_by_hand

    monkeypatch.setattr(L, "PART_CHARS", 60)
    monkeypatch.setattr(L, "TABLE_CELLS", 50)
    monkeypatch.setattr(L, "BLOCK_TEXTS", 2)
    base = ["The wasp lays its eggs", "a beetle eats\tleaves and leaves", "ÉTÉ à la mer", "x", "zebra zebra zebra"]
    test = [*base, "nothing of it"]
    train = [b + extra for b in base for extra in ("", " again", "\n\nand once more in spring")] + ["", " \r\n "]
    sims = cosine_by_hand(test, train)
    t = spark.createDataFrame(list(enumerate(test)) + [(99, None)], "tid int, text string")
    d = spark.createDataFrame(list(enumerate(train)), "did int, text string")
    got = {r.tid: (r.did, r.similarity) for r in L.near_duplicates(t, d.unionByName(d.where("did > 90")), "tid", "did", "text", 0.4).collect()}
    assert set(got) >= {0, 1, 2, 3, 4} and all(got[k][0] == 3 * k for k in range(5))
    # the row without a text counts among all rows, so weights differ a little
    assert all(v[1] == pytest.approx(max(sims[k]), abs=0.02) for k, v in got.items())
