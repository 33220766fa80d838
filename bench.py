"""Time the headline queries on one scale factor; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from claimweave.plans.catalog import all_queries  # noqa: E402
from claimweave.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_sentence_profile",
    "flt_07_recall_prefilter",
    "str_22_lexicon_signal",
    "str_33_species_mentions",
    "rule_0_first_reason",
    "join_12_dictionary_hits",
    "join_15_typed_pairs",
    "join_17_name_cascade",
    "join_19_shingle_jaccard",
    "agg_04_claim_edges",
    "agg_08_contradiction_risk",
    "agg_22_auc_ap",
    "agg_27_bootstrap_interval",
    "agg_39_quality_gates",
    "win_03_rerank_samples",
    "win_13_best_threshold",
    "set_02_incremental_union",
    "smp_05_balanced_classes",
    "grf_03_relation_inference",
    "grf_07_components",
    "grf_10_partner_support",
    "tru_01_claim_trust",
    "tru_03_document_trust",
    "comp_01_corpus_build",
    "stm_01_article_stream",
]
#: Of the training-data operators, where that part is installed.
TRAINING_DATA = ["op1_substrings", "op2_host_quality", "op5_line_chunks", "op9_threshold_mix", "op11_pivots", "op12_lockstep", "op13_stripes"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    queries = {name: q.run for name, q in all_queries().items()}
    try:
        from claimweave.llm.queries import QUERIES

        queries |= QUERIES
    except ImportError:
        pass
    times: dict[str, float] = {}
    for name in [*HEADLINE, *TRAINING_DATA]:
        if name not in queries:
            continue
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
