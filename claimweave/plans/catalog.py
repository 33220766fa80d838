"""All registered queries."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from claimweave.plans.registry import QUERIES, Query

MODULES = ["flagship", "scalar", "sources", "filters", "joins", "aggregates", "evaluation", "windows", "sampling", "graph", "trust", "composites", "streams"]


def all_queries() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"claimweave.plans.{m}")
    return QUERIES


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return all_queries()["flagship_sentence_profile"].run(spark, sf)
