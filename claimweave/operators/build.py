"""Corpus building from a list of source specifications."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import evidence as E
from claimweave.functions.text import complete_sentence, false_negative
from claimweave.operators.corpus import keep_first
from claimweave.operators.ranking import hash_rank
from claimweave.operators.sampling import cap_per_group
from claimweave.session import stage


@dataclass(frozen=True)
class SourceSpec:
    """What to take from one source, in order of priority."""

    name: str
    signal_only: bool = False
    cap_per_type: int | None = None
    negative_budget: int | None = None
    complete_only: bool = False
    drop_false_negatives: bool = False


def take_source(df: DataFrame, spec: SourceSpec, seed: str) -> DataFrame:
    """Columns: claim_id, text, label, interaction_type."""
    if spec.complete_only:
        df = df.where(complete_sentence("text"))
    if spec.drop_false_negatives:
        df = df.where(~((F.col("label") == 0) & false_negative("text")))
    pos, neg = df.where("label = 1"), df.where("label = 0")
    if spec.signal_only:
        pos = E.with_lexicon(pos, "text").where("lex_strength > 0").select(*df.columns)
    if spec.cap_per_type is not None:
        pos = cap_per_group(pos, ["interaction_type"], ["claim_id"], spec.cap_per_type, seed)
    if spec.negative_budget is not None:
        neg = cap_per_group(neg, ["label"], ["claim_id"], spec.negative_budget, seed)
    return pos.unionByName(neg).withColumn("source", F.lit(spec.name))


def build_corpus(sources: list[tuple[DataFrame, SourceSpec]], seed: str) -> DataFrame:
    """All sources at once: one union with a rank, one deduplication against all earlier sources, one seeded order."""
    union = None
    for rank, (df, spec) in enumerate(sources):
        part = take_source(df, spec, seed).withColumn("source_rank", F.lit(rank))
        union = part if union is None else union.unionByName(part)
    keyed = union.withColumn("k", F.md5(F.trim(F.lower("text")).cast("binary")))
    once = stage(keep_first(keyed, ["k"], ["source_rank", "claim_id"]).drop("k"), "corpus").withColumn("all", F.lit(0))
    return hash_rank(once, ["all"], ["claim_id"], seed, "position").drop("all", "source_rank")
