"""Polarity of relations that are written as alternatives, decided by forms and by a vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as V


def decided(relations: DataFrame, surfaces: DataFrame) -> DataFrame:
    """``relations`` (relation, concept_polarity or null) → relation, polarity (1 agent first, -1 patient first, 0 symmetric, null unknown), decided_by.

    ``surfaces`` (form, polarity) is a vocabulary of any size, joined. A relation is ``a|b|c``, its alternatives in order
    of preference. First an active form among them decides, then the concept, then the first alternative that the
    vocabulary knows as itself, without its plural s, or with one, or that has a telling form. A vocabulary entry of 0
    counts only after the forms.
    """
    r = relations.select("relation", "concept_polarity").distinct()
    parts = r.select("relation", F.posexplode(F.split(F.lower("relation"), r"\|")).alias("at", "part"))
    parts = parts.select("relation", "at", F.trim(F.regexp_replace("part", r"\s+", " ")).alias("k")).where("k <> ''")
    k = F.col("k")
    forms = F.array(k, F.regexp_replace(k, "s+$", ""), F.concat(k, F.lit("s")))
    looked = parts.select("relation", "at", "k", F.posexplode(forms).alias("variant", "form")).join(surfaces.select("form", F.col("polarity").alias("p")), "form", "left")
    told = F.min(F.when(F.col("p") != 0, F.struct("variant", "p")))["p"]
    per = looked.groupBy("relation", "at", "k").agg(told.alias("told"), F.max((F.col("variant") == 0) & (F.col("p") == 0)).alias("zero"))
    rules = [
        (F.col("told").isNotNull(), F.col("told"), "surface"), (k.rlike(V.SYMMETRIC_FORM), F.lit(0), "symmetric_form"), (k.rlike(V.PATIENT_FORM), F.lit(-1), "patient_form"),
        (k.rlike(V.AGENT_NOUN), F.lit(1), "agent_noun"), (k.rlike(V.AGENT_VERB), F.lit(1), "agent_verb"), (F.coalesce("zero", F.lit(False)), F.lit(0), "surface_symmetric"),
    ]
    found = F.lit(None).cast("struct<p:int,by:string>")
    for test, value, name in reversed(rules):
        found = F.when(test, F.struct(value.cast("int").alias("p"), F.lit(name).alias("by"))).otherwise(found)
    active = ~k.contains(" by") & k.rlike(V.ACTIVE_FORM)
    one = per.select("relation", "at", active.alias("active"), found.alias("found"))
    best = one.groupBy("relation").agg(F.max("active").alias("active"), F.min(F.when(F.col("found").isNotNull(), F.struct("at", "found")))["found"].alias("found"))
    j = r.join(best, "relation", "left")
    concept = F.col("concept_polarity")
    pol = F.when(F.col("active"), F.lit(1)).when(concept.isNotNull(), concept).otherwise(F.col("found.p"))
    by = F.when(F.col("active"), "active_form").when(concept.isNotNull(), "concept").otherwise(F.coalesce("found.by", F.lit("none")))
    return j.select("relation", pol.cast("int").alias("polarity"), by.alias("decided_by"))
