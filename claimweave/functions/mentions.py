"""Where names stand in a text: location with fallbacks, binomial mentions with offsets, direction baselines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as V


def word_pattern(name: Column) -> Column:
    return F.concat(F.lit(r"(?i)\b\Q"), name, F.lit(r"\E\b"))


def locate(name: Column | str, text: Column | str) -> Column:
    """(form, start) of the first written form found as whole words: every alternative in full, then per
    alternative its first word, last word, plural and singular. ``start`` counts from 1; null when absent."""
    name = F.col(name) if isinstance(name, str) else name
    text = F.col(text) if isinstance(text, str) else text
    alts = F.filter(F.transform(F.split(name, r"\|"), lambda a: F.trim(a)), lambda a: a != "")

    def weaker(a: Column) -> Column:
        w = F.split(a, r"\s+")
        many = F.size(w) > 1
        stem = F.regexp_replace(a, "s+$", "")
        return F.array_compact(
            F.array(
                F.when(many, F.get(w, F.lit(0))), F.when(many, F.element_at(w, -1)), F.concat(a, F.lit("s")), F.when((stem != a) & (stem != ""), stem)
            )
        )

    forms = F.concat(alts, F.flatten(F.transform(alts, weaker)))
    hit = F.get(F.filter(forms, lambda f: F.regexp_like(text, word_pattern(f))), F.lit(0))
    return F.when(hit.isNotNull(), F.struct(hit.alias("form"), F.regexp_instr(text, word_pattern(hit)).alias("start")))


def binomial_mentions(text: Column | str) -> Column:
    """Array of (start, mention, genus, qualified) of capitalised binomials that do not begin with a stop word.

    Offsets follow from the lengths of the pieces between matches.
    """
    text = F.col(text) if isinstance(text, str) else text
    pattern = F.lit(V.BINOMIAL_CAP)
    found = F.arrays_zip(
        F.split(text, V.BINOMIAL_CAP).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("g"),
    )
    empty = F.array().cast("array<struct<start:int,mention:string,genus:string,qualified:boolean>>")
    acc = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(
                x["m"].isNotNull(),
                F.concat(
                    a["out"],
                    F.array(
                        F.struct(
                            (a["at"] + F.length(x["gap"])).alias("start"), x["m"].alias("mention"), x["g"].alias("genus"),
                            x["m"].rlike(r"\s(cf\.|aff\.|sp\.?)\s").alias("qualified"),
                        )
                    ),
                ),
            ).otherwise(a["out"]).alias("out"),
        ),
    )
    return F.filter(acc["out"], lambda m: ~m["genus"].isin(V.GENUS_STOPWORDS))


def abbreviated_pattern(name: Column | str) -> Column:
    """Pattern of ``G. epithet`` for a two-word name, null otherwise."""
    name = F.trim(F.col(name) if isinstance(name, str) else name)
    w = F.split(name, r"\s+")
    form = F.concat(F.lit(r"(?i)\b\Q"), F.substring(F.get(w, F.lit(0)), 1, 1), F.lit(r"\E\.\s*\Q"), F.get(w, F.lit(1)), F.lit(r"\E\b"))
    return F.when(F.size(w) == 2, form)


def subject_by_order(start_1: Column, start_2: Column) -> Column:
    """First-mentioned name is the subject; null when one is missing."""
    return F.when((start_1 > 0) & (start_2 > 0), F.when(start_1 <= start_2, 1).otherwise(2))


def subject_by_syntax(start_1: Column, end_1: Column, start_2: Column, end_2: Column, rel: Column, voice: Column) -> Column:
    """The name nearest to the left of the relation, flipped when the relation is passive."""
    gap_1 = F.when((start_1 > 0) & (rel > 0) & (end_1 <= rel), rel - end_1)
    gap_2 = F.when((start_2 > 0) & (rel > 0) & (end_2 <= rel), rel - end_2)
    left = F.when(gap_1.isNotNull() & (gap_2.isNull() | (gap_1 < gap_2)), 1).when(gap_2.isNotNull(), 2)
    usable = (start_1 > 0) & (start_2 > 0) & (rel > 0)
    return F.when(usable & left.isNotNull(), F.when(voice > 0, left).otherwise(3 - left))
