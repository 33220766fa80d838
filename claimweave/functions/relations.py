"""Relation terms: categories, variants, polarity, voice, surface class, direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as V


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def category_by_rule(term: Column | str) -> Column:
    """First matching category rule, GENERIC when none matches."""
    term = _col(term)
    out = None
    for pattern, category in V.CATEGORY_RULES:
        hit = term.rlike("(?i)" + pattern)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("GENERIC")


def category_of(type_code: Column | str, term: Column | str | None = None) -> Column:
    """Category of a type code: the fixed table first, then the rules on the term."""
    code = _col(type_code)
    out = None
    for name, category in V.CATEGORY_OF_TYPE.items():
        out = F.when(code == name, category) if out is None else out.when(code == name, category)
    return out.otherwise(category_by_rule(code if term is None else term))


def spaced(c: Column | str) -> Column:
    """camelCase to lower-case words."""
    return F.lower(F.regexp_replace(_col(c), "([a-z])([A-Z])", "$1 $2"))


def surface_class(rel: Column | str) -> Column:
    """Coarse form of the first alternative of a relation."""
    form = F.lower(F.trim(F.get(F.split(_col(rel), r"\|"), F.lit(0))))
    return (
        F.when(form.rlike(r"\bby\b"), "C_passive_by")
        .when(form.rlike(r"\b(of|on|for|to|with|in)\s*$"), "B_prep_headed")
        .when(form.endswith("ing"), "D_present_participle")
        .when(form.endswith("ed"), "E_past_participle_bare")
        .otherwise("A_bare_noun")
    )


def voice(rel: Column | str) -> Column:
    """-1 for a passive or receptive frame ("… by"), +1 otherwise."""
    return F.when(F.lower(_col(rel)).rlike(r"\bby\b"), -1).otherwise(1)


def polarity(rel: Column | str, concept: Column | None = None, surface: Column | None = None) -> tuple[Column, Column]:
    """(+1 agent first, -1 patient first, 0 symmetric, null unknown; source of the decision).

    ``concept`` and ``surface`` are polarities looked up for the concept id and the surface form.
    """
    k = F.regexp_replace(F.lower(F.trim(_col(rel))), r"\s+", " ")
    concept = F.lit(None).cast("int") if concept is None else concept
    surface = F.lit(None).cast("int") if surface is None else surface
    rules = [
        (~k.contains(" by") & k.rlike(V.ACTIVE_FORM), F.lit(1), "active_form"),
        (concept.isNotNull(), concept, "concept"),
        (surface.isNotNull() & (surface != 0), surface, "surface"),
        (k.rlike(V.SYMMETRIC_FORM), F.lit(0), "symmetric_form"),
        (k.rlike(V.PATIENT_FORM), F.lit(-1), "patient_form"),
        (k.rlike(V.AGENT_NOUN), F.lit(1), "agent_noun"),
        (k.rlike(V.AGENT_VERB), F.lit(1), "agent_verb"),
        (surface.isNotNull(), F.lit(0), "surface_symmetric"),
    ]
    pol, src = None, None
    for test, value, name in rules:
        pol = F.when(test, value) if pol is None else pol.when(test, value)
        src = F.when(test, name) if src is None else src.when(test, name)
    return pol.cast("int"), src.otherwise("none")


def polarity_index(pol: Column, heads: int) -> Column:
    """Class index of a polarity: 2 heads (+1→1, else 0), 3 heads (+1→1, 0→2, -1/null→0)."""
    if heads == 2:
        return F.when(pol == 1, 1).otherwise(0)
    return F.when(pol == 1, 1).when(pol == 0, 2).otherwise(0)


def concept_forms(rel: Column | str) -> Column:
    """Candidate surface forms in order of preference, as an array of structs (priority, form)."""
    alts = F.filter(F.transform(F.split(F.lower(_col(rel)), r"\|"), lambda f: F.trim(f)), lambda f: f != "")
    stem = lambda f: F.regexp_replace(f, "s+$", "")
    exact = F.transform(alts, lambda f, i: F.struct(i.alias("priority"), f.alias("form")))
    others = F.flatten(
        F.transform(
            alts,
            lambda f, i: F.array(
                F.struct((i * 4 + 100).alias("priority"), stem(f).alias("form")),
                F.struct((i * 4 + 101).alias("priority"), F.concat(f, F.lit(" of")).alias("form")),
                F.struct((i * 4 + 102).alias("priority"), F.concat(stem(f), F.lit(" of")).alias("form")),
                F.struct((i * 4 + 103).alias("priority"), F.concat(f, F.lit("s")).alias("form")),
            ),
        )
    )
    return F.concat(exact, others)


def subject_from_role(score_1: Column, score_2: Column, pol: Column) -> Column:
    """1 or 2: which argument is the subject, from role scores and polarity; 0 when undecided."""
    agent_first = score_1 > score_2
    return (
        F.when(pol.isNull() | (pol == 0) | score_1.isNull() | score_2.isNull() | (score_1 == score_2), 0)
        .when((pol > 0) == agent_first, 1)
        .otherwise(2)
    )
