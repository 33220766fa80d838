"""Scientific names: cleanup, variants, binomials, kingdoms, abbreviations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as V
from claimweave.functions.text import bind

PEEL_PASSES = 5


def strip_authorship(c: Column, passes: int = PEEL_PASSES) -> Column:
    """Peel trailing parentheses, years, authors and particles; ``passes`` rounds reach the fixed point."""
    for _ in range(passes):
        for pattern in (V.TRAILING_PARENTHESIS, V.TRAILING_YEAR, V.TRAILING_AUTHOR, V.TRAILING_PARTICLE):
            c = F.regexp_replace(c, pattern, "")
    return F.trim(c)


def normalize_name(c: Column | str, passes: int = PEEL_PASSES) -> Column:
    """Key form of a name: no accents, authorship, rank tags or punctuation; lower case."""
    c = F.col(c) if isinstance(c, str) else c
    bare = strip_authorship(F.trim(F.translate(c, V.ACCENTED, V.UNACCENTED)), passes)
    no_rank = F.regexp_replace(F.lower(bare), V.RANK_TAGS, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_rank, r"[^a-z0-9\s.]", " "), r"\s+", " "))


def name_variants(c: Column | str) -> Column:
    """Distinct written forms: full, binomial, abbreviated genus, genus, subspecies forms."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    w = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    n, genus, epithet, sub = F.size(w), F.get(w, F.lit(0)), F.get(w, F.lit(1)), F.get(w, F.lit(2))
    initial = F.concat(F.substring(genus, 1, 1), F.lit(". "))
    forms = F.array(
        F.when((n >= 2) | (F.length(c) > 0), c),
        F.when(n >= 2, F.concat_ws(" ", genus, epithet)),
        F.when((n >= 2) & (F.length(genus) > 1), F.concat(initial, epithet)),
        F.when((n >= 2) & (F.length(genus) > 3), genus),
        F.when(n >= 3, F.concat_ws(" ", genus, epithet, sub)),
        F.when(n >= 3, F.concat(initial, F.concat_ws(" ", epithet, sub))),
    )
    return F.array_distinct(F.array_compact(forms))


def is_binomial(c: Column | str) -> Column:
    """``Genus epithet`` or ``G. epithet`` in the first two words."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c).rlike(r"^([A-Z][a-z]+|[A-Z]\.)\s+[a-z]+(\s|$)")


def count_species(c: Column | str) -> Column:
    """Capitalised binomials whose first word is not a stop word; else lower-case word pairs without stop words."""
    c = F.col(c) if isinstance(c, str) else c
    genera = F.regexp_extract_all(c, F.lit(V.BINOMIAL_CAP), F.lit(1))
    n_cap = F.size(F.filter(genera, lambda g: ~g.isin(V.GENUS_STOPWORDS)))
    pairs = F.zip_with(
        F.regexp_extract_all(c, F.lit(V.BINOMIAL_LOWER), F.lit(1)),
        F.regexp_extract_all(c, F.lit(V.BINOMIAL_LOWER), F.lit(2)),
        lambda a, b: ~a.isin(V.LOWER_STOPWORDS) & ~b.isin(V.LOWER_STOPWORDS),
    )
    n_low = F.size(F.filter(pairs, lambda ok: ok))
    return bind(n_cap, lambda n: F.when(n > 0, n).otherwise(n_low))


def kingdom_by_suffix(c: Column | str) -> Column:
    """Kingdom from a name ending, or null."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    groups = [
        ("Plantae", V.PLANT_SUFFIXES),
        ("Fungi", V.FUNGI_SUFFIXES),
        ("Animalia", V.ANIMAL_SUFFIXES),
        ("Bacteria", V.BACTERIA_SUFFIXES),
    ]
    out = None
    for kingdom, suffixes in groups:
        test = reduce(lambda a, b: a | b, [c.endswith(s) for s in suffixes])
        out = F.when(test, kingdom) if out is None else out.when(test, kingdom)
    return out


def kingdom_of(name: Column | str, by_name: Column, by_genus: Column) -> tuple[Column, Column]:
    """(kingdom, confidence): dictionary on name, then genus, then suffix, then binomial guess."""
    name = F.col(name) if isinstance(name, str) else name
    known = F.coalesce(by_name, by_genus)
    suffix = kingdom_by_suffix(name)
    guess = F.trim(name).rlike(r"^[A-Z][a-z]+\s+[a-z]+$")
    kingdom = F.coalesce(known, suffix, F.when(guess, "Animalia"))
    confidence = (
        F.when(known.isNotNull(), "high").when(suffix.isNotNull(), "medium").when(guess, "low")
    )
    return kingdom, confidence


def pair_key(a: Column | str, b: Column | str, sep: str = ";") -> Column:
    """Order-free key of two names."""
    a = F.lower(F.trim(F.col(a) if isinstance(a, str) else a))
    b = F.lower(F.trim(F.col(b) if isinstance(b, str) else b))
    return F.concat_ws(sep, F.least(a, b), F.greatest(a, b))


def triple_key(a, b, relation, directed: Column | None = None) -> Column:
    """Key of a typed pair; endpoint order counts only where ``directed`` holds."""
    a, b, relation = (F.col(x) if isinstance(x, str) else x for x in (a, b, relation))
    unordered = F.concat_ws(";", F.least(a, b), F.greatest(a, b), relation)
    if directed is None:
        return unordered
    return F.when(directed, F.concat_ws(";", a, b, relation)).otherwise(unordered)


def pmid_of(c: Column | str) -> Column:
    """PMID in a URL or citation, or a bare number."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract(c, r"(?i)(?:pubmed\.ncbi\.nlm\.nih\.gov/|PMID:)(\d+)", 1)
    at_end = F.when(
        F.lower(c).rlike("pubmed|ncbi\\.nlm\\.nih\\.gov"),
        F.coalesce(
            F.nullif(F.regexp_extract(c, r"/(\d{6,9})/?$", 1), F.lit("")),
            F.nullif(F.regexp_extract(c, r"(?i)pubmed[/=](\d{6,9})", 1), F.lit("")),
        ),
    )
    bare = F.when(F.trim(c).rlike(r"^\d+$"), F.trim(c))
    return F.coalesce(F.nullif(found, F.lit("")), at_end, bare)


def doi_of(c: Column | str) -> Column:
    """First DOI in a text, lower case, trailing punctuation removed."""
    c = F.col(c) if isinstance(c, str) else c
    raw = F.regexp_extract(c, r"10\.\d{4,}/\S+", 0)
    return F.nullif(F.lower(F.regexp_replace(raw, r"[.,;)]+$", "")), F.lit(""))


def pmcid_of(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.upper(F.regexp_extract(c, r"(?i)PMC\d+", 0)), F.lit(""))


def reference_kind(c: Column | str) -> Column:
    """doi / pmcid / pmid / title / empty, by shape."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return (
        F.when(c.isNull() | (c == ""), "empty")
        .when(c.rlike(r"(?i)^(https?://(dx\.)?doi\.org/)?10\.\d{4,9}/\S+$"), "doi")
        .when(c.rlike(r"(?i)^PMC\d+$"), "pmcid")
        .when(c.rlike(r"^\d{5,9}$"), "pmid")
        .otherwise("title")
    )
