"""Candidate rejection rules: each says whether a candidate (passage, name, relation, name) is rejected.

Name slots may hold ``a|b`` alternatives. Names are matched as whole words, case-insensitively.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as V
from claimweave.functions.text import bind


def alternatives(c: Column | str) -> Column:
    """Lower-cased, blank-squeezed alternatives of a slot."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.transform(F.split(c, r"\|"), lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))
    return F.filter(parts, lambda x: x != "")


def quoted(name: Column) -> Column:
    """A name as a literal, whole-word, case-insensitive pattern."""
    return F.concat(F.lit(r"(?i:\b\Q"), name, F.lit(r"\E\b)"))


def _once(passage: Column, s1: Column, s2: Column, test) -> Column:
    """``test(passage, forms of the first name, forms of the second)``, each computed once per row however often it is read."""
    row = F.struct(passage.alias("p"), alternatives(s1).alias("a"), alternatives(s2).alias("b"))
    return bind(row, lambda r: test(r["p"], r["a"], r["b"]))


#: A character that each apposition must hold, beside the word "the".
APPOSITION_SIGNS = [",", ")"]


def same_organism(passage: Column, s1: Column, s2: Column) -> Column:
    """A shared form, or an apposition that names one by the other."""
    return _once(passage, s1, s2, _same_organism)


def _same_organism(passage: Column, a: Column, b: Column) -> Column:
    def named_by(left: Column, right: Column) -> Column:
        """Some apposition whose one side holds a form of the first name and the other of the second."""
        pairs = F.zip_with(
            left, right, lambda p, q: F.exists(a, lambda n: p.contains(n)) & F.exists(b, lambda n: q.contains(n))
        )
        return F.coalesce(F.exists(pairs, lambda x: x), F.lit(False))

    hit = F.arrays_overlap(a, b)
    for pattern, sign in zip(V.APPOSITION, APPOSITION_SIGNS, strict=True):
        sides = F.struct(
            *[F.transform(F.regexp_extract_all(passage, F.lit(pattern), F.lit(g)), lambda x: F.lower(x)).alias(f"g{g}") for g in (1, 2)]
        )
        named = bind(sides, lambda s: named_by(s["g1"], s["g2"]) | named_by(s["g2"], s["g1"]))
        stands = passage.contains("the") & passage.contains(sign) & passage.rlike(pattern)
        hit = hit | F.coalesce(stands & named, F.lit(False))
    return hit


def own_clade(passage: Column, s1: Column, s2: Column) -> Column:
    """A clade annotation in parentheses right after one name lists the other."""
    return _once(passage, s1, s2, _own_clade)


def _own_clade(passage: Column, a: Column, b: Column) -> Column:
    def one(names: Column, other: Column) -> Column:
        def lists_other(n: Column) -> Column:
            notes = F.regexp_extract_all(passage, F.concat(quoted(n), F.lit(".{0,3}?" + V.CLADE_IN_PARENTHESES)), F.lit(1))
            clades = F.flatten(F.transform(notes, lambda x: F.split(F.lower(x), r"\s*:\s*")))
            return F.arrays_overlap(F.filter(clades, lambda x: F.length(x) >= 5), other)

        return F.exists(names, lists_other)

    return passage.contains("(") & passage.rlike(V.CLADE_IN_PARENTHESES) & (one(a, b) | one(b, a))


#: Stands in every match of AUTHOR_AND_YEAR.
AUTHOR_YEAR = r"[12]\d\d\d"


def authority(passage: Column, s1: Column, s2: Column) -> Column:
    """One "name" is the author of another name."""
    return _once(passage, s1, s2, _authority)


def _authority(passage: Column, a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    authors = F.concat(
        F.when(passage.rlike(AUTHOR_YEAR), F.regexp_extract_all(passage, F.lit(V.AUTHOR_AND_YEAR), F.lit(2))).otherwise(none),
        F.when(passage.contains("("), F.regexp_extract_all(passage, F.lit(V.AUTHOR_IN_PARENTHESES), F.lit(2))).otherwise(none),
    )
    authors = F.filter(F.transform(authors, lambda x: F.lower(x)), lambda x: ~x.isin(V.AUTHOR_STOPWORDS))
    return F.arrays_overlap(F.concat(a, b), authors)


def non_biotic(relation: Column) -> Column:
    """Any alternative of the relation is taxonomic, comparative or biogeographic."""
    return F.exists(alternatives(relation), lambda r: r.rlike(V.NON_BIOTIC_RELATION))


def denied(passage: Column, s1: Column, s2: Column) -> Column:
    """The pair itself is denied: a "non-X hosts" form, or a negated infection whose scope holds a name."""
    return _once(passage, s1, s2, _denied)


def _denied(passage: Column, a: Column, b: Column) -> Column:
    names = F.concat(a, b)
    non = F.exists(
        names, lambda n: F.regexp_like(passage, F.concat(F.lit(r"(?i)\bnon-?\Q"), n, F.lit(r"\E\s+hosts?\b")))
    )
    scopes = F.regexp_extract_all(passage, F.lit("(?i)" + V.DENIAL_SCOPE), F.lit(1))
    inside = F.exists(scopes, lambda s: F.exists(names, lambda n: F.regexp_like(s, quoted(n))))
    return bind(F.lower(passage), lambda low: (low.contains("non") & non) | ((low.contains("infect") | low.contains("infest")) & low.rlike("infest|infect(?:ion|ed)") & inside))


def not_organism(s1: Column, s2: Column) -> Column:
    return _not_organism(alternatives(s1), alternatives(s2))


def _not_organism(a: Column, b: Column) -> Column:
    return F.exists(F.concat(a, b), lambda n: n.isin(V.NOT_ORGANISM))


def pathogen_modifier(passage: Column, s1: Column, s2: Column) -> Column:
    """A host adjective that in every mention modifies a pathogen word."""
    return _once(passage, s1, s2, _pathogen_modifier)


def _pathogen_modifier(passage: Column, a: Column, b: Column) -> Column:
    names = F.filter(F.concat(a, b), lambda n: n.isin(V.HOST_ADJECTIVES))

    def always(n: Column) -> Column:
        mentions = F.regexp_count(passage, quoted(n))
        modifying = F.regexp_count(passage, F.concat(quoted(n), F.lit(r"(?i:\s*" + V.PATHOGEN_HEAD + ")")))
        return (mentions > 0) & (mentions == modifying)

    return F.exists(names, always)


def co_listed(passage: Column, s1: Column, s2: Column) -> Column:
    """Only list connectors stand between some mention of each, at most 80 characters apart; every pair is tried."""
    return _once(passage, s1, s2, _co_listed)


def _co_listed(passage: Column, a: Column, b: Column) -> Column:
    gap = rf"\A{V.LIST_GAP}{{1,{V.LIST_SPAN_MAX}}}\z"
    connector = r"(?:[,;]|\band\b|\bor\b)"

    def listed(mid: Column) -> Column:
        tokens = F.transform(F.split(F.lower(mid), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;()&'\-]+|[.,;()&'\-]+$", ""))
        breaks = F.exists(tokens, lambda w: w.rlike("^(?:" + "|".join(V.LIST_BREAKERS) + ")"))
        return mid.rlike("(?i)" + connector) & mid.rlike(gap) & ~breaks

    def some_before(after: Column, y: Column) -> Column:
        """Whether a list leads up to some mention of ``y``."""

        def test(parts: Column) -> Column:
            upto = lambda i: F.aggregate(F.slice(parts, 1, i + 1), i * F.length(y), lambda n, p: n + F.length(p))
            mids = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, i: F.substring(after, F.lit(1), upto(i)))
            return F.exists(mids, listed)

        return bind(F.split(after, quoted(y), -1), test)

    def between(x: Column, y: Column) -> Column:
        # a look-ahead takes what follows a mention, so that none hides another
        room = (F.length(y) + V.LIST_SPAN_MAX + 1).cast("string")
        ahead = F.concat(quoted(x), F.lit("(?=((?s:.{0,"), room, F.lit("})))"))
        follows = F.regexp_extract_all(passage, ahead, F.lit(1))
        return F.exists(follows, lambda after: some_before(after, y))

    def test(low: Column) -> Column:
        plain = (F.octet_length(passage) == F.length(passage)) & (F.octet_length(low) == F.length(low))
        locate = lambda name, start: F.call_function("locate", name, low, start)

        def apart(x: Column, y: Column) -> Column:
            """In plain letters, a ``y`` after the first ``x``, and a list between them where both stand once: so wherever the
            patterns, which are built per name, find a list."""

            def listed_once(at: Column) -> Column:
                i, j = at["i"], at["j"]
                once = plain & (locate(x, i + 1) == 0) & (locate(y, j + 1) == 0)
                end = i + F.length(x)
                return (i > 0) & (j > 0) & (~once | listed(F.substring(low, end, j - end)))

            first = locate(x, F.lit(1))
            return bind(first, lambda i: bind(F.struct(i.alias("i"), locate(y, i + F.length(x)).alias("j")), listed_once))

        def in_order(first: Column, second: Column) -> Column:
            return F.exists(first, lambda x: F.exists(second, lambda y: apart(x, y) & between(x, y)))

        return in_order(a, b) | in_order(b, a)

    return passage.rlike("(?i)" + connector) & bind(F.lower(passage), test)


def _rejections(passage: Column, a: Column, relation: Column, b: Column) -> dict[str, Column]:
    """The frozen rules in their fixed order, over the forms of the names."""
    return {
        "same_organism": _same_organism(passage, a, b),
        "own_clade": _own_clade(passage, a, b),
        "authority": _authority(passage, a, b),
        "non_biotic_relation": non_biotic(relation),
        "negated": _denied(passage, a, b),
        "not_an_organism": _not_organism(a, b),
        "pathogen_modifier": _pathogen_modifier(passage, a, b),
    }


def reject_reason(passage: Column, s1: Column, relation: Column, s2: Column, only: list[str] | None = None) -> Column:
    """Name of the first rule that rejects, null when the candidate is kept. Passage and names are read once for all rules."""

    def first(p: Column, a: Column, b: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, test in reversed(_rejections(p, a, relation, b).items()):
            if only is None or name in only:
                out = F.when(test, F.lit(name)).otherwise(out)
        return out

    return _once(passage, s1, s2, first)
