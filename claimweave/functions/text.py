"""Text normalisers, sentence splitting, shingles and sentence-shape tests."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as V

PROTECTED_DOT = "<DOT>"
#: What stands between tokens: anything but letters, marks and digits of any script.
TOKEN_SPLIT = r"[^\p{L}\p{M}\p{N}]+"


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once per row.

    An array of one element and a lambda over it: inside nested lambdas the bound variable is
    read, not recomputed, and the body stays out of generated code that would outgrow its limit.
    """
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))


def norm_match(c: Column | str) -> Column:
    """Lower case, whitespace collapsed, punctuation stripped (letters of any script kept)."""
    c = F.col(c) if isinstance(c, str) else c
    squeezed = F.regexp_replace(F.lower(c), r"\s+", " ")
    return F.trim(F.regexp_replace(squeezed, r"[^\p{L}\p{N}_\s]", ""))


def norm_ascii(c: Column | str) -> Column:
    """ASCII letters and digits only, lower case, single spaces."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +", " "))


def norm_space(c: Column | str) -> Column:
    """Whitespace collapsed, case kept."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))


def nullify(c: Column | str) -> Column:
    """Blank and "nan" cells become null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.lower(F.trim(c)).isin("", "nan"), c)


def protect_abbreviations(c: Column) -> Column:
    """Hide the dots of known abbreviations so they do not end a sentence."""
    return reduce(
        lambda acc, a: F.replace(acc, F.lit(a), F.lit(a.replace(".", PROTECTED_DOT))), V.ABBREVIATIONS, c
    )


def split_sentences(c: Column, protect: bool = True) -> Column:
    """Array of sentences: break after . ! ? before an ASCII capital."""
    flat = F.regexp_replace(c, r"[ \t\r\n]+", " ")
    flat = protect_abbreviations(flat) if protect else flat
    parts = F.split(F.regexp_replace(flat, r"([.!?]) ([A-Z])", "$1§$2"), "§")
    return F.transform(parts, lambda s: F.trim(F.replace(s, F.lit(PROTECTED_DOT), F.lit("."))))


def sentences_of(docs: DataFrame, text: str, keep: list[str], min_chars: int = 10, protect: bool = False) -> DataFrame:
    """One row per sentence longer than ``min_chars``, with its position."""
    out = docs.select(*keep, F.posexplode(split_sentences(F.col(text), protect)).alias("sent_id", "sentence"))
    return out.where(F.length("sentence") > min_chars)


def words(c: Column | str) -> Column:
    """Whitespace-separated words."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(c, r"[ \t\r\n]+"), lambda w: w != "")


def good_sentence(c: Column | str) -> Column:
    """40–600 characters, ≥ 8 words, ≥ 30 letters, no caption, ≤ 30 % digits and brackets, no bare name list."""
    c = F.col(c) if isinstance(c, str) else c
    n_words = F.size(words(c))
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    noise = F.length(c) - F.length(F.regexp_replace(c, r"[\[\]()0-9]", ""))
    return (
        F.length(c).between(V.SENTENCE_MIN, V.SENTENCE_MAX)
        & (n_words >= V.SENTENCE_MIN_WORDS)
        & (letters >= V.SENTENCE_MIN_LETTERS)
        & ~c.rlike(r"(?i)^(Fig(ure)?|Table|Supplementary)\s")
        & (noise / F.length(c) <= 0.3)
        & ~((F.regexp_count(c, F.lit(r"[A-Z][a-z]+\s[a-z]+")) > 3) & (n_words < 20))
    )


def valid_passage(c: Column | str) -> Column:
    """50–800 characters, ≥ 8 words, ≥ 30 letters, no methods wording."""
    c = F.col(c) if isinstance(c, str) else c
    method = "(?i)" + "|".join(f"(?:{p})" for p in V.PASSAGE_METHOD)
    return (
        F.length(c).between(V.PASSAGE_MIN, V.PASSAGE_MAX)
        & (F.size(words(c)) >= V.SENTENCE_MIN_WORDS)
        & (F.length(F.regexp_replace(c, r"[^\p{L}]", "")) >= V.SENTENCE_MIN_LETTERS)
        & ~c.rlike(method)
    )


def complete_sentence(c: Column | str) -> Column:
    """Ends like a sentence and holds no template placeholder."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c).rlike(r"[.!?)]$") & ~c.contains("{") & ~c.contains("}")


def false_negative(c: Column | str) -> Column:
    """States an interaction and carries no negation word."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    return bind(c, lambda t: any_gated(t, t, V.FALSE_NEGATIVE_PATTERNS) & ~any_gated(t, t, V.FALSE_NEGATIVE_NEGATION))


def _grams(items: Column, k: int, sep: str) -> Column:
    """k consecutive items joined, at every position of an already bound array."""
    join = lambda i: F.concat_ws(sep, *[F.get(items, i + d) for d in range(k)])
    last = F.size(items) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), join))


def shingles(c: Column | str, k: int = 5) -> Column:
    """Distinct word k-grams of the ASCII-normalised text (the whole text when shorter)."""
    whole = norm_ascii(c)
    grams = bind(F.split(whole, " "), lambda w: _grams(w, k, " "))
    return F.array_distinct(F.coalesce(grams, F.array(whole)))


def char_ngrams(c: Column | str, n: int) -> Column:
    """All character n-grams of a string, in order; empty when it is shorter."""
    c = F.col(c) if isinstance(c, str) else c
    grams = bind(F.filter(F.split(c, ""), lambda x: x != ""), lambda chars: _grams(chars, n, ""))
    return F.coalesce(grams, F.array().cast("array<string>"))


def any_of(patterns: list[str], flags: str = "") -> str:
    """One alternation for many patterns, so that a text is scanned once."""
    return flags + "|".join(f"(?:{p})" for p in patterns)


def contains_any(c: Column, stems: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(s) for s in stems])


def leading_literal(pattern: str) -> str:
    """Letters every match of a pattern must begin with ("" when there are fewer than three)."""
    m = re.match(r"\\b([a-z]+)", pattern)
    if m is None or "|" in re.sub(r"\([^()]*\)", "", pattern):
        return ""
    letters = m.group(1)
    if pattern[m.end() : m.end() + 1] in ("?", "*", "{"):
        letters = letters[:-1]
    return letters if len(letters) >= 3 else ""


def leading_literals(pattern: str) -> tuple[str, ...]:
    """Lower-case beginnings of which every match holds one; empty when that cannot be read off the pattern."""
    one = leading_literal(pattern)
    if one:
        return (one,)
    m = re.match(r"\\b\((?:\?:)?([^()\[\]]*)\)(?![?*{])", pattern)
    if m is None or "|" in re.sub(r"\([^()]*\)", "", pattern):
        return ()
    found = []
    for alternative in m.group(1).split("|"):
        begin = re.match(r"[A-Za-z0-9 ]*", alternative).group()
        if alternative[len(begin) : len(begin) + 1] in ("?", "*", "{"):
            begin = begin[:-1]
        found.append(begin.lower())
    return tuple(dict.fromkeys(found)) if all(len(x) >= 2 for x in found) else ()


def _by_literal(patterns: list[str]) -> dict[str, dict[tuple[str, ...], list[str]]]:
    """Patterns by their beginnings, these by the three letters that they share."""
    groups: dict[str, dict[tuple[str, ...], list[str]]] = {}
    for p in patterns:
        begins = leading_literals(p)
        shared = begins[0][:3] if len(begins) == 1 else ""
        groups.setdefault(shared, {}).setdefault(begins, []).append(p)
    return groups


def _gated(t: Column, patterns: list[str], join, none: Column, value) -> Column:
    """``value`` of the patterns by group, joined; a group whose beginnings do not occur gives ``none``."""
    parts = []
    for shared, groups in _by_literal(patterns).items():
        inner = []
        for begins, group in groups.items():
            n = value(group)
            inner.append(F.when(contains_any(t, list(begins)), n).otherwise(none) if begins and begins != (shared,) else n)
        both = reduce(join, inner)
        parts.append(F.when(t.contains(shared), both).otherwise(none) if shared else both)
    return reduce(join, parts)


def count_patterns(lowered: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur at least once in a lower-cased text.

    A plain substring test on the letters a pattern begins with comes first; the regular expression runs
    only where it can match.
    """

    def count(t: Column) -> Column:
        return _gated(t, patterns, lambda a, b: a + b, F.lit(0), lambda group: reduce(lambda a, b: a + b, [t.rlike(p).cast("int") for p in group]))

    return bind(lowered, count)


def has_pattern(lowered: Column, patterns: list[str]) -> Column:
    """Whether any pattern occurs in a lower-cased text, with the same cheap test first."""
    return bind(lowered, lambda t: any_gated(t, t, patterns))


def any_gated(low: Column, text: Column, patterns: list[str], flags: str = "") -> Column:
    """Whether any pattern occurs in ``text``, whose lower-cased form is bound as ``low``."""
    return _gated(low, patterns, lambda a, b: a | b, F.lit(False), lambda group: text.rlike(any_of(group, flags)))


def count_stems(c: Column, stems: list[str]) -> Column:
    return bind(c, lambda t: reduce(lambda a, b: a + b, [t.contains(s).cast("int") for s in stems]))
