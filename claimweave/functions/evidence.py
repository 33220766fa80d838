"""Evidence type, negation, lexicon signal, outcome codes and quality scores of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import fixed_values as V
from claimweave.functions.names import is_binomial
from claimweave.functions.text import any_gated, any_of, bind, contains_any, count_patterns, count_stems, has_pattern


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match(c: Column, patterns: list[str]) -> Column:
    """Text matched by the first pattern, in list order, that occurs; null when none does."""
    hits = [F.nullif(F.regexp_extract(c, "(?i)" + p, 0), F.lit("")) for p in patterns]
    return F.when(c.rlike(any_of(patterns, "(?i)")), F.coalesce(*hits))


def negation_match(c: Column | str) -> Column:
    return first_match(_col(c), V.SENTENCE_NEGATION)


def is_negated(c: Column | str) -> Column:
    return _col(c).rlike(any_of(V.SENTENCE_NEGATION, "(?i)"))


def evidence_type(c: Column | str, publication_types: Column | None = None) -> Column:
    """Publication types first (most specific listed type), then the text patterns in order."""
    c = _col(c)

    def kind_of(row: Column) -> Column:
        out = None
        for kind, patterns in V.EVIDENCE_PATTERNS.items():
            hit = any_gated(row["low"], row["text"], patterns, "(?i)")
            out = F.when(hit, kind) if out is None else out.when(hit, kind)
        return out.otherwise("unknown")

    by_text = bind(F.struct(F.lower(c).alias("low"), c.alias("text")), kind_of)
    if publication_types is None:
        return by_text
    lowered = F.transform(publication_types, lambda p: F.lower(F.trim(p)))
    by_type = None
    for needle, kind in V.PUBLICATION_TYPES:
        hit = F.exists(lowered, lambda p: p.contains(needle))  # noqa: B023
        by_type = F.when(hit, kind) if by_type is None else by_type.when(hit, kind)
    return F.coalesce(by_type, by_text)


def evidence_match(c: Column | str) -> Column:
    return first_match(_col(c), [p for ps in V.EVIDENCE_PATTERNS.values() for p in ps])


def evidence_score(kind: Column | str) -> Column:
    kind = _col(kind)
    out = None
    for name, weight in V.EVIDENCE_WEIGHTS.items():
        out = F.when(kind == name, F.lit(weight)) if out is None else out.when(kind == name, F.lit(weight))
    return out.otherwise(F.lit(V.EVIDENCE_WEIGHTS["unknown"]))


def lexicon_counts(lowered: Column) -> tuple[Column, Column, Column, Column]:
    """(strong terms, weak terms, negated, method cues) of a lower-cased text."""
    return (
        count_patterns(lowered, V.STRONG_TERMS),
        count_patterns(lowered, V.WEAK_TERMS),
        has_pattern(lowered, V.LEXICON_NEGATION),
        count_patterns(lowered, V.LEXICON_METHOD),
    )


def lexicon_strength(strong: Column, weak: Column, negated: Column, method: Column) -> Column:
    """0.40 per strong and 0.15 per weak term up to 1, damped by negation and methods wording."""
    base = F.least(F.lit(1.0), strong * V.STRONG_WEIGHT + weak * V.WEAK_WEIGHT)
    damped = F.when(negated, base * V.NEGATION_FACTOR).otherwise(base)
    final = F.when(method >= 2, F.greatest(F.lit(V.METHOD_FLOOR), damped - V.METHOD_PENALTY)).otherwise(damped)
    return F.when(strong + weak == 0, 0.0).otherwise(final)


def has_signal(strong: Column, weak: Column, strength: Column) -> Column:
    return (strong + weak > 0) & ((strength >= V.SIGNAL_MIN) | (strong >= 2))


def with_lexicon(df: DataFrame, text: str, prefix: str = "lex_") -> DataFrame:
    """Add counts, strength and signal flag; counts are computed once and reused."""
    strong, weak, negated, method = lexicon_counts(F.lower(F.col(text)))
    df = df.withColumns(
        {f"{prefix}strong": strong, f"{prefix}weak": weak, f"{prefix}negated": negated, f"{prefix}method": method}
    )
    s, w = F.col(f"{prefix}strong"), F.col(f"{prefix}weak")
    df = df.withColumn(
        f"{prefix}raw", lexicon_strength(s, w, F.col(f"{prefix}negated"), F.col(f"{prefix}method"))
    )
    return df.withColumns(
        {
            f"{prefix}signal": has_signal(s, w, F.col(f"{prefix}raw")),
            f"{prefix}strength": F.round(f"{prefix}raw", 3),
        }
    ).drop(f"{prefix}raw")


def rule_decision(signal: Column, strength: Column, n_species: Column) -> tuple[Column, Column, Column]:
    """(label, confidence, reason): both an interaction signal and two names are needed."""
    label = F.when(signal & (n_species >= 2), 1).otherwise(0)
    reason = (
        F.when(~signal, "no_interaction_verb")
        .when(n_species < 2, "insufficient_species")
        .otherwise("rule_positive")
    )
    confidence = (
        F.when(~signal, 0.90)
        .when(n_species < 2, 0.85)
        .otherwise(F.round(F.least(F.lit(0.95), 0.60 + strength * 0.40), 3))
    )
    return label, confidence, reason


def heuristic_confidence(strong: Column, weak: Column, strength: Column, signal: Column) -> Column:
    """Confidence of the lexicon-only validator."""
    return (
        F.when(~signal, 0.15)
        .when(strong >= 2, 0.90)
        .when((strong == 1) & (weak >= 1), 0.80)
        .when(strong == 1, F.greatest(F.lit(0.50), strength + 0.10))
        .otherwise(F.least(F.lit(0.65), strength + 0.05))
    )


def outcome_code(
    n_species: Column, strength: Column, negated: Column, methodology: Column, score: Column, has_term: Column,
    threshold: float = 0.5,
) -> Column:
    """One of nine codes, in fixed precedence."""
    pos = score >= threshold
    return (
        F.when(methodology & ~(has_term & pos), "METHODOLOGY")
        .when(n_species == 0, "NO_SPECIES")
        .when(n_species == 1, "ONE_SPECIES")
        .when(negated & ((strength > 0) | has_term), "NEGATED")
        .when(pos & (has_term | (strength >= V.SIGNAL_MIN)), "INTERACTION")
        .when(pos & (n_species >= 2), "IMPLICIT")
        .when(pos, "INTERACTION_WEAK")
        .when((strength >= V.STRONG_WEIGHT) | has_term, "BORDERLINE")
        .otherwise("TWO_SPECIES_NO_VERB")
    )


def outcome_text(code: Column, subjects: Column, term: Column, category: Column, score: Column, strength: Column) -> Column:
    """One-sentence explanation of an outcome code."""
    pct = F.concat(F.round(score * 100).cast("int").cast("string"), F.lit("%"))
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(code == "INTERACTION", cat(subjects, " are linked by '", term, "' (", category, ", ", pct, ")."))
        .when(code == "INTERACTION_WEAK", cat("Predicted at ", pct, " without interaction vocabulary."))
        .when(code == "NO_SPECIES", F.lit("No species names found."))
        .when(code == "ONE_SPECIES", cat("Only one organism found: ", subjects, "."))
        .when(code == "TWO_SPECIES_NO_VERB", cat("Organisms found (", subjects, ") but no interaction vocabulary."))
        .when(code == "NEGATED", cat("'", term, "' is negated."))
        .when(code == "METHODOLOGY", F.lit("Methods or statistics wording."))
        .when(code == "BORDERLINE", cat("Score ", pct, " and signal ", F.format_number(strength, 2), " disagree."))
        .otherwise(cat(subjects, " co-occur without interaction vocabulary."))
    )


def specificity_lookup(term: Column | str) -> Column:
    """Exact specificity, else that of the first known term contained in or containing it, else the default."""
    t = F.lower(F.trim(_col(term)))
    exact, partial = None, None
    for known, value in V.TERM_SPECIFICITY.items():
        exact = F.when(t == known, F.lit(value)) if exact is None else exact.when(t == known, F.lit(value))
        near = t.contains(known) | F.lit(known).contains(t)
        partial = F.when(near, F.lit(value)) if partial is None else partial.when(near, F.lit(value))
    return F.coalesce(exact, partial, F.lit(V.DEFAULT_SPECIFICITY))


def match_quality(sentence, name_1, name_2, term, match_length) -> dict[str, Column]:
    """Score parts (length ≤ 40, binomials ≤ 30, specificity ≤ 20, sentence form ≤ 10) and their sum."""
    sentence, name_1, name_2, n = _col(sentence), _col(name_1), _col(name_2), _col(match_length)
    length = (
        F.when(n <= 0, 0.0).when(n < 15, n / F.lit(30.0)).otherwise(F.least(n / F.lit(60.0), F.lit(1.0))) * 40
    )
    binomial = F.when(is_binomial(name_1), 15).otherwise(0) + F.when(is_binomial(name_2), 15).otherwise(0)
    size = F.length(sentence)
    odd = F.length(F.regexp_replace(sentence, r"[a-zA-Z0-9\s.,;:'\"()-]", ""))
    form = (
        F.when(size.between(80, 250), 5).when(size.between(50, 350), 3).otherwise(0)
        + F.when(F.substring(sentence, 1, 1).rlike(r"^\p{Lu}"), 2).otherwise(0)
        + F.when(F.rtrim(sentence).endswith("."), 2).otherwise(0)
        - F.when(odd / F.greatest(size, F.lit(1)) > 0.1, 3).otherwise(0)
    )
    form = F.greatest(F.lit(0), F.least(F.lit(10), form))
    specific = specificity_lookup(term) * 20
    return {
        "length_score": length,
        "binomial_score": binomial.cast("double"),
        "specificity_score": specific,
        "form_score": form.cast("double"),
        "total_score": length + binomial + specific + form,
    }


def wrong_accept_parts(c: Column | str) -> tuple[Column, Column]:
    """(flags, probability) that an accepted sentence is a wrong accept."""
    c = _col(c)
    low = F.lower(c)
    no_verb = ~contains_any(low, V.INTERACTION_STEMS)
    cues = count_stems(low, V.WRONG_ACCEPT_CUES)
    heads = F.regexp_extract_all(c, F.lit(r"[A-Z][a-z]+(?:\s+[a-z]+)?"), F.lit(0))
    between = F.regexp_extract(c, r"(?s)[A-Z][a-z]+(?:\s+[a-z]+)?(.*)[A-Z][a-z]+(?:\s+[a-z]+)?", 1)
    no_structure = (F.size(heads) < 2) | ~contains_any(F.lower(between), V.INTERACTION_STEMS)
    n = F.regexp_count(c, F.lit(r"\b[A-Z][a-z]+\s+[a-z]{3,}\b"))
    flags = F.array_compact(
        F.array(
            F.when(cues > 0, "wrong_accept_cues"),
            F.when(no_verb, "no_interaction_verb"),
            F.when(no_structure, "no_interaction_structure"),
            F.when(n > 4, "many_species").when(n < 2, "few_species"),
        )
    )
    add = lambda test, v: F.when(test, F.lit(v)).otherwise(F.lit(0.0))
    prob = (
        add(no_verb, 0.4)
        + F.least(F.size(flags) * 0.15, F.lit(0.4))
        + add(F.length(c) < 50, 0.1)
        + add(F.length(c) > 300, 0.1)
        + add(no_structure, 0.2)
        + add(n > 4, 0.15)
    )
    return flags, F.least(prob, F.lit(1.0))


def keyword_quality(c: Column | str) -> tuple[Column, Column]:
    """(score as a positive, score as a negative) from keyword tiers."""
    low = F.lower(_col(c))
    l1, l2, l3 = (count_stems(low, k) for k in (V.KEYWORDS_L1, V.KEYWORDS_L2, V.KEYWORDS_L3))
    phrase = contains_any(low, V.INTERACTION_PHRASES)
    other = count_stems(low, V.NON_INTERACTION)
    positive = l1 * 4 + l2 * 2 + l3 + F.when(phrase, 3).otherwise(0) - F.greatest(F.lit(0), other - 2)
    negative = other * 2 - l1 * 5 - l2 * 3 - F.when(phrase, 5).otherwise(0)
    return positive, negative


def with_sentence_class(df: DataFrame, text: str) -> DataFrame:
    """Add class, confidence and reason from counts of patterns for and against an interaction."""
    strong = V.INFECTION_PATTERNS + V.HOST_PARASITE_PATTERNS + V.PREDATION_PATTERNS
    low = F.lower(F.trim(F.col(text)))
    df = df.withColumns(
        {
            "_tp": count_patterns(low, strong + V.OTHER_INTERACTION_PATTERNS),
            "_fp": count_patterns(low, V.NO_INTERACTION_PATTERNS),
        }
    )
    tp, fp = F.col("_tp"), F.col("_fp")
    yes, no = "true_positive", "false_positive"
    ladder = [
        (F.length(F.trim(F.col(text))) < 15, no, "high", "too_short"),
        ((tp >= 2) & (fp == 0), yes, "high", "strong_interaction_evidence"),
        ((tp == 1) & (fp == 0), yes, "high", "clear_interaction_pattern"),
        ((fp >= 2) & (tp == 0), no, "high", "methodology_focused"),
        ((fp == 1) & (tp == 0), no, "medium", "methodology_pattern_present"),
        ((tp > fp) & (fp >= 1), yes, "medium", "interaction_despite_methodology"),
        ((fp > tp) & (tp >= 1), no, "medium", "methodology_despite_interaction"),
        ((tp >= 1) & low.rlike(any_of(strong)), yes, "low", "strong_interaction_in_mixed_context"),
        (tp >= 1, no, "low", "unclear_mixed_context"),
        (low.rlike(V.DISEASE_CONTEXT), yes, "medium", "disease_context"),
        (low.rlike(V.TREATED_ANIMALS), yes, "medium", "experimental_organism_context"),
        (low.rlike(V.ORGANISM_IN_ORGANISM), yes, "medium", "organism_in_organism"),
        (low.rlike(V.CAUSATION), yes, "low", "causation_language"),
        (contains_any(low, V.BIOLOGY_WORDS), yes, "low", "biological_interaction_term"),
        (count_stems(low, V.MOLECULE_WORDS) >= 2, no, "low", "molecular_focus"),
        (low.rlike(V.COMPARISON) & ~low.rlike(V.COMPARISON_EXCEPTION), no, "low", "comparative_statement"),
        (contains_any(low, V.CONTEXT_HINTS), yes, "low", "interaction_context_hint"),
    ]
    verdict = None
    for test, cls, confidence, reason in ladder:
        value = F.struct(F.lit(cls).alias("class"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
        verdict = F.when(test, value) if verdict is None else verdict.when(test, value)
    default = F.struct(
        F.lit(yes).alias("class"), F.lit("low").alias("confidence"), F.lit("default_assumed_interaction").alias("reason")
    )
    return df.withColumn("_v", verdict.otherwise(default)).select("*", "_v.*").drop("_tp", "_fp", "_v")


def looks_like_title(c: Column | str) -> Column:
    """Short, one final period, no narrative words."""
    c = _col(c)
    return (
        (F.length(c) < 200)
        & c.endswith(".")
        & (F.length(c) - F.length(F.replace(c, F.lit("."))) == 1)
        & ~contains_any(F.lower(c), V.TRUE_TITLE_WORDS)
    )


def teacher_decision(score: Column, has_term: Column, strength: Column, text: Column) -> tuple[Column, Column]:
    """(label or null, reason) for pseudo-labelling; everything uncertain is discarded."""
    title = looks_like_title(text)
    ladder = [
        (score >= 0.92, 1, "very_high"),
        ((score >= 0.80) & ~title, 1, "high_not_title"),
        (score <= 0.08, 0, "very_low"),
        ((score <= 0.20) & ~has_term & (strength == 0), 0, "low_no_signals"),
    ]
    label, reason = None, None
    for test, value, name in ladder:
        label = F.when(test, value) if label is None else label.when(test, value)
        reason = F.when(test, name) if reason is None else reason.when(test, name)
    return label, reason.otherwise("uncertain")
