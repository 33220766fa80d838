"""Small helpers that spell pattern lists and rule ladders as SQL text."""

from __future__ import annotations


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sql(col: str, patterns: list[str], flags: str = "") -> str:
    return f"regexp_matches({col}, {q(flags + '|'.join(f'(?:{p})' for p in patterns))})"


def count_sql(col: str, patterns: list[str], flags: str = "") -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({col}, {q(flags + p)}) AS INTEGER)" for p in patterns) + ")"


def stems_sql(col: str, stems: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {q(s)}) AS INTEGER)" for s in stems) + ")"


def any_stem_sql(col: str, stems: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(s)})" for s in stems) + ")"


def first_sql(col: str, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({col}, {q('(?i)' + p)}), '')" for p in patterns) + ")"


def case_sql(pairs: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {default} END"


def list_sql(values: list[str]) -> str:
    return ", ".join(q(v) for v in values)


def values_sql(name: str, cols: list[str], rows: list[tuple]) -> str:
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return q(v) if isinstance(v, str) else repr(v)

    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(cols)}) AS (VALUES {body})"


def norm_ascii_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '[ \\t\\r\\n]+'), lambda w: w <> '')"
