"""Dictionary matching by joins: n-grams of tokens against name tables, longest match, pairs, enrichment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.text import TOKEN_SPLIT, bind


def token_grams(text: Column, max_words: int) -> Column:
    """Array of (start, len, gram) for all runs of 1..max_words tokens of a text; tokens hold letters of any script."""
    toks = F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda w: w != "")

    none = F.array().cast("array<struct<start:int,len:int,gram:string>>")

    def runs_of(ws: Column, k: int) -> Column:
        def run(i: Column) -> Column:
            gram = F.concat_ws(" ", *[F.get(ws, i + d) for d in range(k)])
            return F.struct(i.alias("start"), F.lit(k).alias("len"), gram.alias("gram"))

        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(ws) - k))
        return F.when(F.size(ws) >= k, F.transform(starts, run)).otherwise(none)

    def runs(ws: Column) -> Column:
        return F.concat(*[runs_of(ws, k) for k in range(1, max_words + 1)])

    return bind(toks, runs)


def dictionary_hits(docs: DataFrame, id_cols: list[str], text: str, names: DataFrame, max_words: int) -> DataFrame:
    """All dictionary hits (ids, start, len, gram): an equi-join on the gram, whatever the size of either side.

    ``names``: name (lower case, single spaces), distinct.
    """
    grams = docs.select(*id_cols, F.inline(token_grams(F.col(text), max_words)))
    return grams.join(names.select(F.col("name").alias("gram")).distinct(), "gram").select(*id_cols, "start", "len", "gram")


def _fold():
    """Longest match over rows sorted by text, start, len, gram: only the span kept last is carried, also to the next batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None  # (ids, start, len, gram)
        columns = None
        for f in frames:
            columns = f.columns
            done = []
            for row in zip(*(f[c].tolist() for c in columns), strict=True):
                now = (row[:-3], *row[-3:])
                if last is None or now[0] != last[0] or now[1] >= last[1] + last[2]:
                    if last is not None:
                        done.append((*last[0], *last[1:]))
                    last = now
                elif now[2] > last[2]:
                    last = now
            yield pd.DataFrame(done, columns=columns).astype(f.dtypes.to_dict())
        if last is not None:
            yield pd.DataFrame([(*last[0], *last[1:])], columns=columns)

    return run


def resolve_overlaps(hits: DataFrame, id_cols: list[str]) -> DataFrame:
    """Longest non-overlapping hits per text: from the left, a span that overlaps the one kept last replaces it only when longer.

    One pass over sorted rows, in work and memory that do not depend on how many hits a text has. Ids are not null.
    """
    h = hits.select(*id_cols, "start", "len", "gram")
    schema = ", ".join(f"`{c}` {t}" for c, t in h.dtypes)
    return h.repartition(*id_cols).sortWithinPartitions(*id_cols, "start", "len", "gram").mapInPandas(_fold(), schema)
