"""User functions: row callbacks, pluggable scorers, generators. Batches travel by Arrow; nothing runs per row in the JVM bridge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_callback(fn: Callable[[str], dict], schema: str) -> Callable[[Column | str], Column]:
    """A Python function text → dict as a struct column, for rules that no expression can state."""

    @F.pandas_udf(schema)
    def batch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fn(t) for t in texts])

    return batch


def batch_scorer(load: Callable[[], Callable[[list[str]], list[float]]]) -> Callable[[Column | str], Column]:
    """Scorer over batches of texts; ``load`` runs once per task, so a model is read once, not per batch."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.tolist()), dtype="float64")

    return score


def order_free(df: DataFrame, scorer: Callable[[Column], Column], template: Column, swapped: Column) -> DataFrame:
    """Maximum of the scores of both argument orders."""
    return df.withColumn("score", F.greatest(scorer(template), scorer(swapped)))


@F.udtf(returnType="sent_id int, n_chars int, n_words int")
class SentenceRows:
    """Generator of one row per sentence of a text."""

    def eval(self, text: str):
        import re

        flat = re.sub(r"[ \t\r\n]+", " ", text)
        for i, part in enumerate(re.split("§", re.sub(r"([.!?]) ([A-Z])", r"\1§\2", flat))):
            part = part.strip(" ")
            if len(part) > 10:
                yield i, len(part), len(part.split(" "))
