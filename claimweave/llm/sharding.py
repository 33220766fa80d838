"""Uniform shuffle into shards of exact size, by a communication matrix.

How many rows go from each partition to each shard is drawn first, from the multivariate hypergeometric law that a
uniform shuffle of all rows would have. Then every partition is permuted by itself and dealt by its row of the matrix,
and every shard is permuted again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.hashing import permuted
from claimweave.llm.common import stage, whole_text

#: numpy draws hypergeometric counts from at most this many rows.
DRAW_LIMIT = 10**9 - 1
ROWS_PER_GROUP = 10_000
LEAST_GROUPS = 16


def _draw(rng: np.random.Generator, wanted: int, free: int, n: int) -> int:
    """Of ``n`` rows drawn without return from ``free``, those that fall on the ``wanted`` ones.

    Beyond numpy's limit: the mode's weight by log-gamma, then outwards by exact ratios until the draw is used up.
    """
    if wanted <= 0 or n <= 0:
        return 0
    if free <= DRAW_LIMIT:
        return int(rng.hypergeometric(wanted, free - wanted, n))
    from math import exp, lgamma

    choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    lo, hi = max(0, n - (free - wanted)), min(n, wanted)
    mode = min(max((n + 1) * (wanted + 1) // (free + 2), lo), hi)
    weight = exp(choose(wanted, mode) + choose(free - wanted, n - mode) - choose(free, n))
    up = down = weight
    a = b = mode
    left = rng.random() - weight
    while left > 0 and (a < hi or b > lo):
        if a < hi:
            up *= (wanted - a) * (n - a) / ((a + 1) * (free - wanted - n + a + 1))
            a += 1
            left -= up
            if left <= 0:
                return a
        if b > lo:
            down *= b * (free - wanted - n + b) / ((wanted - b + 1) * (n - b + 1))
            b -= 1
            left -= down
            if left <= 0:
                return b
    return mode


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows of each partition × rows of each shard → counts with exactly these sums, one draw after another."""
    rng, room, out = np.random.default_rng(seed), list(shards), []
    for n in rows:
        free, line = sum(room), []
        for k in range(len(room)):
            x = _draw(rng, room[k], free, n)
            line.append(x)
            free, n = free - room[k], n - x
        room = [a - b for a, b in zip(room, line, strict=True)]
        out.append(line)
    return out


def shuffled(docs: DataFrame, n_shards: int = 16, seed: int = 7) -> DataFrame:
    """``docs`` with ``shard`` (int) and ``slot`` (bigint, gapless from 0 in each shard); sizes differ by one at most.

    The input is written first, with each row's partition and place in it, so that lost tasks are repeated on the same
    rows. A row's new place in its partition, its shard and its slot follow from these two numbers and the matrix;
    whole rows move once, to files of one shard. Values play no part: nulls, repeated rows and hot keys are spread like
    all others. Columns named shard or slot are replaced, all others stay as they are; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    d = docs.select(*[F.col(c).alias(f"_c_{c}") for c in kept])
    d = stage(d.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "shard-rows")
    counts = sorted((r["_part"], r["n"]) for r in d.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row per partition
    total = sum(n for _, n in counts)
    sizes = [total // n_shards + (k < total % n_shards) for k in range(n_shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    before = np.cumsum([[0] * n_shards, *matrix], axis=0)[:-1] if counts else []
    rows = [(p, n, np.cumsum(line).tolist(), (o - np.cumsum(line) + line).tolist()) for (p, n), line, o in zip(counts, np.array(matrix), before, strict=True)]
    lines = spark.createDataFrame(rows, "_part int, _n bigint, _bounds array<bigint>, _shift array<bigint>")
    dealt = d.join(F.broadcast(lines) if len(counts) <= 10_000 else lines, "_part")
    # the row number's lower 33 bits count within its partition
    local = permuted(F.col("_row").bitwiseAND(F.lit(2**33 - 1)), F.col("_n"), F.lit(seed), F.col("_part"))
    dealt = dealt.withColumn("_local", local).withColumn("shard", F.size(F.filter("_bounds", lambda b: b <= F.col("_local"))))
    held = F.get(F.array(*[F.lit(n).cast("bigint") for n in sizes]), F.col("shard"))
    slot = permuted(F.col("_local") + F.get("_shift", F.col("shard")), held, F.lit(seed), F.lit("shard"), F.col("shard"))
    # a shard's rows go to several tasks by ranges of slots, whatever its size
    groups = max(LEAST_GROUPS, -(-total // (n_shards * ROWS_PER_GROUP)))
    placed = dealt.withColumn("slot", slot).withColumn("_g", F.floor(F.col("slot") * groups / held))
    return placed.repartition("shard", "_g").select(*[F.col(f"_c_{c}").alias(c) for c in kept], "shard", "slot")


def row_size(text: str) -> Column:
    """UTF-8 bytes plus 1."""
    return (F.octet_length(whole_text(text)) + 1).cast("bigint")


def row_crc(text: str) -> Column:
    return F.crc32(whole_text(text).cast("binary")).cast("bigint")
