"""Seeded, partition-independent draws: every random choice is an md5 of seed and key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_md5(seed: str, *cols: Column | str) -> Column:
    """md5 of ``seed|col|col…``; a total order that acts as a shuffle."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))


def hash_bucket(digest: Column, n_hex: int = 4) -> Column:
    """Integer of the first ``n_hex`` hex digits."""
    return F.conv(F.substring(digest, 1, n_hex), 16, 10).cast("bigint")


def unit_draw(digest: Column) -> Column:
    """Uniform draw in [0, 1) with 16 bits."""
    return hash_bucket(digest, 4) / F.lit(65536.0)


def fine_draw(digest: Column) -> Column:
    """Uniform draw in (0, 1) with 48 bits."""
    return (hash_bucket(digest, 12) + F.lit(0.5)) / F.lit(281474976710656.0)


def permuted(place: Column, size: Column, *seed: Column | str | int, rounds: int = 48) -> Column:
    """Bijection of 0 … ``size`` - 1, keyed by ``seed``: where ``place`` goes. No sort, no window, any size.

    In each round a place and its mirror about a drawn number swap or stay together, as a bit drawn for the pair says;
    so every round is a bijection whatever the size.
    """
    key = F.xxhash64(*[F.lit(s) if not isinstance(s, Column) else s for s in seed])
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def walk(k: Column) -> Column:
        def step(x: Column, i: Column) -> Column:
            mirror = F.pmod(F.pmod(F.xxhash64(k, i), size) - x, size)
            return once(mirror, lambda m: F.when(F.xxhash64(k, i, F.greatest(x, m)).bitwiseAND(F.lit(1)) == 1, m).otherwise(x))

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), place.cast("bigint"), step)

    return F.when(size > 1, once(key, walk)).otherwise(place.cast("bigint"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _walk(x: np.ndarray, n: np.ndarray, k: np.ndarray, rounds: int) -> np.ndarray:
    """Where places ``x`` of 0 … ``n`` - 1 go under the bijections keyed by ``k`` (broadcast against each other)."""
    step = 0x9E3779B97F4A7C15
    for i in range(1, rounds + 1):
        own = _mixed(k + np.uint64(i * step % 2**64))
        mirror = own % n + n - x
        mirror = np.where(mirror >= n, mirror - n, mirror)
        swap = _mixed(own ^ (np.maximum(x, mirror) + np.uint64(1)) * np.uint64(step)) & np.uint64(1)
        x = np.where(swap == 1, mirror, x)
    return x


def replicate_keys(keys: np.ndarray, reps: int) -> np.ndarray:
    """A key per group and replicate."""
    return _mixed(keys.astype(np.int64).astype(np.uint64)[:, None] + np.arange(1, reps + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))


def whole_permutations(keys: np.ndarray, n: int, reps: int, rounds: int = 32) -> np.ndarray:
    """The bijections of ``permuted_often`` for groups of equal size: an array (group, replicate, place)."""
    x = np.broadcast_to(np.arange(n, dtype=np.uint64), (len(keys), reps, n))
    return _walk(x, np.uint64(n), replicate_keys(keys, reps)[:, :, None], rounds).astype(np.int64)


def permuted_often(place: Column, size: Column, key: Column, reps: int, rounds: int = 32) -> Column:
    """Places of ``place`` under ``reps`` bijections of 0 … ``size`` - 1, as an array; a bigint ``key`` names the group.

    The bijections of ``permuted``, for many replicates of a row at once, over Arrow batches.
    """

    @F.pandas_udf("array<bigint>")
    def draw(places: pd.Series, sizes: pd.Series, keys: pd.Series) -> pd.Series:
        n = sizes.to_numpy(np.int64)[:, None].astype(np.uint64)
        x = np.repeat(places.to_numpy(np.int64)[:, None], reps, axis=1).astype(np.uint64)
        return pd.Series(list(_walk(x, n, replicate_keys(keys.to_numpy(np.int64), reps), rounds).astype(np.int64)))

    return draw(place, size, key)
