"""Near-duplicate vectors by a pivot-permutation index.

Reference vectors, the pivots, are drawn from the data. A vector is described by its nearest pivots in order of
nearness, and listed under the first few of them. Vectors of one list that share enough of their nearest pivots are
candidates, and the cosine in double precision decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import small, stage
from claimweave.llm.components import components

#: Nearest pivots that describe a vector, those under which it is listed, and how many two candidates must share.
NEAREST, LISTED, SHARED = 16, 6, 4
#: Pivots by the number of vectors: PIVOTS_PER_ROOT times its square root, inside these bounds. They are chosen among
#: DRAWN times as many vectors, none within a cosine of APART of an earlier one: a dense group has one pivot, not a share
#: of all pivots in an order that chance decides.
PIVOTS_PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS, DRAWN, APART = 2.0, 32, 4096, 4, 0.8
#: Vectors of a list's part; two parts meet in a block.
PART = 1024
_INDEX = "digest binary, label string, dim int, copies bigint, embedding array<double>, pivots array<int>"


def usable(embedding: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Equally long lists as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _describe(pivots: dict[int, np.ndarray], nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                x = unit(_matrix(rows.column("embedding")))
                p = pivots.get(dim)
                if p is None:  # no pivot of this length: all such vectors stand in one list
                    near = np.zeros((len(x), 1), np.int32)
                else:
                    near = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :nearest].astype(np.int32)
                ends = np.arange(len(x) + 1, dtype=np.int32)
                lists = [pa.ListArray.from_arrays(ends * a.shape[1], pa.array(a.ravel())) for a in (x, near)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("digest", "label", "dim", "copies")), *lists], names=["digest", "label", "dim", "copies", "embedding", "pivots"])

    return run


def fit_pivots(once: DataFrame, per_root: float = PIVOTS_PER_ROOT, least: int = LEAST_PIVOTS, most: int = MOST_PIVOTS) -> dict[int, np.ndarray]:
    """Pivots by vector length, at most ``most`` each, from DRAWN times as many vectors drawn by a hash of their digest.

    ``once`` is a written table of distinct vectors. The draw is cut by a threshold first, so no task sends more than
    its share.
    """
    n = once.count()
    m = int(min(most, max(least, per_root * n**0.5)))
    place = F.pmod(F.xxhash64("digest", F.lit(11)), F.lit(1 << 40))
    share = min(1.0, (2.0 * DRAWN * m + 16.0) / max(n, 1))
    drawn = once.where(place < int(share * (1 << 40))).select("dim", "embedding", place.alias("place"), "digest").orderBy("place", "digest").limit(DRAWN * m).collect()
    rows: dict[int, list] = {}
    for r in drawn:
        rows.setdefault(r.dim, []).append(r.embedding)
    return {dim: spread_out(unit(np.array(x, np.float64)), m) for dim, x in rows.items()}


def spread_out(x: np.ndarray, m: int, apart: float = APART) -> np.ndarray:
    """The first ``m`` unit rows none of which lies within a cosine of ``apart`` of an earlier one."""
    free = np.ones(len(x), bool)
    chosen: list[int] = []
    for k in range(len(x)):
        if free[k]:
            chosen.append(k)
            if len(chosen) == m:
                break
            free &= x @ x[k] < apart
    return x[chosen]


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what a block's links (a symmetric matrix) join, one fewer than there are vectors at most."""
    unseen = linked.any(axis=1)
    out = []
    for start in range(len(linked)):
        if not unseen[start]:
            continue
        unseen[start] = False
        todo = [start]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(linked[x] & unseen)
            unseen[new] = False
            out += [(x, y) for y in new.tolist()]
            todo += new.tolist()
    return out


def _block(t: pa.Table, listed: int, shared: int, threshold: float) -> Iterator[pa.RecordBatch]:
    if t.num_rows < 2:
        return
    list_of = t["pivot"][0].as_py()
    x = _matrix(t["embedding"].combine_chunks())
    copies, part = t["copies"].to_numpy(), t["part"].to_numpy()
    near = _matrix(t["pivots"].combine_chunks()).astype(np.int64)
    names, code = np.unique(near, return_inverse=True)
    code = code.reshape(near.shape)
    has = np.zeros((len(x), len(names)), np.float32)
    np.put_along_axis(has, code, 1, axis=1)
    # the pivots under which both are listed; the pair belongs to the first of these lists
    first = np.zeros((len(x), len(names)), np.float32)
    np.put_along_axis(first, code[:, :listed], 1, axis=1)
    first = first[:, : np.searchsorted(names, list_of)]
    linked = (has @ has.T >= min(shared, near.shape[1])) & (first @ first.T == 0)
    np.fill_diagonal(linked, False)
    if part.min() != part.max():
        linked &= part[:, None] != part[None, :]
    if not linked.any():
        return
    linked &= x @ x.T >= threshold
    linked |= linked.T
    degree = linked @ copies
    at = np.flatnonzero(degree)
    if len(at):
        digest = t["digest"].combine_chunks()
        edges = np.array(_forest(linked))
        none = pa.nulls(len(at), pa.binary())
        yield pa.RecordBatch.from_arrays([digest.take(pa.array(at)).cast(pa.binary()), pa.array(degree[at].astype(np.int64)), none], names=["digest", "links", "other"])
        yield pa.RecordBatch.from_arrays([digest.take(pa.array(edges[:, 0])).cast(pa.binary()), pa.array(np.zeros(len(edges), np.int64)), digest.take(pa.array(edges[:, 1])).cast(pa.binary())], names=["digest", "links", "other"])


def _compare(listed: int, shared: int, threshold: float):
    keys = ("label", "dim", "pivot", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # of a block that goes on in the next batch
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_pylist() for c in keys]
            rows = list(zip(*cols, strict=True))
            at = 0
            for k in range(1, len(rows) + 1):
                if k < len(rows) and rows[k] == rows[at]:
                    continue
                if rows[at] != last and kept:
                    yield from _block(pa.Table.from_batches(kept), listed, shared, threshold)
                    kept = []
                kept.append(batch.slice(at, k - at))
                last, at = rows[at], k
        if kept:
            yield from _block(pa.Table.from_batches(kept), listed, shared, threshold)

    return run


def links(once: DataFrame, threshold: float = 0.93, nearest: int = NEAREST, listed: int = LISTED, shared: int = SHARED) -> DataFrame:
    """``once`` (digest, label, dim, copies, embedding; a written table of distinct vectors) → digest, links, other.

    Rows with ``links`` count linked vectors, copies included, a block's share each; rows with ``other`` are links that
    join what all links join. A list is dealt into parts and each two parts meet in a block of bounded size, where the
    pairs are formed; a pair of vectors belongs to the first list that holds both.
    """
    pivots = fit_pivots(once)
    index = stage(once.mapInArrow(_describe(pivots, nearest), _INDEX), "vector-index")
    first = F.slice("pivots", 1, listed)
    held = index.select("label", "dim", F.explode(first).alias("pivot")).groupBy("label", "dim", "pivot").agg(F.count("*").alias("n")).where("n > 1")
    lists = stage(held.select("label", "dim", "pivot", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "vector-lists")
    posted = index.withColumn("pivot", F.explode(first)).join(small(lists), ["label", "dim", "pivot"])
    part = F.pmod(F.xxhash64("digest", F.lit(13)), F.col("parts")).cast("int")
    dealt = posted.withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"low": F.least("part", "with"), "high": F.greatest("part", "with")}).drop("with", "parts")
    key = ["label", "dim", "pivot", "low", "high"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare(listed, shared, threshold), "digest binary, links bigint, other binary")


def linked(docs: DataFrame, carry: list[str], vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93, **kw) -> DataFrame:
    """One row per input row: ``carry`` (as ``_c_<name>``), n_links, component_id, kept.

    Only vectors of one label and one length are compared; a null label, and a vector that is null, zero or holds a
    null or non-finite component, links with nothing and is a component of its own id. Equal vectors link with each
    other, repeated rows too; ids may be null, and a component without any id has none. An empty table gives no rows.
    """
    vector = F.col(embedding).cast("array<double>")
    d = docs.select(*[F.col(c).alias(f"_c_{c}") for c in carry], F.col(vec_id).cast("bigint").alias("_id"), F.col(label).cast("string").alias("_label"), vector.alias("_v"))
    text = F.concat_ws("|", F.col("_label"), F.col("_v").cast("string"))
    d = d.withColumn("_digest", F.when(F.col("_label").isNotNull() & usable(F.col("_v")), F.unhex(F.md5(text))))
    valid = d.where(F.col("_digest").isNotNull())
    once = valid.groupBy("_digest").agg(F.count("*").alias("copies"), F.min("_id").alias("id"), F.first(F.struct("_label", "_v")).alias("_f"))
    once = stage(once.select(F.col("_digest").alias("digest"), "copies", "id", F.col("_f._label").alias("label"), F.size("_f._v").alias("dim"), F.col("_f._v").alias("embedding")), "vectors")
    found = stage(links(once.drop("id"), threshold, **kw), "vector-links")
    degree = found.groupBy("digest").agg(F.sum("links").alias("links"))
    root = stage(components(found.where(F.col("other").isNotNull()).select(F.col("digest").alias("a"), F.col("other").alias("b"))), "vector-roots")
    named = stage(once.select("digest", "copies", "id").join(root.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest")), "vector-roots")
    least = stage(named.groupBy("root").agg(F.min("id").alias("component_id")), "vector-least")
    marks = named.join(least.hint("merge"), "root").join(degree, "digest", "left")
    marks = stage(marks.select(F.col("digest").alias("_digest"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("component_id")), "vector-marks")
    joined = d.drop("_label", "_v").join(marks, "_digest", "left")
    component = F.when(F.col("_digest").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    out = joined.select(*[f"_c_{c}" for c in carry], F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("_id"))
    return out.withColumn("kept", F.col("_id").eqNullSafe(F.col("component_id"))).drop("_id")


SQL = r"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a AS node, least(a, b) AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(least(m.root, e.vec_id), e.vec_id) AS component_id, coalesce(least(m.root, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN m ON m.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
