"""Line dedup by content-defined chunks of lines.

A hash rolled over the hashes of the last lines sets the boundaries, so they move with the text when lines are put in
or taken out. Chunks of two lines and more that occur again anywhere later lose those occurrences, after their bytes
were found equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import doc_ref, let, stage, text_digest, whole_text

#: Base and modulus of the rolling hash over three lines.
BASE, MODULUS = 8191, 1_000_000_007
MEAN_LINES = 4


def _chunks(text: Column, mean_lines: int) -> Column:
    """Array of (text, lines); joined by line ends they give the text again."""

    def cut(lines: Column) -> Column:
        hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("bigint"))

        def ends(h: Column) -> Column:
            before = lambda i, k: F.coalesce(F.get(h, i - k), F.lit(0).cast("bigint"))
            rolled = F.transform(h, lambda x, i: (x + BASE * before(i, 1) + BASE * BASE * before(i, 2)) % MODULUS)
            marks = F.filter(F.transform(rolled, lambda r, i: F.when((r % mean_lines == 0) | (i == F.size(h) - 1), i + 1)), lambda i: i.isNotNull())
            return let(marks, lambda m: F.transform(m, lambda e, j: let(F.when(j == 0, 0).otherwise(F.get(m, j - 1)), lambda s: F.struct(F.array_join(F.slice(lines, s + 1, e - s), "\n").alias("text"), (e - s).alias("n")))))

        return let(hashes, ends)

    return let(F.split(text, "\n", -1), cut)


def repeated_chunks(docs: DataFrame, mean_lines: int) -> DataFrame:
    """``docs`` (ref, text) → ref, drop: the numbers of the chunks that occurred before."""
    c = docs.select("ref", F.posexplode(_chunks(F.col("text"), mean_lines)).alias("k", "c"))
    c = c.where((F.col("c.n") > 1) & F.col("c.text").rlike(r"[^\x20\x09-\x0D]")).select("ref", "k", F.col("c.text").alias("chunk"), text_digest(F.col("c.text")).alias("d"))
    at = F.struct("ref", "k")
    # grouping by the chunk itself compares bytes; a digest that stands for two texts is left alone
    same = c.groupBy("d", "chunk").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    again = stage(same.groupBy("d").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.max("last").alias("last")).where("texts = 1 and first <> last").select("d", "first"), "line-chunks")
    later = c.select("d", "ref", "k").join(again, "d").where(at != F.col("first"))
    return later.groupBy("ref").agg(F.collect_set("k").alias("drop"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", mean_lines: int = MEAN_LINES) -> DataFrame:
    """Input columns (as ``_c_<name>``) with ``kept_text``, ``n_lines``, ``n_removed_lines`` (bigint).

    The first occurrence (smallest doc_id, nulls last, then place) stays. Rows equal in id and text are one document and
    lose the same chunks. Null texts count as empty: one empty line, never removed, as blank chunks and single-line
    chunks are.
    """
    d = docs.select(*[F.col(c).alias(f"_c_{c}") for c in docs.columns], whole_text(text).alias("_text")).withColumn("_ref", doc_ref(F.col(f"_c_{doc_id}"), F.col("_text")))
    drops = stage(repeated_chunks(d.select(F.col("_ref").alias("ref"), F.col("_text").alias("text")), mean_lines), "line-drops")
    # a merge join at every size
    j = d.join(drops.withColumnRenamed("ref", "_ref").hint("merge"), "_ref", "left")
    kept = let(_chunks(F.col("_text"), mean_lines), lambda c: F.filter(c, lambda x, i: ~F.array_contains("drop", i)))
    j = j.withColumn("_kept", F.when(F.col("drop").isNotNull(), kept))
    n_lines = F.size(F.split("_text", "\n", -1)).cast("bigint")
    left = F.aggregate("_kept", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return j.select(*[f"_c_{c}" for c in docs.columns], F.when(F.col("drop").isNull(), F.col("_text")).otherwise(F.array_join(F.transform("_kept", lambda x: x["text"]), "\n")).alias("kept_text"), n_lines.alias("n_lines"), F.when(F.col("drop").isNull(), F.lit(0)).otherwise(n_lines - left).cast("bigint").alias("n_removed_lines"))


SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT r, row_number() OVER (ORDER BY doc_id NULLS LAST, md5(t)) AS o FROM d),
l AS (SELECT r, i, string_split(t, chr(10))[i] AS x, n FROM (SELECT r, t, len(string_split(t, chr(10))) AS n, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)),
h AS (SELECT *, ('0x' || substr(md5(x), 1, 7))::BIGINT AS h FROM l),
b AS (SELECT *, CASE WHEN i = n OR ((h + 8191 * coalesce(lag(h, 1) OVER w, 0) + 67092481 * coalesce(lag(h, 2) OVER w, 0)) % 1000000007) % 4 = 0 THEN 1 ELSE 0 END AS cut FROM h WINDOW w AS (PARTITION BY r ORDER BY i)),
g AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
c AS (SELECT r, k, string_agg(x, chr(10) ORDER BY i) AS chunk, count(*) AS n, bool_or(regexp_matches(x, '[^\x20\x09-\x0D]')) AS has_word FROM g GROUP BY r, k),
q AS (SELECT c.*, has_word AND n > 1 AND row_number() OVER (PARTITION BY chunk, has_word AND n > 1 ORDER BY o, k) > 1 AS gone FROM c JOIN o USING (r))
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_removed_lines, sha256(coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM q JOIN d USING (r) GROUP BY r, doc_id
"""
