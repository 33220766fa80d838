"""Documents → sentences → first copy of each → quality filter → profile by source."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.functions.text import good_sentence, norm_ascii
from claimweave.operators.corpus import keep_first
from claimweave.plans.registry import query
from claimweave.plans.tables import SENTENCES, sentences


@query(
    "flagship_sentence_profile",
    rf"""WITH {SENTENCES},
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(sentence), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS key FROM sentences),
d AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, sent_id) = 1),
w AS (SELECT *, len(list_filter(string_split_regex(sentence, '[ \t\r\n]+'), lambda x: x <> '')) AS nw FROM d)
SELECT source, count(*) AS n_sentences, count(DISTINCT doc_id) AS n_docs, CAST(sum(length(sentence)) AS BIGINT) AS n_chars
FROM w WHERE length(sentence) BETWEEN 40 AND 600 AND nw >= 8 AND length(regexp_replace(sentence, '[^\p{{L}}]', '', 'g')) >= 30
 AND NOT regexp_matches(sentence, '(?i)^(Fig(ure)?|Table|Supplementary)\s')
 AND (length(sentence) - length(regexp_replace(sentence, '[\[\]()0-9]', '', 'g'))) / length(sentence) <= 0.3
 AND NOT (len(regexp_extract_all(sentence, '[A-Z][a-z]+\s[a-z]+')) > 3 AND nw < 20)
GROUP BY source""",
)
def sentence_profile(spark, sf):
    s = sentences(spark, sf).select("doc_id", "source", "sent_id", "sentence")
    s = s.withColumn("key", norm_ascii("sentence"))
    first = keep_first(s, ["key"], ["doc_id", "sent_id"])
    return (
        first.where(good_sentence("sentence"))
        .groupBy("source")
        .agg(
            F.count("*").alias("n_sentences"),
            F.countDistinct("doc_id").alias("n_docs"),
            F.sum(F.length("sentence").cast("bigint")).alias("n_chars"),
        )
    )
