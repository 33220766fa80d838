"""URL filter: host and path rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import let, small, stage

#: (verdict, host, path): the rule holds for the host and its subdomains where the path starts so.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words of host names by which URLs are labelled for training: gambling, unlicensed medicine, advertising.
SEED_WORDS = ("ads", "bets", "betting", "casino", "pills", "poker", "track", "viagra", "win")
#: Labelled URLs used for fitting, at most, in the order of their md5.
TRAIN_ROWS = 20_000
TREES, DEPTH = 20, 4
SMOOTH = 20.0

FEATURES = ["url_length", "host_length", "path_length", "depth", "host_labels", "host_hyphens", "digit_ratio", "host_digits", "host_entropy", "path_entropy", "n_params", "query_length", "suffix_log_n", "suffix_rate", "domain_log_n", "domain_rate"]


def split_url(url: str) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and rest (query) of a URL; all empty without ``://`` or if null."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    cut = F.instr(u, "://")
    rest = F.when(cut > 0, F.substring(u, cut + 3, F.length(u))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    after = F.substring(rest, F.length(raw) + 1, F.length(u))
    path = F.regexp_extract(after, r"\A[^?#]*", 0)
    query = F.regexp_extract(F.substring(after, F.length(path) + 1, F.length(u)), r"\A\?([^#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path, query


def rule_of(rules=RULES, host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule as host + path, verdict) of the longest fitting rule, or nulls."""
    h, p = F.col(host), F.col(path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rh, rp in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is tried first
        fits = ((h == rh) | h.endswith(f".{rh}")) & p.startswith(rp)
        rule, verdict = F.when(fits, F.lit(rh + rp)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _count(c: Column, what: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))).cast("double")


def _entropy(c: Column) -> Column:
    """Bits per character."""
    def bits(s: Column) -> Column:
        n = F.length(s).cast("double")
        each = F.transform(F.array_distinct(F.split(s, "")), lambda x: F.length(s) - F.length(F.replace(s, x, F.lit(""))))
        share = lambda k: k / n * F.log2(k / n)
        return F.when(n > 0, -F.aggregate(F.filter(each, lambda k: k > 0), F.lit(0.0), lambda a, k: a + share(k))).otherwise(0.0)

    return let(c, bits)


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host, path and the features that a URL has by itself."""
    host, path, query = split_url(url)
    d = urls.withColumns({"host": host, "path": path, "_query": query}).withColumn("_u", F.coalesce(F.col(url).cast("string"), F.lit("")))
    h, p, u = F.col("host"), F.col("path"), F.col("_u")
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", "")).cast("double")
    n = F.length(u).cast("double")
    d = d.withColumns(
        {
            "url_length": n,
            "host_length": F.length(h).cast("double"),
            "path_length": F.length(p).cast("double"),
            "depth": _count(p, "/"),
            "host_labels": _count(h, "."),
            "host_hyphens": _count(h, "-"),
            "digit_ratio": F.when(n > 0, digits(u) / n).otherwise(0.0),
            "host_digits": digits(h),
            "host_entropy": _entropy(h),
            "path_entropy": _entropy(p),
            "n_params": F.when(F.col("_query") == "", 0.0).otherwise(_count(F.col("_query"), "&") + 1),
            "query_length": F.length("_query").cast("double"),
            "_suffix": F.substring_index(h, ".", -1),
            "_domain": F.substring_index(h, ".", -2),
        }
    )
    return d.drop("_query", "_u")


@dataclass
class UrlModel:
    trees: GBTClassificationModel | None
    suffixes: DataFrame
    domains: DataFrame
    rate: float


def _with_statistics(d: DataFrame, suffixes: DataFrame, domains: DataFrame, rate: float) -> DataFrame:
    for key, table in (("suffix", suffixes), ("domain", domains)):
        d = d.join(table.withColumnRenamed("key", f"_{key}"), f"_{key}", "left")
        d = d.withColumns({f"{key}_log_n": F.log1p(F.coalesce("n", F.lit(0)).cast("double")), f"{key}_rate": F.coalesce("r", F.lit(rate))}).drop("n", "r")
    return d


def fit(labelled: DataFrame, url: str = "url", label: str = "label", rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> UrlModel:
    """Trees from labelled URLs (label 1: block), on at most ``rows`` of them; their suffix statistics come from the same rows.

    With labels of one kind only, or none, there are no trees and every URL gets the rate of the labels.
    """
    train = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("label")).where("url is not null and label is not null").distinct()
    train = stage(lexical(train.withColumn("_o", F.md5("url")).orderBy("_o", "url", "label").limit(rows).drop("_o")), "url-train")
    mean = train.agg(F.avg("label")).first()[0]
    rate = float(mean) if mean is not None else 0.0

    def table(key: str, name: str) -> DataFrame:
        t = train.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), ((F.sum("label") + SMOOTH * rate) / (F.count("*") + SMOOTH)).alias("r"))
        return small(stage(t, name))

    suffixes, domains = table("_suffix", "url-suffixes"), table("_domain", "url-domains")
    if rate in (0.0, 1.0):
        return UrlModel(None, suffixes, domains, rate)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_with_statistics(train, suffixes, domains, rate)).select("features", "label")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=32).fit(ready.coalesce(1))
    return UrlModel(model, suffixes, domains, rate)


def judged(urls: DataFrame, model: UrlModel, url: str = "url", rules=RULES) -> DataFrame:
    """Input columns (as ``_c_<name>``) with host, path, rule, verdict, probability (of block, by the trees).

    The longest fitting rule decides, else the trees. Null and broken URLs have an empty host and path and are judged by
    their features like others; repeated rows are judged alike.
    """
    d = urls.select(*[F.col(c).alias(f"_c_{c}") for c in urls.columns])
    d = _with_statistics(lexical(d, f"_c_{url}"), model.suffixes, model.domains, model.rate)
    if model.trees is None:
        d = d.withColumn("p_block", F.lit(model.rate))
    else:
        from pyspark.ml.functions import vector_to_array

        d = model.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(d)).withColumn("p_block", vector_to_array("probability")[1])
    rule, verdict = rule_of(rules)
    method = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return d.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, method)).select(*[f"_c_{c}" for c in urls.columns], "host", "path", "rule", "verdict", "p_block")


def seed_labelled(urls: DataFrame, url: str = "url", words: tuple[str, ...] = SEED_WORDS) -> DataFrame:
    """(url, label): 1 where a word of the host name is one of ``words``."""
    host, _, _ = split_url(url)
    parts = F.split(host, r"[^a-z0-9]+")
    return urls.select(F.col(url).alias("url"), F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words])).cast("int").alias("label"))
