"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host and a path prefix; it fits the host and its subdomains if the URL's path starts with
the prefix, and the longest rule that fits decides. URLs that rules decide are the labelled ones: the
trees learn from a bounded sample of them (the first `sample` by hash, so the same on each run) and
judge the URLs that no rule fits.

Suffixes and first path segments enter as statistics of the whole table: the suffix's share of all URLs,
and the smoothed share of block among all labelled URLs with that suffix or segment. A labelled URL's own
shares leave out its fold (by hash of the URL), so the trees never see a label in its own features, and
meet suffixes and segments without labels as they will among the URLs to judge.

Defined results: a null URL, or one without `://`, has an empty host and path and is judged by the
trees on the features of empty text; repeated rows and ties are judged row by row, alike; an empty
table gives an empty result; if the labelled URLs are all of one kind, or there are none, the verdict
beyond the rules is that kind, or allow; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_sample, written

#: (verdict, rule); a rule ends its host at the first slash.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SAMPLE, TREES, DEPTH, FOLDS, PRIOR = 6000, 10, 4, 5, 10
FEATURES = ("url_length", "host_length", "path_length", "labels", "depth", "digits", "digit_ratio", "hyphens", "entropy", "parameters", "has_fragment", "has_www", "suffix_share", "suffix_block", "segment_block")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def fits(rule: str) -> Column:
        name, _, prefix = rule.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")

    rule = reduce(lambda c, r: c.when(fits(r[1]), F.lit(r[1])), ordered, F.when(F.lit(False), F.lit(None).cast("string")))
    verdict = reduce(lambda c, r: c.when(fits(r[1]), F.lit(r[0])), ordered, F.when(F.lit(False), F.lit(None).cast("string")))
    return rule, verdict


def lexical(df: DataFrame) -> DataFrame:
    """df (url, host, path) with features that need only the URL itself."""
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda pattern: F.regexp_count(url, F.lit(pattern)).cast("double")
    letters = F.filter(F.array_sort(F.split(url, "")), lambda x: x != "")
    bits = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)
    begin = F.struct(F.lit("").alias("letter"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda a, x: F.when(a["letter"] == x, F.struct(x.alias("letter"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(x.alias("letter"), F.lit(1.0).alias("run"), (a["sum"] + bits(a["run"])).alias("sum")))
    runs = F.aggregate(letters, begin, step, lambda a: a["sum"] + bits(a["run"]))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    return df.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        F.regexp_count("path", F.lit("/[^/]")).cast("double").alias("depth"),
        count("[0-9]").alias("digits"),
        (count("[0-9]") / F.greatest(F.length(url), F.lit(1))).alias("digit_ratio"),
        count("-").alias("hyphens"),
        (F.log2(size) - runs / size).alias("entropy"),
        count("[?&][^=&#]+=").alias("parameters"),
        F.when(url.contains("#"), 1.0).otherwise(0.0).alias("has_fragment"),
        F.when(F.col("host").startswith("www."), 1.0).otherwise(0.0).alias("has_www"),
        F.substring_index("host", ".", -1).alias("_suffix"),
        F.regexp_extract("path", "^/([^/]*)", 1).alias("_segment"),
    )


def rates(labelled: DataFrame, key: str, prior: float, fold: bool) -> DataFrame:
    """key, <key>_block: the smoothed share of block among labelled URLs; with fold, for each fold those of the others."""
    by = labelled.groupBy(key, "_fold").agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n"))
    share = lambda b, n: ((b + PRIOR * prior) / (n + PRIOR)).alias(f"{key}_block")
    whole = by.groupBy(key).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    if not fold:
        return whole.select(key, share(F.col("b"), F.col("n")))
    own = by.select(key, "_fold", F.col("b").alias("own_b"), F.col("n").alias("own_n"))
    return whole.join(own, key).select(key, "_fold", share(F.col("b") - F.col("own_b"), F.col("n") - F.col("own_n")))


def featured(df: DataFrame, labelled: DataFrame, suffixes: DataFrame, prior: float, fold: bool) -> DataFrame:
    """df (of lexical()) with its features as a vector. Spark broadcasts a table of statistics only if it is small."""
    on = ["_fold"] if fold else []
    df = df.join(suffixes, "_suffix", "left")
    for key in ("_suffix", "_segment"):
        df = df.join(rates(labelled, key, prior, fold), [key, *on], "left")
    df = df.withColumnsRenamed({"_suffix_block": "suffix_block", "_segment_block": "segment_block"}).fillna({"suffix_block": prior, "segment_block": prior, "suffix_share": 0.0})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def trees(df: DataFrame) -> GBTClassificationModel:
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, featuresCol="features", labelCol="label").fit(df.select("features", "label").coalesce(4))


def split_rows(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(all URLs with host, path, rule and decided; the labelled ones with features of the URL itself, label and fold)."""
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).withColumns({"host": host, "path": path})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "decided": verdict})
    known = urls.where(F.col("decided").isNotNull()).withColumn("label", F.when(F.col("decided") == "block", 1.0).otherwise(0.0))
    return urls, written(lexical(known).withColumn("_fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")), "labelled-urls")


def suffix_shares(urls: DataFrame) -> DataFrame:
    suffix = F.substring_index("host", ".", -1).alias("_suffix")
    counts = written(urls.groupBy(suffix).agg(F.count(F.lit(1)).alias("n")), "suffixes")
    whole = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select("_suffix", (F.col("n") / F.lit(whole)).alias("suffix_share"))


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block; null where a rule decides)."""
    urls, labelled = split_rows(pages, rules)
    kinds = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    if len(kinds) < 2:
        other = "block" if 1.0 in kinds else "allow"
        return urls.select("page_id", "host", "path", "rule", F.coalesce("decided", F.lit(other)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    prior, suffixes = kinds[1.0] / sum(kinds.values()), suffix_shares(urls)
    model = trees(featured(bounded_sample(labelled, sample, "url", "page_id"), labelled, suffixes, prior, True))
    # A rule's verdict needs no features: only what is left goes through the trees.
    rest = model.transform(featured(lexical(urls.where(F.col("decided").isNull())), labelled, suffixes, prior, False))
    score = vector_to_array("probability")[1]
    by_rule = urls.where(F.col("decided").isNotNull()).select("page_id", "host", "path", "rule", F.col("decided").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return by_rule.unionByName(rest.select("page_id", "host", "path", "rule", F.when(F.col("prediction") == 1.0, "block").otherwise("allow").alias("verdict"), score.alias("score")))


def held_out_accuracy(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, sample: int = SAMPLE) -> tuple[float, float]:
    """Share of labelled URLs of one fold that trees and statistics of the other folds judge rightly, and that of their commoner kind."""
    urls, labelled = split_rows(pages, rules)
    known, unknown = labelled.where("_fold > 0"), labelled.where("_fold = 0")
    prior, suffixes = known.agg(F.avg("label")).first()[0], suffix_shares(urls)
    model = trees(featured(bounded_sample(known, sample, "url", "page_id"), known, suffixes, prior, True))
    got = model.transform(featured(unknown, known, suffixes, prior, False)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")), F.avg("label")).first()
    return got[0], max(got[1], 1 - got[1])
