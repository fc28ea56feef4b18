"""URL filters: host and path rules, and a model for the URLs that no rule judges.

Method: gradient-boosted trees on lexical features of the URL (length, depth, digit ratio, entropy, parameters and the
statistics of its suffix), trained from labelled URLs. The labels are the verdicts of the rules, or a label column.
Everything is a DataFrame or SQL function or a Spark ML estimator; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: (host, path, verdict): a rule fits its host and all subdomains where the path begins so; the longest wins.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Labelled URLs that the model learns from, and the trees.
SAMPLE, TREES, DEPTH = 20_000, 12, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "has_fragment", "secure", "longest_token", "suffix_allow", "suffix_share"]


def parsed(pages: DataFrame) -> DataFrame:
    """pages with host and path; both are empty where the url is null or has no ://."""
    u = F.coalesce("url", F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def ruled(pages: DataFrame, rules=None) -> DataFrame:
    """pages with rule (null where none fits) and rule_verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules or RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def lexical(pages: DataFrame) -> DataFrame:
    """pages with the lexical features but the suffix statistics, and suffix."""
    u = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(u), F.lit(1)).cast("double")
    digits = F.length(F.regexp_replace(u, "[^0-9]", ""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / size
    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0), lambda a, c: a - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    tokens = F.transform(F.split(u, "[^A-Za-z0-9]+"), lambda t: F.length(t))
    values = {
        "length": size,
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda t: t != "")),
        "labels": F.size(F.split("host", r"\.")),
        "digit_ratio": digits / size,
        "host_digits": F.length(F.regexp_replace("host", "[^0-9]", "")),
        "hyphens": F.length(F.regexp_replace("host", "[^-]", "")),
        "entropy": entropy,
        "parameters": F.when(query != "", F.size(F.split(query, "&"))).otherwise(0),
        "has_fragment": F.contains(u, F.lit("#")),
        "secure": F.startswith(u, F.lit("https")),
        "longest_token": F.array_max(tokens),
    }
    return pages.withColumns({k: v.cast("double") for k, v in values.items()}).withColumn("suffix", F.regexp_extract("host", r"([^.]*\.[^.]*|[^.]*)$", 1))


def with_suffix(pages: DataFrame, stats: DataFrame, base: float) -> DataFrame:
    joined = pages.join(stats, "suffix", "left")
    return joined.withColumn("suffix_allow", F.coalesce("suffix_allow", F.lit(base))).withColumn("suffix_share", F.coalesce("suffix_share", F.lit(0.0)))


def judge(pages: DataFrame, rules=None, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """pages with host, path, rule, verdict and score (chance of allow; 1 or 0 where a rule decides).

    The model learns from at most sample URLs that a rule judges, chosen by a hash. Where the rules label no URL, or
    all alike, the verdict of the others is that label (allow without any). A null or odd url is judged by the model on
    the features of an empty one. Rows that are repeated get a row each.
    """
    own = ["host", "path", "rule", "rule_verdict", "verdict", "score", "suffix", *FEATURES]
    pages = pages.drop(*own)
    kept = pages.columns
    marked = lexical(ruled(parsed(pages), rules))
    learn = marked.filter("rule_verdict is not null").withColumn("label", (F.col("rule_verdict") == "allow").cast("double"))
    learn = learn.select("suffix", "label", *FEATURES[:-2], F.xxhash64("url").alias("h"), "url").orderBy("h", "url").limit(sample).drop("url", "h")
    learn = C.written(learn, "labelled")
    n, mean = learn.agg(F.count("*"), F.coalesce(F.avg("label"), F.lit(1.0))).first()
    if mean in (0.0, 1.0):
        scored = marked.withColumn("p", F.lit(mean))
    else:
        stats = learn.groupBy("suffix").agg(((F.sum("label") + F.lit(20 * mean)) / (F.count("*") + 20)).alias("suffix_allow"), (F.count("*") / F.lit(float(n))).alias("suffix_share"))
        stats = F.broadcast(stats.filter(F.col("suffix_share") * n >= 5))  # at most sample / 5 suffixes
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="__features")
        seen = assemble.transform(with_suffix(learn, stats, mean)).select("label", "__features")
        learner = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=trees, maxDepth=depth, seed=1, predictionCol="__said")
        model = learner.setRawPredictionCol("__raw").setProbabilityCol("__p").fit(seen)
        scored = model.transform(assemble.transform(with_suffix(marked, stats, mean))).withColumn("p", vector_to_array("__p")[1])
    score = F.when(F.col("rule_verdict") == "allow", 1.0).when(F.col("rule_verdict") == "block", 0.0).otherwise(F.col("p"))
    return scored.select(*kept, "host", "path", "rule", F.when(score >= 0.5, "allow").otherwise("block").alias("verdict"), score.alias("score"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "pages").select("page_id", "url"))
