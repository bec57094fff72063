"""URL filters: host and path rules, and for the rest logistic regression on hashed character n-grams of both.

The model is trained from a small labelled URL table (a bounded sample, at most ``MOST_LABELLED`` rows): here the
urls that a rule decides. Parsing, rules and features are built-in expressions; the model is Spark's own.

Defined results: a null url or one without ``://`` has an empty host and path and no rule; without labelled urls of
both verdicts the method allows everything; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import lower_ascii

# fixed values: rules, a host with its path, and the verdict
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block",
         "net/fr/": "block"}
MOST_LABELLED = 4000
DIMENSIONS = 1 << 13
GRAMS = (3, 4, 5)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(coalesce(cast(url as string), ''), "
                                                  "instr(coalesce(cast(url as string), ''), '://') + 3)")).otherwise("")
    return (pages.select("page_id", F.col("url"), rest.alias("_rest"))
            .withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
            .select("page_id", "url", lower_ascii(F.col("_host")).alias("host"),
                    F.regexp_extract(F.expr("substring(_rest, char_length(_host) + 1)"), "^[^?#]*", 0).alias("path")))


def rule_of(host: Column, path: Column) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(RULES, key=len):  # a longer one replaces a shorter one
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in RULES.items():
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def featured(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path) with the vector ``features`` of hashed character n-grams."""
    characters = F.split(F.concat(F.lit("^"), F.col("host"), F.col("path"), F.lit("$")), "")

    def grams(n: int) -> Column:
        return F.when(F.size("_url") >= n, F.transform(
            F.sequence(F.lit(0), F.size("_url") - n), lambda i: F.concat(*[F.get("_url", i + j) for j in range(n)]))
        ).otherwise(F.array().cast("array<string>"))

    with_grams = urls.withColumn("_url", characters).withColumn("_grams", F.concat(*map(grams, GRAMS)))
    return HashingTF(numFeatures=DIMENSIONS, binary=True, inputCol="_grams", outputCol="features").transform(
        with_grams).drop("_url", "_grams")


def train(labelled: DataFrame) -> LogisticRegressionModel | None:
    """A model of a labelled URL table (host, path, verdict), at most MOST_LABELLED rows of it by hash; None if it
    does not hold both verdicts."""
    sample = (labelled.select("host", "path", (F.col("verdict") == "block").cast("double").alias("label")).distinct()
              .orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(MOST_LABELLED))
    sample = featured(sample).cache()
    try:
        if sample.select("label").distinct().count() < 2:
            return None
        return LogisticRegression(maxIter=100, regParam=0.0001, standardization=False).fit(sample)
    finally:
        sample.unpersist()


def judge(pages: DataFrame, model: LogisticRegressionModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's probability of block; null without a model)."""
    urls = parsed(pages).withColumn("rule", rule_of(F.col("host"), F.col("path")))
    model = model or train(urls.where("rule IS NOT NULL").select("host", "path", verdict_of(F.col("rule")).alias("verdict")))
    if model is None:
        scored = urls.withColumn("score", F.lit(None).cast("double"))
    else:
        from pyspark.ml.functions import vector_to_array
        scored = model.transform(featured(urls)).withColumn("score", vector_to_array("probability")[1])
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce(verdict_of(F.col("rule")), method).alias("verdict"), "score")
