"""URL filter: host and path rules first, then logistic regression on character n-grams.

Native columns. The n-grams of host and path are hashed into a fixed number of buckets by
SQL functions; the model is fitted on a small labelled table of URLs and scored inside each
row, so the pages are neither shuffled nor joined.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import col

BUCKETS = 4096
GRAMS = (3, 4, 5)
#: Most labelled URLs that a model is fitted on.
MOST_LABELLED = 10_000
THRESHOLD = 0.5

#: (verdict, host, path): the longest fitting one decides.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: The labelled table: host names of either kind; each comes with several paths.
BLOCKED = (
    "casino-win casino-royal online-casino casinospin free-bets best-bets freebets bets-online "
    "sportbets cheap-pills pills-shop cheappills diet-pills adult-x adult-cam adultvideo xxx-adult "
    "spam-farm spamfarm link-spam spam-mail ads-track adstrack track-ads ads-server click-ads "
    "poker-win slots-win jackpot-win porn-tube viagra-shop"
).split()
ALLOWED = (
    "library museum weather history science garden cooking travel school university hospital "
    "theatre music gallery news journal review sports football tennis hiking bakery farmers "
    "market city council transport railway airport tracker trackfield winter window winners "
    "twin better alphabet betsy adults-education adelaide headset loads roads spamalot pillar "
    "pillow caterpillar casing cascade therin ththth ththon tionsh thering theron tionble tiontion "
    "thonth therly ththing ththre theres ththor ththat thertion therha thernd ththe ththti ther "
    "ciónla quela erund enlich ungder keitver mentou leaux eauxre streetmap docs wiki forum"
).split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: block) for the host names above, with each prefix, ending and path."""

    def named(names: list[str], label: float) -> DataFrame:
        each = F.explode(F.split(F.lit(" ".join(names)), " ")).alias("name")
        return spark.range(1).select(each, F.lit(label).alias("label"))

    hosts = named(BLOCKED, 1.0).union(named(ALLOWED, 0.0))
    forms = F.array(
        *[
            F.struct(F.lit(a).alias("before"), F.lit(b).alias("after"))
            for a, b in (
                ("https://www.", ".example.com/en/12.html"),
                ("http://blog.", ".example.org/fr/345/"),
                ("https://m.", ".example.net/es/67?page=2"),
                ("http://", ".example.com/de/890#top"),
            )
        ]
    )
    each = hosts.select("name", "label", F.inline(forms))
    return each.select(F.concat("before", "name", "after").alias("url"), "label")


def _parts(df: DataFrame, url_col: str) -> DataFrame:
    url = F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")
    found = F.coalesce(F.locate("://", col(url_col)) > 0, F.lit(False))
    out = df.withColumn("__u_rest", F.when(found, url).otherwise(""))
    host = F.regexp_extract("__u_rest", r"(?s)^([^/?#]*)", 1)
    return out.withColumns(
        {
            "host": F.translate(
                host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
            ),
            "path": F.regexp_extract("__u_rest", r"(?s)^[^/?#]*([^?#]*)", 1),
        }
    ).drop("__u_rest")


def _buckets(text: Column, tag: str, n: int) -> Column:
    def bucket(i):
        gram = F.xxhash64(F.lit(tag), F.substring(text, i, F.lit(n)))
        return F.pmod(gram, F.lit(BUCKETS)).cast("int")

    places = F.sequence(F.lit(1), F.length(text) - (n - 1))
    none = F.array().cast("array<int>")
    return F.when(F.length(text) >= n, F.transform(places, bucket)).otherwise(none)


def features(df: DataFrame) -> DataFrame:
    """Rows with ``host`` and ``path``, with ``__u_grams``: the distinct buckets of n-grams.

    Digits of the path are one sign, so page numbers teach nothing.
    """
    out = df.withColumns(
        {
            "__u_host": F.concat(F.lit("^"), "host", F.lit("$")),
            "__u_path": F.concat(F.lit("^"), F.regexp_replace("path", "[0-9]+", "0"), F.lit("$")),
        }
    )
    grams = [_buckets(F.col(f"__u_{p}"), p, n) for p in ("host", "path") for n in GRAMS]
    return out.withColumn("__u_grams", F.array_distinct(F.concat(*grams))).drop(
        "__u_host", "__u_path"
    )


def fit(labelled: DataFrame, most: int = MOST_LABELLED) -> tuple[list[float], float]:
    """Weights per bucket and intercept, from at most ``most`` rows of url, label."""
    known = labelled.where("url is not null and label is not null")
    known = known.orderBy(F.xxhash64("url"), "url").limit(most)
    rows = features(_parts(known, "url"))
    zeros = F.array_repeat(F.lit(0.0), BUCKETS)
    marked = F.transform(
        zeros, lambda x, i: F.when(F.array_contains("__u_grams", i), F.lit(1.0)).otherwise(x)
    )
    # named twice, so that the n-grams are made once per row and not once per bucket
    marked = F.when(F.size("__u_grams") >= 0, marked)
    vectors = rows.select("label", array_to_vector(marked).alias("features"))
    model = LogisticRegression(regParam=0.01, maxIter=40, standardization=False).fit(vectors)
    return [float(w) for w in model.coefficients], float(model.intercept)


def score(df: DataFrame, weights: list[float], intercept: float) -> DataFrame:
    """``df`` (with host and path) with ``score``, the probability to be blocked."""
    table = F.split(F.lit(",".join(f"{w:.8g}" for w in weights)), ",").cast("array<double>")
    z = F.aggregate(
        F.transform("__u_grams", lambda g: F.get(table, g)), F.lit(intercept), lambda a, b: a + b
    )
    rows = features(df)
    return rows.withColumn("score", 1 / (1 + F.exp(-z))).drop("__u_grams")


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits host and path, as struct(verdict, rule); null if none does."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [
        (
            ((F.col("host") == host) | F.col("host").endswith("." + host))
            & F.col("path").startswith(path),
            F.struct(F.lit(verdict).alias("verdict"), F.lit(host + path).alias("rule")),
        )
        for verdict, host, path in order
    ]
    found = F.when(*fits[0])
    for condition, result in fits[1:]:
        found = found.when(condition, result)
    return found


def judge(
    df: DataFrame, weights: list[float], intercept: float, url_col: str = "url", rules=RULES
) -> DataFrame:
    """``df`` with host, path, score, rule (null if none fits) and verdict.

    Null URLs, and those without ``://``, have empty host and path and are judged by the model
    like any other. Columns of these names are replaced, and those that begin with ``__u_``.
    """
    made = ("host", "path", "score", "rule", "verdict")
    kept = df.select(
        *[col(c) for c in df.columns if c not in made and c != url_col],
        col(url_col).cast("string").alias("__u_url"),
    )
    scored = score(_parts(kept, "__u_url"), weights, intercept).withColumn("__u_rule", rule_of(rules))
    verdict = F.when(F.col("score") > THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    out = scored.withColumns(
        {
            "rule": F.col("__u_rule.rule"),
            "verdict": F.coalesce(F.col("__u_rule.verdict"), verdict),
        }
    ).drop("__u_rule")
    return out.drop("__u_url") if url_col in made else out.withColumnRenamed("__u_url", url_col)
