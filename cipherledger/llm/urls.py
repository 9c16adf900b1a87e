"""URL filter: rules first, then a logistic regression on hashed character n-grams.

The model is fitted on a small labelled table and compiled to one column expression: an
array of weights, read at the hash of every n-gram of the bracketed host and path. Scoring
is row-local and needs no shuffle, so a hot host costs no more than others.

Defined cases: a null url or one without ``://`` has an empty host and path; such urls match
no rule and are scored on their empty n-grams. Repeated rows keep one result each, other
columns are not read, an empty table gives an empty result. Labelled rows with a null url or
label are ignored; without both labels present every url is allowed.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZES, DIMENSIONS = (3, 4, 5), 4096

# Rule (host and path), verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# A small labelled table (host and path, 1: block), made by hand: hosts named by what they
# are about. No name is taken from a corpus.
UNWANTED = ("onlinecasino", "casino-bonus", "poker-slots", "best-slots", "bigwin", "winner-prize", "lottery-cash", "buy-pills", "pillshop", "pharmacy-deals", "cheapmeds", "diet-meds",
            "spamlinks", "link-farm", "content-farm", "seo-spam", "adserver", "ads-banner", "popup-ads", "clicktrack", "tracker-pixel", "adult-video", "adultchat", "xxx-cams",
            "payday-loans", "cheap-replica", "free-cash", "hot-singles")
WANTED = ("library", "weather", "history", "theatre", "reading", "museum", "school", "bookshop", "music", "travel", "garden", "cooking", "science", "sports", "housing", "nursery", "forest",
          "station", "together", "thread", "another", "within", "farther", "northern", "heritage", "newspaper", "university", "hospital", "orchard", "engineering", "shelter", "wandering", "harvest", "stories",
          "english", "danish", "spanish", "finnish", "gardening", "allotment", "kindergarten", "fashion", "fishing", "nationwide", "ambitions", "traditions", "months", "north", "health", "mathematics",
          "vegetables", "tables", "lessons", "authors", "parish", "others", "thinking", "anthem", "ringing", "inn")
PLACES = (("www.", ".example.com", "en/17"), ("", ".example.org", "guide/start"), ("blog.", ".example.com", "fr/2204.html"), ("m.", ".example.org", "es/9/"))
LABELLED = tuple((f"http://{sub}{host}{end}/{path}", label) for hosts, label in ((UNWANTED, 1), (WANTED, 0)) for host in hosts for sub, end, path in PLACES)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lower-cased, and path, as given."""
    def part(k: int) -> Column:
        return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or one above it, and whose path begins the
    url's; null if none fits."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # longer rules are asked first
        h, p = rule.split("/", 1)
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), F.lit(rule)).otherwise(out)
    return out


def n_gram_slots(host: Column, path: Column, sizes=SIZES, dimensions: int = DIMENSIONS) -> Column:
    """Slots of all character n-grams of host and path, each between brackets of its own."""
    def grams(text: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(dimensions)).cast("int"))

    return F.concat(*[grams(F.concat(F.lit(a), text, F.lit(b)), n) for text, a, b in ((host, "<", ">"), (path, "{", "}")) for n in sizes])


def fit(labelled: DataFrame, sizes=SIZES, dimensions: int = DIMENSIONS) -> tuple[list[float], float]:
    """Weights of the slots and the intercept, from (url, label). The table is small by
    contract; a model has ``dimensions`` numbers however many rows it has."""
    known = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(
        "url", n_gram_slots(*split_url(F.col("url")), sizes, dimensions).alias("slots"), F.col("label").cast("double").alias("label"))
    if known.select("label").distinct().count() < 2:
        return [0.0] * dimensions, -1.0
    share = known.select("url", "label", F.size("slots").alias("n"), F.explode("slots").alias("slot")).groupBy("url", "label", "slot").agg(
        (F.count(F.lit(1)) / F.first("n")).alias("share"))
    rows = share.groupBy("url", "label").agg(F.map_from_entries(F.collect_list(F.struct("slot", "share"))).alias("shares"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.coalesce(F.element_at("shares", k), F.lit(0.0)))
    rows = rows.orderBy("url", "label").select(array_to_vector(dense).alias("features"), "label").coalesce(1)
    model = LogisticRegression(regParam=1e-6, standardization=False, maxIter=200).fit(rows)
    return model.coefficients.toArray().tolist(), float(model.intercept)


def score(slots: Column, weights: list[float], intercept: float) -> Column:
    """Probability of the label 1."""
    table = F.array(*[F.lit(w) for w in weights])
    total = F.aggregate(F.transform(slots, lambda s: F.get(table, s)), F.lit(0.0), lambda a, w: a + w)
    return 1 / (1 + F.exp(-(total / F.size(slots) + intercept)))


def judge(pages: DataFrame, labelled: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(key, host, path, rule, score, verdict) of every row."""
    weights, intercept = fit(labelled)
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path")).withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("score", score(n_gram_slots(F.col("host"), F.col("path")), weights, intercept))
    verdict = F.when(F.col("rule").isNull(), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    for rule, said in rules:
        verdict = verdict.when(F.col("rule") == rule, said)
    return rows.select(key, "host", "path", "rule", verdict.alias("verdict"), "score")


def labelled_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{url}', {label})" for url, label in LABELLED)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS labelled(url, label)")
