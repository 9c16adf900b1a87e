"""Mixing to target weights by soft membership.

A multinomial regression on hashed words, fitted on labelled rows, gives every document a
posterior over domains. Its tokens are shared out by the posterior, and nonnegative document
rates are fitted so that the expected token totals of the domains meet their targets: least
squares over all documents by projected gradient steps from rate 1. The gradient of a rate
is a combination of the document's posterior with one number per domain, so a step needs one
row of sums, and rates follow from the posterior and the numbers of all steps. Steps are
scaled by the inverse of the domains' normal matrix over the documents whose rate is not
zero, and halved when the squares grow.

Domains: ``toxic`` where that label is 1, else ``poor`` or ``good`` by quality. Defined
cases: null and empty texts have no tokens and the posterior of no words; null ids keep
their rows; labels with nulls are ignored, of repeated labels the greatest counts; a domain
without labelled rows has posterior 0 and its target is not met; a domain without target is
free; with fewer than two domains
every row belongs to the one that is there (``good`` if none is); other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_stage, write_stage

DOMAINS = ("good", "poor", "toxic")
#: Share of all tokens each domain shall have.
TARGETS = {"good": 0.80, "poor": 0.17, "toxic": 0.03}
#: Expected number of labelled rows at most; they are broadcast as (id, domain).
SAMPLE_ROWS, FEATURES, SEED = 20_000, 1 << 14, 13
STEPS, MEETS, NESTED = 60, 1e-9, 8


def words(text: Column) -> Column:
    """Words in lower case, without the punctuation around them but with marks of junk."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,;:]+"), lambda w: w != "")


def domain(toxic: Column, quality: Column) -> Column:
    """Number of the domain of a labelled row."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 0)


def posteriors(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, tokens, p0, p1, ...) of every row, the posteriors in the order of DOMAINS."""
    known = labels.select(F.col(key), domain(F.col("toxic"), F.col("quality")).alias("domain")).where(F.col(key).isNotNull() & F.col("domain").isNotNull())
    known = known.groupBy(key).agg(F.max("domain").cast("double").alias("label"))
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(n)) < sample_rows)
    hashed = HashingTF(inputCol="words", outputCol="features", numFeatures=FEATURES, binary=True)
    rows = docs.select(F.col(key), words(F.col(text)).alias("words"))
    learnt = write_stage(hashed.transform(rows.join(F.broadcast(known), key)).select("features", "label"), "labelled-words")
    seen = sorted(int(r.label) for r in learnt.select("label").distinct().collect())
    tokens = F.size("words").cast("long").alias("tokens")
    if len(seen) < 2:
        sure = seen[0] if seen else 0
        out = rows.select(key, tokens, *[F.lit(float(k == sure)).alias(f"p{k}") for k in range(len(DOMAINS))])
    else:
        number = {d: k for k, d in enumerate(seen)}
        dense = F.create_map(*[F.lit(float(x)) for kv in number.items() for x in kv])
        model = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=0.8, maxIter=60, standardization=False).fit(
            learnt.withColumn("label", dense[F.col("label")]))
        p = vector_to_array("probability")
        out = PipelineModel([hashed, model]).transform(rows).withColumn("p", p).select(
            key, tokens, *[(F.col("p")[number[k]] if k in number else F.lit(0.0)).alias(f"p{k}") for k in range(len(DOMAINS))])
    out = write_stage(out, "posteriors")
    drop_stage(learnt)
    return out


def fit_rates(rows: DataFrame, targets: dict[str, float], steps: int = STEPS, meets: float = MEETS, rate: str = "rate") -> tuple[Column, DataFrame, np.ndarray]:
    """The rate as a column over the returned rows (tokens, p0, p1, ...), and the domains'
    expected totals. ``targets`` are token totals; a domain without one is free. Sums of one
    pass: totals and the normal matrix over positive rates; nothing else reaches the
    driver."""
    n = len(targets)
    p = [F.col(f"p{DOMAINS.index(d)}") for d in targets]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    wanted = np.array(list(targets.values()), float)
    scale = max(1.0, float(np.abs(wanted).sum()))

    def measure(rows: DataFrame, rate: Column) -> tuple[np.ndarray, np.ndarray]:
        live = F.when(rate > 0, F.col("tokens"))
        row = rows.agg(*[F.coalesce(F.sum(F.col("tokens") * rate * p[k]), F.lit(0.0)) for k in range(n)],
                       *[F.coalesce(F.sum(live * p[i] * p[j]), F.lit(0.0)) for i, j in pairs]).first()
        normal = np.zeros((n, n))
        for (i, j), x in zip(pairs, row[n:]):
            normal[i, j] = normal[j, i] = x
        return np.array(row[:n], float), normal

    def stepped(rate: Column, c: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), rate - sum((p[k] * F.lit(float(c[k])) for k in range(n)), F.lit(0.0)))

    now, nested = F.lit(1.0), 0
    totals, normal = measure(rows, now)
    squares = float(((totals - wanted) ** 2).sum())
    size = 1.0
    for _ in range(steps):
        if squares ** 0.5 <= meets * scale or size < 1e-3:
            break
        step = np.linalg.pinv(normal, rcond=1e-10) @ (totals - wanted) * size
        tried = stepped(now, step)
        new_totals, new_normal = measure(rows, tried)
        new_squares = float(((new_totals - wanted) ** 2).sum())
        if new_squares >= squares * (1 - 1e-6):
            size /= 2
            continue
        now, totals, normal, squares, size, nested = tried, new_totals, new_normal, new_squares, min(1.0, 2 * size), nested + 1
        if nested % NESTED == 0:  # keeps the expression short
            rows = write_stage(rows.withColumn(rate, now), "rates")
            now = F.col(rate)
    return now, rows, totals


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: str | float = "all", growth: float = 1.0,
        key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens, p_good, p_poor, p_toxic, rate) of every row. The budget is a number of
    tokens, ``all`` for as many as there are, or a domain whose total shall stay; it is multiplied
    by ``growth``."""
    rows = posteriors(docs, labels, key, text)
    if isinstance(budget, str):
        have = F.sum("tokens") if budget == "all" else F.sum(F.col("tokens") * F.col(f"p{DOMAINS.index(budget)}"))
        total = float(rows.agg(F.coalesce(have, F.lit(0))).first()[0]) / (1.0 if budget == "all" else targets[budget])
    else:
        total = float(budget)
    rate, rows, _ = fit_rates(rows, {d: growth * total * share for d, share in targets.items()})
    return rows.select(key, "tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)], rate.alias("rate"))


def copies(rate: Column, key: Column) -> Column:
    """Whole number of copies whose mean over ids is the rate."""
    chance = F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")
