"""Quality scores from a sparse ensemble of rules.

A random forest is grown on statistics of the labelled texts. Every path from a root to a
node of it is a conjunction of bounds on statistics, a rule; a logistic regression with a
lasso penalty weighs the rules and drops most; the rest compile to one column expression
over the statistics. Both fits run on Spark, over a sample of labelled rows of bounded
expected size; scoring is row-local and reads whole texts.

Labels come only from rows whose ``held_out`` is false; neither labels nor ids, languages or
sources are statistics. Defined cases: null texts score as empty ones; a null id is not held
out and never labelled; labels that are null, or not 0 or 1, are ignored, of repeated labels
the greater counts; with fewer than two kinds of label every row scores 1 and is kept; other
columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_stage, write_stage

#: Expected number of labelled rows at most; they are broadcast as (id, label).
SAMPLE_ROWS = 30_000
TREES, DEPTH, LASSO, SEED = 16, 4, 0.0008, 11
#: Classes of characters whose share of the text is a statistic.
CHARACTERS = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "stop": r"[.?]", "comma": r"[,;:]", "shout": r"!", "bar": r"\|", "symbol": r"[#$%&*@<>{}\[\]=+^~_\\/]", "line": r"\n"}


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a whole text, finite for every text."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n_words = F.size(words)
    share = {name: F.regexp_count(t, F.lit(rx)) / F.greatest(chars, F.lit(1)) for name, rx in CHARACTERS.items()}
    return {"words": F.log2(n_words + F.lit(1.0)), "word_length": chars / F.greatest(n_words, F.lit(1)),
            "distinct": F.size(F.array_distinct(words)) / F.greatest(n_words, F.lit(1)), **share}


#: The statistics in the order of the trees' features.
NAMES = ["words", "word_length", "distinct", *CHARACTERS]


@dataclass(frozen=True)
class Rule:
    """Bounds (name, above, at most) that all hold; None is no bound."""
    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for name, above, most in self.bounds:
            if above is not None:
                out &= F.col(prefix + name) > F.lit(above)
            if most is not None:
                out &= F.col(prefix + name) <= F.lit(most)
        return out


def held_out(key: Column) -> Column:
    """Rows whose label must not be learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def paths(node, above: dict, most: dict) -> list[Rule]:
    """The rules of all nodes below a node of a grown tree."""
    rules = [Rule(tuple((n, above.get(n), most.get(n)) for n in NAMES if n in above or n in most))] if above or most else []
    if node.subtreeDepth() == 0:
        return rules
    name, at = NAMES[node.split().featureIndex()], float(node.split().threshold())
    return (rules + paths(node.leftChild(), above, {**most, name: min(at, most.get(name, at))})
            + paths(node.rightChild(), {**above, name: max(at, above.get(name, at))}, most))


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, sample_rows: int) -> DataFrame:
    """Statistics and label of the rows to learn from."""
    known = (labels.where(F.col("quality").isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
             .groupBy(key).agg(F.max("quality").cast("double").alias("label")))
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(n)) < sample_rows)
    rows = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(known), key)
    return rows.select("label", *[c.cast("double").alias(n) for n, c in statistics(F.col("text")).items()])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[dict[Rule, float], float]:
    """Weighted rules and the intercept."""
    rows = write_stage(labelled(docs, labels, key, text, sample_rows), "labelled-statistics")
    if rows.select("label").distinct().count() < 2:
        drop_stage(rows)
        return {}, 10.0
    features = rows.select("*", array_to_vector(F.array(*NAMES)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=SEED).fit(features)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in paths(tree._call_java("rootNode"), {}, {})))
    if not rules:
        drop_stage(rows)
        return {}, 10.0
    holds = rows.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(holds)
    drop_stage(rows)
    return {r: float(w) for r, w in zip(rules, model.coefficients.toArray()) if w}, float(model.intercept)


def scored(docs: DataFrame, model: tuple[dict[Rule, float], float], text: str = "text", score: str = "score") -> DataFrame:
    """Add the probability of the label 1."""
    weights, intercept = model
    prefix = "quality statistic "
    out = docs.select("*", *[c.cast("double").alias(prefix + n) for n, c in statistics(F.col(text)).items()])
    total = F.lit(intercept)
    for rule, w in weights.items():
        total += F.when(rule.column(prefix), F.lit(w)).otherwise(F.lit(0.0))
    return out.withColumn(score, 1 / (1 + F.exp(-total))).drop(*[prefix + n for n in NAMES])


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    out = scored(docs.select(key, text), fit(docs, labels, key, text), text)
    return out.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
