"""Rule ensembles: held-out accuracy, rules against plain Python, defined cases."""

import zlib

from pyspark.sql import functions as F

from cipherledger.llm import quality, registry

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_whole_table(spark):
    out = registry.QUERIES["op2_rule_quality"](spark, SF).collect()
    labels = {r.doc_id: r.quality for r in registry.table(spark, SF, "labels").collect()}
    assert len(out) == registry.table(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in out)
    held = [(labels[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= .95 * len(held)


def test_rules_are_conjunctions_of_bounds(spark):
    rows = [(i, "Good plain text with words, and a stop. " * (1 + i % 9) if i % 4 else "BAD!! " * (3 + i % 7), i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality"))
    weights, intercept = model = quality.fit(docs, labels)
    assert weights and all(w for w in weights.values())
    stats = docs.select("doc_id", *[c.alias(n) for n, c in quality.statistics(F.col("text")).items()]).collect()
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    for r in stats:
        total = intercept + sum(w for rule, w in weights.items() if all((a is None or r[n] > a) and (m is None or r[n] <= m) for n, a, m in rule.bounds))
        assert abs(got[r.doc_id] - 1 / (1 + 2.718281828459045 ** -total)) < 1e-9


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (1, "a " * 50_000, "z")], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (7, 5)], "doc_id long, quality int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == 3 and all(r.predicted == 1 and r.score > .99 for r in out)
    assert quality.classify(docs.limit(0), labels.limit(0)).collect() == []
