"""Fitted rates against a dense solver, targets, defined cases."""

import numpy as np
from pyspark.sql import functions as F

from cipherledger.llm import mixing

SF = "/root/testdata/sf0.01"


def dense(tokens, p, wanted, steps=200_000):
    """Projected gradient with the metric of the tokens, in plain numpy with a small step."""
    r = np.ones(len(tokens))
    step = 1 / np.linalg.eigvalsh((p * tokens[:, None]).T @ p).max()
    for _ in range(steps):
        gap = (p * tokens[:, None]).T @ r - wanted
        if np.abs(gap).max() < 1e-7 * tokens.sum():
            break
        r = np.maximum(0, r - step * p @ gap)
    return r


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([.6, .3, .2], 500)
    tokens = rng.integers(0, 900, 500).astype(float)
    rows = spark.createDataFrame([(int(t), *map(float, q)) for t, q in zip(tokens, p)], "tokens long, p0 double, p1 double, p2 double")
    for shares in ((.7, .2, .1), (.3, .3, .4), (.9, .05, .05)):
        wanted = tokens.sum() * np.array(shares)
        rate, out, totals = mixing.fit_rates(rows, dict(zip(mixing.DOMAINS, wanted)))
        got = np.array([r.r for r in out.select(rate.alias("r")).collect()])
        reachable = dense(tokens, p, wanted)
        assert (got >= 0).all() and np.allclose(totals, (p * tokens[:, None]).T @ got)
        assert np.abs(totals - wanted).sum() <= np.abs((p * tokens[:, None]).T @ reachable - wanted).sum() + 1e-5 * tokens.sum()
    rate, out, totals = mixing.fit_rates(rows, {"good": tokens.sum() / 2})
    assert np.allclose(totals, tokens.sum() / 2)


def test_posteriors_and_targets_on_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = mixing.mix(docs, labels).collect()
    assert len(out) == docs.count() and all(abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-6 and r.rate >= 0 for r in out)
    total = sum(r.tokens for r in out)
    for d, share in mixing.TARGETS.items():
        assert abs(sum(r.tokens * r.rate * r["p_" + d] for r in out) - share * total) < 1e-6 * total


def test_copies_have_the_rate_as_mean(spark):
    got = spark.range(20_000).select(mixing.copies(F.lit(1.3), F.col("id")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert abs(got[0] - 1.3) < .02 and got[1:] == (1, 2)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "w " * 60_000, "z"), (2, "w " * 60_000, "z")], "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(1, None, 1), (2, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    one = mixing.mix(docs, labels.where("false")).collect()
    assert len(one) == 4 and all(r.p_good == 1 for r in one) and sorted(r.tokens for r in one) == [0, 0, 60_000, 60_000]
    assert {r.p_toxic for r in mixing.mix(docs, labels).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labels.limit(0)).collect() == []
