"""Length histogram against brute force."""

import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

from cipherledger.llm import registry
from cipherledger.llm import token_counts as t

SF = "/root/testdata/sf0.001"


def test_histogram_answers_every_limit(spark):
    lengths = [0, 0, 3, 3, 3, 5000, 4096, 4095, 70_000, 12]
    hist = t.length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long")).cache()
    for r in hist.collect():
        longer = [n for n in lengths if n >= r.n_tokens]
        assert (r.docs, r.tokens, r.docs_at_least, r.tokens_at_least) == (lengths.count(r.n_tokens), r.n_tokens * lengths.count(r.n_tokens), len(longer), sum(longer))
        assert r.share_at_most == sum(n <= r.n_tokens for n in lengths) / len(lengths)
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths)
    limits = [0, 1, 3, 4, 4095, 4096, 4097, 10**6]
    got = {r.context_limit: (r.docs_over, r.truncated_total) for r in t.answer_limits(hist, spark.createDataFrame([(x,) for x in limits], "context_limit int")).collect()}
    assert got == {x: (sum(n > x for n in lengths), sum(min(n, x) for n in lengths)) for x in limits}
    for q, want in ((0.0, 0), (.2, 0), (.21, 3), (.5, 3), (.51, 12), (.9, 5000), (1.0, 70_000)):
        assert t.length_quantile(hist, q).first().length == want


def test_defined_cases(spark):
    df = spark.createDataFrame([(None,), ("",), ("a b",), ("a b",), ("<|endoftext|> " * 30_000,)], "text string").withColumn("n_tokens", F.lit("clash"))
    n = sorted(r.n_tokens for r in t.encoded_lengths(df, registry.RANKS, public_tokenizers.PATTERN).collect())
    assert n[:4] == [0, 0, 2, 2] and n[4] > 30_000
    empty = t.length_histogram(t.encoded_lengths(df.limit(0), registry.RANKS, public_tokenizers.PATTERN))
    assert empty.collect() == [] and t.length_quantile(empty, .5).first().length is None


def test_query_against_another_library(spark):
    other = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    lengths = [len(other.encode(r.text or "", add_special_tokens=False).ids) for r in registry.table(spark, SF, "documents").collect()]
    got = {r.n_tokens: r.docs for r in registry.QUERIES["op1_length_histogram"](spark, SF).collect()}
    assert got == {n: lengths.count(n) for n in set(lengths)}
