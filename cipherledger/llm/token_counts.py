"""Exact histogram of encoded lengths, with suffix sums that answer every context limit.

Defined cases: null and empty texts have length 0 and are counted; repeated rows count
each; other columns are not read; an empty table gives an empty histogram, whose answers
are zero or null.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_stage

#: Lengths whose sums are taken together, so that no window holds the whole histogram.
SPAN = 4096

_ENCODERS: dict[tuple[str, bytes], object] = {}


def _encoder(pattern: str, ranks: bytes):
    """One encoder per worker process."""
    import tiktoken
    if (pattern, ranks) not in _ENCODERS:
        _ENCODERS.clear()
        pairs = (line.split() for line in ranks.splitlines() if line)
        _ENCODERS[pattern, ranks] = tiktoken.Encoding("ranks", pat_str=pattern, special_tokens={}, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs})
    return _ENCODERS[pattern, ranks]


def encoded_lengths(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """(n_tokens) of each row's whole text; special tokens are ordinary text."""
    with open(ranks_path, "rb") as f:
        ranks = f.read()

    @F.pandas_udf("long")
    def length(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(pattern, ranks)
        for texts in parts:
            yield pd.Series([len(encoder.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return docs.select(length(text).alias("n_tokens"))


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """One row per occurring length: documents and tokens of that length, of that length or
    longer, the tokens that a limit of that length keeps of all documents, and the share of
    documents no longer than it; the first row whose share reaches q is the quantile q.

    Lengths are summed in spans, and spans among each other, so a window sees one span or
    one row per span. The exact counts are written once, since texts are read once.
    """
    exact = write_stage(lengths.groupBy(F.col(column).alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs")), "lengths")
    exact = exact.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("span", F.floor(F.col("n_tokens") / SPAN))
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = exact.groupBy("span").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).select(
        "span", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"), F.sum("t").over(Window.partitionBy(F.lit(0))).alias("total"),
        F.sum("d").over(Window.partitionBy(F.lit(0))).alias("total_docs"))
    here = Window.partitionBy("span").orderBy(F.desc("n_tokens"))
    up = exact.join(spans, "span").select(
        "n_tokens", "docs", "tokens", "total", "total_docs",
        (F.sum("docs").over(here) + F.col("later_docs")).alias("docs_at_least"),
        (F.sum("tokens").over(here) + F.col("later_tokens")).alias("tokens_at_least"))
    return up.select("n_tokens", "docs", "tokens", "docs_at_least", "tokens_at_least",
                     (F.col("total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
                     ((F.col("total_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("total_docs")).alias("share_at_most"))


def answer_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """For each (context_limit): documents over it and the tokens it keeps. Between two
    lengths the sums of the next longer one hold. A window sees the lengths and limits of one
    span, or one row per span for what later spans add."""
    span = F.floor(F.col("n_tokens") / SPAN).alias("span")
    asked = limits.select(F.col("context_limit").cast("long").alias("n_tokens"), F.lit(1).alias("asked"))
    rows = histogram.select("n_tokens", F.lit(0).alias("asked"), "docs", "tokens", "docs_at_least", "tokens_at_least").unionByName(asked, allowMissingColumns=True).select("*", span)
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("span").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))
    sums = sums.select("span", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"),
                       F.sum("t").over(Window.partitionBy(F.lit(0))).alias("total"))
    longer = Window.partitionBy("span").orderBy(F.desc("n_tokens"), F.desc("asked")).rowsBetween(Window.unboundedPreceding, -1)
    next_docs, next_tokens = (F.last(c, True).over(longer) for c in ("docs_at_least", "tokens_at_least"))
    found = rows.select("span", "n_tokens", "asked", next_docs.alias("docs"), next_tokens.alias("tokens")).where("asked = 1").join(sums, "span")
    over, tokens = F.coalesce("docs", "later_docs"), F.coalesce("tokens", "later_tokens")
    return found.select(F.col("n_tokens").alias("context_limit"), over.alias("docs_over"), "total", (F.col("total") - tokens + F.col("n_tokens") * over).alias("truncated_total"))


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least the share q of documents does not exceed;
    null for no documents."""
    return histogram.where(F.col("share_at_most") >= float(q)).agg(F.min("n_tokens").alias("length"))
