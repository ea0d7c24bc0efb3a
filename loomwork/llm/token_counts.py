"""Token counts from an exact histogram of encoded lengths.

Documents are encoded and counted by length, in each task first. Suffix sums of the histogram then answer, for any
context limit, how many documents are longer, how many tokens there are, and how many stay after truncation; and any quantile of lengths.
Lengths are summed up in spans of SPAN lengths first, so that no task orders the whole histogram: a span's own suffix sums and
the sums of the longer spans add up.

Rows: a null or empty text has length 0; every row counts, repeated ones too; an empty table has an empty histogram, totals of 0 and quantiles
of null; ids and extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import length_histogram
from .shared import kept

SPAN = 256


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Of each length that occurs: n_docs of just it, docs_at_least and tokens_at_least of it or more, docs_up_to and tokens_up_to of it or less, and truncated_tokens, the tokens that are left if every document is cut to it."""
    h = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / SPAN).alias("span"), (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    spans = h.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    longer = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    tops = spans.select("span", *(F.coalesce(F.sum(c).over(longer), F.lit(0)).alias(f"over_{c}") for c in "dt"), *(F.sum(c).over(everything).alias(f"all_{c}") for c in "dt"))
    own = Window.partitionBy("span").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(tops, "span").withColumn("docs_at_least", F.sum("n_docs").over(own) + F.col("over_d")).withColumn("tokens_at_least", F.sum("tokens").over(own) + F.col("over_t"))
    docs_up_to = F.col("all_d") - F.col("docs_at_least") + F.col("n_docs")
    tokens_up_to = F.col("all_t") - F.col("tokens_at_least") + F.col("tokens")
    cut = tokens_up_to + F.col("n_tokens") * (F.col("docs_at_least") - F.col("n_docs"))
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", docs_up_to.alias("docs_up_to"), tokens_up_to.alias("tokens_up_to"), cut.alias("truncated_tokens"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_longer than it and truncated_tokens under it, for each of a few limits."""
    asked = sorted(set(limits))
    sums = [F.struct(F.lit(x).cast("long").alias("context_limit"), F.coalesce(F.sum(F.when(F.col("n_tokens") > x, F.col("n_docs"))), F.lit(0)).alias("docs_longer"), F.coalesce(F.sum(F.least("n_tokens", F.lit(x)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens")) for x in asked]
    return histogram.agg(F.array(*sums).alias("r")).select(F.inline("r"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """Of each share the least length that at least this share of documents don't exceed; exact."""
    sums = suffix_sums(histogram)
    n = F.col("docs_up_to") + F.col("docs_at_least") - F.col("n_docs")
    each = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("docs_up_to") >= n * F.lit(float(q)), F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return sums.agg(F.array(*each).alias("r")).select(F.inline("r"))


def counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """suffix_sums of docs' encoded lengths; documents are encoded once."""
    return suffix_sums(kept(length_histogram(docs, path, key, text)))
