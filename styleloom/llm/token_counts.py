"""Token counts as an exact histogram of encoded lengths, with suffix sums for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import lengths
from .common import checkpointed

#: Lengths whose sums are formed together; only one row for each such block meets in one task.
BLOCK = 1024


def histogram(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Return ``(n_tokens, n_docs)``: how many rows have texts of exactly that many tokens.

    Null text counts as empty, with no tokens; repeated rows count each. Empty table: no row.
    """
    return lengths(docs, F.lit(0), F.col(f"`{text}`"), path).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Add to each length what a limit of that many tokens asks for.

    ``docs_at_least`` and ``tokens_at_least``: documents of this length or more, and their tokens;
    ``docs_up_to``: documents that fit; ``truncated_tokens``: tokens of the corpus if each document is cut
    at this length. Sums run within blocks of 1024 lengths and over the blocks, so the widest window over
    one partition has a row for each 1024 tokens of the longest text.
    """
    rows = hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"), (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"], F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("d", F.sum("n_docs").over(own)).withColumn("t", F.sum("tokens").over(own)).join(blocks, "block")
    docs, tokens = F.col("d") + F.col("d_after"), F.col("t") + F.col("t_after")
    return rows.select(
        "n_tokens",
        "n_docs",
        docs.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        (F.col("all_docs") - docs + F.col("n_docs")).alias("docs_up_to"),
        (F.col("all_tokens") - tokens + F.col("n_tokens") * docs).alias("truncated_tokens"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row ``(docs, tokens, docs_cut, truncated_tokens)`` for any limit, exact between the lengths as well."""
    return sums.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
        F.coalesce(F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(limit))), F.lit(0)).alias("truncated_tokens"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row ``(n_tokens)``: the least length that the share q of the documents doesn't exceed; null for no document."""
    total = F.col("docs_up_to") + F.col("docs_at_least") - F.col("n_docs")
    return sums.where(F.col("docs_up_to") >= F.lit(q) * total).agg(F.min("n_tokens").alias("n_tokens"))


def report(docs: DataFrame) -> DataFrame:
    """What the query returns: the histogram of all documents with its suffix sums."""
    return suffix_sums(checkpointed(histogram(docs)))  # two branches read it, and it is small
