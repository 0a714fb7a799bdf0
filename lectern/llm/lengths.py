"""Exact token counts by length histogram (operator 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed

#: Lengths in a block of the suffix sums.
BLOCK = 1024


def length_histogram(lengths: DataFrame, *, n_tokens: str = "n_tokens", block: int = BLOCK) -> DataFrame:
    """One row per distinct length: ``n_tokens``, ``n_docs`` and the suffix sums that answer every context limit.

    ``docs_ge`` and ``tokens_ge`` count the documents at least so long and their tokens.  ``docs_le`` counts those
    at most so long and ``share_le`` their share: the p-quantile is the first length whose share reaches p.  ``total_tokens`` is the whole corpus.  ``truncated_total`` is the
    corpus total after cutting every document to this length: the tokens of shorter documents plus
    length times ``docs_ge``.  Null lengths count as 0, repeated rows once each, very long ones like any other; an empty table gives no rows, and extra
    columns are ignored.

    Counting combines on the map side, so a length that a third of the documents share is one row per task.
    The counts, one row per length, are kept before the sums use them twice, so lengths are computed once.
    The sums run in two levels, inside blocks of ``block`` lengths and over block totals.
    """
    hist = lengths.groupBy(F.coalesce(F.col(n_tokens), F.lit(0)).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    hist = checkpointed(hist).withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    # one row per block of lengths that occurs: as many as the longest document has blocks, not as there are documents
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("b_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("b_docs").over(everything).alias("all_docs"),
        F.sum("b_tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        hist.join(blocks, "block")
        .withColumn("docs_ge", F.col("docs_above") + F.sum("n_docs").over(inside))
        .withColumn("tokens_ge", F.col("tokens_above") + F.sum("tokens").over(inside))
        .select(
            "n_tokens",
            "n_docs",
            "docs_ge",
            "tokens_ge",
            (F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
            (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
            ((F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_docs")).alias("share_le"),
            F.col("all_tokens").alias("total_tokens"),
        )
    )


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``(limit_tokens, truncated_total, docs_cut)`` for arbitrary context limits, from the histogram alone."""
    return histogram.agg(
        *[F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(k))).alias(f"t{i}") for i, k in enumerate(limits)],
        *[F.sum(F.when(F.col("n_tokens") > k, F.col("n_docs")).otherwise(0)).alias(f"c{i}") for i, k in enumerate(limits)],
    ).select(
        F.explode(
            F.array(*[F.struct(F.lit(k).cast("long").alias("limit_tokens"), F.coalesce(f"t{i}", F.lit(0)).alias("truncated_total"), F.coalesce(f"c{i}", F.lit(0)).alias("docs_cut")) for i, k in enumerate(limits)])
        ).alias("r")
    ).select("r.*")


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, n_tokens)``: the smallest length that at least ``share`` of the documents do not exceed."""
    total = F.col("docs_le") + F.col("docs_ge") - F.col("n_docs")
    return histogram.agg(*[F.min(F.when(F.col("docs_le") >= F.ceil(total * p), F.col("n_tokens"))).alias(f"q{i}") for i, p in enumerate(shares)]).select(
        F.explode(F.array(*[F.struct(F.lit(float(p)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, p in enumerate(shares)])).alias("r")
    ).select("r.*")
