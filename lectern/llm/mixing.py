"""Mixing sources to target weights (operator 9), in DataFrame functions only.

A source's weight is its token share to the power ``alpha``, normalised.  ``alpha`` is bisected until the weights meet a target
entropy or keep within a repetition limit.  The weights are then realised as whole passes over every source and one
partial pass, which takes blocks in a hashed order until the source's budget is spent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, checkpointed

#: Exponents tried in a round of the bisection, all in one aggregation; each round narrows the interval so many times.
FAN = 16
ROUNDS = 8


def word_count(text: Column) -> Column:
    """Words of a text; null: none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("bigint")


def source_totals(docs: DataFrame, *, source: str, tokens: str) -> DataFrame:
    """``(source, tokens, share)`` of every source that has tokens; combined on the map side, so a hot source is a row per task."""
    totals = docs.groupBy(F.col(source).alias("source")).agg(F.sum(tokens).alias("tokens")).where("tokens > 0")
    whole = totals.agg(F.sum("tokens").alias("all_tokens"), F.max("tokens").alias("top"))
    return totals.join(F.broadcast(whole), F.lit(True)).select("source", "tokens", (F.col("tokens") / F.col("all_tokens")).alias("share"))


def solve_alpha(totals: DataFrame, *, entropy: float | None = None, repetition: float | None = None) -> float:
    """The largest exponent in 0 to 1 that meets the targets.

    ``entropy`` asks for weights of at least this entropy in nats, ``repetition`` that no source be repeated more than
    so many times as often as the least repeated.  Entropy falls and the spread of repetition shrinks as the exponent
    grows, so entropy bounds it above and repetition below; if both can't hold the repetition limit wins.
    A round evaluates ``FAN`` exponents in one aggregation over the totals; two numbers for each come to the driver.
    """
    def bisect(holds, low: float, high: float, upper: bool) -> float:
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / FAN for i in range(FAN + 1)]
            ok = holds(grid)
            good = [g for g, x in zip(grid, ok, strict=True) if x]
            if not good:
                return low if upper else high
            best = max(good) if upper else min(good)
            step = (high - low) / FAN
            low, high = (best, min(high, best + step)) if upper else (max(low, best - step), best)
        return low if upper else high

    def entropies(grid: list[float]) -> list[float]:
        row = totals.agg(*[f(F.pow("share", F.lit(a)) * x).alias(f"{n}{i}") for i, a in enumerate(grid) for n, x, f in (("z", F.lit(1.0), F.sum), ("l", F.log("share"), F.sum))]).first()
        import math

        return [math.log(row[f"z{i}"]) - a * row[f"l{i}"] / row[f"z{i}"] if row[f"z{i}"] else 0.0 for i, a in enumerate(grid)]

    alpha = 1.0
    if entropy is not None:
        alpha = bisect(lambda grid: [h >= entropy for h in entropies(grid)], 0.0, 1.0, True)
    if repetition is not None:
        row = totals.agg(F.max("share").alias("a"), F.min("share").alias("b")).first()
        spread = (row["a"] or 1.0) / (row["b"] or 1.0)
        if spread > 1:
            alpha = max(alpha if entropy is not None else 0.0, bisect(lambda grid: [spread ** (1 - g) <= repetition for g in grid], 0.0, 1.0, False))
    return alpha


def quotas(totals: DataFrame, alpha: float, budget: int | None = None) -> DataFrame:
    """``(source, tokens, weight, quota, passes, partial)``: tokens to draw, as whole passes and a partial one.

    Without ``budget`` the smallest one is taken that draws every source whole at least once, so nothing is lost.
    """
    weighted = totals.withColumn("raw", F.pow("share", F.lit(float(alpha))))
    whole = weighted.agg(F.sum("raw").alias("z"), F.max(F.col("tokens") / F.col("raw")).alias("least"))
    w = weighted.join(F.broadcast(whole), F.lit(True)).withColumn("weight", F.col("raw") / F.col("z"))
    quota = F.col("least") * F.col("raw") if budget is None else F.col("weight") * F.lit(int(budget))
    return (
        w.withColumn("quota", F.round(quota).cast("bigint"))
        .withColumn("passes", F.floor(F.col("quota") / F.col("tokens")).cast("bigint"))
        .withColumn("partial", F.col("quota") - F.col("passes") * F.col("tokens"))
        .select("source", "tokens", "weight", "quota", "passes", "partial")
    )


def mix(docs: DataFrame, *, source: str = "source", tokens: str, key: str, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, blocks: int = 4096, seed: int = 7) -> DataFrame:
    """``docs`` with ``weight``, ``passes`` (whole passes drawn), ``extra`` (drawn once more) and ``copies``.

    Every row of the input is in the result; a row that isn't drawn has 0 copies.  A source's documents are spread over
    ``blocks`` by a seeded hash of ``key``, and the hash order of the blocks is its permutation: the partial pass takes
    whole blocks while they fit and then, in the block that crosses the budget, documents in hash order while
    they fit.  Running sums go over block totals, at most ``blocks`` rows a source, and over the documents of a crossing
    block; a source that has a third of all rows is thus never in one task.

    Null sources form a source of their own.  Documents without tokens go with their source's whole passes (or once
    if the source has no tokens at all) and never in the partial pass.  Ties and repeated rows are ordered by the hash and key only,
    and equal rows are drawn alike.  Empty tables give empty results.  Extra columns pass through; those named like an output column are replaced, and
    names that begin with two underscores are reserved.
    """
    own = ["weight", "passes", "extra", "copies"]
    names = [c for c in docs.columns if c not in own]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{source}`").alias("__source"), F.coalesce(F.col(f"`{tokens}`"), F.lit(0)).cast("bigint").alias("__tokens"))
    rows = rows.withColumn("__hash", F.xxhash64(F.lit(seed), F.col(f"`{key}`").cast("string"))).withColumn("__block", F.pmod("__hash", F.lit(blocks)).cast("int"))
    # combined on the map side: at most a row for each source and block from a task
    in_blocks = checkpointed(rows.groupBy("__source", "__block").agg(F.sum("__tokens").alias("b_tokens")))
    totals = checkpointed(source_totals(in_blocks, source="__source", tokens="b_tokens"))
    plan = quotas(totals, solve_alpha(totals, entropy=entropy, repetition=repetition), budget)
    order = Window.partitionBy("__source").orderBy(F.xxhash64(F.lit(seed + 1), "__block"), "__block")
    null_safe = lambda a, b: a.eqNullSafe(b)
    cut = in_blocks.alias("b").join(plan.alias("p"), null_safe(F.col("b.__source"), F.col("p.source")), "left")
    before = F.sum("b_tokens").over(order) - F.col("b_tokens")
    cut = cut.select(
        F.col("b.__source").alias("__c_source"), F.col("b.__block").alias("__c_block"),
        F.col("weight").alias("__weight"), F.coalesce("passes", F.lit(1)).alias("__passes"), F.coalesce("partial", F.lit(0)).alias("__partial"), before.alias("__before"), F.col("b_tokens").alias("__b_tokens"),
    ).withColumn("__place", F.when(F.col("__before") + F.col("__b_tokens") <= F.col("__partial"), 1).when(F.col("__before") < F.col("__partial"), 2).otherwise(0))
    joined = rows.join(cut, null_safe(F.col("__source"), F.col("__c_source")) & (F.col("__block") == F.col("__c_block")))
    inner = Window.partitionBy("__source", "__block").orderBy("__hash", F.col(f"`{key}`"))
    crossing = joined.where("__place = 2").withColumn("__extra", ((F.col("__before") + F.sum("__tokens").over(inner) <= F.col("__partial")) & (F.col("__tokens") > 0)).cast("int"))
    settled = joined.where("__place <> 2").withColumn("__extra", ((F.col("__place") == 1) & (F.col("__tokens") > 0)).cast("int"))
    both = settled.unionByName(crossing)
    passes, extra = F.col("__passes"), F.col("__extra")
    return both.select(*[F.col(f"`{c}`") for c in names], F.col("__weight").alias("weight"), passes.alias("passes"), extra.alias("extra"), (passes + extra).alias("copies"))
