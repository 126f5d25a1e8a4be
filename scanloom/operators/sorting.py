"""Positions in a global order, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _cuts(df: DataFrame, value: str, buckets: int) -> list[float]:
    """Values that cut the rows into some ``buckets`` parts of much the same size (at most so many numbers)."""
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
    return sorted(set(found or []))


def _digit(value: str, cuts: list[float], low: int = 0, high: int | None = None) -> Column:
    """Which part a value lies in, the number of cuts below it, by halving."""
    high = len(cuts) if high is None else high
    if low == high:
        return F.lit(low).cast("long")
    middle = (low + high) // 2
    return F.when(F.col(value).cast("double") <= F.lit(cuts[middle]), _digit(value, cuts, low, middle)).otherwise(_digit(value, cuts, middle + 1, high))


def sorted_positions(df: DataFrame, code: str, tie: str, buckets: int = 256, tie_buckets: int = 64) -> DataFrame:
    """Adds ``position`` (from 0) in the order of a number and a numeric tie breaker.

    As a radix sort does: counts by leading digits give each digit's first
    position, and rows are ranked inside theirs.  The digits are quantiles of the
    codes, so that clustered codes spread as evenly as others, and quantiles of the
    ties, so that a code that many rows share is ranked by several tasks.
    """
    by_code, by_tie = _cuts(df, code, buckets), _cuts(df, tie, tie_buckets)
    dealt = df.select("*", _digit(code, by_code).alias("_bucket"), _digit(tie, by_tie).alias("_part"))
    counts = dealt.groupBy("_bucket", code, "_part").agg(F.count(F.lit(1)).alias("_n"))
    inside = counts.withColumn("_inner", F.sum("_n").over(Window.partitionBy("_bucket").orderBy(code, "_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    sizes = counts.groupBy("_bucket").agg(F.sum("_n").alias("_size"))  # bounded by the number of buckets
    starts = sizes.withColumn("_start", F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size"))
    first = inside.join(starts, "_bucket").select(F.col(code).alias("_code"), F.col("_part").alias("_of"), (F.col("_start") + F.col("_inner")).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(code, "_part").orderBy(tie)) - 1
    ranked = dealt.withColumn("_rank", rank).join(first, (F.col(code) == F.col("_code")) & (F.col("_part") == F.col("_of")))
    return ranked.withColumn("position", F.col("_first") + F.col("_rank")).select(*df.columns, "position")
