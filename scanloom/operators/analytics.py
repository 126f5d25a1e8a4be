"""Statistics of runs, logs and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.functions import geometry as G


def timing_stats(df: DataFrame, value: str, *keys: str, accuracy: int | None = None) -> DataFrame:
    """n, mean, population deviation, min, max, median, p95, p99 and throughput (1000 / mean) of milliseconds.

    Percentiles are exact and hold a count of every distinct value of a group; with
    an ``accuracy`` they come from a sketch of bounded size, off by 1 / accuracy in rank.
    """
    v = F.col(value)
    points = [0.5, 0.95, 0.99]
    percentiles = F.percentile_approx(v, points, accuracy) if accuracy else F.percentile(v, F.array(*map(F.lit, points)))
    out = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        percentiles.alias("_p"),
    )
    return out.select(*keys, "n", "mean", "std", "min", "max", F.col("_p")[0].alias("median"), F.col("_p")[1].alias("p95"), F.col("_p")[2].alias("p99"), F.when(F.col("mean") > 0, 1000 / F.col("mean")).alias("throughput"))


def by_iterations(df: DataFrame, value: str, iterations: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, iterations).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def warmup(df: DataFrame, value: str, order: str, keys: list[str], frames: int = 10) -> DataFrame:
    """Mean of the first frames beside the mean of the rest."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    early = F.col("_at") <= frames
    return df.withColumn("_at", at).groupBy(*keys).agg(F.avg(F.when(early, F.col(value))).alias("first_mean"), F.avg(F.when(~early, F.col(value))).alias("steady_mean"))


def convergence_rate(df: DataFrame, status: str, converged: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.lit(100.0) * F.count_if(F.col(status) == converged) / F.count(F.lit(1))).alias("convergence_rate"))


def overhead(slow: DataFrame, fast: DataFrame, value: str) -> DataFrame:
    """Mean of one run over the mean of the other."""
    a, b = slow.agg(F.avg(value).alias("slow_mean")), fast.agg(F.avg(value).alias("fast_mean"))
    return a.crossJoin(b).withColumn("ratio", F.when(F.col("fast_mean") > 0, F.col("slow_mean") / F.col("fast_mean")))


def trajectory_error(pairs: DataFrame, *keys: str) -> DataFrame:
    """RMSE and greatest error of x, y, z against ``other``; infinite without pairs (no keys)."""
    error = G.distance([F.col(c) for c in "xyz"], [F.col(f"other.{c}") for c in "xyz"])
    out = pairs.withColumn("_e", error).groupBy(*keys).agg(F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.max("_e").alias("max_error"), F.count("_e").alias("pairs"))
    return out.withColumns({c: F.coalesce(c, F.lit(float("inf"))) for c in ("rmse", "max_error")})


def compare_scores(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    a, b = left.agg(F.avg(value).alias("mean_a")), right.agg(F.avg(value).alias("mean_b"))
    return a.crossJoin(b).withColumns({"difference": F.col("mean_a") - F.col("mean_b"), "ratio": F.when(F.col("mean_b") != 0, F.col("mean_a") / F.col("mean_b"))})


def join_logs(left: DataFrame, right: DataFrame, stamp: str, order: str) -> DataFrame:
    """Rows of two logs with the same stamp; of repeated stamps the last by ``order`` counts."""
    last = lambda df, side: df.groupBy(stamp).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias(side))
    return last(left, "a").join(last(right, "b"), stamp)


def join_positions(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of two logs at the same place of their order."""
    number = lambda df, side: df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).select(*keys, "position", F.struct(*[c for c in df.columns if c not in keys]).alias(side))
    return number(left, "a").join(number(right, "b"), [*keys, "position"])


def offsets_by_topic(df: DataFrame, topic: str, wall: str, stamp: str) -> DataFrame:
    """Mean, least and greatest wall - stamp of every topic, in milliseconds."""
    off = (F.col(wall) - F.col(stamp)) / 1e6
    return df.groupBy(topic).agg(F.avg(off).alias("mean_ms"), F.min(off).alias("min_ms"), F.max(off).alias("max_ms"), F.count(F.lit(1)).alias("n"))
