"""Selections on points and scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.config import FilterConfig, GateConfig


def squared_range(x="x", y="y", z="z") -> Column:
    return F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z)


def is_finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return out


def drop_non_finite(points: DataFrame) -> DataFrame:
    return points.where(is_finite("x", "y", "z"))


def reject_reason(config: FilterConfig) -> Column:
    """``distance`` before ``z``; null for points that stay."""
    r2 = squared_range()
    far = (r2 < config.min_distance**2) | (r2 > config.max_distance**2)
    return F.when(far, "distance").when((F.col("z") < config.min_z) | (F.col("z") > config.max_z), "z")


def filter_points(points: DataFrame, config: FilterConfig) -> DataFrame:
    return points.where(reject_reason(config).isNull())


def reject_counts(points: DataFrame, config: FilterConfig, *keys: str) -> DataFrame:
    """kept, rejected_distance and rejected_z, in one pass."""
    reason = reject_reason(config)
    return points.groupBy(*keys).agg(
        F.count_if(reason.isNull()).alias("kept"),
        F.count_if(F.coalesce(reason == "distance", F.lit(False))).alias("rejected_distance"),
        F.count_if(F.coalesce(reason == "z", F.lit(False))).alias("rejected_z"),
    )


def crop_box(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    keep = F.lit(True)
    for c, a, b in zip("xyz", low, high, strict=True):
        keep = keep & F.col(c).between(a, b)
    return points.where(keep)


def random_sample(points: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """The n rows of least hash of a key: a uniform sample that doesn't depend on partitioning."""
    return points.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def remove_ground(points: DataFrame, base_z: float | Column, margin: float = 0.8) -> DataFrame:
    """Points (in the map frame) more than ``margin`` above the base."""
    return points.where(F.col("z") - base_z > margin)


def scans_in_range(points: DataFrame, scan: str, required_distance: float) -> DataFrame:
    """Per scan the greatest range, and whether it reaches the required one."""
    reach = points.groupBy(scan).agg(F.sqrt(F.max(squared_range())).alias("max_range"))
    return reach.withColumn("accepted", F.col("max_range") >= required_distance)


def publish_gate(alignments: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """Adds ``published``: converged, little oscillation, score over its threshold."""
    enough = (F.col("tp_pairs") >= config.tp_threshold) if config.kind == 0 else (F.col("nvtl") >= config.nvtl_threshold)
    gate = (F.col("status") == "converged") & (F.col("oscillation") <= config.max_oscillation) & enough
    return alignments.withColumn("published", F.coalesce(gate, F.lit(False)))
