"""Covariance of an estimated pose, and the weights behind it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.config import CovarianceConfig


def softmax_weights(df: DataFrame, score: str, temperature: float, *keys: str) -> DataFrame:
    """Adds ``weight``: softmax of the score within its group, shifted by the maximum.

    Two aggregates joined back rather than a window, so that a group of any size is
    spread over tasks.
    """
    top = df.groupBy(*keys).agg(F.max(score).alias("_top"))
    lifted = df.join(top, list(keys)) if keys else df.crossJoin(top)
    lifted = lifted.withColumn("_e", F.exp((F.col(score) - F.col("_top")) / temperature))
    total = lifted.groupBy(*keys).agg(F.sum("_e").alias("_sum"))
    full = lifted.join(total, list(keys)) if keys else lifted.crossJoin(total)
    return full.withColumn("weight", F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


def log_sum_exp(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """ln(sum(exp(value))) of every group, stable; minus infinity without rows (no keys)."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    lifted = df.join(top, list(keys)) if keys else df.crossJoin(top)
    out = lifted.groupBy(*keys).agg((F.max("_top") + F.log(F.sum(F.exp(F.col(value) - F.col("_top"))))).alias("lse"))
    return out.withColumn("lse", F.coalesce("lse", F.lit(float("-inf"))))


def weighted_covariance(df: DataFrame, weight: str, *keys: str) -> DataFrame:
    """Weighted means and 2x2 covariance of x and y (weights sum to 1); the identity without rows."""
    mean = df.groupBy(*keys).agg(F.sum(F.col(weight) * F.col("x")).alias("mx"), F.sum(F.col(weight) * F.col("y")).alias("my"))
    both = df.join(mean, list(keys)) if keys else df.crossJoin(mean)
    dx, dy, w = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col(weight)
    out = both.groupBy(*keys).agg(F.max("mx").alias("mean_x"), F.max("my").alias("mean_y"), F.sum(w * dx * dx).alias("cxx"), F.sum(w * dx * dy).alias("cxy"), F.sum(w * dy * dy).alias("cyy"))
    return _or_identity(out)


def sample_covariance(df: DataFrame, *keys: str) -> DataFrame:
    """Means and 2x2 covariance (n - 1) of x and y; the identity under two rows."""
    out = df.groupBy(*keys).agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.var_samp("x").alias("cxx"), F.covar_samp("x", "y").alias("cxy"), F.var_samp("y").alias("cyy"))
    return _or_identity(out)


def _or_identity(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(i)) for c, i in (("cxx", 1.0), ("cxy", 0.0), ("cyy", 1.0))})


def laplace_xy(hxx: Column, hxy: Column, hyy: Column) -> tuple[Column, Column, Column]:
    """Minus the inverse of the Hessian's position block; the identity where it is singular."""
    det = hxx * hyy - hxy * hxy
    fine = F.abs(det) > 1e-12
    return F.when(fine, -hyy / det).otherwise(1.0), F.when(fine, hxy / det).otherwise(0.0), F.when(fine, -hxx / det).otherwise(1.0)


def scale_and_floor(cxx: Column, cxy: Column, cyy: Column, scale: float, least: tuple[float, float]) -> tuple[Column, Column, Column]:
    return F.greatest(cxx * scale, F.lit(least[0])), cxy * scale, F.greatest(cyy * scale, F.lit(least[1]))


def rotate_covariance(cov: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """R6 C R6' with the rotation on position and on orientation."""
    big = np.kron(np.eye(2), rotation)
    return big @ cov @ big.T


def offset_poses(alignments: DataFrame, config: CovarianceConfig = CovarianceConfig()) -> DataFrame:
    """The result pose (offset_id 0) and its proposals, shifted in the vehicle's frame."""
    offsets = F.array(*(F.struct(F.lit(i).alias("offset_id"), F.lit(float(x)).alias("ox"), F.lit(float(y)).alias("oy")) for i, (x, y) in enumerate([(0.0, 0.0), *config.offsets])))
    out = alignments.withColumn("_o", F.explode(offsets)).select("*", "_o.*").drop("_o")
    # the upper 2x2 block of Rx Ry Rz
    sr, cr, sp, cp, sy, cy = (f(a) for a in ("roll", "pitch", "yaw") for f in (F.sin, F.cos))
    x, y = F.col("ox"), F.col("oy")
    return out.withColumns({"tx": F.col("tx") + cp * cy * x - cp * sy * y, "ty": F.col("ty") + (sr * sp * cy + cr * sy) * x + (cr * cy - sr * sp * sy) * y}).drop("ox", "oy")


def covariance_from_offsets(results: DataFrame, config: CovarianceConfig, *keys: str) -> DataFrame:
    """cxx, cxy, cyy from aligned (multi_ndt) or scored (multi_ndt_score) offsets with tx, ty, nvtl.

    ``multi_ndt`` weighs equally; ``correction`` says whether the equal weights'
    covariance is shrunk by (n-1)/n or raised by n/(n-1).
    """
    placed = results.withColumns({"x": F.col("tx"), "y": F.col("ty")})
    if config.kind == "multi_ndt_score":
        raw = weighted_covariance(softmax_weights(placed, "nvtl", config.temperature, *keys), "weight", *keys)
        factor: Column = F.lit(1.0)
    else:
        sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        even = placed.join(sizes, list(keys)).withColumn("weight", 1.0 / F.col("_n"))
        n = F.col("_n")
        raw = weighted_covariance(even, "weight", *keys).join(sizes, list(keys))
        factor = (n - 1) / n if config.correction == "shrunk" else F.when(n > 1, n / (n - 1)).otherwise(1.0)
    xx, xy, yy = scale_and_floor(F.col("cxx") * factor, F.col("cxy") * factor, F.col("cyy") * factor, config.scale, config.diagonal[:2])
    return raw.withColumns({"cxx": xx, "cxy": xy, "cyy": yy}).drop("_n")


def fixed_covariance(config: CovarianceConfig = CovarianceConfig()) -> Column:
    """36 values with the default diagonal."""
    return F.array(*(F.lit(config.diagonal[i] if i == j else 0.0) for i in range(6) for j in range(6)))


def full_covariance(config: CovarianceConfig = CovarianceConfig()) -> Column:
    """36 values: the default diagonal with cxx, cxy, cyy in the position block."""
    block = {(0, 0): F.col("cxx"), (0, 1): F.col("cxy"), (1, 0): F.col("cxy"), (1, 1): F.col("cyy")}
    return F.array(*(block.get((i, j), F.lit(config.diagonal[i] if i == j else 0.0)) for i in range(6) for j in range(6)))


def best_of(df: DataFrame, score: str, *keys: str) -> DataFrame:
    """The row of greatest score of each group; ties by particle_id."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col("particle_id"))).alias("_b"))
    return best.select(*keys, "_b.*")


def running_best(df: DataFrame, score: str, order: str, *keys: str) -> DataFrame:
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best_so_far", F.max(score).over(frame))


def rotate_xy(cxx: Column, cxy: Column, cyy: Column, yaw: Column) -> tuple[Column, Column, Column]:
    """R C R' of a covariance of x and y under a turn about z."""
    c, s = F.cos(yaw), F.sin(yaw)
    return c * c * cxx - 2 * c * s * cxy + s * s * cyy, c * s * (cxx - cyy) + (c * c - s * s) * cxy, s * s * cxx + 2 * c * s * cxy + c * c * cyy
