"""Downsampling and voxel Gaussians.

The cell aggregate is algebraic (counts, sums, sums of products), so Spark
combines it before its only shuffle.  Sums are taken relative to the cell's
origin, which keeps the digits that map coordinates would cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.config import VoxelConfig
from scanloom.functions.geometry import cells
from scanloom.functions.kernels import clamp_covariance

CELL = ("vx", "vy", "vz")
_PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def with_cells(points: DataFrame, resolution: float) -> DataFrame:
    vx, vy, vz = cells("x", "y", "z", resolution)
    return points.withColumns({"vx": vx, "vy": vy, "vz": vz})


def downsample(points: DataFrame, resolution: float, *keys: str) -> DataFrame:
    """The centroid of every occupied cell; the points themselves for resolutions of 0 or less."""
    if resolution <= 0:
        return points.select(*keys, "x", "y", "z")
    cellular = with_cells(points, resolution)
    return cellular.groupBy(*keys, *CELL).agg(*(F.avg(c).alias(c) for c in "xyz"), F.count(F.lit(1)).alias("n")).select(*keys, *CELL, "x", "y", "z", "n")


def moments(points: DataFrame, resolution: float, *keys: str) -> DataFrame:
    """Per cell n, sums and sums of products, relative to the cell's origin."""
    local = with_cells(points, resolution)
    local = local.select(*keys, *CELL, *((F.col(c) - F.col(v) * resolution).alias(c) for c, v in zip("xyz", CELL, strict=True)))
    sums = [F.sum(c).alias(f"s{c}") for c in "xyz"] + [F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in _PAIRS]
    return local.groupBy(*keys, *CELL).agg(F.count(F.lit(1)).alias("n"), *sums)


def means_and_covariances(sums: DataFrame, resolution: float, min_points: int = 6) -> DataFrame:
    """mx, my, mz and the six covariances (n - 1) of cells with enough points."""
    n = F.col("n")
    mean = {c: F.col(f"s{c}") / n for c in "xyz"}
    cov: list[Column] = [((F.col(f"s{a}{b}") - n * mean[a] * mean[b]) / (n - 1)).alias(f"c{a}{b}") for a, b in _PAIRS]
    keep = [c for c in sums.columns if not c.startswith("s") or c in CELL]
    return sums.where(n >= min_points).select(*keep, *((mean[c] + F.col(v) * resolution).alias(f"m{c}") for c, v in zip("xyz", CELL, strict=True)), *cov)


VOXEL_SCHEMA = "vx int, vy int, vz int, n long, mean array<double>, cov array<double>, inv_cov array<double>, axis array<double>"


def gaussians(statistics: DataFrame, ratio: float = 0.01, *keys: str) -> DataFrame:
    """Clamp eigenvalues, invert, and find the axis of least spread; cells without spread go.

    A stack of 3x3 eigenproblems has no column expression: Arrow batches of
    voxels (few beside the points) go through one vectorised call each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch.column(c) for c in batch.schema.names}
            c6 = [np.asarray(col[f"c{a}{b}"], dtype=float) for a, b in _PAIRS]
            cov = np.stack([c6[0], c6[1], c6[2], c6[1], c6[3], c6[4], c6[2], c6[4], c6[5]], axis=1).reshape(-1, 3, 3)
            valid, clamped, inverse, axis = clamp_covariance(cov, ratio)
            mean = np.stack([np.asarray(col[f"m{c}"], dtype=float) for c in "xyz"], axis=1)
            lists = [pa.array(list(m.reshape(len(m), -1)), pa.list_(pa.float64())) for m in (mean, clamped, inverse, axis)]
            out = pa.RecordBatch.from_arrays([*(col[k] for k in (*keys, *CELL, "n")), *lists], names=[*keys, *CELL, "n", "mean", "cov", "inv_cov", "axis"])
            yield out.filter(pa.array(valid))

    types = "".join(f"{k} {statistics.schema[k].dataType.simpleString()}, " for k in keys)
    return statistics.mapInArrow(run, types + VOXEL_SCHEMA)


def build_voxels(points: DataFrame, config: VoxelConfig = VoxelConfig(), *keys: str) -> DataFrame:
    statistics = means_and_covariances(moments(points, config.resolution, *keys), config.resolution, config.min_points)
    return gaussians(statistics, config.eigenvalue_ratio, *keys)


def build_multi_resolution(points: DataFrame, resolutions: list[float], config: VoxelConfig = VoxelConfig()) -> DataFrame:
    """Voxels of several resolutions side by side (column ``resolution``)."""
    out = None
    for r in resolutions:
        grid = build_voxels(points, VoxelConfig(r, config.min_points, config.eigenvalue_ratio)).withColumn("resolution", F.lit(float(r)))
        out = grid if out is None else out.unionByName(grid)
    return out


def members(points: DataFrame, resolution: float, id_col: str = "point_id", most: int = 5) -> DataFrame:
    """Per cell its number of points and the ``most`` smallest point ids (a report, ordered by cell).

    The rank filter is pruned before the shuffle, so a dense cell sends few ids.
    """
    cellular = with_cells(points, resolution)
    counts = cellular.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*CELL).orderBy(id_col))
    first = cellular.select(*CELL, id_col).withColumn("rank", rank).where(F.col("rank") <= most)
    sample = first.groupBy(*CELL).agg(F.array_sort(F.collect_list(id_col)).alias("sample"))
    return counts.join(sample, list(CELL)).orderBy(*CELL)


def bounds(points: DataFrame, *keys: str) -> DataFrame:
    low_high = [f(c).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max)) for c in "xyz"]
    extent = [(F.max(c) - F.min(c)).alias(f"extent_{c}") for c in "xyz"]
    return points.groupBy(*keys).agg(*low_high, *extent)
