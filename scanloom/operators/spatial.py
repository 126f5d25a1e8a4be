"""Distance joins of points with voxels.

A voxel's mean lies in its own cell, so voxels within a radius r of a point lie in
cells at most ceil(r / resolution) away.  The voxels, which are few, are copied
to the cells that they can reach, and points meet them by an equi-join on their
own cell: points are never multiplied before the join, and a hash join is chosen
by the voxels' size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.operators.voxels import CELL, with_cells


def _reach(voxels: DataFrame, cells_away: int) -> DataFrame:
    """Every voxel once for each cell that is at most so many cells away, as px, py, pz."""
    steps = F.array(*(F.lit(i) for i in range(-cells_away, cells_away + 1)))
    out = voxels
    for own, at in zip(CELL, ("px", "py", "pz"), strict=True):
        out = out.withColumn(at, F.explode(steps)).withColumn(at, F.col(own) + F.col(at))
    return out


def mean_distance_squared() -> Column:
    d = [F.col(c) - F.col("mean")[i] for i, c in enumerate("xyz")]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def neighbour_join(points: DataFrame, voxels: DataFrame, resolution: float, cells_away: int = 1, how: str = "inner") -> DataFrame:
    """Points beside the voxels of the cells around them, without a distance test."""
    near = _reach(voxels, cells_away)
    own = with_cells(points, resolution).withColumnsRenamed({"vx": "qx", "vy": "qy", "vz": "qz"})
    return own.join(near, (F.col("qx") == F.col("px")) & (F.col("qy") == F.col("py")) & (F.col("qz") == F.col("pz")), how).drop("qx", "qy", "qz", "px", "py", "pz")


def radius_join(points: DataFrame, voxels: DataFrame, resolution: float, radius: float | None = None) -> DataFrame:
    """Points beside all voxels whose mean is within the radius, with ``dist2``."""
    radius = resolution if radius is None else radius
    pairs = neighbour_join(points, voxels, resolution, max(1, math.ceil(radius / resolution)))
    return pairs.withColumn("dist2", mean_distance_squared()).where(F.col("dist2") <= radius * radius)


def nearest(pairs: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k nearest voxels of each point, numbered from 1; ties by cell."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("dist2", *CELL))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def lookup(points: DataFrame, voxels: DataFrame, resolution: float) -> DataFrame:
    """Points beside the voxel of their own cell, null where there is none."""
    return with_cells(points, resolution).join(voxels, list(CELL), "left")


def with_poses(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Every point under every pose.  ``poses`` are a stated set of candidates; Spark
    broadcasts them where their size allows, which a search's few hundred do."""
    return points.crossJoin(poses)
