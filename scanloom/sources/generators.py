"""Synthetic clouds as DataFrames, made on the executors from ``spark.range``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _f(c: Column) -> Column:
    return c.cast("float")


def half_cube(spark: SparkSession, length: float = 20.0, interval: float = 0.2, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Three faces of a cube that meet in a corner: (u, v, 0), (0, u, v), (u, 0, v)."""
    k = int(np.float32(length) / np.float32(interval)) + 1
    grid = spark.range(k * k).select(F.col("id"), _f(F.lit(interval).cast("float") * (F.col("id") % k).cast("float")).alias("u"), _f(F.lit(interval).cast("float") * F.floor(F.col("id") / k).cast("float")).alias("v"))
    zero = F.lit(0.0).cast("float")
    faces = F.array(*(F.struct(F.lit(i).alias("face"), a.alias("x"), b.alias("y"), c.alias("z")) for i, (a, b, c) in enumerate([(F.col("u"), F.col("v"), zero), (zero, F.col("u"), F.col("v")), (F.col("u"), zero, F.col("v"))])))
    out = grid.select("id", F.explode(faces).alias("p"))
    moved = [_f(F.col(f"p.{c}") + F.lit(o).cast("float")).alias(c) for c, o in zip("xyz", offset, strict=True)]
    return out.select((F.col("id") * 3 + F.col("p.face")).alias("point_id"), *moved)


def plane(spark: SparkSession, size: float, interval: float, z: float = 0.0) -> DataFrame:
    k = int(size / interval) + 1
    at = lambda c: _f(c.cast("double") * interval)
    return spark.range(k * k).select(F.col("id").alias("point_id"), at(F.col("id") % k).alias("x"), at(F.floor(F.col("id") / k)).alias("y"), F.lit(z).cast("float").alias("z"))


def lattice(spark: SparkSession, size: int, interval: float, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """size^3 points of a cubic lattice."""
    at = lambda c, o: _f(c.cast("double") * interval + o)
    i = F.col("id")
    return spark.range(size**3).select(i.alias("point_id"), at(i % size, offset[0]).alias("x"), at(F.floor(i / size) % size, offset[1]).alias("y"), at(F.floor(i / (size * size)), offset[2]).alias("z"))


def sphere(spark: SparkSession, centre: tuple[float, float, float], radius: float, n: int, seed: int = 0) -> DataFrame:
    """n points uniform on a sphere; each point's numbers are hashes of its id and the seed."""
    unit = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), 11) / float(1 << 53)
    height, turn = 2 * unit(1) - 1, 2 * np.pi * unit(2)
    flat = F.sqrt(1 - F.col("h") * F.col("h"))
    out = spark.range(n).withColumns({"h": height, "a": turn})
    return out.select(F.col("id").alias("point_id"), _f(centre[0] + radius * flat * F.cos("a")).alias("x"), _f(centre[1] + radius * flat * F.sin("a")).alias("y"), _f(centre[2] + radius * F.col("h")).alias("z"))


def clustered(spark: SparkSession, centres: list[tuple[float, float, float]], spread: float, n: int, seed: int = 0) -> DataFrame:
    """n points around each centre."""
    table = F.array(*(F.struct(F.lit(i).alias("c"), *(F.lit(float(v)).alias(a) for a, v in zip("xyz", c, strict=True))) for i, c in enumerate(centres)))
    unit = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id"), F.col("t.c")), 11) / float(1 << 53) - 0.5
    out = spark.range(n).select("id", F.explode(table).alias("t"))
    return out.select((F.col("t.c") * n + F.col("id")).alias("point_id"), *(_f(F.col(f"t.{a}") + spread * unit(k)).alias(a) for k, a in enumerate("xyz")))
