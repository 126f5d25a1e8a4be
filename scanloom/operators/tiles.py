"""A map kept as tiles: differential loads, statistics, and when to update."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.config import MapConfig


def in_area(tiles: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    d2 = (F.col("cx") - x) * (F.col("cx") - x) + (F.col("cy") - y) * (F.col("cy") - y)
    return tiles.where(d2 <= radius * radius)


def tile_difference(area: DataFrame, cached: DataFrame, tile: str = "tile_id") -> DataFrame:
    """tile and action: ``add`` what the area has and the cache lacks, ``remove`` the reverse."""
    wanted, held = area.select(tile).distinct(), cached.select(tile).distinct()
    add = wanted.join(held, tile, "left_anti").withColumn("action", F.lit("add"))
    return add.union(held.join(wanted, tile, "left_anti").withColumn("action", F.lit("remove")))


def apply_difference(points: DataFrame, difference: DataFrame, new_points: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Tile points after an update; tiles that are added replace what was there."""
    stay = points.join(difference.select(tile), tile, "left_anti")
    return stay.unionByName(new_points.join(difference.where("action = 'add'").select(tile), tile, "left_semi"))


def tile_centres(points: DataFrame, tile: str = "tile_id") -> DataFrame:
    return points.groupBy(tile).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"), F.count(F.lit(1)).alias("points"))


def tile_stats(points: DataFrame, x: float, y: float, radius: float, tile: str = "tile_id") -> DataFrame:
    """Tiles and points of the map, and those within the radius."""
    near = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) <= radius * radius
    per_tile = points.groupBy(tile).agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("m"))
    return per_tile.agg(F.count(F.lit(1)).alias("tiles"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"), F.coalesce(F.sum("m"), F.lit(0)).alias("points_in_range"))


def update_decisions(positions: DataFrame, keys: list[str], order: str, config: MapConfig = MapConfig()) -> DataFrame:
    """Adds ``moved`` (from the last update; null before the first), ``should_update`` and ``out_of_range``.

    An update is due on the first position and after more than the update distance
    from the position of the last update, so each row depends on the ones before:
    a track is scanned in its order, by one task, with three numbers of state.
    """
    names = [f.name for f in positions.schema.fields]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        x, y = (np.asarray(table.column(c), dtype=float) for c in ("x", "y"))
        moved, due, out = np.full(len(x), np.nan), np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
        last = None
        for i in range(len(x)):
            if last is None:
                due[i] = out[i] = True
            else:
                moved[i] = np.hypot(x[i] - last[0], y[i] - last[1])
                due[i], out[i] = moved[i] > config.update_distance, moved[i] + config.lidar_radius > config.map_radius
            if due[i]:
                last = (x[i], y[i])
        columns = [*table.columns, pa.array(moved, from_pandas=True), pa.array(due), pa.array(out)]
        return pa.table(columns, names=[*names, "moved", "should_update", "out_of_range"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in positions.schema.fields) + ", moved double, should_update boolean, out_of_range boolean"
    return positions.groupBy(*keys).applyInArrow(run, schema)


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of every key, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")
