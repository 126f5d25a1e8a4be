"""Marker rows for viewers: particles of a search and the history of an alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as G

#: Marker groups at the result pose, and what colours them; the group of initial poses has one colour.
RESULT_GROUPS = (
    ("initial_pose_transform_probability_color_marker", "score"), ("initial_pose_iteration_color_marker", "iterations"), ("initial_pose_index_color_marker", "index"),
    ("result_pose_transform_probability_color_marker", "score"), ("result_pose_iteration_color_marker", "iterations"), ("result_pose_index_color_marker", "index"),
)
INITIAL_GROUP, INITIAL_COLOR = "monte_carlo_initial", (0.3, 0.5, 1.0)
#: Scale and opacity of initial, result and best markers.
INITIAL_STYLE, RESULT_STYLE, BEST_STYLE = (0.15, 0.6), (0.2, 0.7), (0.4, 1.0)
#: Greatest hue of the index colours, and the least range of scores that is told apart.
INDEX_HUE, LEAST_RANGE = 300.0, 0.001


def particle_color(by: str) -> tuple[Column, Column, Column]:
    """Scores from red to green, iterations from green to red, indices along the rainbow."""
    if by == "index":
        hue = F.when(F.col("total") > 1, F.col("index") / F.col("total") * INDEX_HUE).otherwise(0.0)
        return G.hsv_to_rgb(hue, F.lit(1.0), F.lit(1.0))
    if by == "score":
        high = (F.col("score") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(LEAST_RANGE))
    else:
        high = 1 - F.when(F.col("most") > 1, F.col("iterations") / F.col("most")).otherwise(0.5)
    high = F.least(F.greatest(high, F.lit(0.0)), F.lit(1.0))
    return 1 - high, high, F.lit(0.0)


def particle_markers(particles: DataFrame) -> DataFrame:
    """Seven markers for each particle: six coloured ones at its result, one at its initial pose.

    ``particles``: particle_id (0, 1, ... in their order), ix, iy, iz (initial),
    rx, ry, rz (result), score, iterations.  ``best`` marks those of the best score.
    """
    ranges = particles.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.max("iterations").alias("most"), F.count(F.lit(1)).alias("total"))
    rows = particles.crossJoin(ranges).withColumn("index", F.col("particle_id"))  # one row of ranges
    best = F.abs(F.col("score") - F.col("high")) < 1e-10
    groups = [F.struct(F.lit(n).alias("namespace"), *(F.col(f"r{c}").alias(c) for c in "xyz"), *(v.cast("double").alias(k) for k, v in zip("rgb", particle_color(by), strict=True)), F.when(best, BEST_STYLE[0]).otherwise(RESULT_STYLE[0]).alias("scale"), F.when(best, BEST_STYLE[1]).otherwise(RESULT_STYLE[1]).alias("a"), best.alias("best")) for n, by in RESULT_GROUPS]
    groups.append(F.struct(F.lit(INITIAL_GROUP).alias("namespace"), *(F.col(f"i{c}").alias(c) for c in "xyz"), *(F.lit(v).alias(k) for k, v in zip("rgb", INITIAL_COLOR, strict=True)), F.lit(INITIAL_STYLE[0]).alias("scale"), F.lit(INITIAL_STYLE[1]).alias("a"), F.lit(False).alias("best")))
    return rows.select("particle_id", F.explode(F.array(*groups)).alias("m")).select("particle_id", "m.*")


def history_markers(alignments: DataFrame, keys: list[str], most: int = 30) -> DataFrame:
    """A marker for every iteration of an alignment log, growing from transparent to solid; unused numbers up to ``most`` are deletions."""
    steps = alignments.select(*keys, F.size("log").alias("_n"), "log").withColumn("marker_id", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    item = F.get("log", F.col("marker_id"))
    shown = F.col("marker_id") < F.col("_n")
    return steps.select(*keys, "marker_id", F.when(shown, "add").otherwise("delete").alias("action"), *(F.when(shown, item["pose"][i]).alias(c) for i, c in enumerate("xyz")), F.when(shown, (F.col("marker_id") + 1) / F.col("_n")).alias("opacity"))
