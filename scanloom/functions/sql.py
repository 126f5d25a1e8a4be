"""The engine's scalar and table functions under SQL names.

They are SQL functions, which the optimizer inlines: calling ``voxel_cell`` in a
query costs what writing its expression would.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, result, body)
SCALARS = {
    "voxel_cell": ("x DOUBLE, resolution DOUBLE", "INT", "CAST(floor(x / resolution) AS INT)"),
    "pack_cell_key": (
        "vx INT, vy INT, vz INT", "BIGINT",
        "shiftleft(CAST(vz AS BIGINT) + 1048576, 42) | shiftleft(CAST(vy AS BIGINT) + 1048576, 21) | (CAST(vx AS BIGINT) + 1048576)",
    ),
    "ndt_score": ("mahalanobis2 DOUBLE, d1 DOUBLE, d2 DOUBLE", "DOUBLE", "-d1 * exp(-d2 * mahalanobis2 / 2)"),
    "wrap_angle": ("a DOUBLE", "DOUBLE", "a - floor((a + pi()) / (2 * pi())) * (2 * pi())"),
    "quaternion_yaw": ("qx DOUBLE, qy DOUBLE, qz DOUBLE, qw DOUBLE", "DOUBLE", "atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))"),
    "quaternion_angle": ("dot DOUBLE", "DOUBLE", "2 * acos(least(1.0, abs(dot)))"),
    "score_fraction": ("score DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN high <= low THEN 0.5 ELSE (score - low) / (high - low) END"),
    "stamp_ns": ("sec BIGINT, nanosec BIGINT", "BIGINT", "sec * 1000000000 + nanosec"),
}
TABLES = {
    "neighbor_cells": (
        "vx INT, vy INT, vz INT, k INT", "px INT, py INT, pz INT",
        "SELECT vx + a.i, vy + b.i, vz + c.i FROM (SELECT explode(sequence(-k, k)) AS i) a, (SELECT explode(sequence(-k, k)) AS i) b, (SELECT explode(sequence(-k, k)) AS i) c",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session; the names, for a caller to show."""
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, (parameters, result, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({result}) RETURN {body}")
    return [*SCALARS, *TABLES]
