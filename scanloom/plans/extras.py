"""Queries over SQL functions, markers and legacy voxels."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanloom.functions import sql as functions
from scanloom.operators import scoring, visual, voxels
from scanloom.plans.points import MOMENTS, PTS, RES, TRK
from scanloom.plans.registry import query
from scanloom.sources.adapters import points, track


@query(f"WITH {PTS} SELECT point_id, vx AS cell_x, ((vz::BIGINT + 1048576) << 42) | ((vy::BIGINT + 1048576) << 21) | (vx::BIGINT + 1048576) AS packed, round(0.5 * exp(-0.25 * z / 2), 6) AS score FROM cells")
def q_sql_functions(spark, d):
    functions.register(spark)
    r = F.lit(RES)
    cell = {c: F.call_function("voxel_cell", F.col(c), r) for c in "xyz"}
    return points(spark, d).select("point_id", cell["x"].alias("cell_x"), F.call_function("pack_cell_key", cell["x"], cell["y"], cell["z"]).alias("packed"), F.round(F.call_function("ndt_score", F.col("z"), F.lit(-0.5), F.lit(0.25)), 6).alias("score"))


@query(f"""WITH {PTS}, v AS (SELECT vx, vy, vz, count(*) AS n FROM cells GROUP BY ALL), o AS (SELECT unnest(range(-1, 2)) AS i)
    SELECT v.vx, v.vy, v.vz, CAST(sum(w.n) AS BIGINT) AS around FROM v, o a, o b, o c, v w WHERE w.vx = v.vx + a.i AND w.vy = v.vy + b.i AND w.vz = v.vz + c.i GROUP BY ALL""")
def q_neighbor_cells(spark, d):
    functions.register(spark)
    cells = voxels.with_cells(points(spark, d), RES).groupBy(*voxels.CELL).agg(F.count(F.lit(1)).alias("n"))
    cells.createOrReplaceTempView("occupied_cells")
    return spark.sql("""SELECT v.vx, v.vy, v.vz, sum(w.n) AS around FROM occupied_cells v, LATERAL neighbor_cells(v.vx, v.vy, v.vz, 1) p
        JOIN occupied_cells w ON w.vx = p.px AND w.vy = p.py AND w.vz = p.pz GROUP BY v.vx, v.vy, v.vz""")


@query(f"""WITH {MOMENTS}, k AS (SELECT vx, vy, vz, n, {', '.join(f's{p} / n - (s{p[0]} / n) * (s{p[1]} / n) + {0.01 if p[0] == p[1] else 0.0} AS {n}' for p, n in zip(('xx', 'xy', 'xz', 'yy', 'yz', 'zz'), 'abcdef', strict=True))} FROM sums WHERE n >= 6)
    SELECT vx, vy, vz, n, round((d * f - e * e) / (a * (d * f - e * e) + b * (c * e - b * f) + c * (b * e - c * d)), 4) AS i00, round((a * d - b * b) / (a * (d * f - e * e) + b * (c * e - b * f) + c * (b * e - c * d)), 4) AS i22 FROM k""")
def q_plain_voxels(spark, d):
    out = scoring.plain_voxels(points(spark, d), RES)
    return out.select(*voxels.CELL, "n", F.round(F.col("inv_cov")[0], 4).alias("i00"), F.round(F.col("inv_cov")[8], 4).alias("i22"))


@query(f"""WITH {TRK}, p AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS particle_id, x AS score, iterations FROM track WHERE event_type = 'view'),
    s AS (SELECT min(score) AS low, max(score) AS high, max(iterations) AS most, count(*) AS total FROM p), u AS (SELECT *, least(greatest((score - low) / greatest(high - low, 0.001), 0), 1) AS by_score, iterations / most AS by_iteration, particle_id / total * 300 / 60 AS hue FROM p, s)
    SELECT namespace, count(*) AS markers, round(avg(red), 6) AS mean_red, count(*) FILTER (best) AS best FROM (SELECT n.namespace, abs(score - high) < 1e-10 AND n.k < 3 AS best,
      CASE n.k WHEN 0 THEN 1 - by_score WHEN 1 THEN by_iteration WHEN 2 THEN 1 - greatest(0, least((5 + hue) % 6, 4 - (5 + hue) % 6, 1)) ELSE 0.3 END AS red
      FROM u, (VALUES ('initial_pose_transform_probability_color_marker', 0), ('initial_pose_iteration_color_marker', 1), ('initial_pose_index_color_marker', 2), ('result_pose_transform_probability_color_marker', 0),
        ('result_pose_iteration_color_marker', 1), ('result_pose_index_color_marker', 2), ('monte_carlo_initial', 3)) n(namespace, k)) GROUP BY namespace""")
def q_particle_markers(spark, d):
    from scanloom.operators.sorting import sorted_positions

    rows = track(spark, d).where("event_type = 'view'").select("event_id", *(F.col(c).alias(f"i{c}") for c in "xyz"), *(F.col(c).alias(f"r{c}") for c in "xyz"), F.col("x").alias("score"), "iterations")
    rows = sorted_positions(rows, "event_id", "score").withColumnRenamed("position", "particle_id")
    return visual.particle_markers(rows).groupBy("namespace").agg(F.count(F.lit(1)).alias("markers"), F.round(F.avg("r"), 6).alias("mean_red"), F.count_if("best").alias("best"))


@query(f"WITH {PTS} SELECT cloud_id, vx, vy, vz, CAST(sum(xi) AS BIGINT) AS sum_x, CAST(sum(yi) AS BIGINT) AS sum_y, CAST(sum(zi) AS BIGINT) AS sum_z, count(*) AS n FROM cells GROUP BY ALL")
def q_segment_sums(spark, d):
    cells = voxels.with_cells(points(spark, d), RES)
    return cells.groupBy("cloud_id", *voxels.CELL).agg(*(F.sum(f"{c}i").alias(f"sum_{c}") for c in "xyz"), F.count(F.lit(1)).alias("n"))
