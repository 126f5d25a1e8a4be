"""Queries over scans and voxels: joins, scores, derivatives, alignment, covariance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.config import CovarianceConfig, GateConfig, InitialPoseConfig, MatchConfig, VoxelConfig
from scanloom.functions.kernels import gaussian_constants
from scanloom.operators import covariance as C
from scanloom.operators import filters, initial_pose, registration, scoring, spatial, voxels
from scanloom.plans.points import PTS, RES, STATS, rotated_sql
from scanloom.plans.registry import query
from scanloom.sources.adapters import points, scan, track

D1, D2 = gaussian_constants(RES, 0.55)
SCAN = """scan AS (SELECT p_partkey AS point_id, CAST(p_partkey % 5 AS INTEGER) AS scan_id, p_size::DOUBLE AS x,
    (CAST(round((p_retailprice - 900) * 1000) AS BIGINT) % 100000) / 1000 AS y, (p_partkey % 18)::DOUBLE AS z FROM part)"""
#: Voxels whose inverse covariance is 1 / s of the mean variance, so that SQL can state it.
ISO = f"{STATS}, iso AS (SELECT vx, vy, vz, n, mx, my, mz, greatest((cxx + cyy + czz) / 3, 0.01) AS s FROM stats)"


def iso_voxels(spark, d) -> DataFrame:
    stats = voxels.means_and_covariances(voxels.moments(points(spark, d), RES), RES)
    s = 1 / F.greatest((F.col("cxx") + F.col("cyy") + F.col("czz")) / 3, F.lit(0.01))
    zero = F.lit(0.0)
    inverse = F.array(s, zero, zero, zero, s, zero, zero, zero, s)
    return stats.select(*voxels.CELL, "n", F.array("mx", "my", "mz").alias("mean"), inverse.alias("inv_cov"), F.array(zero, zero, F.lit(1.0)).alias("axis"))


def _pairs(source: str = "scan", x: str = "q.x", y: str = "q.y", z: str = "q.z", near: bool = True) -> str:
    """SQL of all pairs; brute force over voxels of neighbouring cells or within the radius."""
    d2 = f"(({x}) - mx) * (({x}) - mx) + (({y}) - my) * (({y}) - my) + (({z}) - mz) * (({z}) - mz)"
    test = f"{d2} <= 16" if near else " AND ".join(f"v.v{c} BETWEEN floor(({e}) / 4) - 1 AND floor(({e}) / 4) + 1" for c, e in zip("xyz", (x, y, z), strict=True))
    # the cell range is implied by the radius and lets the engine prune
    prune = f"v.vx BETWEEN floor(({x}) / 4) - 1 AND floor(({x}) / 4) + 1"
    return f"SELECT q.*, v.vx, v.vy, v.vz, v.mx, v.my, v.mz, v.s, {d2} AS dist2, {-D1!r} * exp({-D2!r} * ({d2}) * (1 / v.s) / 2) AS score FROM {source} q, iso v WHERE {prune} AND {test}"


PAIRS = f"{ISO}, {SCAN}, pairs AS ({_pairs()})"


@query(f"WITH {PAIRS} SELECT point_id, count(*) AS voxels, round(min(dist2), 6) AS nearest2, round(sum(dist2), 5) AS total2 FROM pairs GROUP BY point_id")
def q_radius_join(spark, d):
    found = spatial.radius_join(scan(spark, d), iso_voxels(spark, d), RES)
    return found.groupBy("point_id").agg(F.count(F.lit(1)).alias("voxels"), F.round(F.min("dist2"), 6).alias("nearest2"), F.round(F.sum("dist2"), 5).alias("total2"))


@query(f"WITH {ISO}, {SCAN}, pairs AS ({_pairs(near=False)}) SELECT point_id, count(*) AS voxels, round(max(score), 6) AS best FROM pairs GROUP BY point_id")
def q_neigh27_join(spark, d):
    found = scoring.scored_pairs(scan(spark, d), iso_voxels(spark, d), RES, search="cells")
    return found.groupBy("point_id").agg(F.count(F.lit(1)).alias("voxels"), F.round(F.max("score"), 6).alias("best"))


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist2, vx, vy, vz) AS rank FROM pairs) SELECT point_id, CAST(rank AS INTEGER) AS rank, vx, vy, vz, round(dist2, 6) AS dist2 FROM r WHERE rank <= 3")
def q_nearest_k(spark, d):
    found = spatial.nearest(spatial.radius_join(scan(spark, d), iso_voxels(spark, d), RES), 3, "point_id")
    return found.select("point_id", "rank", *voxels.CELL, F.round("dist2", 6).alias("dist2"))


@query(f"WITH {ISO}, {SCAN} SELECT point_id, n IS NOT NULL AS found, coalesce(n, 0) AS n FROM scan LEFT JOIN iso ON vx = floor(x / 4) AND vy = floor(y / 4) AND vz = floor(z / 4)")
def q_point_lookup(spark, d):
    return spatial.lookup(scan(spark, d), iso_voxels(spark, d), RES).select("point_id", F.col("n").isNotNull().alias("found"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {PAIRS}, k AS (SELECT s.point_id, count(p.vx) AS k FROM scan s LEFT JOIN pairs p USING (point_id) GROUP BY 1) SELECT CAST(least(k, 3) AS BIGINT) AS voxels, count(*) AS points FROM k GROUP BY 1")
def q_vpp_histogram(spark, d):
    p = scan(spark, d)
    return scoring.voxels_per_point(p, spatial.radius_join(p, iso_voxels(spark, d), RES), "point_id").withColumn("voxels", F.col("voxels").cast("long"))


@query(f"WITH {PAIRS} SELECT s.point_id, round(coalesce(sum(p.score), 0), 6) AS score, round(coalesce(max(p.score), 0), 6) AS best, count(p.vx) AS voxels FROM scan s LEFT JOIN pairs p USING (point_id) GROUP BY 1")
def q_point_scores(spark, d):
    p = scan(spark, d)
    out = scoring.point_scores(p.select("point_id"), scoring.scored_pairs(p, iso_voxels(spark, d), RES), "point_id")
    return out.select("point_id", F.round("score", 6).alias("score"), F.round("best", 6).alias("best"), F.col("voxels").cast("long").alias("voxels"))


def _scan_sql(pairs: str, scan_keys: str, sizes: str) -> str:
    return f"""pt AS (SELECT {scan_keys}, point_id, sum(score) AS s, max(score) AS m, count(*) AS k FROM {pairs} GROUP BY ALL),
    sc AS (SELECT {scan_keys}, sum(s) AS score, sum(k) AS pairs, avg(m) AS nvtl, count(*) AS matched FROM pt GROUP BY ALL),
    sz AS ({sizes})
    SELECT {scan_keys}, points, round(coalesce(score, 0), 5) AS score, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs, round(CASE WHEN pairs > 0 THEN score / pairs ELSE 0 END, 6) AS tp_pairs,
    round(coalesce(score, 0) / points, 6) AS tp_points, round(exp(-coalesce(score, 0) / 10), 6) AS tp_exp, round(coalesce(nvtl, 0), 6) AS nvtl, points - coalesce(matched, 0) AS unmatched
    FROM sz LEFT JOIN sc USING ({scan_keys})"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"score": F.round("score", 5), **{c: F.round(c, 6) for c in ("tp_pairs", "tp_points", "tp_exp", "nvtl")}})


@query(f"WITH {PAIRS}, {_scan_sql('pairs', 'scan_id', 'SELECT scan_id, count(*) AS points FROM scan GROUP BY scan_id')}")
def q_scan_scores(spark, d):
    p = scan(spark, d)
    pairs = scoring.scored_pairs(p, iso_voxels(spark, d), RES)
    return _rounded(scoring.scan_scores(pairs, p.groupBy("scan_id").agg(F.count(F.lit(1)).alias("points")), ["point_id"], ["scan_id"]))


POSES = [(0, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)), (1, (1.5, -2.0, 0.25, 0.1, -0.2, 0.7)), (2, (500.0, 0.0, 0.0, 0.0, 0.0, 0.0))]


def pose_frame(spark) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in POSES], "pose_id long, " + ", ".join(f"{c} double" for c in registration.POSE))


def _posed_sql() -> str:
    parts = []
    for i, p in POSES:
        m = rotated_sql(pose=p)
        parts.append(f"SELECT {i}::BIGINT AS pose_id, scan_id, point_id, {', '.join(f'{v} AS {c}' for c, v in m.items())} FROM scan")
    return " UNION ALL ".join(parts)


@query(f"WITH {ISO}, {SCAN}, posed AS ({_posed_sql()}), pairs AS ({_pairs('posed')}), {_scan_sql('pairs', 'scan_id, pose_id', 'SELECT scan_id, pose_id, count(*) AS points FROM posed GROUP BY ALL')}")
def q_score_batch(spark, d):
    p = scan(spark, d)
    poses = p.select("scan_id").distinct().crossJoin(pose_frame(spark))  # a stated set of candidate poses
    return _rounded(registration.score_batch(p, poses, iso_voxels(spark, d), "scan_id", RES))


@query(f"""WITH {PAIRS}, b AS (SELECT point_id, max(score) AS best FROM pairs GROUP BY 1), u AS (SELECT point_id, least(greatest((best - 1.0) / 2.5, 0), 0.9999) AS u FROM b),
    w AS (SELECT *, sin((u*4 - floor(u*4)) * {math.pi / 2!r}) AS up, cos((u*4 - floor(u*4)) * {math.pi / 2!r}) AS down FROM u)
    SELECT point_id, round(CASE WHEN u < 0.5 THEN 0 WHEN u < 0.75 THEN up ELSE 1 END, 6) AS r, round(CASE WHEN u < 0.25 THEN up WHEN u < 0.75 THEN 1 ELSE down END, 6) AS g,
    round(CASE WHEN u < 0.25 THEN 1 WHEN u < 0.5 THEN down ELSE 0 END, 6) AS b, 0.999::DOUBLE AS a FROM w""")
def q_score_color(spark, d):
    best = scoring.scored_pairs(scan(spark, d), iso_voxels(spark, d), RES).groupBy("point_id").agg(F.max("score").alias("best"))
    return scoring.coloured(best).select("point_id", *(F.round(c, 6).alias(c) for c in "rgb"), "a")


@query("""WITH p AS (SELECT * FROM (VALUES (1.0, 0.55), (2.0, 0.55), (4.0, 0.3)) t(r, o)), c AS (SELECT r, o, 10 * (1 - o)::DOUBLE AS c1, (o / (r * r * r))::DOUBLE AS c2 FROM (SELECT r::DOUBLE AS r, o::DOUBLE AS o FROM p)),
    e AS (SELECT *, -ln(c2) AS d3 FROM c), f AS (SELECT *, -ln(c1 + c2) - d3 AS d1 FROM e)
    SELECT r AS resolution, o AS outlier_ratio, round(d1, 9) AS d1, round(-2 * ln((-ln(c1 * exp(-0.5) + c2) - d3) / d1), 9) AS d2 FROM f""")
def q_gauss_params(spark, d):
    rows = [(r, o, *(round(v, 9) for v in gaussian_constants(r, o))) for r, o in ((1.0, 0.55), (2.0, 0.55), (4.0, 0.3))]
    return spark.createDataFrame(rows, "resolution double, outlier_ratio double, d1 double, d2 double")


_SHIFT = (0.3, -0.2, 0.1, 0.0, 0.0, 0.0)
_DPAIRS = _pairs("scan", "q.x + 0.3", "q.y + -0.2", "q.z + 0.1")


@query(f"""WITH {ISO}, {SCAN}, pairs AS ({_DPAIRS}), w AS (SELECT *, x + 0.3 - mx AS dx, y - 0.2 - my AS dy, z + 0.1 - mz AS dz, {D1!r} * {D2!r} * exp({-D2!r} * dist2 / s / 2) AS w FROM pairs)
    SELECT round(sum(score), 4) AS score, round(sum(w * dx / s), 4) AS g0, round(sum(w * dy / s), 4) AS g1, round(sum(w * dz / s), 4) AS g2,
    round(sum(w * (1 / s - {D2!r} * (dx / s) * (dx / s))), 4) AS h00, round(sum(w * -{D2!r} * (dx / s) * (dy / s)), 4) AS h01, round(sum(w * (1 / s - {D2!r} * (dy / s) * (dy / s))), 4) AS h11, count(*)::DOUBLE AS pairs FROM w""")
def q_derivative_sums(spark, d):
    out = scoring.derivative_sums(scan(spark, d), iso_voxels(spark, d), _SHIFT, RES)
    return out.select(*(F.round(c, 4).alias(c) for c in ("score", "g0", "g1", "g2", "h00", "h01", "h11")), "pairs")


# ---- covariance and weights over event values

_TRK_SAMPLES = "t AS (SELECT event_id, event_type, value AS x, CAST(json_extract(props, '$.k') AS INTEGER)::DOUBLE AS y FROM events)"


def _samples(spark, d) -> DataFrame:
    return track(spark, d).select("event_id", "event_type", "x", "y", (F.col("x") / 100).alias("nvtl"))


_WEIGHTS = f"{_TRK_SAMPLES}, m AS (SELECT event_type, max(x / 100) AS top FROM t GROUP BY 1), e AS (SELECT t.*, exp((x / 100 - top) / 0.05) AS e FROM t JOIN m USING (event_type)), w AS (SELECT *, e / sum(e) OVER (PARTITION BY event_type) AS w FROM e)"


@query(f"WITH {_WEIGHTS} SELECT event_id, round(w, 7) AS weight FROM w")
def q_softmax_weights(spark, d):
    return C.softmax_weights(_samples(spark, d), "nvtl", 0.05, "event_type").select("event_id", F.round("weight", 7).alias("weight"))


@query(f"""WITH {_WEIGHTS}, c AS (SELECT event_type, sum(w * x) AS mx, sum(w * y) AS my FROM w GROUP BY 1) SELECT event_type, round(any_value(mx), 5) AS mean_x, round(any_value(my), 5) AS mean_y,
    round(sum(w * (x - mx) * (x - mx)), 5) AS cxx, round(sum(w * (x - mx) * (y - my)), 5) + 0.0 AS cxy, round(sum(w * (y - my) * (y - my)), 5) AS cyy FROM w JOIN c USING (event_type) GROUP BY 1""")
def q_cov_softmax_weighted(spark, d):
    out = C.weighted_covariance(C.softmax_weights(_samples(spark, d), "nvtl", 0.05, "event_type"), "weight", "event_type")
    return out.select("event_type", *((F.round(c, 5) + 0.0).alias(c) for c in ("mean_x", "mean_y", "cxx", "cxy", "cyy")))


@query(f"WITH {_TRK_SAMPLES} SELECT event_type, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(var_samp(x), 5) AS cxx, round(covar_samp(x, y), 5) AS cxy, round(var_samp(y), 5) AS cyy FROM t GROUP BY 1")
def q_sample_cov2(spark, d):
    out = C.sample_covariance(_samples(spark, d), "event_type")
    return out.select("event_type", F.round("mean_x", 6).alias("mean_x"), F.round("mean_y", 6).alias("mean_y"), *(F.round(c, 5).alias(c) for c in ("cxx", "cxy", "cyy")))


@query("""WITH h AS (SELECT p_partkey, -(p_size + 1)::DOUBLE AS a, ((p_partkey % 13) - 6)::DOUBLE AS b, -((p_partkey % 17) * 3)::DOUBLE AS c FROM part), k AS (SELECT *, a * c - b * b AS det FROM h)
    SELECT p_partkey, round(CASE WHEN abs(det) > 1e-12 THEN -c / det ELSE 1 END, 6) + 0.0 AS cxx, round(CASE WHEN abs(det) > 1e-12 THEN b / det ELSE 0 END, 6) + 0.0 AS cxy, round(CASE WHEN abs(det) > 1e-12 THEN -a / det ELSE 1 END, 6) + 0.0 AS cyy FROM k""")
def q_laplace_2x2(spark, d):
    h = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (-(F.col("p_size") + 1)).cast("double").alias("a"), ((F.col("p_partkey") % 13) - 6).cast("double").alias("b"), (-(F.col("p_partkey") % 17) * 3).cast("double").alias("c"))
    out = C.laplace_xy(F.col("a"), F.col("b"), F.col("c"))
    return h.select("p_partkey", *((F.round(v, 6) + 0.0).alias(n) for v, n in zip(out, ("cxx", "cxy", "cyy"), strict=True)))


@query(f"WITH {_TRK_SAMPLES} SELECT event_type, arg_max(event_id, (x, -event_id)) AS particle_id, max(x) AS score FROM t GROUP BY 1")
def q_best_particle(spark, d):
    rows = _samples(spark, d).select("event_type", F.col("event_id").alias("particle_id"), F.col("x").alias("score"))
    return C.best_of(rows, "score", "event_type")


@query(f"WITH {_TRK_SAMPLES}, m AS (SELECT event_type, max(x) AS top FROM t GROUP BY 1) SELECT event_type, round(any_value(top) + ln(sum(exp(x - top))), 6) AS lse FROM t JOIN m USING (event_type) GROUP BY 1")
def q_logsumexp(spark, d):
    return C.log_sum_exp(_samples(spark, d), "x", "event_type").withColumn("lse", F.round("lse", 6))


@query(f"WITH {_TRK_SAMPLES}, r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY x DESC, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM t) SELECT event_id, rn <= greatest(1, least(n // 10, 10)) AS above FROM r")
def q_topk_above(spark, d):
    rows = _samples(spark, d).select("event_type", F.col("event_id").alias("trial_id"), F.col("x").alias("score"))
    return initial_pose.split_trials(rows, "score", "event_type").select(F.col("trial_id").alias("event_id"), "above")


_SIG = initial_pose.KERNEL_SIGMA
_LOGP = f"-0.5 * ((c.x - t.x) / {_SIG[0]!r}) * ((c.x - t.x) / {_SIG[0]!r}) - {math.log(_SIG[0])!r} - 0.5 * ((c.y - t.y) / {_SIG[1]!r}) * ((c.y - t.y) / {_SIG[1]!r}) - {math.log(_SIG[1])!r} - 0.5 * (wr / {_SIG[2]!r}) * (wr / {_SIG[2]!r}) - {math.log(_SIG[2])!r}"


@query(f"""WITH t AS (SELECT s_suppkey AS id, s_acctbal / 5000 AS x, s_nationkey / 10 AS y, s_suppkey % 7 / 1.0 AS yaw FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY x DESC, id) AS rn, count(*) OVER () AS n FROM t),
    tr AS (SELECT *, rn <= greatest(1, least(n // 10, 10)) AS above FROM r), c AS (SELECT n_nationkey AS candidate_id, n_nationkey / 20 AS x, n_regionkey / 3 AS y, n_nationkey % 5 / 1.0 AS yaw FROM nation),
    w AS (SELECT c.candidate_id, t.above, {_LOGP.replace('wr', '((c.yaw - t.yaw) - floor(((c.yaw - t.yaw) + pi()) / (2 * pi())) * (2 * pi()))')} AS lp FROM c, tr t), m AS (SELECT candidate_id, above, max(lp) AS top FROM w GROUP BY ALL),
    l AS (SELECT candidate_id, above, any_value(top) + ln(sum(exp(lp - top))) - ln(count(*)) AS lse FROM w JOIN m USING (candidate_id, above) GROUP BY ALL)
    SELECT candidate_id, round(coalesce(max(lse) FILTER (above), 0) - 5 * coalesce(max(lse) FILTER (NOT above), 0), 4) AS ratio FROM l GROUP BY 1""")
def q_tpe_ratio(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("trial_id"), (F.col("s_acctbal") / 5000).alias("x"), (F.col("s_nationkey") / 10).alias("y"), (F.col("s_suppkey") % 7).cast("double").alias("yaw"))
    trials = initial_pose.split_trials(s.withColumn("score", F.col("x")))
    c = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("candidate_id"), (F.col("n_nationkey") / 20).alias("x"), (F.col("n_regionkey") / 3).alias("y"), (F.col("n_nationkey") % 5).cast("double").alias("yaw"))
    return initial_pose.density_ratio(c, trials).withColumn("ratio", F.round("ratio", 4))


_OFF = CovarianceConfig().offsets


@query(f"""WITH o AS (SELECT * FROM (VALUES (0, 0.0, 0.0), {', '.join(f'({i}, {x}, {y})' for i, (x, y) in enumerate(_OFF, 1))}) t(offset_id, ox, oy)), p AS (SELECT p_partkey, p_size::DOUBLE AS tx, (p_partkey % 50)::DOUBLE AS ty, (p_partkey % 9) / 10 - 0.4 AS yaw FROM part)
    SELECT p_partkey, CAST(offset_id AS INTEGER) AS offset_id, round(tx + cos(yaw) * ox - sin(yaw) * oy, 6) AS tx, round(ty + sin(yaw) * ox + cos(yaw) * oy, 6) AS ty FROM p, o""")
def q_offset_poses(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("tx"), (F.col("p_partkey") % 50).cast("double").alias("ty"), F.lit(0.0).alias("roll"), F.lit(0.0).alias("pitch"), ((F.col("p_partkey") % 9) / 10 - 0.4).alias("yaw"))
    return C.offset_poses(rows).select("p_partkey", "offset_id", F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"))


@query("""WITH a AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'max_iterations' ELSE 'converged' END AS status, value / 50 AS nvtl, CAST(json_extract(props, '$.k') AS INTEGER) % 20 AS oscillation FROM events)
    SELECT event_id, status = 'converged' AND oscillation <= 10 AND nvtl >= 2.3 AS published FROM a""")
def q_gate(spark, d):
    rows = track(spark, d).select("event_id", F.when(F.col("event_type") == "error", "max_iterations").otherwise("converged").alias("status"), (F.col("x") / 50).alias("nvtl"), F.lit(0.0).alias("tp_pairs"), (F.col("iterations") % 20).alias("oscillation"))
    return filters.publish_gate(rows, GateConfig()).select("event_id", "published")


@query("""WITH a AS (SELECT event_id, event_type <> 'error' AS posed, event_type <> 'view' AS moved, value / 50 AS nvtl, CAST(json_extract(props, '$.k') AS INTEGER) % 20 AS oscillation FROM events)
    SELECT event_id AS scan_id, CASE WHEN NOT posed THEN 'warn' WHEN NOT moved THEN 'error' WHEN oscillation > 10 THEN 'warn' ELSE 'ok' END AS level,
    CASE WHEN NOT posed THEN 'Failed to interpolate initial pose' WHEN NOT moved THEN 'Failed to transform sensor points' WHEN oscillation > 10 THEN 'Oscillation detected: ' || oscillation || ' reversals' ELSE 'OK' END AS message,
    CAST(oscillation AS VARCHAR) AS oscillation, format('{:.6f}', nvtl) AS nvtl FROM a""")
def q_diagnostics(spark, d):
    from scanloom.config import EngineConfig
    from scanloom.streaming.matcher import diagnostics

    rows = track(spark, d).select(
        F.col("event_id").alias("scan_id"), F.lit("converged").alias("status"), (F.col("x") / 50).alias("nvtl"), F.lit(0.0).alias("tp_pairs"), "iterations", (F.col("iterations") % 20).alias("oscillation"),
        (F.col("event_type") != "error").alias("is_succeed_interpolate_initial_pose"), (F.col("event_type") != "view").alias("is_succeed_transform_sensor_points"),
    )
    out = diagnostics(rows, EngineConfig())
    return out.select("scan_id", "level", "message", F.col("values")["local_optimal_solution_oscillation_num"].alias("oscillation"), F.col("values")["nearest_voxel_transformation_likelihood"].alias("nvtl"))
