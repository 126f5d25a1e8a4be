"""Queries that align: scans of a room whose poses are known, so that SQL states where they must end.

The map is made of every row of ``lineitem``, and so are the scans (or of every
row of ``part``); a scan's points are the map's, moved by the inverse of its pose.
Alignments start from no movement.  Positions are compared to a tenth of a
metre, angles to a fiftieth of a radian.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.config import CovarianceConfig, EngineConfig, InitialPoseConfig, MatchConfig, VoxelConfig
from scanloom.matcher import Matcher, MultiGridMatcher
from scanloom.operators import covariance as C
from scanloom.operators import initial_pose, registration, visual, voxels
from scanloom.operators.packed import PackedScans
from scanloom.plans.registry import query
from scanloom.sources.adapters import ROOM_POSE, ROOM_SCANS, room, room_scans

#: Steps short enough for walls some centimetres thick.
MATCH = MatchConfig(resolution=2.0, step_size=0.03)
POSE = registration.POSE
_PARTS_AT = [f"round((scan_id % {m} - {s}) / {d}, 2) + 0.0 AS {n}" for n, (m, s, d) in ROOM_POSE.items()]
_AT, _YAW = ", ".join(_PARTS_AT), _PARTS_AT[-1]
_SCANS = f"scans AS (SELECT CAST(l_suppkey % {ROOM_SCANS} AS INTEGER) AS scan_id, count(*) AS points FROM lineitem GROUP BY 1)"
_PARTS = "scans AS (SELECT CAST(p_size % 2 AS INTEGER) AS scan_id, count(*) AS points FROM part GROUP BY 1)"


def room_voxels(spark, d, resolution: float = 2.0) -> DataFrame:
    return voxels.build_voxels(room(spark, d), VoxelConfig(resolution=resolution))


def packed_room(spark, d) -> PackedScans:
    """The scans of the room, packed once for several alignments."""
    return PackedScans(room_scans(spark, d), "scan_id", MATCH.resolution)


def unmoved(scans: DataFrame | PackedScans) -> DataFrame:
    """One pose for each scan: none."""
    scans = scans.points if isinstance(scans, PackedScans) else scans
    return scans.select("scan_id").distinct().select("scan_id", F.lit(0).cast("long").alias("pose_id"), *(F.lit(0.0).alias(c) for c in POSE))


def coarse(c: str):
    """A position to a tenth, an angle to a fiftieth."""
    steps = 10 if c in POSE[:3] else 50
    return (F.round(F.round(F.col(c) * steps) / steps, 2) + 0.0).alias(c)


def found_poses(spark, d, config: MatchConfig, **more) -> DataFrame:
    scans = room_scans(spark, d)
    return registration.align_batch(scans, unmoved(scans), room_voxels(spark, d, config.resolution), "scan_id", config, **more)


@query(f"WITH {_SCANS} SELECT scan_id, 0::BIGINT AS pose_id, 'converged' AS status, true AS likely, {_AT} FROM scans")
def q_align_batch(spark, d):
    return found_poses(spark, d, MATCH).select("scan_id", "pose_id", "status", (F.col("nvtl") >= 2.3).alias("likely"), *map(coarse, POSE))


@query(f"WITH {_SCANS} SELECT scan_id, 'converged' AS status, true AS gapless, true AS from_guess, true AS ascends, true AS ends_small, {_AT} FROM scans")
def q_align_debug(spark, d):
    """With the line search: the log has every iteration, starts at the guess, and scores rise."""
    out = found_poses(spark, d, replace(MATCH, use_line_search=True, step_size=0.1), debug=True)
    first, last = F.col("log")[0], F.element_at("log", -1)
    rises = F.forall(F.sequence(F.lit(1), F.size("log") - 1), lambda i: F.get("log", i)["score"] >= F.get("log", i - 1)["score"] - 1e-6)
    return out.select(
        "scan_id", "status", ((last["iteration"] + 1 == F.size("log")) & (last["iteration"] == F.col("iterations"))).alias("gapless"), (F.array_max(F.transform(first["pose"], F.abs)) == 0).alias("from_guess"),
        rises.alias("ascends"), (last["newton_step_norm"] < MATCH.trans_epsilon).alias("ends_small"), *map(coarse, POSE),
    )


@query(f"WITH {_SCANS} SELECT scan_id, true AS ended, {_YAW} FROM scans")
def q_align_plane(spark, d):
    """The plane metric is looser along its planes: only the heading is compared."""
    out = found_poses(spark, d, replace(MATCH, metric="plane"))
    return out.select("scan_id", F.col("status").isin("converged", "max_iterations").alias("ended"), coarse("yaw"))


@query(f"WITH {_SCANS} SELECT scan_id, 0::BIGINT AS pose_id, 2.0::DOUBLE AS resolution, 'converged' AS status, {_AT} FROM scans")
def q_align_multigrid(spark, d):
    scans = room_scans(spark, d)
    grids = {r: room_voxels(spark, d, r) for r in (4.0, 2.0)}
    out = registration.align_multigrid(scans, unmoved(scans), grids, "scan_id", {4.0: 10, 2.0: 30}, MATCH, adaptive_nvtl=2.3)
    return out.select("scan_id", "pose_id", "resolution", "status", *map(coarse, POSE))


@query("SELECT count(*) AS points, 'converged' AS status, " + ", ".join(f"(9 % {m} - {s}) / {d}::DOUBLE + 0.0 AS {n}" for n, (m, s, d) in ROOM_POSE.items()) + " FROM lineitem")
def q_align_cloud(spark, d):
    """All points as one cloud under the pose of scan 9; points stay distributed."""
    cloud = room_scans(spark, d, one=9)
    found = registration.align_cloud(cloud, room_voxels(spark, d).persist(), (0.0,) * 6, MATCH)
    row = spark.range(1).select(F.lit(found["status"]).alias("status"), *(F.lit(float(v)).alias(c) for c, v in zip(POSE, found["pose"], strict=True)))
    return cloud.agg(F.count(F.lit(1)).alias("points")).join(row).select("points", "status", *map(coarse, POSE))  # one row each


@query(f"WITH {_PARTS} SELECT scan_id AS search, {InitialPoseConfig().particles}::BIGINT AS particles, true AS reliable, {_AT} FROM scans")
def q_initial_pose(spark, d):
    """A search for each scan of part's points; yaw may be anything at the start."""
    rows, _ = initial_pose.search_scans(room_scans(spark, d, "part"), room_voxels(spark, d).persist(), (0.0,) * 6, (0.5, 0.5, 0.1, 0.02, 0.02, 0.0), "scan_id", InitialPoseConfig(), MATCH)
    best = C.best_of(rows.select("scan_id", "particle_id", "score"), "score", "scan_id")
    sizes = rows.groupBy("scan_id").agg(F.count(F.lit(1)).alias("particles"))
    chosen = best.select("scan_id", "particle_id").join(rows, ["scan_id", "particle_id"]).join(sizes, "scan_id")
    return chosen.select(F.col("scan_id").alias("search"), "particles", (F.col("nvtl") >= InitialPoseConfig().reliable_nvtl).alias("reliable"), *map(coarse, POSE))


_COV = CovarianceConfig(kind="multi_ndt")


@query(f"WITH {_SCANS} SELECT scan_id, {len(_COV.offsets) + 1}::BIGINT AS poses, {_COV.diagonal[0]}::DOUBLE AS cxx, {_COV.diagonal[1]}::DOUBLE AS cyy, true AS slight, {sum(_COV.diagonal)!r}::DOUBLE AS trace FROM scans")
def q_cov_multi_ndt(spark, d):
    """Proposals around each result end where it does, so that the floor of the covariance holds."""
    scans, grid = packed_room(spark, d), room_voxels(spark, d).persist()
    found = registration.align_batch(scans, unmoved(scans), grid, "scan_id", MATCH).persist()
    offsets = C.offset_poses(found.select("scan_id", *POSE), _COV).withColumnRenamed("offset_id", "pose_id")
    again = registration.align_batch(scans, offsets, grid, "scan_id", MATCH).persist()
    scans.close()
    out = C.covariance_from_offsets(again, _COV, "scan_id").withColumn("covariance", C.full_covariance(_COV))
    trace = sum(F.col("covariance")[7 * i] for i in range(6))
    sizes = again.groupBy("scan_id").agg(F.count(F.lit(1)).alias("poses"))
    return out.join(sizes, "scan_id").select("scan_id", "poses", F.round("cxx", 6).alias("cxx"), F.round("cyy", 6).alias("cyy"), (F.abs("cxy") < F.col("cxx")).alias("slight"), F.round(trace, 6).alias("trace"))


@query(f"WITH {_SCANS} SELECT scan_id, 30::BIGINT AS markers, true AS grows, true AS solid, true AS deletions_last FROM scans")
def q_history_markers(spark, d):
    rows = visual.history_markers(found_poses(spark, d, MATCH, debug=True), ["scan_id", "pose_id"])
    before = F.lag("opacity").over(Window.partitionBy("scan_id", "pose_id").orderBy("marker_id"))
    rows = rows.withColumn("rises", before.isNull() | F.col("opacity").isNull() | (F.col("opacity") > before))
    added = F.col("action") == "add"
    last = F.max(F.when(added, F.col("marker_id")))
    return rows.groupBy("scan_id").agg(F.count(F.lit(1)).alias("markers"), F.min("rises").alias("grows"), (F.max("opacity") == 1).alias("solid"), (last + 1 == F.count_if(added)).alias("deletions_last"))


_SEARCHES = ("more_thuente", "backtracking", "candidates")


@query(f"WITH {_SCANS} SELECT search, scan_id, 'converged' AS status, {_AT} FROM scans, (VALUES {', '.join(f'({x!r})' for x in _SEARCHES)}) t(search)")
def q_line_searches(spark, d):
    """The three line searches reach the same poses."""
    from functools import reduce

    scans, grid = packed_room(spark, d), room_voxels(spark, d).persist()
    poses = unmoved(scans).persist()
    runs = []
    for x in _SEARCHES:
        found = registration.align_batch(scans, poses, grid, "scan_id", replace(MATCH, use_line_search=True, step_size=0.1, search=x))
        runs.append(found.select(F.lit(x).alias("search"), "scan_id", "status", *map(coarse, POSE)))
    scans.close()
    return reduce(DataFrame.union, runs)


_KINDS = ("fixed", "laplace", "multi_ndt", "multi_ndt_score")


@query(f"WITH {_SCANS} SELECT kind, scan_id, {_COV.diagonal[0]}::DOUBLE AS cxx, {_COV.diagonal[1]}::DOUBLE AS cyy, {_COV.diagonal[5]}::DOUBLE AS cww, true AS slight FROM scans, (VALUES {', '.join(f'({x!r})' for x in _KINDS)}) t(kind)")
def q_covariance_kinds(spark, d):
    """In a room that fixes every direction all estimators fall to the floor."""
    from functools import reduce

    matcher = Matcher(EngineConfig(match=MATCH)).set_target(room(spark, d))
    scans = matcher.pack(room_scans(spark, d))
    found = matcher.align_scans(scans, unmoved(scans)).persist()
    runs = []
    for kind in _KINDS:
        matcher.config = replace(matcher.config, covariance=CovarianceConfig(kind=kind))
        c = F.col("covariance")
        runs.append(matcher.covariances(found, scans).select(F.lit(kind).alias("kind"), "scan_id", F.round(c[0], 6).alias("cxx"), F.round(c[7], 6).alias("cyy"), F.round(c[35], 6).alias("cww"), (F.abs(c[1]) < c[0]).alias("slight")))
    scans.close()
    return reduce(DataFrame.union, runs)


@query(f"WITH {_SCANS} SELECT resolution, true AS likely, n AS points FROM (VALUES (4.0::DOUBLE), (2.0::DOUBLE)) t(resolution), (SELECT count(*) AS n FROM lineitem) UNION ALL SELECT 0, true, count(*) FROM scans")
def q_multi_grid_matcher(spark, d):
    """A matcher of two resolutions: scores of the whole room where it stands, and the scans that it brings home."""
    matcher = MultiGridMatcher((4.0, 2.0), EngineConfig(match=MATCH), {4.0: 10, 2.0: 30}, adaptive_nvtl=2.3).set_target(room(spark, d))
    whole = [(r, bool(x["nvtl"] >= 2.3), int(x["points"])) for r, x in matcher.evaluate(room(spark, d), (0.0,) * 6).items()]
    scans = room_scans(spark, d)
    home = matcher.align_scans(scans, unmoved(scans)).agg(F.lit(0.0).alias("resolution"), (F.min("nvtl") >= 2.3).alias("likely"), F.count_if(F.col("status") == "converged").alias("points"))
    rows = F.array(*(F.struct(F.lit(r).alias("resolution"), F.lit(g).alias("likely"), F.lit(n).cast("long").alias("points")) for r, g, n in whole))
    return spark.range(1).select(F.inline(rows)).union(home)


#: Where the sensor stands on the vehicle: a quarter turn, half a metre ahead and one up.
_LIDAR = (0.5, 0.0, 1.0, 0.0, 0.0, 0.7071067811865476, 0.7071067811865476)


def room_messages(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Messages of the sensor, poses, transforms and fixes; scan 7 names an unknown frame, scan 5 has no poses near."""
    from scanloom.functions import geometry as G
    from scanloom.sources import pointcloud
    from scanloom.sources.adapters import room_pose

    scans = room_scans(spark, d)
    # p_sensor = R' (p - t) with a quarter turn about z: x' = y, y' = -x
    seen = scans.select("point_id", F.col("scan_id").cast("long").alias("scan_id"), F.col("y").alias("x"), (F.lit(_LIDAR[0]) - F.col("x")).alias("y"), (F.col("z") - _LIDAR[2]).alias("z"))
    stamp = (F.col("scan_id") * 10_000_000_000 + 1_000_000_000).cast("long").alias("stamp_ns")
    messages = pointcloud.encode(seen, "scan_id").withColumns({"vehicle": F.lit("v"), "frame": F.when(F.col("scan_id") == 7, "elsewhere").otherwise("lidar")}).withColumn("stamp_ns", stamp)
    ids = scans.select(F.col("scan_id").cast("long").alias("scan_id")).distinct()
    at = room_pose(F.col("scan_id"))
    turn = dict(zip(("qx", "qy", "qz", "qw"), G.xyz_to_quaternion(at["roll"], at["pitch"], at["yaw"]), strict=True))
    sides = ids.where("scan_id <> 5").select("scan_id", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    poses = sides.select(
        F.lit("v").alias("vehicle"), (F.col("scan_id") * 10_000_000_000 + 1_000_000_000 + F.col("side") * 100_000_000).cast("long").alias("stamp_ns"),
        (at["tx"] + 0.1 + F.col("side") / 10).alias("x"), (at["ty"] + 0.1).alias("y"), at["tz"].alias("z"), *(v.alias(n) for n, v in turn.items()),
    )
    transforms = spark.range(1).select(F.lit("base_link").alias("parent"), F.lit("lidar").alias("child"), F.lit(0).cast("long").alias("stamp_ns"), F.lit(True).alias("is_static"), *(F.lit(v).alias(n) for n, v in zip(("tx", "ty", "tz", "qx", "qy", "qz", "qw"), _LIDAR, strict=True)))
    fixes = ids.select(F.lit("v").alias("vehicle"), (F.col("scan_id") * 10_000_000_000).cast("long").alias("stamp_ns"), at["tx"].alias("x"), at["ty"].alias("y"))
    return messages, poses, transforms, fixes


_FAILS = "scan_id IN (5, 7)"


@query(f"""WITH {_SCANS} SELECT scan_id::BIGINT AS scan_id, CASE WHEN scan_id = 5 THEN 'warn' WHEN scan_id = 7 THEN 'error' ELSE 'ok' END AS level,
    CASE WHEN scan_id = 5 THEN 'Failed to interpolate initial pose' WHEN scan_id = 7 THEN 'Failed to transform sensor points' ELSE 'OK' END AS message,
    CASE WHEN {_FAILS} THEN NULL ELSE round(sqrt(0.02), 1) END AS moved, CASE WHEN {_FAILS} THEN NULL ELSE 0.0225::DOUBLE END AS cxx, CASE WHEN {_FAILS} THEN NULL ELSE true END AS likely_without_ground,
    {', '.join(f"CASE WHEN {_FAILS} THEN NULL ELSE {x.rsplit(' AS ', 1)[0]} END AS {x.rsplit(' AS ', 1)[1]}" for x in _PARTS_AT)} FROM scans""")
def q_on_points(spark, d):
    """From the sensor's bytes to published poses, and a report on every message."""
    from scanloom.config import PoseBufferConfig
    from scanloom.functions import geometry as G
    from scanloom.operators.scan_pipeline import match_scans
    from scanloom.streaming.matcher import diagnostics

    messages, poses, transforms, fixes = room_messages(spark, d)
    config = EngineConfig(match=MATCH, pose_buffer=PoseBufferConfig(timeout_sec=1.0))
    out = match_scans(messages.persist(), poses, transforms, room_voxels(spark, d).persist(), config, fixes)
    turn = dict(zip(POSE[3:], G.quaternion_to_xyz("qx", "qy", "qz", "qw"), strict=True))
    found = out["poses"].select("scan_id", *(F.col(c).alias(f"t{c}") for c in "xyz"), *(v.alias(n) for n, v in turn.items()), F.round(F.col("covariance")[0], 6).alias("cxx"))
    moved = out["relative"].select("scan_id", F.round("initial_to_result_distance", 1).alias("moved"))
    bare = out["alignments"].select("scan_id", (F.col("no_ground_nvtl") >= 2.3).alias("likely_without_ground"))
    report = diagnostics(out["reports"], config).select("scan_id", "level", "message")
    rows = report.join(found, "scan_id", "left").join(moved, "scan_id", "left").join(bare, "scan_id", "left")
    return rows.select("scan_id", "level", "message", "moved", "cxx", "likely_without_ground", *map(coarse, POSE))
