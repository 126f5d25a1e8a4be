"""A batch of sensor messages to published poses: the whole way of a scan.

Decode, move to the vehicle's frame, filter, check the range, interpolate the
initial pose, take the latest satellite fix, align, gate, estimate the
covariance, score once more without the ground, and report.  Every step is a
join or an expression over all scans of the batch; points are moved once, to
their scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.config import EngineConfig
from scanloom.functions import geometry as G
from scanloom.operators import registration
from scanloom.operators.estimation import with_covariance
from scanloom.operators.filters import drop_non_finite, filter_points, publish_gate, remove_ground, scans_in_range
from scanloom.operators.scoring import move, under_pose
from scanloom.operators.temporal import bracket, interpolate_poses, lookup_transform
from scanloom.sources.pointcloud import decode

POSE = registration.POSE
Q = ("qx", "qy", "qz", "qw")


def sensor_points(messages: DataFrame, transforms: DataFrame, base: str = "base_link") -> tuple[DataFrame, DataFrame]:
    """(scan_id, x, y, z in the vehicle's frame; scan_id, is_succeed_transform_sensor_points of every message).

    ``messages``: scan_id, frame, stamp_ns and a point cloud payload.
    """
    asked = messages.select(F.col("scan_id").alias("query_id"), F.col("frame").alias("source"), F.lit(base).alias("target"), "stamp_ns")
    found = lookup_transform(asked, transforms).select(F.col("query_id").alias("scan_id"), "transform").persist()  # a row a scan
    moved = decode(messages.drop("frame", "stamp_ns", "vehicle"), "scan_id").join(found.where("transform is not null"), "scan_id")
    moved = moved.withColumns({c: F.col(c).cast("double") for c in "xyz"})
    turn = G.rotation_quaternion(*(F.col(f"transform.{q}") for q in Q))
    points = move(moved, turn, tuple(F.col(f"transform.t{c}") for c in "xyz")).select("scan_id", "x", "y", "z")
    return points, found.select("scan_id", F.col("transform").isNotNull().alias("is_succeed_transform_sensor_points"))


def initial_poses(heads: DataFrame, poses: DataFrame, config: EngineConfig, gnss: DataFrame | None = None) -> DataFrame:
    """scan_id, pose_id, tx .. yaw at each scan's time, valid, and the latest fix at or before it.

    ``heads``: vehicle, scan_id, stamp_ns; ``poses``: vehicle, stamp_ns, x .. qw;
    ``gnss``: vehicle, stamp_ns, x, y.
    """
    at = interpolate_poses(heads.select("vehicle", "scan_id", "stamp_ns"), poses, ["vehicle"], config.pose_buffer)
    turn = dict(zip(POSE[3:], G.quaternion_to_xyz(*Q), strict=True))
    out = at.select("vehicle", "scan_id", "stamp_ns", F.lit(0).cast("long").alias("pose_id"), *(F.col(c).alias(f"t{c}") for c in "xyz"), *(v.alias(n) for n, v in turn.items()), "valid")
    if gnss is not None:
        out = bracket(out, gnss.select("vehicle", "stamp_ns", "x", "y"), ["vehicle"]).withColumns({"gnss_x": F.col("prev.x"), "gnss_y": F.col("prev.y")}).drop("prev", "next")
    return out


def match_scans(messages: DataFrame, poses: DataFrame, transforms: DataFrame, voxels: DataFrame, config: EngineConfig = EngineConfig(), gnss: DataFrame | None = None, base: str = "base_link", ground_margin: float = 0.8) -> dict[str, DataFrame]:
    """What a matcher publishes of a batch.

    ``alignments``: every aligned scan with scores, covariance, ``published`` and
    the scores without ground; ``poses``: the published ones as position and
    quaternion with covariance; ``relative``: the result seen from the initial
    pose and their distance; ``points``: every aligned scan's points in the map;
    ``reports``: every message with its conditions, for ``matcher.diagnostics``;
    ``refused``: scans that don't reach far enough.
    """
    heads = messages.select("vehicle", "scan_id", "stamp_ns")
    points, moved = sensor_points(messages, transforms, base)
    clean = filter_points(drop_non_finite(points), config.filter).persist()
    reach = scans_in_range(clean, "scan_id", config.filter.required_distance)
    start = initial_poses(heads, poses, config, gnss).persist()
    accepted = reach.where("accepted").select("scan_id")
    wanted = start.where("valid").join(accepted, "scan_id", "left_semi").drop("vehicle", "stamp_ns", "valid")
    cloud = clean.join(wanted.select("scan_id"), "scan_id", "left_semi")
    found = publish_gate(registration.align_batch(cloud, wanted, voxels, "scan_id", config.match, config.line_search), config.gate).persist()
    final = found.select("scan_id", "pose_id", *POSE)
    in_map = under_pose(cloud.join(final, "scan_id"))
    standing = remove_ground(in_map, F.col("tz"), ground_margin).select("scan_id", "x", "y", "z")
    still = final.select("scan_id", "pose_id", *(F.lit(0.0).alias(c) for c in POSE))
    bare = registration.score_batch(standing, still, voxels, "scan_id", config.match.resolution, config.match.outlier_ratio)
    out = with_covariance(found, cloud, voxels, config).join(bare.select("scan_id", F.col("nvtl").alias("no_ground_nvtl"), F.col("tp_points").alias("no_ground_tp_points")), "scan_id", "left")
    out = out.join(heads, "scan_id")
    turned = dict(zip(Q, G.xyz_to_quaternion("roll", "pitch", "yaw"), strict=True))
    placed = out.withColumns(turned)
    began = start.select("scan_id", *(F.col(f"t{c}").alias(f"i{c}") for c in "xyz"), *(v.alias(f"i{n}") for n, v in zip(Q, G.xyz_to_quaternion("roll", "pitch", "yaw"), strict=True)))
    both = placed.join(began, "scan_id")
    shift, turn = G.relative_pose((("tx", "ty", "tz"), Q), (("ix", "iy", "iz"), tuple(f"i{q}" for q in Q)))
    relative = both.select("scan_id", *(v.alias(c) for c, v in zip("xyz", shift, strict=True)), *(v.alias(q) for q, v in zip(Q, turn, strict=True)), G.distance(("tx", "ty", "tz"), ("ix", "iy", "iz")).alias("initial_to_result_distance"))
    reports = heads.join(moved, "scan_id", "left").join(start.select("scan_id", F.col("valid").alias("is_succeed_interpolate_initial_pose")), "scan_id", "left").join(found.select("scan_id", "status", "iterations", "oscillation", "tp_pairs", "nvtl"), "scan_id", "left")
    flags = ("is_succeed_transform_sensor_points", "is_succeed_interpolate_initial_pose")
    return {
        "alignments": out, "poses": placed.where("published").select("vehicle", "scan_id", "stamp_ns", *(F.col(f"t{c}").alias(c) for c in "xyz"), *Q, "covariance"), "relative": relative,
        "points": in_map.select("scan_id", "x", "y", "z"), "reports": reports.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags}), "refused": reach.where("not accepted"),
    }
