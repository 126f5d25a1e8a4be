"""Alignment of scans against voxels.

Two modes share the numeric kernels.  ``align_batch`` distributes alignments: the
voxels travel once as a broadcast whose size is checked, every (scan, pose) is
one group, and the whole Newton loop runs inside its task without a shuffle.
Scans too large for a task (``packed.LARGE_SCAN``) are dealt to tasks as blocks
instead, and their alignments go in step, one small job a round for all of them.
``align_cloud`` aligns one cloud of any size so; for voxel tables too large to
broadcast its rounds are joins.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.config import LineSearchConfig, MatchConfig
from scanloom.functions.blocks import Cloud
from scanloom.functions.kernels import VoxelIndex, align, align_steps, gaussian_constants, scores
from scanloom.operators.packed import PackedScans, scores_of
from scanloom.operators.scoring import derivative_sums, scan_scores, scored_pairs, under_pose

POSE = ("tx", "ty", "tz", "roll", "pitch", "yaw")
#: Voxels that may be broadcast: 24 doubles and a key each, some 200 MB.
MAX_BROADCAST_VOXELS = 1_000_000

RESULT = (
    "tx double, ty double, tz double, roll double, pitch double, yaw double, status string, score double, tp_pairs double, "
    "tp_points double, nvtl double, iterations int, hessian array<double>, pairs long, oscillation int"
)
DEBUG = "iteration int, pose array<double>, score double, gradient array<double>, num_correspondences long, step_length double, newton_step_norm double, direction_reversed boolean"


class TooManyVoxels(ValueError):
    """A voxel table that can't be broadcast."""


def local_voxels(voxels: DataFrame, resolution: float, most: int = MAX_BROADCAST_VOXELS) -> VoxelIndex:
    """The voxel table on the driver, for a broadcast; refuses tables over ``most``."""
    axis = F.col("axis" if "axis" in voxels.columns else "mean").alias("axis")  # only the plane metric has a use for it
    t = voxels.select("vx", "vy", "vz", "mean", "inv_cov", axis).limit(most + 1).toArrow()
    if t.num_rows > most:
        raise TooManyVoxels(f"more than {most} voxels can't be broadcast; use align_cloud or a part of the map")
    if not t.num_rows:
        raise ValueError("the target has no voxels")
    flat = lambda c, k: np.asarray(t.column(c).combine_chunks().flatten(), dtype=float).reshape(-1, k)
    cells = np.stack([np.asarray(t.column(c)) for c in ("vx", "vy", "vz")], axis=1)
    return VoxelIndex(cells, flat("mean", 3), flat("inv_cov", 9).reshape(-1, 3, 3), flat("axis", 3), resolution)


def _points_of(table: pa.Table) -> np.ndarray:
    return np.stack([np.asarray(table.column(c), dtype=float) for c in "xyz"], axis=1)


def _result(found: dict, judged: dict) -> dict:
    """The columns of an alignment and its scores."""
    return {
        **dict(zip(POSE, (float(v) for v in found["pose"]), strict=True)), "status": found["status"], "score": found["score"],
        "tp_pairs": judged["tp_pairs"], "tp_points": judged["tp_points"], "nvtl": judged["nvtl"], "iterations": found["iterations"],
        "hessian": found["hessian"].reshape(-1).tolist(), "pairs": found["pairs"], "oscillation": found["oscillation"], "log": found["log"],
    }


def _gnss(pose: dict) -> tuple[float, float] | None:
    return (pose["gnss_x"], pose["gnss_y"]) if pose.get("gnss_x") is not None and pose.get("gnss_y") is not None else None


def align_batch(points: DataFrame | PackedScans, poses: DataFrame, voxels: DataFrame, scan: str, config: MatchConfig = MatchConfig(), line_search: LineSearchConfig = LineSearchConfig(), debug: bool = False, poses_per_task: int = 8) -> DataFrame:
    """One row for every pose of every scan.

    ``points``: scan, x, y, z.  ``poses``: scan, pose_id, tx .. yaw and optionally
    gnss_x, gnss_y.  A scan (one sensor sweep) goes whole to each task that aligns
    some of its poses, so a search with many poses of one scan is spread too.
    Poses of scans without points have status ``empty``.  Large scans are aligned at
    once, when this is called; ``PackedScans`` keep what is packed for further calls.
    """
    given = points
    scans = points if isinstance(points, PackedScans) else PackedScans(points, scan, config.resolution)
    points = scans.points
    index = points.sparkSession.sparkContext.broadcast(local_voxels(voxels, config.resolution))
    kind = points.schema[scan].dataType.simpleString()
    d1, d2 = gaussian_constants(config.resolution, config.outlier_ratio)
    has_gnss = {"gnss_x", "gnss_y"} <= set(poses.columns)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cloud, rows = _points_of(left), []
        packed = Cloud.of(cloud, config.resolution)
        for pose in right.to_pylist():
            initial = np.array([pose[c] for c in POSE])
            if not len(cloud):
                rows.append({**pose, "status": "empty", "score": 0.0, "tp_pairs": 0.0, "tp_points": 0.0, "nvtl": 0.0, "iterations": 0, "hessian": [0.0] * 36, "pairs": 0, "oscillation": 0, "log": []})
                continue
            if packed.sparse():
                found = align(cloud, index.value, initial, config, line_search, _gnss(pose))
                judged = scores(cloud, index.value, found["pose"], d1, d2)
            else:
                found = align(cloud, index.value, initial, config, line_search, _gnss(pose), lambda x, order: packed.sums(index.value, x[None], d1, d2, config.metric, order)[0])
                judged = scores_of(*packed.judged(index.value, found["pose"][None], d1, d2)[0], packed.total)
            rows.append({scan: pose[scan], "pose_id": pose["pose_id"], **_result(found, judged)})
        return pa.Table.from_pylist([{n: r[n] for n in schema.names} for r in rows], schema=schema)

    text = f"{scan} {kind}, pose_id long, {RESULT}" + (f", log array<struct<{DEBUG.replace(' ', ':').replace(',:', ',')}>>" if debug else "")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(points.sparkSession.createDataFrame([], text).schema)
    poses = poses if poses.storageLevel.useMemory else poses.persist()  # read several times; small beside the points
    packed_rows = None
    if scans.sizes:
        large = F.broadcast(scans.marks())
        rows = [r.asDict() for r in poses.join(large, F.col(scan) == F.col("_large"), "left_semi").collect()]
        if rows:
            packed_rows = points.sparkSession.createDataFrame([tuple(r[n] for n in schema.names) for r in _align_packed(scans, rows, scan, index, config, line_search, d1, d2)], text)
            if scans is not given:
                scans.close()
        poses, points = poses.join(large, F.col(scan) == F.col("_large"), "left_anti"), scans.small()
        if packed_rows is not None and poses.isEmpty():
            return packed_rows
    parts = poses.groupBy(F.col(scan).alias("_scan")).agg(F.ceil(F.count(F.lit(1)) / poses_per_task).alias("_parts"))
    wanted = poses.join(parts, F.col(scan) == F.col("_scan")).withColumn("_part", F.pmod(F.xxhash64("pose_id"), "_parts"))
    wanted = wanted.select(F.col(scan).alias(scan), "_part", F.col("pose_id").cast("long").alias("pose_id"), *(F.col(c).cast("double").alias(c) for c in POSE), *(["gnss_x", "gnss_y"] if has_gnss else []))
    cloud = points.select(scan, "x", "y", "z").join(parts, F.col(scan) == F.col("_scan")).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    cloud = cloud.select(F.col(scan).alias("_of"), F.col("_part").alias("_at"), "x", "y", "z")
    # A task's work is in its iterations, not in its bytes: as many partitions as keep
    # all cores busy, which a stated number protects from being coalesced.
    spark = points.sparkSession
    deal = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    whole = cloud.repartition(deal, "_of", "_at").groupBy("_of", "_at").cogroup(wanted.repartition(deal, scan, "_part").groupBy(scan, "_part")).applyInArrow(run, text)
    return whole if packed_rows is None else whole.union(packed_rows)


def _align_packed(scans: PackedScans, poses: list[dict], scan: str, index, config: MatchConfig, line_search: LineSearchConfig, d1: float, d2: float) -> list[dict]:
    """A row for every pose of the packed scans."""
    steps = {i: align_steps(np.array([p[c] for c in POSE], dtype=float), config, line_search, _gnss(p)) for i, p in enumerate(poses)}
    found = scans.aligned(steps, {i: p[scan] for i, p in enumerate(poses)}, index, d1, d2, config.metric)
    judged = scans.judged([(p[scan], found[i]["pose"]) for i, p in enumerate(poses)], index, d1, d2)
    return [{scan: p[scan], "pose_id": p["pose_id"], **_result(found[i], judged[i])} for i, p in enumerate(poses)]


def align_cloud(points: DataFrame, voxels: DataFrame, initial: tuple[float, ...], config: MatchConfig = MatchConfig(), gnss: tuple[float, float] | None = None) -> dict:
    """One alignment of one cloud whose points stay distributed."""
    try:
        index = points.sparkSession.sparkContext.broadcast(local_voxels(voxels, config.resolution))
    except TooManyVoxels:
        return _align_joined(points, voxels, initial, config, gnss)
    scans = PackedScans(points.select(F.lit(0).alias("_one"), "x", "y", "z"), "_one", config.resolution, 0)
    d1, d2 = gaussian_constants(config.resolution, config.outlier_ratio)
    found = scans.aligned({0: align_steps(np.array(initial, dtype=float), config, gnss=gnss)}, {0: 0}, index, d1, d2, config.metric)[0]
    scans.close()
    return found


def _align_joined(points: DataFrame, voxels: DataFrame, initial: tuple[float, ...], config: MatchConfig, gnss: tuple[float, float] | None) -> dict:
    """The same by joins of points and voxels, for any number of voxels."""

    def evaluate(pose: np.ndarray, _: int) -> tuple[float, np.ndarray, np.ndarray, int]:
        row = derivative_sums(points, voxels, tuple(pose), config.resolution, config.outlier_ratio).first()
        hessian = np.zeros((6, 6))
        upper = np.triu_indices(6)
        hessian[upper] = [row[f"h{i}{j}"] for i, j in zip(*upper, strict=True)]
        hessian = hessian + np.triu(hessian, 1).T
        return row["score"], np.array([row[f"g{i}"] for i in range(6)]), hessian, int(row["pairs"])

    return align(np.zeros((0, 3)), None, np.array(initial, dtype=float), config, gnss=gnss, evaluate=evaluate)


def score_batch(points: DataFrame | PackedScans, poses: DataFrame, voxels: DataFrame, scan: str, resolution: float, outlier_ratio: float = 0.55) -> DataFrame:
    """Scores of every (scan, pose) without aligning, as joins and two aggregates; of large scans by their blocks, at once."""
    given = points
    scans = points if isinstance(points, PackedScans) else PackedScans(points, scan, resolution)
    points, packed_rows = scans.points, None
    if scans.sizes:
        poses, large = poses.persist(), F.broadcast(scans.marks())
        rows = poses.join(large, F.col(scan) == F.col("_large"), "left_semi").collect()
        try:
            index = points.sparkSession.sparkContext.broadcast(local_voxels(voxels, resolution)) if rows else None
        except ValueError:  # too many voxels, or none
            rows = []
        if rows:
            d1, d2 = gaussian_constants(resolution, outlier_ratio)
            judged = scans.judged([(r[scan], np.array([r[c] for c in POSE], dtype=float)) for r in rows], index, d1, d2)
            if scans is not given:
                scans.close()
            made = [(r[scan], r["pose_id"], j["points"], j["score"], j["pairs"], j["tp_pairs"], j["tp_points"], math.exp(-j["score"] / 10), j["nvtl"], j["unmatched"]) for r, j in zip(rows, judged, strict=True)]
            kinds = [f"{c} {poses.schema[c].dataType.simpleString()}" for c in (scan, "pose_id")]
            packed_rows = points.sparkSession.createDataFrame(made, f"{', '.join(kinds)}, points long, score double, pairs long, tp_pairs double, tp_points double, tp_exp double, nvtl double, unmatched long")
            poses, points = poses.join(large, F.col(scan) == F.col("_large"), "left_anti"), scans.small()
            if poses.isEmpty():
                return packed_rows
    cloud = points.withColumn("_n", F.monotonically_increasing_id())
    posed = cloud.join(poses, scan)
    pairs = scored_pairs(under_pose(posed), voxels, resolution, outlier_ratio)
    sizes = points.groupBy(scan).agg(F.count(F.lit(1)).alias("points")).join(poses.select(scan, "pose_id"), scan)
    joined = scan_scores(pairs, sizes, ["_n"], [scan, "pose_id"])
    return joined if packed_rows is None else joined.unionByName(packed_rows)


def align_multigrid(points: DataFrame | PackedScans, poses: DataFrame, grids: dict[float, DataFrame], scan: str, iterations: dict[float, int] | None = None, config: MatchConfig = MatchConfig(), adaptive_nvtl: float | None = None) -> DataFrame:
    """Coarse to fine: each resolution starts from the poses that the one before reached.

    With ``adaptive_nvtl`` alignments that converged with that score or more go
    straight to the finest resolution.
    """
    order = sorted(grids, reverse=True)
    given = points
    points = points if isinstance(points, PackedScans) else PackedScans(points, scan, order[-1])
    limits = iterations or dict(zip(order, (5, 10, 15), strict=False))
    current, settled, out = poses, None, None
    for i, r in enumerate(order):
        last = i == len(order) - 1
        if last and settled is not None:
            current = current.unionByName(settled)
        out = align_batch(points, current, grids[r], scan, replace(config, resolution=r, max_iterations=limits.get(r, config.max_iterations)))
        if not last:
            out = out.persist()  # small; recomputed if a block is lost
            next_ = out.select(scan, "pose_id", *POSE, (F.lit(adaptive_nvtl is not None) & (F.col("status") == "converged") & (F.col("nvtl") > F.lit(adaptive_nvtl if adaptive_nvtl is not None else 0.0))).alias("done"))
            done = next_.where("done").drop("done")
            settled = done if settled is None else settled.unionByName(done)
            current = next_.where("not done").drop("done")
    if points is not given:
        points.close()
    return out.withColumn("resolution", F.lit(float(order[-1])))
