"""The covariance of alignments, by the kind that the configuration names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.config import EngineConfig, covariance_kind
from scanloom.operators import covariance as C
from scanloom.operators.packed import PackedScans
from scanloom.operators.registration import POSE, align_batch, score_batch


def with_covariance(found: DataFrame, points: DataFrame | PackedScans, voxels: DataFrame, config: EngineConfig, scan: str = "scan_id") -> DataFrame:
    """``found`` (alignments of ``points``, one for each scan) with ``covariance``, 36 values.

    ``laplace``: minus the inverse Hessian of the position; ``multi_ndt``: the
    spread of alignments begun at offsets; ``multi_ndt_score``: of the offsets
    themselves, weighted by their scores; others: the default diagonal.  Position
    terms are scaled and not below the default.  Scans without a result keep the
    default.
    """
    own = config.covariance
    kind = covariance_kind(own.kind)
    if kind == "fixed":
        return found.withColumn("covariance", C.fixed_covariance(own))
    if kind == "laplace":
        raw = C.laplace_xy(*(F.get("hessian", F.lit(i)) for i in (0, 1, 7)))
        spread = found.select(scan, *(c.alias(n) for n, c in zip(("cxx", "cxy", "cyy"), C.scale_and_floor(*raw, own.scale, own.diagonal[:2]), strict=True)))
    else:
        found = found if found.storageLevel.useMemory else found.persist()  # read twice, one row a scan
        offsets = C.offset_poses(found.where("status <> 'empty'").select(scan, *POSE), own).withColumnRenamed("offset_id", "pose_id")
        if kind == "multi_ndt":
            tried = align_batch(points, offsets, voxels, scan, config.match, config.line_search)
        else:
            tried = score_batch(points, offsets, voxels, scan, config.match.resolution, config.match.outlier_ratio).select(scan, "pose_id", "nvtl").join(offsets, [scan, "pose_id"])
        spread = C.covariance_from_offsets(tried, own, scan)
    full = spread.select(F.col(scan).alias("_of"), C.full_covariance(own).alias("covariance"))
    joined = found.join(full, F.col(scan) == F.col("_of"), "left").drop("_of")
    return joined.withColumn("covariance", F.coalesce("covariance", C.fixed_covariance(own)))
