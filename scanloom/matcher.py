"""Matchers as objects: a target set once, then clouds, scans and searches against it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.config import EngineConfig, VoxelConfig
from scanloom.operators import initial_pose, registration, voxels
from scanloom.operators.estimation import with_covariance
from scanloom.operators.filters import drop_non_finite, filter_points
from scanloom.operators.packed import PackedScans

POSE = registration.POSE


def _finite(scans: DataFrame | PackedScans) -> DataFrame | PackedScans:
    """Points whose coordinates are numbers; what is packed holds no others."""
    return scans if isinstance(scans, PackedScans) else drop_non_finite(scans)


class Matcher:
    """Scans against one voxel map.

    Errors, all ValueError: no target set, a target without a voxel, a source
    without a finite point.
    """

    def __init__(self, config: EngineConfig = EngineConfig()) -> None:
        self.config = config
        self.voxels: DataFrame | None = None

    def set_target(self, points: DataFrame) -> Matcher:
        """Build the voxels of a map; they stay in memory until the next target."""
        own = self.config
        fresh = voxels.build_voxels(drop_non_finite(points), VoxelConfig(own.match.resolution, own.voxel.min_points, own.voxel.eigenvalue_ratio)).persist()
        if fresh.isEmpty():
            raise ValueError("the target has no voxels")
        self.close()
        self.voxels = fresh
        return self

    def close(self) -> None:
        if self.voxels is not None:
            self.voxels.unpersist()
        self.voxels = None

    def _target(self) -> DataFrame:
        if self.voxels is None:
            raise ValueError("no target is set")
        return self.voxels

    def pack(self, scans: DataFrame, scan: str = "scan_id") -> PackedScans:
        """Scans for several calls, of which large ones are packed once; to be closed after the last."""
        return PackedScans(drop_non_finite(scans), scan, self.config.match.resolution)

    def align(self, points: DataFrame, initial: tuple[float, ...] = (0.0,) * 6, gnss: tuple[float, float] | None = None) -> dict:
        """One cloud of any size, whose points stay distributed."""
        cloud = drop_non_finite(points)
        if cloud.isEmpty():
            raise ValueError("the source has no points")
        return registration.align_cloud(cloud, self._target(), initial, self.config.match, gnss)

    def align_scans(self, scans: DataFrame | PackedScans, poses: DataFrame, scan: str = "scan_id", debug: bool = False, filtered: bool = False) -> DataFrame:
        """Every pose of every scan; ``filtered`` applies the point filter first."""
        cloud = filter_points(drop_non_finite(scans), self.config.filter) if filtered else _finite(scans)
        return registration.align_batch(cloud, poses, self._target(), scan, self.config.match, self.config.line_search, debug)

    def score_scans(self, scans: DataFrame | PackedScans, poses: DataFrame, scan: str = "scan_id") -> DataFrame:
        return registration.score_batch(_finite(scans), poses, self._target(), scan, self.config.match.resolution, self.config.match.outlier_ratio)

    def evaluate(self, points: DataFrame | PackedScans, pose: tuple[float, ...]) -> dict:
        """Scores of one cloud, or of the one packed scan 0, under one pose: tp_pairs, tp_points, nvtl and others."""
        one = points if isinstance(points, PackedScans) else points.withColumn("scan_id", F.lit(0))
        spark = one.points.sparkSession if isinstance(points, PackedScans) else points.sparkSession
        at = spark.range(1).select(F.lit(0).alias("scan_id"), F.lit(0).cast("long").alias("pose_id"), *(F.lit(float(v)).alias(c) for c, v in zip(POSE, pose, strict=True)))
        found = self.score_scans(one, at).first()
        if found is None:
            raise ValueError("the source has no points")
        return found.asDict()

    def covariances(self, alignments: DataFrame, scans: DataFrame | PackedScans, scan: str = "scan_id") -> DataFrame:
        """Alignments with the covariance that the configuration names."""
        return with_covariance(alignments, _finite(scans), self._target(), self.config, scan)

    def search(self, scans: DataFrame, mean: tuple[float, ...], deviation: tuple[float, ...], scan: str = "scan_id", seed: int = 0) -> tuple[DataFrame, dict]:
        """Initial poses: all particles of every scan, and each scan's best."""
        return initial_pose.search_scans(drop_non_finite(scans), self._target(), mean, deviation, scan, self.config.initial_pose, self.config.match, seed)


class MultiGridMatcher:
    """Scans against voxel maps of several resolutions, coarse to fine."""

    def __init__(self, resolutions: tuple[float, ...] = (4.0, 2.0, 1.0), config: EngineConfig = EngineConfig(), iterations: dict[float, int] | None = None, adaptive_nvtl: float | None = None) -> None:
        if not resolutions or min(resolutions) <= 0:
            raise ValueError("resolutions must be positive")
        self.config, self.iterations, self.adaptive_nvtl = config, iterations, adaptive_nvtl
        self.grids = {r: Matcher(replace(config, match=replace(config.match, resolution=r))) for r in sorted(resolutions, reverse=True)}

    def set_target(self, points: DataFrame) -> MultiGridMatcher:
        for matcher in self.grids.values():
            matcher.set_target(points)
        return self

    def close(self) -> None:
        for matcher in self.grids.values():
            matcher.close()

    def align_scans(self, scans: DataFrame | PackedScans, poses: DataFrame, scan: str = "scan_id") -> DataFrame:
        grids = {r: m._target() for r, m in self.grids.items()}
        return registration.align_multigrid(_finite(scans), poses, grids, scan, self.iterations, self.config.match, self.adaptive_nvtl)

    def evaluate(self, points: DataFrame, pose: tuple[float, ...]) -> dict[float, dict]:
        """Scores of a cloud under a pose in every resolution."""
        one = PackedScans(drop_non_finite(points).withColumn("scan_id", F.lit(0)), "scan_id", min(self.grids))
        found = {r: m.evaluate(one, pose) for r, m in self.grids.items()}
        one.close()
        return found
