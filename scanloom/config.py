"""Parameters with their defaults, as frozen groups; all may be overridden by keyword."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class VoxelConfig:
    resolution: float = 2.0
    min_points: int = 6
    eigenvalue_ratio: float = 0.01


@dataclass(frozen=True)
class FilterConfig:
    min_distance: float = 0.0
    max_distance: float = float("inf")
    min_z: float = float("-inf")
    max_z: float = float("inf")
    required_distance: float = 10.0


@dataclass(frozen=True)
class MatchConfig:
    resolution: float = 2.0
    outlier_ratio: float = 0.55
    max_iterations: int = 30
    trans_epsilon: float = 0.01
    step_size: float = 0.1
    use_line_search: bool = False
    search: str = "more_thuente"  # or "backtracking", "candidates" (several steps judged at once)
    metric: str = "distribution"  # or "plane"
    min_correspondences: int = 10
    svd_tolerance: float = 1e-10
    max_eigenvalue: float = -1e-3  # of the Hessian used in a step
    regularization_weight: float = 0.0


@dataclass(frozen=True)
class LineSearchConfig:
    step_max: float = 0.1
    step_min: float = 1e-9
    mu: float = 1e-4
    nu: float = 0.9
    max_iterations: int = 10


@dataclass(frozen=True)
class GateConfig:
    kind: int = 1  # 0: tp_pairs, 1: nvtl
    tp_threshold: float = 3.0
    nvtl_threshold: float = 2.3
    max_oscillation: int = 10


@dataclass(frozen=True)
class PoseBufferConfig:
    timeout_sec: float = 1.0
    distance_tolerance: float = 10.0


@dataclass(frozen=True)
class QueueConfig:
    depth: int = 8
    max_age_ms: float = 100.0
    batch: int = 4
    timeout_ms: float = 20.0


@dataclass(frozen=True)
class MapConfig:
    update_distance: float = 20.0
    map_radius: float = 150.0
    lidar_radius: float = 100.0


@dataclass(frozen=True)
class InitialPoseConfig:
    particles: int = 200
    startup: int = 100
    candidates: int = 100
    reliable_nvtl: float = 2.3


@dataclass(frozen=True)
class CovarianceConfig:
    kind: str = "fixed"  # laplace, multi_ndt, multi_ndt_score
    temperature: float = 0.05
    scale: float = 1.0
    diagonal: tuple[float, ...] = (0.0225, 0.0225, 0.0225, 0.000625, 0.000625, 0.000625)
    offsets: tuple[tuple[float, float], ...] = ((0.0, 0.5), (0.0, -0.5), (0.5, 0.0), (-0.5, 0.0), (1.0, 0.0), (-1.0, 0.0))
    correction: str = "shrunk"  # (n-1)/n after equal weights, or "unbiased"


@dataclass(frozen=True)
class EngineConfig:
    voxel: VoxelConfig = field(default_factory=VoxelConfig)
    filter: FilterConfig = field(default_factory=FilterConfig)
    match: MatchConfig = field(default_factory=MatchConfig)
    line_search: LineSearchConfig = field(default_factory=LineSearchConfig)
    gate: GateConfig = field(default_factory=GateConfig)
    pose_buffer: PoseBufferConfig = field(default_factory=PoseBufferConfig)
    queue: QueueConfig = field(default_factory=QueueConfig)
    map: MapConfig = field(default_factory=MapConfig)
    initial_pose: InitialPoseConfig = field(default_factory=InitialPoseConfig)
    covariance: CovarianceConfig = field(default_factory=CovarianceConfig)


def load(tree: dict | str | None = None) -> EngineConfig:
    """Defaults overlaid with a tree of groups (a dict or JSON text); unknown names are errors."""
    tree = json.loads(tree) if isinstance(tree, str) else tree or {}
    config = EngineConfig()
    known = {f.name: getattr(config, f.name) for f in fields(config)}
    for group, values in tree.items():
        if group not in known or not is_dataclass(known[group]):
            raise KeyError(f"no parameter group {group!r}")
        known[group] = replace(known[group], **values)
    return EngineConfig(**known)


def covariance_kind(name: str) -> str:
    """An estimator's name; unknown ones mean the fixed covariance."""
    return name if name in {"fixed", "laplace", "multi_ndt", "multi_ndt_score"} else "fixed"
