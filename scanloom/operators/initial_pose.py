"""Search for an initial pose: random particles, then guided ones.

Particles are aligned as a batch (one job); the guided phase proposes in
mini-batches by the ratio of two kernel density estimates.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.config import InitialPoseConfig, MatchConfig
from scanloom.functions.geometry import wrap_angle
from scanloom.operators.packed import PackedScans
from scanloom.operators.registration import POSE, align_batch

#: Kernel widths of x, y and yaw, and the weight of the lower set.
KERNEL_SIGMA, BELOW_WEIGHT = (0.25, 0.25, math.radians(2.5)), 5.0


def above_count(n: int) -> int:
    return max(1, min(n // 10, 10))


def split_trials(trials: DataFrame, score: str = "score", *keys: str) -> DataFrame:
    """Adds ``above``: the best clamp(n / 10, 1, 10) trials (a bounded table of trials)."""
    w = Window.partitionBy(*keys)
    count = F.count(F.lit(1)).over(w)
    rank = F.row_number().over(w.orderBy(F.col(score).desc(), "trial_id"))
    return trials.withColumn("above", rank <= F.greatest(F.lit(1), F.least(F.floor(count / 10), F.lit(10))))


def density_ratio(candidates: DataFrame, trials: DataFrame) -> DataFrame:
    """candidate_id and ratio: log density of the upper trials less the weighted one of the lower.

    ``candidates`` (candidate_id, x, y, yaw) and ``trials`` (x, y, yaw, above) are a
    search's few hundred proposals and results; the product is their size alone.
    """
    t = trials.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("yaw").alias("tyaw"), "above")
    pairs = candidates.crossJoin(t)
    square = lambda d, s: -0.5 * (d / s) * (d / s) - math.log(s)
    log_p = square(F.col("x") - F.col("tx"), KERNEL_SIGMA[0]) + square(F.col("y") - F.col("ty"), KERNEL_SIGMA[1]) + square(wrap_angle(F.col("yaw") - F.col("tyaw")), KERNEL_SIGMA[2])
    sized = pairs.withColumn("log_p", log_p)
    top = sized.groupBy("candidate_id", "above").agg(F.max("log_p").alias("top"))
    lse = sized.join(top, ["candidate_id", "above"]).groupBy("candidate_id", "above").agg((F.max("top") + F.log(F.sum(F.exp(F.col("log_p") - F.col("top")))) - F.log(F.count(F.lit(1)))).alias("lse"))
    side = lambda flag: F.max(F.when(F.col("above") == flag, F.col("lse")))
    return lse.groupBy("candidate_id").agg((F.coalesce(side(True), F.lit(0.0)) - BELOW_WEIGHT * F.coalesce(side(False), F.lit(0.0))).alias("ratio"))


def random_poses(n: int, mean: tuple[float, ...], deviation: tuple[float, ...], rng: np.random.Generator) -> np.ndarray:
    """Normal in position, roll and pitch; uniform in yaw."""
    out = rng.normal(mean, deviation, (n, 6))
    out[:, 5] = rng.uniform(-math.pi, math.pi, n)
    return out


def ratios(candidates: np.ndarray, trials: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The density ratio of poses, in numpy, for the search loop."""
    order = np.argsort(-scores, kind="stable")
    k = above_count(len(scores))
    pick = [0, 1, 5]

    def lse(members: np.ndarray) -> np.ndarray:
        if not len(members):
            return np.zeros(len(candidates))
        d = candidates[:, None, pick] - trials[members][None][:, :, pick]
        d[..., 2] = (d[..., 2] + math.pi) % (2 * math.pi) - math.pi
        log_p = (-0.5 * (d / KERNEL_SIGMA) ** 2 - np.log(KERNEL_SIGMA)).sum(axis=2) - math.log(len(members))
        top = log_p.max(axis=1)
        return top + np.log(np.exp(log_p - top[:, None]).sum(axis=1))

    return lse(order[:k]) - BELOW_WEIGHT * lse(order[k:])


def search(points: DataFrame, voxels: DataFrame, mean: tuple[float, ...], deviation: tuple[float, ...], config: InitialPoseConfig = InitialPoseConfig(), match: MatchConfig = MatchConfig(), seed: int = 0, rounds: int = 4) -> tuple[DataFrame, dict]:
    """All particles as a DataFrame, and the best with ``reliable``.

    ``points``: x, y, z of one scan.  The guided phase runs in ``rounds``
    mini-batches, each proposing the candidates of greatest ratio.
    """
    out, best = search_scans(points.select(F.lit(0).cast("long").alias("scan_id"), "x", "y", "z"), voxels, mean, deviation, "scan_id", config, match, seed, rounds)
    return out.drop("scan_id"), best[0]


def search_scans(points: DataFrame, voxels: DataFrame, mean: tuple[float, ...], deviation: tuple[float, ...], scan: str, config: InitialPoseConfig = InitialPoseConfig(), match: MatchConfig = MatchConfig(), seed: int = 0, rounds: int = 4) -> tuple[DataFrame, dict]:
    """All particles of every scan as a DataFrame, and of each scan the best.

    ``points``: scan, x, y, z.  Each scan has its own search; a round of all of
    them is one batch.  Poses and scores, not points, come to the driver.
    """
    spark = points.sparkSession
    kind = points.schema[scan].dataType.simpleString()
    cloud = points.select(scan, "x", "y", "z").where(F.col(scan).isNotNull())
    ids = sorted(r[0] for r in cloud.select(scan).distinct().collect())
    rngs = {k: np.random.default_rng([seed, i]) for i, k in enumerate(ids)}
    done, results = 0, {k: [] for k in ids}
    packed = PackedScans(cloud, scan, match.resolution)
    batches = [config.startup, *np.diff(np.linspace(config.startup, config.particles, rounds + 1).astype(int)).tolist()]
    for n in batches:
        if n <= 0 or not ids:
            continue
        proposed = []
        for k in ids:
            poses = random_poses(n if not done else n * config.candidates, mean, deviation, rngs[k])
            if done:
                tried = np.array([[r[c] for c in POSE] for r in results[k]])
                poses = poses[np.argsort(-ratios(poses, tried, np.array([r["nvtl"] for r in results[k]])), kind="stable")[:n]]
            proposed += [(k, done + i, *map(float, p)) for i, p in enumerate(poses)]
        frame = spark.createDataFrame(proposed, f"{scan} {kind}, pose_id long, " + ", ".join(f"{c} double" for c in POSE))
        each = max(1, len(proposed) // (2 * spark.sparkContext.defaultParallelism))
        for r in align_batch(packed, frame, voxels, scan, match, poses_per_task=min(8, each)).collect():  # a few hundred particles a scan
            results[r[scan]].append(r.asDict())
        done += n
    packed.close()
    rows = [(k, r["pose_id"], *(r[c] for c in POSE), r["nvtl"] if r["nvtl"] else 5 * r["tp_pairs"], r["nvtl"], r["iterations"], r["status"]) for k in ids for r in results[k]]
    out = spark.createDataFrame(rows, f"{scan} {kind}, particle_id long, " + ", ".join(f"{c} double" for c in POSE) + ", score double, nvtl double, iterations int, status string")
    best = {k: max(results[k], key=lambda r: (r["nvtl"] or 5 * r["tp_pairs"], -r["pose_id"])) for k in ids}
    return out, {k: {"pose": [b[c] for c in POSE], "score": b["nvtl"], "iterations": b["iterations"], "reliable": b["nvtl"] >= config.reliable_nvtl} for k, b in best.items()}
