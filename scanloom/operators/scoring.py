"""Scores of a scan against voxels: pair, point and scan level."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import geometry as G
from scanloom.functions.kernels import gaussian_constants
from scanloom.operators.spatial import neighbour_join, radius_join


def mahalanobis2() -> Column:
    """d' S d with the nine values of inv_cov."""
    d = [F.col(c) - F.col("mean")[i] for i, c in enumerate("xyz")]
    s = [F.col("inv_cov")[i] for i in range(9)]
    rows = [s[3 * i] * d[0] + s[3 * i + 1] * d[1] + s[3 * i + 2] * d[2] for i in range(3)]
    return d[0] * rows[0] + d[1] * rows[1] + d[2] * rows[2]


def pair_score(mahalanobis: Column, d1: float, d2: float) -> Column:
    return F.lit(-d1) * F.exp(F.lit(-d2) * mahalanobis / 2)


def plane_score(d1: float, d2: float) -> Column:
    off = sum(((F.col(c) - F.col("mean")[i]) * F.col("axis")[i] for i, c in enumerate("yz", start=1)), (F.col("x") - F.col("mean")[0]) * F.col("axis")[0])
    return pair_score(off * off, d1, d2)


def move(points: DataFrame, matrix: list[list[Column]], shift: tuple) -> DataFrame:
    x, y, z = G.apply_rigid(matrix, ("x", "y", "z"), shift)
    return points.withColumns({"x": x, "y": y, "z": z})


def under_pose(points: DataFrame, pose: tuple[float, ...] | None = None) -> DataFrame:
    """Points moved by a literal pose, or by pose columns tx .. yaw."""
    parts = [F.lit(float(v)) for v in pose] if pose is not None else [F.col(c) for c in ("tx", "ty", "tz", "roll", "pitch", "yaw")]
    return move(points, G.rotation_xyz(*parts[3:]), tuple(parts[:3]))


def scored_pairs(points: DataFrame, voxels: DataFrame, resolution: float, outlier_ratio: float = 0.55, search: str = "radius", metric: str = "distribution") -> DataFrame:
    """Point-voxel pairs with ``score``; search ``radius`` or ``cells`` (27 cells, no distance test)."""
    d1, d2 = gaussian_constants(resolution, outlier_ratio)
    pairs = radius_join(points, voxels, resolution) if search == "radius" else neighbour_join(points, voxels, resolution)
    return pairs.withColumn("score", plane_score(d1, d2) if metric == "plane" else pair_score(mahalanobis2(), d1, d2))


def point_scores(points: DataFrame, pairs: DataFrame, *keys: str) -> DataFrame:
    """Per point the sum and the greatest pair score (0 without neighbours) and the number of voxels."""
    best = pairs.groupBy(*keys).agg(F.sum("score").alias("score"), F.max("score").alias("best"), F.count(F.lit(1)).alias("voxels"))
    return points.join(best, list(keys), "left").withColumns({"score": F.coalesce("score", F.lit(0.0)), "best": F.coalesce("best", F.lit(0.0)), "voxels": F.coalesce("voxels", F.lit(0))})


def scan_scores(pairs: DataFrame, sizes: DataFrame, point_keys: list[str], scan_keys: list[str]) -> DataFrame:
    """score, pairs, tp_pairs, tp_points, tp_exp, nvtl and unmatched of every scan.

    Two levels: a point's sum and maximum, then the scan's.  ``sizes`` has each
    scan's number of points as ``points``.
    """
    per_point = pairs.groupBy(*scan_keys, *point_keys).agg(F.sum("score").alias("s"), F.max("score").alias("m"), F.count(F.lit(1)).alias("k"))
    per_scan = per_point.groupBy(*scan_keys).agg(F.sum("s").alias("score"), F.sum("k").alias("pairs"), F.avg("m").alias("nvtl"), F.count(F.lit(1)).alias("matched"))
    full = sizes.join(per_scan, scan_keys, "left") if scan_keys else sizes.join(per_scan, F.lit(True), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score, pairs_, points = F.coalesce("score", F.lit(0.0)), zero("pairs"), F.col("points")
    return full.select(
        *scan_keys, "points", score.alias("score"), pairs_.alias("pairs"),
        F.when(pairs_ > 0, score / pairs_).otherwise(0.0).alias("tp_pairs"), F.when(points > 0, score / points).otherwise(0.0).alias("tp_points"),
        F.exp(-score / 10).alias("tp_exp"), F.coalesce("nvtl", F.lit(0.0)).alias("nvtl"), (points - zero("matched")).alias("unmatched"),
    )


def voxels_per_point(points: DataFrame, pairs: DataFrame, *keys: str) -> DataFrame:
    """How many points have 0, 1, 2, and 3 or more voxels."""
    counts = points.select(*keys).join(pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")), list(keys), "left")
    return counts.groupBy(F.least(F.coalesce("k", F.lit(0)), F.lit(3)).alias("voxels")).agg(F.count(F.lit(1)).alias("points"))


def coloured(points: DataFrame, score: str = "best", low: float = 1.0, high: float = 3.5) -> DataFrame:
    """Adds r, g, b, a and the packed colour of a score column."""
    r, g, b, a = G.score_color(G.normalised_score(score, low, high))
    out = points.withColumns({"r": r, "g": g, "b": b, "a": a})
    return out.withColumn("rgb", G.pack_rgb("r", "g", "b"))


def derivative_sums(points: DataFrame, voxels: DataFrame, pose: tuple[float, ...], resolution: float, outlier_ratio: float = 0.55) -> DataFrame:
    """The 29 sums (score, gradient, upper Hessian, pairs) of one pose over a cloud of any size.

    The join and the pairing are Catalyst's; each Arrow batch of pairs becomes one
    row of partial sums, and an ordinary aggregate adds the rows.
    """
    import numpy as np
    import pyarrow as pa

    from scanloom.functions.kernels import pair_derivatives

    d1, d2 = gaussian_constants(resolution, outlier_ratio)
    names = ["score", *(f"g{i}" for i in range(6)), *(f"h{i}{j}" for i in range(6) for j in range(i, 6)), "pairs"]
    moved = under_pose(points.withColumns({f"s{c}": F.col(c) for c in "xyz"}), pose)
    pairs = radius_join(moved, voxels, resolution).select("sx", "sy", "sz", "mean", "inv_cov")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            source = np.stack([np.asarray(batch.column(i), dtype=float) for i in range(3)], axis=1)
            mean = np.asarray(batch.column(3).flatten()).reshape(-1, 3)
            inverse = np.asarray(batch.column(4).flatten()).reshape(-1, 3, 3)
            s, g, h, n = pair_derivatives(source, mean, inverse, np.array(pose, dtype=float), d1, d2)
            row = [s, *g, *h[np.triu_indices(6)], float(n)]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=names)

    partial = pairs.mapInArrow(run, ", ".join(f"{n} double" for n in names))
    return partial.agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names))




def plain_voxels(points: DataFrame, resolution: float, min_points: int = 6, ridge: float = 0.01) -> DataFrame:
    """The simpler voxel of legacy scores: covariance over n, a ridge on its diagonal, no eigenvalue clamp.

    The inverse is the adjugate over the determinant, as expressions.
    """
    from scanloom.operators.voxels import CELL, means_and_covariances, moments

    stats = means_and_covariances(moments(points, resolution), resolution, min_points)
    n = F.col("n")
    a, b, c, d, e, f = ((F.col(x) * (n - 1) / n + (ridge if x in ("cxx", "cyy", "czz") else 0.0)) for x in ("cxx", "cxy", "cxz", "cyy", "cyz", "czz"))
    minors = {"aa": d * f - e * e, "ab": c * e - b * f, "ac": b * e - c * d, "bb": a * f - c * c, "bc": b * c - a * e, "cc": a * d - b * b}
    det = a * minors["aa"] + b * minors["ab"] + c * minors["ac"]
    inverse = F.array(*(minors[k] / det for k in ("aa", "ab", "ac", "ab", "bb", "bc", "ac", "bc", "cc")))
    return stats.select(*CELL, "n", F.array("mx", "my", "mz").alias("mean"), inverse.alias("inv_cov"))
