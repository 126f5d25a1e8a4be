"""Kernels, voxels, scores and alignment on synthetic clouds with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.config import CovarianceConfig, InitialPoseConfig, LineSearchConfig, MatchConfig, VoxelConfig, load
from scanloom.functions import kernels as K
from scanloom.operators import covariance, initial_pose, registration, scoring, spatial, voxels
from scanloom.sources import generators


def test_gaussian_constants():
    d1, d2 = K.gaussian_constants(2.0, 0.55)
    assert (d1, d2) == (pytest.approx(-4.196518186951408), pytest.approx(0.24847851012449546))


@pytest.mark.parametrize("plane", [False, True])
def test_derivatives_match_differences(plane):
    rng = np.random.default_rng(1)
    p, m, a, n = rng.normal(size=(30, 3)), rng.normal(size=(30, 3)), rng.normal(size=(30, 3, 3)), rng.normal(size=(30, 3))
    s, n = np.einsum("nij,nkj->nik", a, a) * 0.3, n / np.linalg.norm(n, axis=1)[:, None]
    d1, d2 = K.gaussian_constants(2.0, 0.55)
    f = lambda x: K.pair_derivatives(p, m, s, x, d1, d2, n if plane else None)
    pose, step = np.array([0.1, 0.2, -0.1, 0.3, -0.4, 0.7]), 1e-5 * np.eye(6)
    _, g, h, _ = f(pose)
    assert np.allclose(g, [(f(pose + e)[0] - f(pose - e)[0]) / 2e-5 for e in step], atol=1e-6)
    assert np.allclose(h, [(f(pose + e)[1] - f(pose - e)[1]) / 2e-5 for e in step], atol=1e-6)
    assert np.allclose(h, h.T)


def test_clamped_covariances():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(50, 3, 3))
    cov = np.einsum("nij,nkj->nik", a, a)
    cov[0] = np.diag([1.0, 1.0, 0.0])
    cov[1] = 0
    valid, clamped, inverse, axis = K.clamp_covariance(cov)
    assert valid.tolist() == [True, False] + [True] * 48
    assert np.allclose(clamped[0], np.diag([1, 1, 0.01])) and np.allclose(np.abs(axis[0]), [0, 0, 1])
    assert np.allclose(np.einsum("nij,njk->nik", clamped[valid], inverse[valid]), np.eye(3))


def test_newton_steps():
    h, g = -np.diag([1.0, 2, 3, 4, 5, 6]), np.arange(6.0)
    assert np.allclose(K.newton_step(g, h), g / [1, 2, 3, 4, 5, 6])
    assert K.newton_step(g, np.zeros((6, 6))) is None
    step = K.newton_step_ascent(g, np.eye(6))
    assert g @ step > 0  # a wrong curvature still gives an ascent
    assert np.allclose(K.newton_step_cholesky(g, np.eye(6)), -g)
    assert np.allclose(K.newton_step_regularized(g, np.zeros((6, 6)), 2.0), -g / 2)
    assert K.condition_number(np.diag([4.0, 2.0])) == 2 and K.condition_number(np.zeros((2, 2))) == math.inf
    assert K.is_negative_definite(h) and not K.is_positive_definite(h)


def test_line_searches():
    f = lambda a: (-((a - 0.05) ** 2), -2 * (a - 0.05))
    step = K.more_thuente(f, *f(0.0), 0.1, LineSearchConfig())
    assert K.strong_wolfe(*f(0.0), *f(step), step) and step == pytest.approx(0.05, abs=0.04)
    assert K.backtrack(lambda a: f(a)[0], *f(0.0), 1.0) < 0.1
    steps = K.golden_candidates(1.0, 8)
    values = [f(s) for s in steps]
    chosen = K.choose_candidate(steps, np.array([v for v, _ in values]), np.array([g for _, g in values]), *f(0.0))
    assert f(chosen)[0] > f(0.0)[0]
    assert K.choose_candidate(steps, np.full(8, -9.0), np.full(8, 9.0), 0.0, 1.0) == steps.min()


def test_oscillation_and_gnss():
    forth = np.array([[i % 2, 0, 0] for i in range(8)], dtype=float)
    assert K.count_oscillation(forth) == 6 and K.count_oscillation(forth[:2]) == 0
    pose = np.array([1.0, 2, 0, 0, 0, 0.3])
    score, gradient, hessian = K.gnss_term(pose, (3.0, 1.0), 0.5, 10)
    bump = lambda i: K.gnss_term(pose + 1e-6 * np.eye(6)[i], (3.0, 1.0), 0.5, 10)[0]
    assert np.allclose([(bump(i) - score) / 1e-6 for i in range(2)], gradient[:2], atol=1e-3)
    assert hessian[0, 0] < 0


@pytest.fixture(scope="module")
def cube(spark):
    cloud = generators.half_cube(spark).persist()
    grid = voxels.build_voxels(cloud, VoxelConfig(2.0)).persist()
    scan = voxels.downsample(cloud, 1.0).select(F.lit(0).cast("long").alias("scan_id"), F.monotonically_increasing_id().alias("point_id"), *(F.col(c).cast("float").cast("double").alias(c) for c in "xyz")).persist()
    return cloud, grid, scan


def test_sparse_index_equals_dense_index(cube, monkeypatch):
    _, grid, scan = cube
    p = scan.toPandas()[["x", "y", "z"]].to_numpy()
    dense = registration.local_voxels(grid, 2.0)
    monkeypatch.setattr(K, "DENSE_CELLS", 0)
    sparse = registration.local_voxels(grid, 2.0)
    assert dense.table is not None and sparse.table is None
    for shift in (0.0, 7.3, -30.0):
        (a, b), (c, d) = dense.pairs(p + shift), sparse.pairs(p + shift)
        assert sorted(zip(a, b, strict=True)) == sorted(zip(c, d, strict=True))


def test_cube_counts(cube):
    cloud, grid, scan = cube
    assert (cloud.count(), scan.count(), grid.count()) == (30603, 1261, 328)
    assert voxels.moments(cloud, 2.0).count() == 331
    assert voxels.downsample(cloud, 0.0).count() == 30603


@pytest.mark.parametrize(("shift", "pairs", "unmatched", "score", "nvtl"), [((0, 0, 0), 3928, 0, 8225.0204, 3.452164), ((0.5, 0.3, 0.1), 3763, 0, 2156.81, 0.96343), ((5, 0, 0), 2165, 525, 3901.3697, 2.855070), ((50, 50, 0), 0, 1261, 0, 0)])
def test_cube_scores(spark, cube, shift, pairs, unmatched, score, nvtl):
    _, grid, scan = cube
    poses = spark.createDataFrame([(0, 0, *map(float, shift), 0.0, 0.0, 0.0)], "scan_id long, pose_id long, " + ", ".join(f"{c} double" for c in registration.POSE))
    row = registration.score_batch(scan, poses, grid, "scan_id", 2.0).first()
    assert (row["pairs"], row["unmatched"]) == (pairs, unmatched)
    assert row["score"] == pytest.approx(score, rel=1e-5) and row["nvtl"] == pytest.approx(nvtl, rel=1e-5)
    assert row["tp_pairs"] == pytest.approx(score / pairs if pairs else 0, rel=1e-5)


def test_radius_join_matches_brute_force(cube):
    _, grid, scan = cube
    v, p = grid.toPandas(), scan.limit(100).toPandas()
    mean = np.stack(v["mean"])
    for radius in (1.0, 3.0):
        got = spatial.radius_join(scan.limit(100), grid, 2.0, radius).count()
        d = np.linalg.norm(p[["x", "y", "z"]].to_numpy()[:, None] - mean[None], axis=2)
        assert got == (d <= radius).sum()


def poses_of(spark, rows):
    return spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(rows)], "scan_id long, pose_id long, " + ", ".join(f"{c} double" for c in registration.POSE))


def test_alignment_of_the_cube(spark, cube):
    _, grid, scan = cube
    starts = [(0.1, 0.1, 0.05, 0, 0, 0), (0, 0, 0, 0, 0, 0), (500, 500, 0, 0, 0, 0)]
    rows = {r["pose_id"]: r for r in registration.align_batch(scan, poses_of(spark, starts), grid, "scan_id", MatchConfig(max_iterations=60), debug=True).collect()}
    assert rows[0]["status"] == "converged" and rows[1]["status"] == "converged"
    assert rows[0]["nvtl"] > 3.4 and np.linalg.norm([rows[0][c] for c in ("tx", "ty", "tz")]) < 0.05
    assert rows[2]["status"] == "no_correspondences" and rows[2]["tx"] == 500 and rows[2]["iterations"] == 0
    assert len(rows[0]["log"]) == rows[0]["iterations"] + 1 and len(rows[0]["hessian"]) == 36
    with pytest.raises(ValueError):
        registration.align_batch(scan, poses_of(spark, starts), grid.limit(0), "scan_id")


def test_distributed_mode_equals_local_mode(spark, cube):
    _, grid, scan = cube
    start, config = (0.2, 0.1, 0.05, 0.0, 0.0, 0.01), MatchConfig(max_iterations=2)
    local = registration.align_batch(scan, poses_of(spark, [start]), grid, "scan_id", config).first()
    spread = registration.align_cloud(scan, grid, start, config)
    assert np.allclose(spread["pose"], [local[c] for c in registration.POSE], atol=1e-6)
    assert spread["status"] == local["status"]


def test_multigrid_and_line_search(spark, cube):
    cloud, _, scan = cube
    grids = {r: voxels.build_voxels(cloud, VoxelConfig(r)) for r in (4.0, 2.0)}
    start = poses_of(spark, [(0.15, 0.1, 0.1, 0, 0, 0.005)])
    before = registration.score_batch(scan, start, grids[2.0], "scan_id", 2.0).first()["nvtl"]
    row = registration.align_multigrid(scan, start, grids, "scan_id", {4.0: 15, 2.0: 30}).first()
    assert row["nvtl"] > before and row["resolution"] == 2.0
    jumped = registration.align_multigrid(scan, start, grids, "scan_id", {4.0: 15, 2.0: 30}, adaptive_nvtl=0.0).first()
    assert jumped["nvtl"] > before
    again = registration.align_batch(scan, poses_of(spark, [(0.1, 0.1, 0.05, 0, 0, 0)]), grids[2.0], "scan_id", MatchConfig(use_line_search=True)).first()
    assert again["nvtl"] > 3.0


def test_initial_pose_search(spark, cube):
    _, grid, scan = cube
    rows, best = initial_pose.search(scan, grid, (0.2, 0.2, 0, 0, 0, 0), (0.2, 0.2, 0.05, 0.01, 0.01, 0), InitialPoseConfig(particles=10, startup=6, candidates=5), MatchConfig(max_iterations=3), rounds=2)
    assert rows.count() == 10 and best["score"] == rows.agg(F.max("nvtl")).first()[0]
    assert initial_pose.above_count(5) == 1 and initial_pose.above_count(500) == 10


def test_covariances(spark):
    assert np.allclose(covariance.rotate_covariance(np.eye(6), K.rotation(np.array([0, 0, 0, 0.3, 0.2, 0.1]))), np.eye(6))
    one = spark.createDataFrame([(1, 2.0, 3.0)], "k int, x double, y double")
    row = covariance.sample_covariance(one, "k").first()
    assert (row["cxx"], row["cxy"], row["cyy"]) == (1.0, 0.0, 1.0)
    results = spark.createDataFrame([(0, 0.0, 0.0, 3.0), (0, 1.0, 0.0, 1.0), (0, 0.0, 1.0, 1.0)], "scan_id long, tx double, ty double, nvtl double")
    shrunk, unbiased = (covariance.covariance_from_offsets(results, CovarianceConfig(kind="multi_ndt", diagonal=(0.0,) * 6, correction=c), "scan_id").first()["cxx"] for c in ("shrunk", "unbiased"))
    assert shrunk == pytest.approx(2 / 9 * 2 / 3) and unbiased == pytest.approx(2 / 9 * 3 / 2)
    scored = covariance.covariance_from_offsets(results, CovarianceConfig(kind="multi_ndt_score"), "scan_id").first()
    assert scored["cxx"] == pytest.approx(0.0225)  # the weights are all on the first; the default floor holds
    assert covariance.log_sum_exp(one.limit(0), "x").first()["lse"] == -math.inf


def test_visualisation_columns(cube):
    _, grid, scan = cube
    pairs = scoring.scored_pairs(scan, grid, 2.0)
    out = scoring.coloured(scoring.point_scores(scan, pairs, "point_id")).agg(F.min("r"), F.max("g"), F.max("rgb")).first()
    assert 0 <= out[0] <= 1 and out[1] <= 1 and 0 <= out[2] < 1 << 24


def test_config():
    config = load('{"match": {"max_iterations": 7}, "queue": {"depth": 3}}')
    assert (config.match.max_iterations, config.queue.depth, config.voxel.min_points) == (7, 3, 6)
    with pytest.raises(KeyError):
        load({"nothing": {}})


def test_matcher_objects_and_their_errors(spark):
    from scanloom.config import EngineConfig, MatchConfig
    from scanloom.matcher import Matcher, MultiGridMatcher
    from scanloom.sources.adapters import room, room_scans

    sf = "/root/testdata/sf0.001"
    target, none = room(spark, sf), room(spark, sf).limit(0)
    matcher = Matcher(EngineConfig(match=MatchConfig(step_size=0.03)))
    with pytest.raises(ValueError, match="no target"):
        matcher.align(target)
    with pytest.raises(ValueError, match="no voxels"):
        matcher.set_target(none)
    matcher.set_target(target)
    with pytest.raises(ValueError, match="no points"):
        matcher.align(none)
    with pytest.raises(ValueError, match="no points"):
        matcher.evaluate(none, (0.0,) * 6)
    found = matcher.align(room_scans(spark, sf, one=9))
    assert found["status"] == "converged" and np.allclose(found["pose"], [0.2, -0.1, 0.0, 0.02, -0.02, -0.02], atol=0.05)
    assert matcher.evaluate(target, (0.0,) * 6)["nvtl"] > matcher.evaluate(target, (0.3, 0.3, 0.3, 0.0, 0.0, 0.0))["nvtl"]
    with pytest.raises(ValueError, match="positive"):
        MultiGridMatcher((2.0, 0.0))
    with pytest.raises(ValueError, match="no target"):
        MultiGridMatcher((2.0,)).align_scans(target, target)
    matcher.close()


def test_positions_of_clustered_codes(spark):
    """Codes in one dense cluster, one far away, and one that many rows share."""
    from scanloom.operators.sorting import sorted_positions

    codes = [1_000_000 + (k * 7919) % 400 for k in range(3000)] + [10**17] + [1_000_000] * 800
    rows = [(k, c) for k, c in enumerate(codes)]
    got = {r["id"]: r["position"] for r in sorted_positions(spark.createDataFrame(rows, "id long, code long"), "code", "id").collect()}
    assert got == {k: p for p, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert sorted_positions(spark.createDataFrame(rows, "id long, code long").limit(0), "code", "id").count() == 0


def test_kernels_of_stacks_are_those_of_single_matrices():
    rng = np.random.default_rng(5)
    h, g = rng.normal(size=(40, 6, 6)), rng.normal(size=(40, 6))
    h = h + h.transpose(0, 2, 1)
    h[:20] = -np.einsum("nij,nkj->nik", h[:20], h[:20])
    h[7] = 0
    for f in (K.newton_step, K.newton_step_ascent, lambda a, b: K.newton_step_cholesky(-a, -b)):
        for found, a, b in zip(f(g, h), g, h, strict=True):
            one = f(a, b)
            assert np.isnan(found).all() if one is None else np.allclose(found, one, rtol=1e-9)
    assert K.is_negative_definite(h).tolist() == [K.is_negative_definite(m) for m in h]
    assert K.condition_number(h).tolist() == [K.condition_number(m) for m in h]
    points, poses = rng.normal(size=(9, 3)), rng.normal(size=(9, 6))
    first, second = K.point_derivatives(points, poses)
    for k in range(9):
        a, b = K.point_derivatives(points[k : k + 1], poses[k])
        assert np.allclose(first[k], a[0]) and np.allclose(second[k], b[0])


def test_rows_of_a_small_file_are_dealt_to_tasks(spark):
    """A file of one row group is read by one task; the kernels' rows are dealt anew."""
    from scanloom.plans import numeric

    rows = numeric.numbers(spark, "/root/testdata/sf0.001").coalesce(1)
    made = numeric.per_row(rows, lambda a, b, c, d: (a + d,), "sum")
    assert made.count() == rows.count() and "REPARTITION_BY_COL" in made._jdf.queryExecution().executedPlan().toString()


def test_messages_are_decoded_a_few_at_a_time(spark, monkeypatch):
    from scanloom.plans import numeric
    from scanloom.sources import bag

    whole = numeric.q_pose_messages(spark, "/root/testdata/sf0.001").orderBy("topic").collect()
    monkeypatch.setattr(bag, "AT_ONCE", 3)
    assert numeric.q_pose_messages(spark, "/root/testdata/sf0.001").orderBy("topic").collect() == whole and len(whole) > 3
