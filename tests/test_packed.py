"""Scans too large for a task: sums by groups, blocks of bounded size, and the same results as whole scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.functions import blocks, kernels as K
from scanloom.operators import packed, registration
from scanloom.plans import rooms
from scanloom.sources.adapters import room_scans
from tests.conftest import SF


@pytest.fixture(scope="module")
def grid(spark):
    return rooms.room_voxels(spark, SF).persist()


def cloud_of(n, seed=0):
    rng = np.random.default_rng(seed)
    u, v, t, face = rng.integers(100, 1100, n) / 100, rng.integers(100, 1100, n) / 100, rng.integers(95, 106, n) / 100, rng.integers(0, 3, n)
    return np.stack([np.where(face == 2, t, u), np.where(face == 1, t, np.where(face == 2, u, v)), np.where(face == 0, t, v / 2)], axis=1)


@pytest.mark.parametrize("metric", ["distribution", "plane"])
@pytest.mark.parametrize("least", [1, 1 << 30])
def test_sums_by_groups_are_sums_over_pairs(grid, monkeypatch, metric, least):
    monkeypatch.setattr(blocks, "LEAST_IN_GROUP", least)  # grouped, or listed
    index = registration.local_voxels(grid, 2.0)
    d1, d2 = K.gaussian_constants(2.0, 0.55)
    once = cloud_of(3000)
    points = np.concatenate([once, once[:1500], [[np.nan, 0, 0], [np.inf, 1, 1], [900.0, 900, 900]]])  # half of them twice
    cloud = blocks.Cloud.from_buffer(blocks.Cloud.of(points, 2.0).to_bytes())
    assert cloud.counts is not None and cloud.counts.sum() == 4501 and cloud.total == 4503 and np.diff(cloud.starts).max() <= blocks.MOST_IN_GROUP
    poses = np.array([[0.0] * 6, [0.1, -0.2, 0.1, 0.02, -0.03, 0.3], [3.0, 1, 1, 1, 2, 3], [500.0, 0, 0, 0, 0, 0]])
    fine = points[np.isfinite(points).all(axis=1)]
    for order in (0, 1, 2):
        for pose, (s, g, h, n) in zip(poses, cloud.sums(index, poses, d1, d2, metric, order), strict=True):
            want = K.derivatives(fine, index, pose, d1, d2, metric)
            assert n == want[3] and s == pytest.approx(want[0], rel=1e-9, abs=1e-9)
            if order:
                assert np.allclose(g, want[1], rtol=1e-9, atol=1e-9 * (1 + np.abs(want[1]).max()))
            if order == 2:
                assert np.allclose(h, want[2], rtol=1e-9, atol=1e-9 * (1 + np.abs(want[2]).max()))
    for pose, row in zip(poses, cloud.judged(index, poses, d1, d2), strict=True):
        got, want = packed.scores_of(*row, cloud.total), K.scores(fine, index, pose, d1, d2)
        assert got["pairs"] == want["pairs"] and got["unmatched"] == want["unmatched"] + 2  # those that are not finite
        assert got["nvtl"] == pytest.approx(want["nvtl"], rel=1e-9) and got["score"] == pytest.approx(want["score"], rel=1e-9)


def test_distance_at_the_radius_is_the_distance_itself():
    index = K.VoxelIndex(np.array([[0, 0, 0]]), np.array([[0.5, 0.5, 0.5]]), np.eye(3)[None], np.array([[0.0, 0, 1]]), 2.0)
    edge = np.array([[2.5, 0.5, 0.5], [np.nextafter(2.5, 3), 0.5, 0.5], [0.5, np.nextafter(2.5, 0), 0.5]])
    points = np.repeat(edge, 40, axis=0) + 0.0
    cloud = blocks.Cloud.of(points, 2.0)
    cloud.sparse = lambda: False
    assert cloud.sums(index, np.zeros((1, 6)), -4.0, 0.25)[0][3] == len(index.pairs(points)[0])


@pytest.fixture
def dealt(monkeypatch):
    """Every scan of more than 100 points is dealt to tasks, in blocks of at most 1,000."""
    monkeypatch.setattr(packed, "LARGE_SCAN", 100)
    monkeypatch.setattr(packed, "BLOCK_POINTS", 1000)


def test_blocks_hold_every_point_and_stay_small(spark, dealt):
    points = room_scans(spark, SF).union(room_scans(spark, SF).limit(7).select(F.lit(-1).cast("long"), F.lit(99), "x", "y", "z"))
    scans = packed.PackedScans(points, "scan_id", 2.0)
    clouds = [(r["scan_id"], blocks.Cloud.from_buffer(r["block"])) for r in scans.blocks.collect()]
    want = {r["scan_id"]: r["count"] for r in points.groupBy("scan_id").count().collect()}
    assert 99 not in scans.sizes and scans.small().count() == 7
    assert {k: sum(c.total for i, c in clouds if i == k) for k in scans.sizes} == scans.sizes == {k: n for k, n in want.items() if k != 99}
    assert max(c.total for _, c in clouds) < 2 * packed.BLOCK_POINTS  # a batch may follow a block that is not full
    scans.close()


def aligned(spark, config, grid):
    scans = room_scans(spark, SF)
    rows = registration.align_batch(scans, rooms.unmoved(scans), grid, "scan_id", config, debug=True).collect()
    return {r["scan_id"]: r for r in rows}


@pytest.mark.parametrize("more", [{}, {"metric": "plane"}, {"use_line_search": True, "search": "candidates"}, {"use_line_search": True, "search": "more_thuente"}, {"use_line_search": True, "search": "backtracking"}])
def test_dealt_scans_align_as_whole_ones(spark, grid, monkeypatch, more):
    from dataclasses import replace

    config = replace(rooms.MATCH, max_iterations=4, **more)
    whole = aligned(spark, config, grid)
    monkeypatch.setattr(packed, "LARGE_SCAN", 520)  # some scans are whole, some dealt
    parts = aligned(spark, config, grid)
    assert whole.keys() == parts.keys() and len(whole) == 10
    for k, a in whole.items():
        b = parts[k]
        assert (a["status"], a["iterations"], a["pairs"], len(a["log"])) == (b["status"], b["iterations"], b["pairs"], len(b["log"]))
        assert np.allclose([a[c] for c in (*registration.POSE, "score", "nvtl", "tp_points", "tp_pairs")], [b[c] for c in (*registration.POSE, "score", "nvtl", "tp_points", "tp_pairs")], rtol=1e-6, atol=1e-7)


#: Queries whose scans are dealt here, against the same results.
DEALT = ["q_align_batch", "q_align_plane", "q_align_debug", "q_history_markers", "q_line_searches"]


@pytest.mark.parametrize("name", DEALT)
def test_query_with_dealt_scans_matches_sql(spark, dealt, name):
    import duckdb

    from scanloom.plans.catalogue import QUERIES, SQL
    from tests.test_catalogue import normal

    con = duckdb.connect()
    for table in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    assert normal(got.collect(), got.columns) == normal(want.fetchall(), want.columns)
