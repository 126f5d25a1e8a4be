"""Sources, sinks and the streaming operators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.config import EngineConfig, FilterConfig, PoseBufferConfig, QueueConfig, VoxelConfig
from scanloom.operators import registration, temporal, tiles, voxels
from scanloom.sources import bag, generators, logs, pointcloud
from scanloom.streaming import matcher
from scanloom.streaming.pose_buffer import PoseBuffer, interpolate_stream
from scanloom.streaming.scan_queue import ScanQueue, run_queue


def test_point_cloud_round_trip(spark):
    cloud = generators.lattice(spark, 3, 0.5).withColumn("scan_id", F.lit(4)).withColumn("rgb", F.lit(0x112233))
    message = pointcloud.encode(cloud, "scan_id", rgb="rgb")
    assert message.first()["point_step"] == 16
    back = pointcloud.decode(message, "scan_id").toPandas()
    assert len(back) == 27 and back.x.max() == 1.0 and (back.scan_id == 4).all()


def test_point_cloud_errors_and_infinities():
    message = pointcloud.encode_payload(np.array([[1, 2, 3], [np.nan, 0, 0], [np.inf, 0, 0]], dtype=np.float32))
    assert pointcloud.decode_payload(message).tolist() == [[1, 2, 3]]
    with pytest.raises(ValueError, match="needs"):
        pointcloud.decode_payload({**message, "data": message["data"][:-1]})
    with pytest.raises(ValueError, match="z"):
        pointcloud.decode_payload({**message, "fields": message["fields"][:2]})


def test_generators(spark):
    assert generators.plane(spark, 2.0, 0.5).count() == 25
    s = generators.sphere(spark, (1, 2, 3), 5.0, 200, 7).toPandas()
    assert np.allclose(np.linalg.norm(s[["x", "y", "z"]] - [1, 2, 3], axis=1), 5.0, atol=1e-4)
    assert generators.clustered(spark, [(0, 0, 0), (9, 9, 9)], 1.0, 10).count() == 20
    assert generators.half_cube(spark, 2.0, 1.0, (100.0, 100.0, 0.0)).agg(F.min("x")).first()[0] == 100.0


def test_voxel_dump_round_trip(spark, tmp_path):
    grid = voxels.build_voxels(generators.half_cube(spark, 6.0, 0.2), VoxelConfig(2.0))
    logs.write_voxels(grid, f"file://{tmp_path}/v", 2.0)
    back = logs.read_voxels(spark, f"file://{tmp_path}/v")
    a = {(r.vx, r.vy, r.vz): r for r in grid.collect()}
    b = {(r.vx, r.vy, r.vz): r for r in back.collect()}
    assert a.keys() == b.keys() and all(a[k].n == b[k].n and np.allclose(a[k].mean, b[k].mean) for k in a)
    document = {"resolution": 2.0, "num_voxels": 1, "voxels": [{"mean": [1.0, 1.0, 1.0], "cov": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "inv_cov": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "point_count": 9}]}
    (tmp_path / "one.json").write_text(json.dumps(document, indent=1))
    assert logs.read_voxels(spark, f"file://{tmp_path}/one.json").first()["n"] == 9


def test_logs_skip_bad_lines(spark, tmp_path):
    lines = ['{"timestamp_ns": 1, "convergence_status": "Converged", "iterations": [{"iteration": 0, "score": 1.5}, {"iteration": 1, "score": 2.5}]}', "not json", '{"type": "init", "num_particles": 3, "reliable": true}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    path = f"file://{tmp_path}/log.jsonl"
    rows = logs.read_alignments(spark, path)
    assert rows.count() == 1 and [r["score"] for r in logs.iterations(rows).orderBy("at").collect()] == [1.5, 2.5]
    assert logs.read_inits(spark, path).first()["num_particles"] == 3
    logs.append_json(rows, f"file://{tmp_path}/out")
    logs.append_json(rows, f"file://{tmp_path}/out")
    assert logs.read_alignments(spark, f"file://{tmp_path}/out").count() == 2


def test_recording(spark, tmp_path):
    import struct

    path = str(tmp_path / "a.db3")
    payload = struct.pack("<4xiIf", 5, 250, 2.5)
    bag.write_recording([("/score", "Float32Stamped", 7, payload), ("/score", "Float32Stamped", 9, struct.pack("<4xiIf", 0, 0, 1.0)), ("/x", "Other", 8, b"1")], path)
    messages = bag.read_recording(spark, path)
    assert {r["topic"]: r["messages"] for r in bag.topics(messages).collect()} == {"/score": 2, "/x": 1}
    got = sorted((r["stamp_ns"], r["value"]) for r in bag.scalars(messages.where("topic = '/score'")).collect())
    assert got == [(9, 1.0), (5_000_000_250, 2.5)]


def pose(stamp, x):
    return (stamp, float(x), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)


def test_pose_buffer_rules():
    second = 1_000_000_000
    b = PoseBuffer()
    assert b.at(0) is None and b.latest() is None
    for i in range(3):
        b.push(pose(i * second // 2, i))
    assert b.at(second // 4)[1] == 0.5 and b.at(-1) is None
    assert b.at(second + second // 2)[1] == 2.0  # past the last, within the timeout
    assert b.at(second * 2) is None
    b.push(pose(second // 8, 9))
    assert len(b.poses) == 4
    reset = PoseBuffer(reset_on_reversal=True)
    reset.push(pose(5, 1))
    reset.push(pose(3, 2))
    assert [p[0] for p in reset.poses] == [3]
    b.drop_before(10 * second)
    assert len(b.poses) == 1
    far = PoseBuffer(PoseBufferConfig(distance_tolerance=1.0))
    far.push(pose(0, 0))
    far.push(pose(10, 5))
    assert far.at(5) is None
    same = PoseBuffer()
    same.push(pose(4, 1))
    same.push(pose(4, 2))
    assert same.at(4)[1] == 1.0


def test_stream_interpolation_equals_batch(spark, tmp_path):
    base, step = 1_700_000_000_000_000_000, 100_000_000  # a live watermark drops what is at the epoch
    poses = [("a", base + i * step, float(i), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for i in range(60)]
    scans = [("a", k, base + 30_000_000 + k * 170_000_000) for k in range(30)]
    p = spark.createDataFrame(poses, "vehicle string, stamp_ns long, x double, y double, z double, qx double, qy double, qz double, qw double")
    s = spark.createDataFrame(scans, "vehicle string, scan_id long, stamp_ns long")
    p.coalesce(1).write.parquet(f"file://{tmp_path}/p")
    s.coalesce(1).write.parquet(f"file://{tmp_path}/s")
    out = interpolate_stream(spark.readStream.schema(p.schema).parquet(f"file://{tmp_path}/p"), spark.readStream.schema(s.schema).parquet(f"file://{tmp_path}/s"))
    run = out.writeStream.format("memory").queryName("interpolated").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    streamed = {r["scan_id"]: r["x"] for r in spark.table("interpolated").collect()}
    batch = {r["scan_id"]: r["x"] for r in temporal.interpolate_poses(s, p, ["vehicle"]).collect()}
    assert len(streamed) >= 29 and all(streamed[k] == pytest.approx(batch[k]) for k in streamed)


def test_queue_rules():
    q = ScanQueue()
    for i in range(10):
        q.enqueue(float(i), i)
    assert q.stats["dropped_overflow"] == 2 and q.due(9.0) == [(2.0, 2), (3.0, 3), (4.0, 4), (5.0, 5)]
    assert [x for x, _ in q.due(106.5)] == [7.0, 8.0, 9.0] and q.stats["dropped_age"] == 1
    q.enqueue(200.0, "late")
    assert q.due(210.0) == [] and len(q.due(220.0)) == 1
    q.enqueue(300.0, "last")
    assert len(q.due(300.0, draining=True)) == 1 and q.stats["processed"] == 9


def test_queue_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(20)], "vehicle string, scan_id long, arrival_ms double")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    seen, counts = [], {}
    run = run_queue(
        spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), lambda df, n: seen.extend(r["scan_id"] for r in df.collect()),
        lambda df, n: counts.update({r["fate"]: r["n"] for r in df.collect()}), f"file://{tmp_path}/c", QueueConfig(depth=8, max_age_ms=15.0),
    )
    run.awaitTermination()
    assert seen == list(range(12, 20)) and counts == {"processed": 8, "dropped_age": 4, "dropped_overflow": 8}


def test_matcher_stream(spark, tmp_path):
    cloud = generators.half_cube(spark, 12.0, 0.2)
    scan = voxels.downsample(cloud, 1.0).select(F.lit(1).cast("long").alias("scan_id"), "x", "y", "z")
    near = scan.where("x < 2 and y < 2 and z < 2").withColumn("scan_id", F.lit(2).cast("long"))
    both = scan.union(near)
    both.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    live = matcher.VersionedMap()
    live.prepare(lambda: 1 / 0)
    assert not live.swap_if_ready() and live.failures
    live.prepare(lambda: voxels.build_voxels(cloud, VoxelConfig(2.0)))
    published = {}
    pose_of = lambda df: df.select("scan_id").distinct().withColumns({"pose_id": F.lit(0).cast("long"), **{c: F.lit(0.05) for c in registration.POSE[:3]}, **{c: F.lit(0.0) for c in registration.POSE[3:]}})
    run = matcher.run_matcher(
        spark.readStream.schema(both.schema).parquet(f"file://{tmp_path}/in"), live, pose_of, lambda name, df, n: published.setdefault(name, []).extend(df.collect()),
        f"file://{tmp_path}/c", EngineConfig(filter=FilterConfig(required_distance=5.0)),
    )
    run.awaitTermination()
    assert [r["scan_id"] for r in published["alignments"]] == [1] and [r["scan_id"] for r in published["refused"]] == [2]
    assert published["alignments"][0]["map_version"] == 1 and len(published["alignments"][0]["covariance"]) == 36
    assert published["diagnostics"][0]["level"] == "ok" and published["diagnostics"][0]["values"]["status"] == published["alignments"][0]["status"]


def test_tiles(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("b", 5.0, 5.0, 0.0)], "tile_id string, x double, y double, z double")
    fresh = spark.createDataFrame([("c", 9.0, 9.0, 0.0), ("a", 1.0, 1.0, 1.0)], "tile_id string, x double, y double, z double")
    diff = tiles.tile_difference(fresh, points)
    assert {(r[0], r[1]) for r in diff.collect()} == {("c", "add"), ("b", "remove")}
    assert {r["tile_id"] for r in tiles.apply_difference(points, diff, fresh).collect()} == {"a", "c"}


def test_transform_buffer_and_switch(spark):
    from scanloom.streaming.transforms import EDGE, Switch, TransformBuffer, serve_map_request

    buffer = TransformBuffer(most=3)
    edge = lambda t, fixed, x: ("/map", "base_link", t, fixed, float(x), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    buffer.push(spark.createDataFrame([edge(i, False, i) for i in range(5)], EDGE))
    assert [e[0] for e in buffer.edges[("map", "base_link")]] == [2, 3, 4]
    ask = spark.createDataFrame([(1, "base_link", "map", 3), (2, "map", "base_link", None)], "query_id long, source string, target string, stamp_ns long")
    got = {r["query_id"]: (r["route"], r["transform"]["tx"]) for r in buffer.lookup(ask).collect()}
    assert got == {1: ("direct", 3.0), 2: ("inverse", -4.0)}  # without a stamp the latest
    buffer.push(spark.createDataFrame([edge(9, True, 50)], EDGE))
    assert {r["transform"]["tx"] for r in buffer.lookup(ask.where("query_id = 1")).collect()} == {50.0}

    calls, resets = [], []
    switch = Switch(False, [lambda: resets.append(1)])
    process = switch.guard(lambda df, n: calls.append(n))
    process(None, 1)
    switch.set(True)
    process(None, 2)
    assert calls == [2] and resets == [1]
    tiles_ = spark.createDataFrame([("a", 0.0, 0.0), ("b", 50.0, 0.0)], "tile_id string, cx double, cy double")
    assert {(r[0], r[1]) for r in serve_map_request(tiles_, 0, 0, 10, ["b"]).collect()} == {("a", "add"), ("b", "remove")}


def test_interpolation_carries_the_older_covariance(spark):
    second = 1_000_000_000
    rows = [("a", 10 * second, 0.0, [1.0]), ("a", 10 * second + second // 2, 4.0, [2.0])]
    poses = spark.createDataFrame([(v, t, x, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, c) for v, t, x, c in rows], "vehicle string, stamp_ns long, x double, y double, z double, qx double, qy double, qz double, qw double, cov array<double>")
    asks = spark.createDataFrame([("a", 1, 10 * second + second // 4), ("a", 2, 0), ("b", 3, 10 * second)], "vehicle string, scan_id long, stamp_ns long")
    got = {r["scan_id"]: (r["valid"], r["x"], r["cov"]) for r in temporal.interpolate_poses(asks, poses, ["vehicle"]).collect()}
    assert got == {1: (True, 2.0, [1.0]), 2: (False, None, None), 3: (False, None, None)}


def test_percentiles_from_a_sketch(spark):
    from scanloom.operators.analytics import timing_stats

    rows = spark.range(10_000).select((F.col("id") % 1000).cast("double").alias("ms"))
    exact, sketch = timing_stats(rows, "ms").first(), timing_stats(rows, "ms", accuracy=200).first()
    assert all(abs(exact[c] - sketch[c]) <= 10 for c in ("median", "p95", "p99"))


def test_pose_and_integer_messages_by_hand(spark):
    import struct

    from scanloom.sources import bag

    # encapsulation, 5 s 7 ns, frame "map" with its zero, no filling (16 bytes), seven doubles
    body = struct.pack("<iII", 5, 7, 4) + b"map\0" + struct.pack("<7d", *range(1, 8))
    assert bag.encode_pose(5_000_000_007, "map", tuple(range(1, 8))) == b"\0\1\0\0" + body
    odd = struct.pack("<iII", 0, 0, 6) + b"world\0" + b"\0" * 6 + struct.pack("<7d", *range(7)) + struct.pack("<36d", *range(36))
    rows = [("/a", 1, b"\0\1\0\0" + body), ("/b", 2, b"\0\1\0\0" + odd), ("/c", 3, b"short"), ("/d", 4, None), ("/e", 5, b"\0\1\0\0" + body[:40])]
    messages = spark.createDataFrame(rows, "topic string, stamp_ns long, data binary")
    got = {r["topic"]: r for r in bag.poses(messages).collect()}
    assert set(got) == {"/a", "/b"}
    assert (got["/a"]["stamp_ns"], got["/a"]["frame"], got["/a"]["x"], got["/a"]["qw"], got["/a"]["covariance"]) == (5_000_000_007, "map", 1.0, 7.0, None)
    assert (got["/b"]["stamp_ns"], got["/b"]["frame"], got["/b"]["y"], got["/b"]["covariance"][35]) == (2, "world", 1.0, 35.0)
    numbers = [("/n", 9, bag.encode_integer(3_000_000_001, -7)), ("/m", 8, bag.encode_integer(0, 12)), ("/x", 1, b"")]
    found = {r["topic"]: (r["stamp_ns"], r["value"]) for r in bag.integers(spark.createDataFrame(numbers, "topic string, stamp_ns long, data binary")).collect()}
    assert found == {"/n": (3_000_000_001, -7), "/m": (8, 12)}
    moved = bag.restamped(messages.withColumn("new", F.when(F.col("topic") != "/b", F.lit(9_000_000_123))), "new")
    again = {r["topic"]: r["stamp_ns"] for r in bag.poses(moved).collect()}
    assert again == {"/a": 9_000_000_123, "/b": 2}
    assert {r["topic"]: r["data"] for r in moved.collect()}["/c"] == b"short"


def test_turned_covariances_agree():
    from scanloom.operators import covariance

    turn = np.array([[np.cos(0.3), -np.sin(0.3), 0], [np.sin(0.3), np.cos(0.3), 0], [0, 0, 1]])
    cov = np.diag([2.0, 1.0, 3.0, 4.0, 5.0, 6.0])
    cov[0, 1] = cov[1, 0] = 0.5
    full = covariance.rotate_covariance(cov, turn)
    assert np.allclose(full[:3, :3], turn @ cov[:3, :3] @ turn.T) and np.allclose(full[3:, 3:], turn @ cov[3:, 3:] @ turn.T)


def test_stream_from_bytes_to_published_poses(spark, tmp_path):
    from scanloom.plans import rooms

    sf = "/root/testdata/sf0.001"
    messages, poses, transforms, fixes = rooms.room_messages(spark, sf)
    messages.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    live, published = matcher.VersionedMap(), {}
    live.prepare(lambda: rooms.room_voxels(spark, sf))
    run = matcher.run_scans(
        spark.readStream.schema(messages.schema).parquet(f"file://{tmp_path}/in"), live, lambda: poses, lambda: transforms, lambda name, df, n: published.setdefault(name, []).extend(df.collect()),
        f"file://{tmp_path}/c", EngineConfig(match=rooms.MATCH, queue=QueueConfig(depth=6)), lambda: fixes,
    )
    run.awaitTermination()
    newest = sorted(r["scan_id"] for r in messages.select("scan_id").collect())[-6:]
    assert {r["fate"]: r["n"] for r in published["shed"]} == {"processed": 6, "dropped_overflow": messages.count() - 6}
    assert sorted(r["scan_id"] for r in published["diagnostics"]) == newest
    good = [k for k in newest if k not in (5, 7)]
    assert sorted(r["scan_id"] for r in published["poses"]) == good
    for r in published["poses"]:
        k = r["scan_id"]
        assert np.allclose([r["x"], r["y"], r["z"]], [(k % 5 - 2) / 10, (k % 3 - 1) / 10, (k % 4 - 1) / 10], atol=0.06) and len(r["covariance"]) == 36
    assert {r["level"] for r in published["diagnostics"] if r["scan_id"] in good} == {"ok"}
