"""Queries over time: as-of joins, transforms, windows, tiles, statistics, streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.config import MapConfig, PoseBufferConfig, QueueConfig
from scanloom.operators import analytics, temporal, tiles
from scanloom.plans.points import TRK
from scanloom.plans.registry import query
from scanloom.sources.adapters import points, track

DAY = 86400
BUFFER = PoseBufferConfig(timeout_sec=float(DAY), distance_tolerance=60.0)
_SIDES = f"""{TRK}, poses AS (SELECT track_id, stamp_ns, x, y, z, sin(iterations / 200) AS qz, cos(iterations / 200) AS qw FROM track WHERE event_type IN ('view', 'signup', 'purchase')),
    targets AS (SELECT event_id, track_id, stamp_ns FROM track WHERE event_type = 'click')"""


def pose_track(spark, d) -> DataFrame:
    rows = track(spark, d).where(F.col("event_type").isin("view", "signup", "purchase"))
    zero = F.lit(0.0)
    return rows.select("track_id", "stamp_ns", "x", "y", "z", zero.alias("qx"), zero.alias("qy"), F.sin(F.col("iterations") / 200).alias("qz"), F.cos(F.col("iterations") / 200).alias("qw"))


def targets(spark, d) -> DataFrame:
    return track(spark, d).where("event_type = 'click'").select("event_id", "track_id", "stamp_ns")


_BRACKET = f"""{_SIDES}, lo AS (SELECT t.*, p.stamp_ns AS t0, p.x AS x0, p.y AS y0, p.z AS z0, p.qz AS a0, p.qw AS b0 FROM targets t ASOF LEFT JOIN poses p ON t.track_id = p.track_id AND t.stamp_ns >= p.stamp_ns),
    br AS (SELECT l.*, coalesce(p.stamp_ns, t0) AS t1, coalesce(p.x, x0) AS x1, coalesce(p.y, y0) AS y1, coalesce(p.z, z0) AS z1, coalesce(p.qz, a0) AS a1, coalesce(p.qw, b0) AS b1 FROM lo l ASOF LEFT JOIN poses p ON l.track_id = p.track_id AND l.stamp_ns < p.stamp_ns),
    sized AS (SELECT br.*, n.n FROM br LEFT JOIN (SELECT track_id, count(*) AS n FROM poses GROUP BY 1) n USING (track_id)),
    v AS (SELECT *, coalesce(n >= 2 AND t0 IS NOT NULL AND abs(stamp_ns - t0) < {DAY}000000000 AND abs(stamp_ns - t1) < {DAY}000000000 AND sqrt((x0-x1)*(x0-x1)+(y0-y1)*(y0-y1)+(z0-z1)*(z0-z1)) < 60, false) AS valid,
      CASE WHEN t1 > t0 THEN least(greatest((stamp_ns - t0) / (t1 - t0), 0), 1) ELSE 0 END AS u, a0*a1 + b0*b1 AS dot FROM sized),
    w AS (SELECT *, acos(least(abs(dot), 1)) AS ang, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS side FROM v),
    k AS (SELECT *, CASE WHEN abs(dot) > 0.9999999 THEN 1 - u ELSE sin((1 - u) * ang) / sin(ang) END AS wa, CASE WHEN abs(dot) > 0.9999999 THEN u ELSE sin(u * ang) / sin(ang) END * side AS wb FROM w)"""


def _asof_sql() -> str:
    show = lambda e, n: f"CASE WHEN valid THEN round({e}, 6) END AS {n}"
    return f"WITH {_BRACKET} SELECT event_id, valid, {', '.join(show(f'{c}0 + ({c}1 - {c}0) * u', c) for c in 'xyz')}, {show('a0 * wa + a1 * wb', 'qz')}, {show('b0 * wa + b1 * wb', 'qw')} FROM k"


def _interpolated(df: DataFrame) -> DataFrame:
    return df.select("event_id", "valid", *(F.round(c, 6).alias(c) for c in ("x", "y", "z", "qz", "qw")))


@query(_asof_sql())
def q_asof_interp(spark, d):
    return _interpolated(temporal.interpolate_poses(targets(spark, d), pose_track(spark, d), ["track_id"], BUFFER))


@query(_asof_sql())
def q_asof_interp_bucketed(spark, d):
    """The same result with tracks cut into time buckets, for tracks too long for one task."""
    return _interpolated(temporal.interpolate_poses(targets(spark, d), pose_track(spark, d), ["track_id"], BUFFER, bucket_ns=5 * DAY * 1_000_000_000))


_NEAR = f"""{_SIDES}, lo AS (SELECT t.*, p.stamp_ns AS t0, p.x AS x0 FROM targets t ASOF LEFT JOIN poses p ON t.track_id = p.track_id AND t.stamp_ns >= p.stamp_ns),
    b AS (SELECT l.*, p.stamp_ns AS t1, p.x AS x1 FROM lo l ASOF LEFT JOIN poses p ON l.track_id = p.track_id AND l.stamp_ns < p.stamp_ns),
    c AS (SELECT *, t1 IS NULL OR (t0 IS NOT NULL AND stamp_ns - t0 <= t1 - stamp_ns) AS early FROM b), e AS (SELECT event_id, CASE WHEN early THEN x0 ELSE x1 END AS x, CASE WHEN early THEN stamp_ns - t0 ELSE t1 - stamp_ns END AS gap_ns FROM c)"""


@query(f"WITH {_NEAR} SELECT event_id, x, gap_ns FROM e WHERE gap_ns <= {DAY // 2}000000000")
def q_asof_nearest(spark, d):
    out = temporal.nearest_in_time(targets(spark, d), pose_track(spark, d), ["track_id"], DAY // 2 * 1_000_000_000)
    return out.select("event_id", F.col("other.x").alias("x"), "gap_ns")


_TF = """tf AS (SELECT 'base_link' AS parent, 'sensor' || (s_suppkey % 5) AS child, s_suppkey * 1000000000 AS stamp_ns, s_acctbal / 100 AS tx FROM supplier),
    q AS (SELECT n_nationkey::BIGINT AS query_id, 'sensor' || (n_nationkey % 6) AS source, 'base_link' AS target, n_nationkey * 3700000000 AS stamp_ns FROM nation)"""


@query(f"""WITH {_TF}, m AS (SELECT query_id, source, target, tx, row_number() OVER (PARTITION BY query_id ORDER BY abs(tf.stamp_ns - q.stamp_ns), tf.stamp_ns) AS rn, abs(tf.stamp_ns - q.stamp_ns) AS gap FROM q LEFT JOIN tf ON q.source = tf.child)
    SELECT query_id, source, target, CASE WHEN tx IS NULL THEN 'none' ELSE 'direct' END AS route, round(tx, 6) AS tx, coalesce(gap > 10000000000, false) AS stale FROM m WHERE rn = 1""")
def q_asof_tf(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    zero = F.lit(0.0)
    edges = s.select(F.lit("/base_link").alias("parent"), F.concat(F.lit("sensor"), (F.col("s_suppkey") % 5).cast("string")).alias("child"), (F.col("s_suppkey") * 1_000_000_000).cast("long").alias("stamp_ns"), F.lit(False).alias("is_static"), (F.col("s_acctbal") / 100).alias("tx"), zero.alias("ty"), zero.alias("tz"), zero.alias("qx"), zero.alias("qy"), zero.alias("qz"), F.lit(1.0).alias("qw"))
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("sensor"), (F.col("n_nationkey") % 6).cast("string")).alias("source"), F.lit("base_link").alias("target"), (F.col("n_nationkey").cast("long") * 3_700_000_000).alias("stamp_ns"))
    return temporal.lookup_transform(n, edges).select("query_id", "source", "target", "route", F.round("transform.tx", 6).alias("tx"), "stale")


@query("""WITH n AS (SELECT n_nationkey::BIGINT AS query_id, CASE WHEN n_nationkey % 3 = 0 THEN 'lidar' WHEN n_nationkey % 3 = 1 THEN 'base_link' ELSE 'camera' END AS source, CASE WHEN n_nationkey % 2 = 0 THEN 'map' ELSE 'lidar' END AS target FROM nation)
    SELECT query_id, source, target, CASE WHEN source = target THEN 'same' WHEN source = 'camera' THEN 'none' WHEN source = 'lidar' THEN 'base_link' WHEN target = 'map' THEN 'direct' ELSE 'inverse' END AS route,
    CASE WHEN source = target THEN 0 WHEN source = 'camera' THEN NULL WHEN source = 'lidar' THEN 98 WHEN target = 'map' THEN 100 ELSE 2 END::DOUBLE AS tx, CASE WHEN source = target THEN 0 WHEN source = 'camera' THEN NULL WHEN source = 'lidar' THEN 51 WHEN target = 'map' THEN 50 ELSE -1 END::DOUBLE AS ty FROM n""")
def q_tf_chain(spark, d):
    """base_link stands in the map at (100, 50), turned by a right angle; the lidar in base_link at (1, 2), turned back."""
    h = math.sqrt(0.5)
    edges = spark.createDataFrame([("map", "base_link", 0, True, 100.0, 50.0, 0.0, 0.0, 0.0, h, h), ("base_link", "lidar", 0, True, 1.0, 2.0, 0.0, 0.0, 0.0, -h, h)], "parent string, child string, stamp_ns long, is_static boolean, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey")
    q = n.select(k.cast("long").alias("query_id"), F.when(k % 3 == 0, "lidar").when(k % 3 == 1, "base_link").otherwise("camera").alias("source"), F.when(k % 2 == 0, "map").otherwise("lidar").alias("target"), F.lit(5).cast("long").alias("stamp_ns"))
    out = temporal.lookup_transform(q, edges)
    # from base_link to the lidar: R' (p - t), with R' a right angle, shifts by -R' t = (2, -1)
    return out.select("query_id", "source", "target", "route", *((F.round(f"transform.{c}", 6) + 0.0).alias(c) for c in ("tx", "ty")))


_OSC = f"""{TRK}, s AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM track WINDOW w AS (PARTITION BY track_id ORDER BY stamp_ns)),
    p AS (SELECT *, lag(dx) OVER w AS px, lag(dy) OVER w AS py, lag(dz) OVER w AS pz FROM s WINDOW w AS (PARTITION BY track_id ORDER BY stamp_ns)),
    n AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS nd, sqrt(px*px+py*py+pz*pz) AS np FROM p),
    f AS (SELECT *, coalesce(CASE WHEN nd >= 1e-10 AND np >= 1e-10 THEN (dx*px+dy*py+dz*pz)/(nd*np) < -0.9 ELSE false END, false) AS flip FROM n),
    i AS (SELECT *, sum(CASE WHEN flip THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY stamp_ns ROWS UNBOUNDED PRECEDING) AS island FROM f),
    r AS (SELECT track_id, island, count(*) FILTER (flip) AS run FROM i GROUP BY ALL)"""


@query(f"WITH {_OSC} SELECT track_id, max(run) AS streak, max(run) > 10 AS oscillating FROM r GROUP BY 1")
def q_oscillation(spark, d):
    return temporal.oscillation(track(spark, d), ["track_id"], "stamp_ns")


@query(f"WITH {_OSC} SELECT track_id, round(max(nd), 6) AS max_jump FROM n GROUP BY 1")
def q_max_jump(spark, d):
    return temporal.jumps(track(spark, d), ["track_id"], "stamp_ns").groupBy("track_id").agg(F.round(F.max("jump"), 6).alias("max_jump"))


@query(f"""WITH {TRK}, g AS (SELECT event_id, x, y, z, lag(x, 1) OVER w AS px, lag(y, 1) OVER w AS py, lag(z, 1) OVER w AS pz, (CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0 END)::DOUBLE AS off FROM track WINDOW w AS (PARTITION BY track_id ORDER BY stamp_ns, event_id))
    SELECT event_id, round(CASE WHEN px IS NULL THEN NULL ELSE off END, 6) AS gap, CASE WHEN px IS NULL THEN NULL ELSE event_id % 3 <> 0 END AS chained FROM g""")
def q_chained_guesses(spark, d):
    """Guesses made from the result before, a third of them shifted by half a metre."""
    w = Window.partitionBy("track_id").orderBy("stamp_ns", "event_id")
    rows = track(spark, d).withColumn("nth", F.row_number().over(w))
    rows = rows.withColumns({f"i{c}": F.lag(c).over(w) + (F.when(F.col("event_id") % 3 == 0, 0.5).otherwise(0.0) if c == "x" else 0.0) for c in "xyz"})
    return temporal.chained_guesses(rows, ["track_id"], order="nth").select("event_id", F.round("gap", 6).alias("gap"), "chained")


@query(f"WITH {_OSC}, far AS (SELECT event_id, stamp_ns, nd, row_number() OVER (ORDER BY stamp_ns) AS rn FROM n WHERE nd > 300) SELECT event_id, round(nd, 6) AS jump FROM far WHERE rn = 1")
def q_first_divergence(spark, d):
    moved = temporal.jumps(track(spark, d), ["track_id"], "stamp_ns")
    return temporal.first_divergence(moved, "stamp_ns", "jump", 300.0).select("event_id", F.round("jump", 6).alias("jump"))


@query(f"WITH {TRK} SELECT event_id, max(x) OVER (PARTITION BY track_id ORDER BY stamp_ns ROWS UNBOUNDED PRECEDING) AS best_so_far FROM track")
def q_run_max(spark, d):
    from scanloom.operators.covariance import running_best

    return running_best(track(spark, d), "x", "stamp_ns", "track_id").select("event_id", "best_so_far")


@query(f"""WITH {TRK}, i AS (SELECT *, x < 30 AS skip, sum(CASE WHEN x < 30 THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY stamp_ns ROWS UNBOUNDED PRECEDING) AS island FROM track)
    SELECT event_id, CAST(sum(CASE WHEN skip THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, island ORDER BY stamp_ns ROWS UNBOUNDED PRECEDING) AS BIGINT) AS skipped FROM i""")
def q_skip_streak(spark, d):
    rows = track(spark, d).withColumn("skip", F.col("x") < 30)
    return temporal.running_streak(rows, ["track_id"], "stamp_ns", "skip", "skipped").select("event_id", "skipped")


@query(f"""WITH {TRK}, m AS (SELECT *, row_number() OVER w - 1 AS place, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM track WINDOW w AS (PARTITION BY track_id ORDER BY stamp_ns)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY stamp_ns ROWS UNBOUNDED PRECEDING) - 1 AS segment FROM m) SELECT track_id, CAST(segment AS BIGINT) AS segment, any_value(event_type) AS code, min(place) AS start, count(*) AS length FROM s GROUP BY ALL""")
def q_segments_rle(spark, d):
    return temporal.segments(track(spark, d), ["track_id"], ["stamp_ns"], "event_type")


@query(f"WITH {TRK} SELECT event_id, CAST(sum(iterations) OVER w AS BIGINT) AS inclusive, CAST(sum(iterations) OVER w - iterations AS BIGINT) AS exclusive FROM track WINDOW w AS (PARTITION BY track_id ORDER BY stamp_ns ROWS UNBOUNDED PRECEDING)")
def q_prefix_sum(spark, d):
    return temporal.prefix_sums(track(spark, d), ["track_id"], ["stamp_ns"], "iterations").select("event_id", "inclusive", "exclusive")


@query(f"""WITH {TRK}, ref AS (SELECT track_id, stamp_ns, stamp_ns + iterations * 1000000 AS clock_ns FROM track WHERE event_type = 'signup'), ev AS (SELECT event_id, track_id, stamp_ns FROM track WHERE event_type = 'error'),
    lo AS (SELECT e.*, r.stamp_ns AS t0, r.clock_ns AS c0 FROM ev e ASOF LEFT JOIN ref r ON e.track_id = r.track_id AND e.stamp_ns >= r.stamp_ns), b AS (SELECT l.*, r.stamp_ns AS t1, r.clock_ns AS c1 FROM lo l ASOF LEFT JOIN ref r ON l.track_id = r.track_id AND l.stamp_ns < r.stamp_ns)
    SELECT event_id, CASE WHEN t0 IS NULL THEN c1 WHEN t1 IS NULL THEN c0 ELSE c0 + CAST(round((stamp_ns - t0) / (t1 - t0) * (c1 - c0)) AS BIGINT) END // 1000 AS clock_us FROM b""")
def q_map_clock(spark, d):
    rows = track(spark, d)
    refs = rows.where("event_type = 'signup'").select("track_id", "stamp_ns", (F.col("stamp_ns") + F.col("iterations") * 1_000_000).alias("clock_ns"))
    events = rows.where("event_type = 'error'").select("event_id", "track_id", "stamp_ns")
    return temporal.map_clock(events, refs, ["track_id"]).select("event_id", F.expr("clock_ns div 1000").alias("clock_us"))


# ---- tiles


def tile_table(spark, d) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    return n.select(F.col("n_name").alias("tile_id"), (F.col("n_nationkey") * 7 % 40).cast("double").alias("cx"), (F.col("n_nationkey") * 11 % 50).cast("double").alias("cy"), "n_regionkey")


@query("""WITH t AS (SELECT n_name AS tile_id, n_nationkey * 7 % 40 AS cx, n_nationkey * 11 % 50 AS cy, n_regionkey FROM nation), a AS (SELECT tile_id FROM t WHERE (cx - 20) * (cx - 20) + (cy - 20) * (cy - 20) <= 225), c AS (SELECT tile_id FROM t WHERE n_regionkey < 2)
    SELECT tile_id, 'add' AS action FROM a WHERE tile_id NOT IN (SELECT tile_id FROM c) UNION ALL SELECT tile_id, 'remove' FROM c WHERE tile_id NOT IN (SELECT tile_id FROM a)""")
def q_tile_diff(spark, d):
    t = tile_table(spark, d)
    return tiles.tile_difference(tiles.in_area(t, 20, 20, 15), t.where("n_regionkey < 2"))


_TILES = "tp AS (SELECT l_quantity AS x, round(l_extendedprice) / 1000 AS y, CAST(l_suppkey % 25 AS BIGINT) AS tile_id FROM lineitem)"


@query(f"WITH {_TILES} SELECT count(DISTINCT tile_id) AS tiles, count(*) AS points, count(*) FILTER ((x - 25) * (x - 25) + (y - 50) * (y - 50) <= 400) AS points_in_range FROM tp")
def q_tile_stats(spark, d):
    return tiles.tile_stats(_tile_points(spark, d), 25, 50, 20)


def _tile_points(spark, d) -> DataFrame:
    return points(spark, d).withColumn("tile_id", (F.col("point_id") % 10000 % 25).cast("long"))


@query(f"WITH {_TILES} SELECT tile_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS points FROM tp GROUP BY 1")
def q_tile_centres(spark, d):
    return tiles.tile_centres(_tile_points(spark, d)).select("tile_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "points")


@query(f"""WITH RECURSIVE {TRK}, seq AS (SELECT event_id, track_id, x, y, row_number() OVER (PARTITION BY track_id ORDER BY stamp_ns) AS rn FROM track),
    walk AS (SELECT event_id, track_id, rn, x AS lx, y AS ly, true AS should_update, true AS out_of_range FROM seq WHERE rn = 1
      UNION ALL SELECT s.event_id, s.track_id, s.rn, CASE WHEN sqrt((s.x-w.lx)*(s.x-w.lx)+(s.y-w.ly)*(s.y-w.ly)) > 20 THEN s.x ELSE w.lx END, CASE WHEN sqrt((s.x-w.lx)*(s.x-w.lx)+(s.y-w.ly)*(s.y-w.ly)) > 20 THEN s.y ELSE w.ly END,
        sqrt((s.x-w.lx)*(s.x-w.lx)+(s.y-w.ly)*(s.y-w.ly)) > 20, sqrt((s.x-w.lx)*(s.x-w.lx)+(s.y-w.ly)*(s.y-w.ly)) + 100 > 150 FROM walk w JOIN seq s ON s.track_id = w.track_id AND s.rn = w.rn + 1)
    SELECT event_id, should_update, out_of_range FROM walk""")
def q_should_update(spark, d):
    return tiles.update_decisions(track(spark, d), ["track_id"], "stamp_ns", MapConfig()).select("event_id", "should_update", "out_of_range")


@query(f"WITH {TRK} SELECT track_id, arg_max(event_id, stamp_ns) AS event_id, max(stamp_ns) AS stamp_ns FROM track GROUP BY 1")
def q_latest_per_key(spark, d):
    return tiles.latest_per_key(track(spark, d).select("track_id", "event_id", "stamp_ns"), "track_id", "stamp_ns")


# ---- statistics


@query(f"""WITH {TRK} SELECT event_type, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max, round(quantile_cont(x, 0.5), 6) AS median,
    round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99, round(1000 / avg(x), 6) AS throughput FROM track GROUP BY 1""")
def q_exec_stats(spark, d):
    out = analytics.timing_stats(track(spark, d), "x", "event_type")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "median", "p95", "p99", "throughput")})


@query(f"WITH {TRK} SELECT iterations, count(*) AS n, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max FROM track GROUP BY 1")
def q_by_iterations(spark, d):
    return analytics.by_iterations(track(spark, d), "x", "iterations").withColumn("mean", F.round("mean", 6))


@query(f"""WITH {TRK}, r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY stamp_ns) AS rn FROM track) SELECT track_id, round(avg(x) FILTER (rn <= 10), 6) AS first_mean, round(avg(x) FILTER (rn > 10), 6) AS steady_mean FROM r GROUP BY 1""")
def q_warmup(spark, d):
    return analytics.warmup(track(spark, d), "x", "stamp_ns", ["track_id"]).withColumns({c: F.round(c, 6) for c in ("first_mean", "steady_mean")})


@query(f"WITH {TRK} SELECT track_id, round(100.0::DOUBLE * count(*) FILTER (event_type = 'view') / count(*), 6) AS convergence_rate FROM track GROUP BY 1")
def q_conv_rate(spark, d):
    return analytics.convergence_rate(track(spark, d), "event_type", "view", "track_id").withColumn("convergence_rate", F.round("convergence_rate", 6))


@query(f"WITH {TRK}, a AS (SELECT avg(x) FILTER (event_type = 'error') AS s, avg(x) FILTER (event_type = 'view') AS f FROM track) SELECT round(s, 6) AS slow_mean, round(f, 6) AS fast_mean, round(s / f, 6) AS ratio FROM a")
def q_overhead(spark, d):
    t = track(spark, d)
    return analytics.overhead(t.where("event_type = 'error'"), t.where("event_type = 'view'"), "x").select(*(F.round(c, 6).alias(c) for c in ("slow_mean", "fast_mean", "ratio")))


@query(f"WITH {TRK}, a AS (SELECT avg(x) FILTER (event_type = 'error') AS s, avg(x) FILTER (event_type = 'view') AS f FROM track) SELECT round(s, 6) AS mean_a, round(f, 6) AS mean_b, round(s - f, 6) AS difference, round(s / f, 6) AS ratio FROM a")
def q_compare_scores(spark, d):
    t = track(spark, d)
    return analytics.compare_scores(t.where("event_type = 'error'"), t.where("event_type = 'view'"), "x").select(*(F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "difference", "ratio")))


@query(f"""WITH {_SIDES}, tg AS (SELECT event_id, track_id, stamp_ns, x, y, z FROM track WHERE event_type = 'click'), lo AS (SELECT t.*, p.stamp_ns AS t0, p.x AS x0, p.y AS y0, p.z AS z0 FROM tg t ASOF LEFT JOIN poses p ON t.track_id = p.track_id AND t.stamp_ns >= p.stamp_ns),
    b AS (SELECT l.*, p.stamp_ns AS t1, p.x AS x1, p.y AS y1, p.z AS z1 FROM lo l ASOF LEFT JOIN poses p ON l.track_id = p.track_id AND l.stamp_ns < p.stamp_ns), c AS (SELECT *, t1 IS NULL OR (t0 IS NOT NULL AND stamp_ns - t0 <= t1 - stamp_ns) AS early FROM b),
    e AS (SELECT track_id, CASE WHEN early THEN stamp_ns - t0 ELSE t1 - stamp_ns END AS gap, CASE WHEN early THEN (x-x0)*(x-x0)+(y-y0)*(y-y0)+(z-z0)*(z-z0) ELSE (x-x1)*(x-x1)+(y-y1)*(y-y1)+(z-z1)*(z-z1) END AS e2 FROM c)
    SELECT track_id, round(sqrt(avg(e2)), 6) AS rmse, round(sqrt(max(e2)), 6) AS max_error, count(e2) AS pairs FROM e WHERE gap <= {DAY // 2}000000000 GROUP BY 1""")
def q_rmse(spark, d):
    left = track(spark, d).where("event_type = 'click'").select("event_id", "track_id", "stamp_ns", "x", "y", "z")
    pairs = temporal.nearest_in_time(left, pose_track(spark, d), ["track_id"], DAY // 2 * 1_000_000_000)
    return analytics.trajectory_error(pairs, "track_id").withColumns({c: F.round(c, 6) for c in ("rmse", "max_error")})


@query("""WITH a AS (SELECT o_orderdate, max(o_orderkey) AS k, arg_max(o_totalprice, o_orderkey) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderdate, max(o_orderkey) AS k, arg_max(o_totalprice, o_orderkey) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT a.k AS left_key, b.k AS right_key, round(a.p - b.p, 2) AS difference FROM a JOIN b USING (o_orderdate)""")
def q_compare_logs(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    out = analytics.join_logs(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_orderdate", "o_orderkey")
    return out.select(F.col("a.o_orderkey").alias("left_key"), F.col("b.o_orderkey").alias("right_key"), F.round(F.col("a.o_totalprice") - F.col("b.o_totalprice"), 2).alias("difference"))


@query(f"""WITH {TRK}, n AS (SELECT track_id, event_type, event_id, row_number() OVER (PARTITION BY track_id, event_type ORDER BY stamp_ns) AS position FROM track)
    SELECT a.track_id, CAST(position AS INTEGER) AS position, a.event_id AS left_id, b.event_id AS right_id FROM n a JOIN n b USING (track_id, position) WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def q_join_positions(spark, d):
    t = track(spark, d).select("track_id", "event_id", "stamp_ns", "event_type")
    out = analytics.join_positions(t.where("event_type = 'view'"), t.where("event_type = 'click'"), ["track_id"], "stamp_ns")
    return out.select("track_id", "position", F.col("a.event_id").alias("left_id"), F.col("b.event_id").alias("right_id"))


@query(f"WITH {TRK} SELECT event_type, round(avg(iterations * 1000.0::DOUBLE), 6) AS mean_ms, min(iterations) * 1000.0::DOUBLE AS min_ms, max(iterations) * 1000.0::DOUBLE AS max_ms, count(*) AS n FROM track GROUP BY 1")
def q_offsets_by_topic(spark, d):
    rows = track(spark, d).withColumn("wall_ns", F.col("stamp_ns") + F.col("iterations").cast("long") * 1_000_000_000)
    return analytics.offsets_by_topic(rows, "event_type", "wall_ns", "stamp_ns").withColumn("mean_ms", F.round("mean_ms", 6))


# ---- streams


@query(f"""WITH {TRK}, a AS (SELECT event_id, track_id, stamp_us / 1000 AS arrival_ms, max(stamp_us / 1000) OVER () - stamp_us / 1000 > 432000000 AS old FROM track),
    r AS (SELECT *, row_number() OVER (PARTITION BY track_id, old ORDER BY arrival_ms DESC, event_id DESC) AS rn FROM a) SELECT event_id, CASE WHEN old THEN 'dropped_age' WHEN rn > 8 THEN 'dropped_overflow' ELSE 'processed' END AS fate FROM r""")
def q_queue_shed(spark, d):
    from scanloom.streaming.scan_queue import shed

    rows = track(spark, d).select(F.col("event_id").alias("scan_id"), F.col("track_id").alias("vehicle"), (F.col("stamp_us") / 1000).alias("arrival_ms"))
    now = rows.agg(F.max("arrival_ms")).first()[0]
    return shed(rows, now or 0.0, QueueConfig(max_age_ms=432_000_000.0)).select(F.col("scan_id").alias("event_id"), "fate")


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type AS vehicle, count(*) AS n, round(avg(value), 6) AS mean_nvtl, min(value) AS min_nvtl FROM events GROUP BY ALL""")
def q_stream_score_windows(spark, d):
    """A stream over the table that is there, run to its end; complete mode keeps the last windows too."""
    import uuid

    from scanloom.streaming.matcher import score_windows

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("vehicle"), F.col("value").alias("nvtl"))
    name = f"score_windows_{uuid.uuid4().hex}"
    writer = score_windows(stream, "1 day", "6 hours").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
    if shared := spark.conf.get("spark.checkpoint.dir", None):  # state must be where all executors see it
        writer = writer.option("checkpointLocation", f"{shared.rstrip('/')}/scanloom/{spark.sparkContext.applicationId}/{name}")
    run = writer.start()
    run.awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "vehicle", "n", F.round("mean_nvtl", 6).alias("mean_nvtl"), "min_nvtl")
