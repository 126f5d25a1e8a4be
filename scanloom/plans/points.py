"""Queries over points: filters, cells, keys, voxels and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.config import FilterConfig
from scanloom.functions import geometry as G
from scanloom.operators import filters, voxels
from scanloom.operators.sorting import sorted_positions
from scanloom.plans.registry import query
from scanloom.sources.adapters import points, scan, track

RES = 4.0
PTS = """points AS (SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS point_id, l_linenumber AS cloud_id,
    CAST(round(l_quantity * 1000) AS BIGINT) AS xi, CAST(round(l_extendedprice) AS BIGINT) AS yi, CAST(round((l_discount + l_tax) * 100000) AS BIGINT) AS zi,
    xi / 1000 AS x, yi / 1000 AS y, zi / 1000 AS z FROM lineitem),
 cells AS (SELECT *, CAST(floor(x / 4) AS INTEGER) AS vx, CAST(floor(y / 4) AS INTEGER) AS vy, CAST(floor(z / 4) AS INTEGER) AS vz FROM points)"""
FILTER = FilterConfig(min_distance=5.0, max_distance=60.0, min_z=2.0, max_z=12.0)
_R2 = "x * x + y * y + z * z"


@query(f"WITH {PTS} SELECT point_id, x, y, z FROM points WHERE {_R2} BETWEEN 25 AND 3600 AND z BETWEEN 2 AND 12")
def q_filter_range_z(spark, d):
    return filters.filter_points(points(spark, d), FILTER).select("point_id", "x", "y", "z")


@query(f"""WITH {PTS} SELECT cloud_id, count(*) FILTER ({_R2} BETWEEN 25 AND 3600 AND z BETWEEN 2 AND 12) AS kept,
    count(*) FILTER (NOT {_R2} BETWEEN 25 AND 3600) AS rejected_distance, count(*) FILTER ({_R2} BETWEEN 25 AND 3600 AND NOT z BETWEEN 2 AND 12) AS rejected_z
    FROM points GROUP BY cloud_id""")
def q_filter_reject_counts(spark, d):
    return filters.reject_counts(points(spark, d), FILTER, "cloud_id")


@query(f"WITH {PTS} SELECT point_id, x, y, z FROM points WHERE x BETWEEN 10 AND 30 AND y BETWEEN 20 AND 60 AND z BETWEEN 1 AND 9")
def q_crop_box(spark, d):
    return filters.crop_box(points(spark, d), (10, 20, 1), (30, 60, 9)).select("point_id", "x", "y", "z")


@query(f"WITH {PTS} SELECT cloud_id, count(*) AS n FROM points WHERE yi % 97 <> 0 AND yi % 89 <> 0 GROUP BY cloud_id")
def q_finite(spark, d):
    dirty = points(spark, d).withColumn("y", F.when(F.col("yi") % 97 == 0, float("nan")).when(F.col("yi") % 89 == 0, float("inf")).otherwise(F.col("y")))
    return filters.drop_non_finite(dirty).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PTS} SELECT cloud_id, round(sqrt(max({_R2})), 6) AS max_range, sqrt(max({_R2})) >= 100 AS accepted FROM points GROUP BY cloud_id")
def q_max_range(spark, d):
    return filters.scans_in_range(points(spark, d), "cloud_id", 100.0).withColumn("max_range", F.round("max_range", 6))


@query(f"WITH {PTS} SELECT point_id, x, y, z FROM points ORDER BY md5('0/' || point_id), point_id LIMIT 500")
def q_random_sample(spark, d):
    return filters.random_sample(points(spark, d), 500, "point_id").select("point_id", "x", "y", "z")


@query(f"WITH {PTS} SELECT point_id, vx, vy, vz FROM cells")
def q_cell_keys(spark, d):
    return voxels.with_cells(points(spark, d), RES).select("point_id", "vx", "vy", "vz")


@query(f"""WITH {PTS}, b AS (SELECT min(vx) lx, min(vy) ly, min(vz) lz, max(vx) - min(vx) + 1 AS dx, max(vy) - min(vy) + 1 AS dy FROM cells)
    SELECT DISTINCT vx, vy, vz, CAST((vx - lx) + (vy - ly) * dx + (vz - lz) * dx * dy AS BIGINT) AS linear_id, vx - lx AS ux, vy - ly AS uy, vz - lz AS uz FROM cells, b""")
def q_linear_id(spark, d):
    cells = voxels.with_cells(points(spark, d), RES).select(*voxels.CELL).distinct()
    low = cells.agg(*(F.min(c).alias(f"l{c[1]}") for c in voxels.CELL), *((F.max(c) - F.min(c) + 1).alias(f"d{c[1]}") for c in voxels.CELL))
    both = cells.crossJoin(low)  # the bounds are one row
    code = G.linear_id(F.col("vx") - F.col("lx"), F.col("vy") - F.col("ly"), F.col("vz") - F.col("lz"), F.col("dx"), F.col("dy"))
    back = G.from_linear_id(F.col("linear_id"), F.col("dx"), F.col("dy"))
    return both.withColumn("linear_id", code).select("vx", "vy", "vz", "linear_id", *(c.alias(n) for c, n in zip(back, ("ux", "uy", "uz"), strict=True)))


@query(f"""WITH {PTS} SELECT DISTINCT vx, vy, vz, ((vz::BIGINT + 1048576) << 42) | ((vy::BIGINT + 1048576) << 21) | (vx::BIGINT + 1048576) AS packed, vx AS ux, vy AS uy, vz AS uz FROM cells""")
def q_packed_key(spark, d):
    cells = voxels.with_cells(points(spark, d), RES).select(*voxels.CELL).distinct().withColumn("packed", G.pack_key(F.col("vx"), F.col("vy"), F.col("vz")))
    return cells.select("*", *(c.alias(n) for c, n in zip(G.unpack_key(F.col("packed")), ("ux", "uy", "uz"), strict=True)))


def _morton_sql(v: str, at: int) -> str:
    return f"list_sum(list_transform(range(21), lambda i: ((({v}::BIGINT >> i) & 1) << (3 * i + {at}))))"


@query(f"WITH {PTS} SELECT DISTINCT vx, vy, vz, CAST({_morton_sql('vx', 0)} + {_morton_sql('vy', 1)} + {_morton_sql('vz', 2)} AS BIGINT) AS code, vx::BIGINT AS ux, vy::BIGINT AS uy, vz::BIGINT AS uz FROM cells")
def q_morton(spark, d):
    cells = voxels.with_cells(points(spark, d), RES).select(*voxels.CELL).distinct().withColumn("code", G.morton("vx", "vy", "vz"))
    return cells.select("*", *(c.alias(n) for c, n in zip(G.unmorton(F.col("code")), ("ux", "uy", "uz"), strict=True)))


@query(f"WITH {PTS} SELECT cloud_id, vx, vy, vz, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, count(*) AS n FROM cells GROUP BY ALL")
def q_downsample_centroid(spark, d):
    return voxels.downsample(points(spark, d), RES, "cloud_id").withColumns({c: F.round(c, 9) for c in "xyz"})


_LOCAL = f"{PTS}, rel AS (SELECT vx, vy, vz, x - vx * 4 AS a, y - vy * 4 AS b, z - vz * 4 AS c FROM cells)"
_SUMS = "sum(a) AS sx, sum(b) AS sy, sum(c) AS sz, sum(a * a) AS sxx, sum(a * b) AS sxy, sum(a * c) AS sxz, sum(b * b) AS syy, sum(b * c) AS syz, sum(c * c) AS szz"
MOMENTS = f"{_LOCAL}, sums AS (SELECT vx, vy, vz, count(*) AS n, {_SUMS} FROM rel GROUP BY vx, vy, vz)"
_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")
STATS = f"""{MOMENTS}, stats AS (SELECT vx, vy, vz, n, {', '.join(f's{c} / n + v{c} * 4 AS m{c}' for c in 'xyz')},
    {', '.join(f'(s{p} - n * (s{p[0]} / n) * (s{p[1]} / n)) / (n - 1) AS c{p}' for p in _PAIRS)} FROM sums WHERE n >= 6)"""


@query(f"WITH {MOMENTS} SELECT vx, vy, vz, n, {', '.join(f'round(s{p}, 6) AS s{p}' for p in ('x', 'y', 'z', *_PAIRS))} FROM sums")
def q_voxel_moments(spark, d):
    out = voxels.moments(points(spark, d), RES)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("s")})


@query(f"WITH {STATS} SELECT vx, vy, vz, n, {', '.join(f'round(m{c}, 9) AS m{c}' for c in 'xyz')}, {', '.join(f'round(c{p}, 7) AS c{p}' for p in _PAIRS)} FROM stats")
def q_voxel_cov(spark, d):
    out = voxels.means_and_covariances(voxels.moments(points(spark, d), RES), RES)
    return out.withColumns({c: F.round(c, 9 if c[0] == "m" else 7) for c in out.columns if c[0] in "mc"})


#: Eigenvalues of a symmetric 3x3 matrix by the roots of its characteristic polynomial, greatest first, in SQL.
_EIGEN = f"""{STATS}, q AS (SELECT *, (cxx + cyy + czz) / 3 AS q, cxy * cxy + cxz * cxz + cyz * cyz AS off FROM stats),
    p AS (SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * off) / 6) AS p FROM q WHERE q > 0),
    r AS (SELECT *, acos(greatest(-1, least(1, ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * p * p * p)))) / 3 AS phi FROM p),
    e AS (SELECT *, q + 2 * p * cos(phi) AS e1, q + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM r),
    c AS (SELECT *, greatest(3 * q - e1 - e3, 0.01 * e1) AS f2, greatest(e3, 0.01 * e1) AS f3 FROM e)"""


@query(f"WITH {_EIGEN} SELECT vx, vy, vz, n, round(mx, 6) AS mx, round(my, 6) AS my, round(mz, 6) AS mz, round(e1 + f2 + f3, 4) AS trace, round(ln(e1) + ln(f2) + ln(f3), 4) AS log_det, round(1 / e1 + 1 / f2 + 1 / f3, 3) AS inverse_trace, true AS inverts, true AS unit_axis FROM c")
def q_voxel_gaussian(spark, d):
    """What the clamp leaves unchanged under rotation, against eigenvalues in closed form; and that cov inv_cov = 1."""
    from scanloom.config import VoxelConfig

    out = voxels.build_voxels(points(spark, d), VoxelConfig(resolution=RES))
    cov, inv = F.col("cov"), F.col("inv_cov")
    det = cov[0] * (cov[4] * cov[8] - cov[5] * cov[7]) - cov[1] * (cov[3] * cov[8] - cov[5] * cov[6]) + cov[2] * (cov[3] * cov[7] - cov[4] * cov[6])
    product = [sum(cov[3 * i + k] * inv[3 * k + j] for k in range(3)) - (1.0 if i == j else 0.0) for i in range(3) for j in range(3)]
    axis = F.col("axis")
    return out.select(
        *voxels.CELL, "n", *(F.round(F.col("mean")[i], 6).alias(f"m{c}") for i, c in enumerate("xyz")), F.round(cov[0] + cov[4] + cov[8], 4).alias("trace"), F.round(F.log(det), 4).alias("log_det"),
        F.round(inv[0] + inv[4] + inv[8], 3).alias("inverse_trace"), (F.greatest(*map(F.abs, product)) < 1e-6).alias("inverts"), (F.abs(axis[0] * axis[0] + axis[1] * axis[1] + axis[2] * axis[2] - 1) < 1e-9).alias("unit_axis"),
    )


def _occupied(r: int) -> str:
    return f"SELECT {r}::DOUBLE AS resolution, count(*) AS voxels, sum(n)::BIGINT AS points FROM (SELECT count(*) AS n FROM points GROUP BY floor(x / {r}), floor(y / {r}), floor(z / {r}) HAVING count(*) >= 6 AND (min(xi) < max(xi) OR min(yi) < max(yi) OR min(zi) < max(zi)))"


@query(f"WITH {PTS} {_occupied(8)} UNION ALL {_occupied(4)}")
def q_voxel_multi_resolution(spark, d):
    out = voxels.build_multi_resolution(points(spark, d), [8.0, 4.0])
    return out.groupBy("resolution").agg(F.count(F.lit(1)).alias("voxels"), F.sum("n").alias("points"))


@query(f"WITH {PTS} SELECT vx, vy, vz, count(*) AS n, array_to_string(list_sort(list(point_id))[1:5], ',') AS sample FROM cells GROUP BY vx, vy, vz")
def q_voxel_members(spark, d):
    return voxels.members(points(spark, d), RES).withColumn("sample", F.array_join(F.transform("sample", lambda i: i.cast("string")), ","))


@query(f"""WITH {PTS} SELECT cloud_id, {', '.join(f'{f}({c}) AS {f}_{c}' for f in ('min', 'max') for c in 'xyz')}, {', '.join(f'max({c}) - min({c}) AS extent_{c}' for c in 'xyz')} FROM points GROUP BY cloud_id""")
def q_bounds(spark, d):
    return voxels.bounds(points(spark, d), "cloud_id")


@query(f"""WITH {PTS}, coded AS (SELECT point_id, ((vz::BIGINT + 1048576) << 42) | ((vy::BIGINT + 1048576) << 21) | (vx::BIGINT + 1048576) AS code FROM cells)
    SELECT point_id, code, row_number() OVER (ORDER BY code, point_id) - 1 AS position FROM coded""")
def q_radix_order(spark, d):
    coded = voxels.with_cells(points(spark, d), RES).select("point_id", G.pack_key(F.col("vx"), F.col("vy"), F.col("vz")).alias("code"))
    return sorted_positions(coded, "code", "point_id")


POSE = (1.5, -2.0, 0.25, 0.1, -0.2, 0.7)


def rotated_sql(x="x", y="y", z="z", pose=POSE) -> dict[str, str]:
    """The moved coordinates as SQL text."""
    tx, ty, tz, r, p, w = pose
    s = {k: f"{f}({v!r}::DOUBLE)" for k, f, v in (("sr", "sin", r), ("cr", "cos", r), ("sp", "sin", p), ("cp", "cos", p), ("sy", "sin", w), ("cy", "cos", w))}
    m = "{cp}*{cy}*X - {cp}*{sy}*Y + {sp}*Z|({sr}*{sp}*{cy}+{cr}*{sy})*X + ({cr}*{cy}-{sr}*{sp}*{sy})*Y - {sr}*{cp}*Z|({sr}*{sy}-{cr}*{sp}*{cy})*X + ({cr}*{sp}*{sy}+{sr}*{cy})*Y + {cr}*{cp}*Z"
    rows = [row.format(**s).replace("X", x).replace("Y", y).replace("Z", z) for row in m.split("|")]
    return {c: f"({row} + {t})" for c, row, t in zip("xyz", rows, (tx, ty, tz), strict=True)}


_MOVED = rotated_sql()


@query(f"WITH {PTS} SELECT point_id, {', '.join(f'round({v}, 6) AS {c}' for c, v in _MOVED.items())} FROM points")
def q_transform_points(spark, d):
    from scanloom.operators.scoring import under_pose

    return under_pose(points(spark, d), POSE).select("point_id", *(F.round(c, 6).alias(c) for c in "xyz"))


@query(f"WITH {PTS} SELECT point_id, round({_MOVED['z']}, 6) AS z FROM points WHERE {_MOVED['z']} - 3 > 0.8")
def q_no_ground(spark, d):
    from scanloom.operators.scoring import under_pose

    return filters.remove_ground(under_pose(points(spark, d), POSE), 3.0).select("point_id", F.round("z", 6).alias("z"))


TRK = """track AS (SELECT event_id, user_id AS track_id, epoch_us(ts) AS stamp_us, epoch_us(ts) * 1000 AS stamp_ns, event_type, value AS x,
    CAST(json_extract(props, '$.k') AS INTEGER) AS iterations, iterations::DOUBLE AS y, (event_id % 7)::DOUBLE AS z FROM events)"""
_RPY = "x / 200 - 0.7 AS roll, y / 100 - 0.5 AS pitch, z / 3 - 1 AS yaw"
_QUAT = """sin(roll/2)*cos(pitch/2)*cos(yaw/2) - cos(roll/2)*sin(pitch/2)*sin(yaw/2) AS qx, cos(roll/2)*sin(pitch/2)*cos(yaw/2) + sin(roll/2)*cos(pitch/2)*sin(yaw/2) AS qy,
    cos(roll/2)*cos(pitch/2)*sin(yaw/2) - sin(roll/2)*sin(pitch/2)*cos(yaw/2) AS qz, cos(roll/2)*cos(pitch/2)*cos(yaw/2) + sin(roll/2)*sin(pitch/2)*sin(yaw/2) AS qw"""
QUATS = f"{TRK}, angles AS (SELECT *, {_RPY} FROM track), quats AS (SELECT *, {_QUAT} FROM angles)"
Q = ("qx", "qy", "qz", "qw")


def posed_track(spark, d):
    rows = track(spark, d).withColumns({"roll": F.col("x") / 200 - 0.7, "pitch": F.col("y") / 100 - 0.5, "yaw": F.col("z") / 3 - 1})
    return rows.withColumns(dict(zip(Q, G.rpy_to_quaternion("roll", "pitch", "yaw"), strict=True)))


@query(f"""WITH {QUATS} SELECT event_id, {', '.join(f'round({q}, 6) + 0.0 AS {q}' for q in Q)}, round(atan2(2*(qw*qx+qy*qz), 1-2*(qx*qx+qy*qy)), 6) + 0.0 AS roll,
    round(asin(greatest(-1, least(1, 2*(qw*qy-qz*qx)))), 6) + 0.0 AS pitch, round(atan2(2*(qw*qz+qx*qy), 1-2*(qy*qy+qz*qz)), 6) + 0.0 AS yaw FROM quats""")
def q_rpy_quat_roundtrip(spark, d):
    back = dict(zip(("roll", "pitch", "yaw"), G.quaternion_to_rpy(*Q), strict=True))
    return posed_track(spark, d).select("event_id", *((F.round(q, 6) + 0.0).alias(q) for q in Q), *((F.round(v, 6) + 0.0).alias(k) for k, v in back.items()))


_REL = """rel AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(z) OVER w AS z0, lag(qx) OVER w AS ax, lag(qy) OVER w AS ay, lag(qz) OVER w AS az, lag(qw) OVER w AS aw
    FROM quats WINDOW w AS (PARTITION BY track_id ORDER BY stamp_ns, event_id)),
  turn AS (SELECT *, -qw*ax + qx*aw - qy*az + qz*ay AS rx, -qw*ay + qx*az + qy*aw - qz*ax AS ry, -qw*az - qx*ay + qy*ax + qz*aw AS rz, qw*aw + qx*ax + qy*ay + qz*az AS rw FROM rel WHERE x0 IS NOT NULL)"""


@query(f"""WITH {QUATS}, {_REL} SELECT event_id, round(x - ((1-2*(ry*ry+rz*rz))*x0 + 2*(rx*ry-rz*rw)*y0 + 2*(rx*rz+ry*rw)*z0), 5) AS dx,
    round(y - (2*(rx*ry+rz*rw)*x0 + (1-2*(rx*rx+rz*rz))*y0 + 2*(ry*rz-rx*rw)*z0), 5) AS dy, round(z - (2*(rx*rz-ry*rw)*x0 + 2*(ry*rz+rx*rw)*y0 + (1-2*(rx*rx+ry*ry))*z0), 5) AS dz,
    round(2 * acos(least(1, abs(rw))), 5) AS angle FROM turn""")
def q_relative_pose(spark, d):
    rows = posed_track(spark, d)
    w = Window.partitionBy("track_id").orderBy("stamp_ns", "event_id")
    before = {f"p{c}": F.lag(c).over(w) for c in ("x", "y", "z", *Q)}
    rows = rows.withColumns(before).where("px is not null")
    shift, _ = G.relative_pose((("x", "y", "z"), Q), (("px", "py", "pz"), tuple(f"p{q}" for q in Q)))
    angle = G.quaternion_angle(Q, tuple(f"p{q}" for q in Q))
    return rows.select("event_id", *(F.round(s, 5).alias(f"d{c}") for s, c in zip(shift, "xyz", strict=True)), F.round(angle, 5).alias("angle"))


@query(f"WITH {TRK} SELECT event_id, round(x / 10 - floor((x / 10 + pi()) / (2 * pi())) * (2 * pi()), 6) AS wrapped FROM track")
def q_wrap_angle(spark, d):
    return track(spark, d).select("event_id", F.round(G.wrap_angle(F.col("x") / 10), 6).alias("wrapped"))


@query("""WITH p AS (SELECT p_partkey, (p_partkey * 7 % 360)::DOUBLE AS h, (p_size % 11) / 10 AS s, (p_partkey % 21) / 20 AS v FROM part)
    SELECT p_partkey, round(v - v*s*greatest(0, least((h/60+5) % 6, 4 - (h/60+5) % 6, 1)), 6) AS r, round(v - v*s*greatest(0, least((h/60+3) % 6, 4 - (h/60+3) % 6, 1)), 6) AS g,
    round(v - v*s*greatest(0, least((h/60+1) % 6, 4 - (h/60+1) % 6, 1)), 6) AS b FROM p""")
def q_hsv(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_partkey") * 7 % 360).cast("double").alias("h"), ((F.col("p_size") % 11) / 10).alias("s"), ((F.col("p_partkey") % 21) / 20).alias("v"))
    return parts.select("p_partkey", *(F.round(c, 6).alias(n) for c, n in zip(G.hsv_to_rgb("h", "s", "v"), "rgb", strict=True)))


@query(f"WITH {TRK} SELECT event_id, CAST(stamp_ns // 1000000000 AS INTEGER) AS sec, CAST(stamp_ns % 1000000000 AS INTEGER) AS nanosec, stamp_ns FROM track")
def q_stamps(spark, d):
    sec, nanosec = G.ns_to_stamp("stamp_ns")
    return track(spark, d).select("event_id", sec.alias("sec"), nanosec.alias("nanosec")).withColumn("stamp_ns", G.stamp_to_ns("sec", "nanosec"))


@query("""SELECT p_partkey % 18 AS z, count(*) AS n FROM part GROUP BY 1""")
def q_scan_layers(spark, d):
    return scan(spark, d).groupBy(F.col("z").cast("long").alias("z")).agg(F.count(F.lit(1)).alias("n"))
