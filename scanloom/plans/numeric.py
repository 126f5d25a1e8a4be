"""Queries over the numeric kernels and the message formats, a row each, beside SQL in closed form or by differences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.functions import geometry as G
from scanloom.functions import kernels as K
from scanloom.operators import covariance as C
from scanloom.plans.points import TRK
from scanloom.plans.registry import query
from scanloom.sources import bag, pointcloud
from scanloom.sources.adapters import points, track

#: part as numbers: id, and four values of moderate size.
_NUM = "num AS (SELECT p_partkey AS id, p_size / 10 AS a, (p_partkey % 23 - 11) / 7 AS b, (p_partkey % 17 - 8) / 5 AS c, (p_partkey % 13 + 1) / 4 AS d FROM part)"


def numbers(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), (F.col("p_size") / 10).alias("a"), ((k % 23 - 11) / 7).alias("b"), ((k % 17 - 8) / 5).alias("c"), ((k % 13 + 1) / 4).alias("d"))


def per_row(rows: DataFrame, f: Callable[..., tuple], names: str, kinds: str = "") -> DataFrame:
    """id and the values of a kernel of a, b, c, d, a row at a time; rounded to six digits."""

    def rowwise(*columns: np.ndarray) -> tuple:
        return tuple(zip(*(f(*v) for v in zip(*(c.tolist() for c in columns), strict=True)), strict=True))

    return per_batch(rows, rowwise, names, kinds)


def per_batch(rows: DataFrame, f: Callable[..., tuple], names: str, kinds: str = "") -> DataFrame:
    """id and the values of a kernel of columns a, b, c, d, in Arrow batches; rounded to six digits.

    The rows are dealt anew: a small file would be a single task.
    """
    out = names.split()
    kinds_ = (kinds or "double " * len(out)).split()
    types = {"double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = f(*(np.asarray(batch.column(c), dtype=float) for c in "abcd"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(np.asarray(c), types[k]) for c, k in zip(columns, kinds_, strict=True))], names=["id", *out])

    made = rows.repartition("id").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in zip(out, kinds_, strict=True)))
    return made.select("id", *((F.round(n, 6) + 0.0).alias(n) if k == "double" else F.col(n) for n, k in zip(out, kinds_, strict=True)))


def _r(sql: str, name: str, digits: int = 6) -> str:
    return f"round(({sql})::DOUBLE, {digits}) + 0.0 AS {name}"


@query(f"WITH {_NUM} SELECT id, {', '.join(_r(f'{p} + 0.5 * {q}', n) for p, q, n in zip('abcdab', 'dcbada', ('tx', 'ty', 'tz', 'roll', 'pitch', 'yaw'), strict=True))} FROM num")
def q_pose_add(spark, d):
    out = numbers(spark, d).withColumn("sum", G.add_pose(F.array(*"abcdab"), F.array(*"dcbada"), 0.5))
    return out.select("id", *((F.round(F.col("sum")[i], 6) + 0.0).alias(n) for i, n in enumerate(("tx", "ty", "tz", "roll", "pitch", "yaw"))))


def _byte(v: str) -> str:
    return f"CAST(floor(greatest(0, least(1, {v})) * 255) AS INTEGER)"


@query(f"WITH {_NUM} SELECT id, ({_byte('b')} << 16) | ({_byte('c')} << 8) | {_byte('d / 4')} AS rgb FROM num")
def q_pack_rgb(spark, d):
    return numbers(spark, d).select("id", G.pack_rgb(F.col("b"), F.col("c"), F.col("d") / 4).alias("rgb"))


@query(f"""WITH {_NUM}, t AS (SELECT *, (2.0 - b) * sin(c) + (1.0 - a) * cos(c) AS along FROM num)
    SELECT id, {_r('-0.01 * 7 * along * along', 'score')}, {_r('0.14 * along * cos(c)', 'gx')}, {_r('0.14 * along * sin(c)', 'gy')}, {_r('-0.14 * cos(c) * cos(c)', 'hxx')}, {_r('-0.14 * cos(c) * sin(c)', 'hxy')} FROM t""")
def q_gnss_term(spark, d):
    def term(a, b, c, _):
        score, gradient, hessian = K.gnss_term(np.array([a, b, 0, 0, 0, c]), (1.0, 2.0), 0.01, 7)
        return score, gradient[0], gradient[1], hessian[0, 0], hessian[0, 1]

    return per_row(numbers(spark, d), term, "score gx gy hxx hxy")


def _block(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """A stack of 6x6 matrices: a block of x and y, and a diagonal."""
    out = np.zeros((len(a), 6, 6))
    for i, v in enumerate((-(a + d + 2.1), -(d + 2.3), -1.1 * d, -2 * d, -3.0, -1.0)):
        out[:, i, i] = v
    out[:, 0, 1] = out[:, 1, 0] = b
    return out


@query(f"""WITH {_NUM}, h AS (SELECT *, -(a + d + 2.1) AS p, -(d + 2.3) AS r FROM num), e AS (SELECT *, p * r - b * b AS det, (p + r) / 2 AS m, sqrt((p - r) * (p - r) / 4 + b * b) AS s FROM h)
    SELECT id, {_r('-(r * c - b * 1) / det', 's0')}, {_r('-(p * 1 - b * c) / det', 's1')}, {_r('b / (1.1 * d)', 's2')}, {_r('a / (2 * d)', 's3')}, {_r('1 / 3', 's4')}, {_r('d', 's5')}, m + s < 0 AS negative,
    {_r('greatest(abs(m - s), abs(m + s), 3, 2 * d) / least(abs(m - s), abs(m + s), 1, 1.1 * d)', 'condition')}, {_r('(abs(r) * c + b * 1) / det', 'c0')} FROM e""")
def q_newton_step(spark, d):
    """Steps towards a maximum, by singular values; of minus the matrix by a Cholesky factor; definiteness and condition."""

    def step(a, b, c, d_):
        one = np.ones(len(a))
        hessian, gradient = _block(a, b, d_), np.stack([c, one, b, a, one, d_], axis=1)
        up = K.newton_step_ascent(gradient, hessian)
        same = K.newton_step_cholesky(-gradient, -hessian)
        return (*up.T, K.is_negative_definite(hessian) & K.is_positive_definite(-hessian), K.condition_number(hessian), same[:, 0])

    return per_batch(numbers(spark, d), step, "s0 s1 s2 s3 s4 s5 negative condition c0", "double double double double double double boolean double double")


@query(f"""WITH {_NUM}, f AS (SELECT id, d AS slope, a / 4 AS step, a * b / 4 AS phi, c AS now FROM num)
    SELECT id, phi >= 1e-4 * step * slope AS enough, abs(now) <= 0.9 * abs(slope) AS flat, phi >= 1e-4 * step * slope AND abs(now) <= 0.9 * abs(slope) AS wolfe,
    CASE WHEN phi >= 1e-4 * step * slope AND abs(now) <= 0.9 * abs(slope) THEN step WHEN 2 * step * slope >= 1e-4 * 2 * step * slope AND abs(slope) <= 0.9 * abs(slope) THEN 2 * step ELSE 2 * step END AS chosen FROM f""")
def q_line_search_rules(spark, d):
    """The conditions of a step, and the choice among two steps whose second has enough increase but no flatness."""

    def rules(a, b, c, d_):
        step, phi = a / 4, a * b / 4
        chosen = K.choose_candidate(np.array([step, 2 * step]), np.array([phi, max(phi, 0) + 2 * step * d_]), np.array([c, d_]), 0.0, d_)
        return K.armijo(0.0, phi, d_, step), K.curvature(d_, c), K.strong_wolfe(0.0, d_, phi, c, step), chosen

    return per_row(numbers(spark, d), rules, "enough flat wolfe chosen", "boolean boolean boolean double")


@query(f"WITH {_NUM} SELECT id, true AS enough, true AS flat, true AS inside FROM num")
def q_more_thuente(spark, d):
    """On the parabola -(x - m)^2 the step found meets both conditions, from any first step."""
    from scanloom.config import LineSearchConfig

    config = LineSearchConfig(step_max=10.0, max_iterations=30)

    def found(a, b, c, d_):
        top = d_
        f = lambda x: (-((x - top) ** 2), -2 * (x - top))
        step = K.more_thuente(f, f(0)[0], f(0)[1], 0.01 + a, config)
        value, slope = f(step)
        return K.armijo(f(0)[0], value, f(0)[1], step), K.curvature(f(0)[1], slope), 0 < step <= 10.0

    return per_row(numbers(spark, d), found, "enough flat inside", "boolean boolean boolean")


_ANGLES = ("(a / 9)", "(b / 5)", "(d / 3)")


def _moved(orders: tuple[int, int, int]) -> list[str]:
    """Rx Ry Rz of the point (1 + a, b, c), derived so often by each angle, as SQL: turns about z, then y, then x."""
    cos = lambda k: [f"cos({_ANGLES[k]})", f"-sin({_ANGLES[k]})", f"-cos({_ANGLES[k]})"][orders[k]]
    sin = lambda k: [f"sin({_ANGLES[k]})", f"cos({_ANGLES[k]})", f"-sin({_ANGLES[k]})"][orders[k]]
    rest = lambda k, v: v if orders[k] == 0 else "0"
    x, y, z = "(1 + a)", "b", "c"
    x, y, z = f"({x} * ({cos(2)}) - {y} * ({sin(2)}))", f"({x} * ({sin(2)}) + {y} * ({cos(2)}))", rest(2, z)
    x, z, y = f"({x} * ({cos(1)}) + {z} * ({sin(1)}))", f"({z} * ({cos(1)}) - {x} * ({sin(1)}))", rest(1, y)
    y, z, x = f"({y} * ({cos(0)}) - {z} * ({sin(0)}))", f"({y} * ({sin(0)}) + {z} * ({cos(0)}))", rest(0, x)
    return [x, y, z]


#: Names of the derivatives by roll, pitch and yaw, first and second, and how often each angle is derived by.
_ORDERS = {"r": (1, 0, 0), "p": (0, 1, 0), "w": (0, 0, 1), "rr": (2, 0, 0), "rp": (1, 1, 0), "rw": (1, 0, 1), "pp": (0, 2, 0), "pw": (0, 1, 1), "ww": (0, 0, 2)}


def _slopes() -> str:
    return ", ".join(_r(v, f"{c}_{n}") for n, orders in _ORDERS.items() for c, v in zip("xyz", _moved(orders), strict=True))


@query(f"WITH {_NUM} SELECT id, {_slopes()} FROM num")
def q_point_derivatives(spark, d):
    """First and second derivatives of a moved point by the angles, against the turns derived one after the other."""

    def slopes(a, b, c, d_):
        none = np.zeros(len(a))
        jacobian, curve = K.point_derivatives(np.stack([1 + a, b, c], axis=1), np.stack([none, none, none, a / 9, b / 5, d_ / 3], axis=1))
        first = [jacobian[:, :, 3 + k] for k in range(3)]
        return tuple(v for column in (*first, *(curve[:, :, i, j] for i in range(3) for j in range(i, 3))) for v in column.T)

    return per_batch(numbers(spark, d), slopes, " ".join(f"{c}_{n}" for n in _ORDERS for c in "xyz"))


@query(f"""WITH {_NUM} SELECT id, {_r('greatest(3 * (a * cos(c) * cos(c) - 2 * cos(c) * sin(c) * b + d * sin(c) * sin(c)), 0.5)', 'cxx', 5)},
    {_r('3 * (cos(c) * sin(c) * (a - d) + (cos(c) * cos(c) - sin(c) * sin(c)) * b)', 'cxy', 5)}, {_r('greatest(3 * (a * sin(c) * sin(c) + 2 * cos(c) * sin(c) * b + d * cos(c) * cos(c)), 0.25)', 'cyy', 5)} FROM num""")
def q_rotate_scale_covariance(spark, d):
    """A covariance turned about z, scaled and floored; the 6x6 form agrees (tests)."""
    turned = C.rotate_xy(F.col("a"), F.col("b"), F.col("d"), F.col("c"))
    out = C.scale_and_floor(*turned, 3.0, (0.5, 0.25))
    return numbers(spark, d).select("id", *((F.round(v, 5) + 0.0).alias(n) for n, v in zip(("cxx", "cxy", "cyy"), out, strict=True)))


@query("""WITH p AS (SELECT l_linenumber AS cloud_id, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS point_id, CAST(round(l_quantity * 1000) AS BIGINT) AS xi, CAST(round(l_extendedprice) AS BIGINT) AS yi,
    CAST(round((l_discount + l_tax) * 100000) AS BIGINT) AS zi, CAST(xi / 1000 AS FLOAT) AS x, CAST(yi / 1000 AS FLOAT) AS y, CAST(zi / 1000 AS FLOAT) AS z FROM lineitem)
    SELECT cloud_id, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id, xi, yi, zi) - 1 AS point_id, x, y, z FROM p""")
def q_point_cloud_messages(spark, d):
    """Every cloud as one binary message with colours, read back."""
    place = F.row_number().over(Window.partitionBy("cloud_id").orderBy("point_id", "xi", "yi", "zi"))  # some ids repeat
    messages = pointcloud.encode(points(spark, d).withColumns({"place": place, "rgb": F.col("cloud_id").cast("int")}), "cloud_id", "place", rgb="rgb")
    return pointcloud.decode(messages, "cloud_id")


@query(f"WITH {TRK} SELECT event_id::VARCHAR AS topic, stamp_ns + 1500000000 AS stamp_ns, 'map' || event_id % 12 AS frame, x, y, z, event_id % 2 = 0 AS with_covariance FROM track")
def q_pose_messages(spark, d):
    """Every event as a stamped pose message, half of them with covariance, stamped anew and read back."""

    def run(batches):
        for batch in (b.slice(at, bag.AT_ONCE) for b in batches for at in range(0, b.num_rows, bag.AT_ONCE)):
            rows = batch.to_pylist()
            data = [bag.encode_pose(r["stamp_ns"], f"map{r['event_id'] % 12}", (r["x"], r["y"], r["z"], 0.0, 0.0, 0.0, 1.0), [float(i) for i in range(36)] if r["event_id"] % 2 == 0 else None) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([str(r["event_id"]) for r in rows], pa.string()), batch.column("stamp_ns"), pa.array(data, pa.binary())], names=["topic", "stamp_ns", "data"])

    messages = track(spark, d).select("event_id", "stamp_ns", "x", "y", "z").mapInArrow(run, "topic string, stamp_ns long, data binary")
    moved = bag.restamped(messages.withColumn("late", F.col("stamp_ns") + 1_500_000_000), "late")
    return bag.poses(moved).select("topic", "stamp_ns", "frame", "x", "y", "z", (F.col("covariance")[35] == 35).alias("c")).select("topic", "stamp_ns", "frame", "x", "y", "z", F.coalesce("c", F.lit(False)).alias("with_covariance"))


@query(f"WITH {TRK} SELECT event_id::VARCHAR AS topic, stamp_ns, iterations - 50 AS value FROM track")
def q_integer_messages(spark, d):
    """Iteration counts as stamped integers, read in expressions."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            data = [bag.encode_integer(r["stamp_ns"], r["iterations"] - 50) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([str(r["event_id"]) for r in rows], pa.string()), pa.array([0] * len(rows), pa.int64()), pa.array(data, pa.binary())], names=["topic", "stamp_ns", "data"])

    return bag.integers(track(spark, d).select("event_id", "stamp_ns", "iterations").mapInArrow(run, "topic string, stamp_ns long, data binary"))


@query("""WITH g AS (SELECT i % 51 AS u, i // 51 AS v FROM range(51 * 51) t(i)), f AS (SELECT u, v, 0 AS w FROM g UNION ALL SELECT 0, u, v FROM g UNION ALL SELECT u, 0, v FROM g)
    SELECT count(*) AS points, sum(u)::BIGINT AS x, sum(v)::BIGINT AS y, sum(w)::BIGINT AS z, count(DISTINCT (u, v, w)) AS places FROM f""")
def q_half_cube(spark, d):
    """Three faces of a cube of 10 m with a point every 20 cm, in steps."""
    from scanloom.sources import generators

    cube = generators.half_cube(spark, 10.0, 0.2)
    steps = [F.round(F.col(c).cast("double") / 0.2).cast("long").alias(c) for c in "xyz"]
    return cube.select(*steps).agg(F.count(F.lit(1)).alias("points"), *(F.sum(c).alias(c) for c in "xyz"), F.count_distinct("x", "y", "z").alias("places"))


