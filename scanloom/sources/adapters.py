"""The relational test tables seen as points, scans, poses, topics and tiles.

Every mapping is deterministic.  Coordinates are whole millimetres before they
become doubles, so that sums of them don't depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import geometry as G


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: quantity, price and discount + tax as x, y, z (metres); the line number as the cloud."""
    key = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    mm = {"xi": F.round(F.col("l_quantity") * 1000), "yi": F.round(F.col("l_extendedprice")), "zi": F.round((F.col("l_discount") + F.col("l_tax")) * 100000)}
    out = _table(spark, sf_dir, "lineitem").select(key.alias("point_id"), F.col("l_linenumber").alias("cloud_id"), *(v.cast("long").alias(k) for k, v in mm.items()))
    return out.select("point_id", "cloud_id", "xi", "yi", "zi", *((F.col(f"{c}i") / 1000).alias(c) for c in "xyz"))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part: size, price and key as a second cloud."""
    mm = {"xi": F.col("p_size") * 1000, "yi": F.round((F.col("p_retailprice") - 900) * 1000) % 100000, "zi": (F.col("p_partkey") % 18) * 1000}
    out = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), (F.col("p_partkey") % 5).cast("int").alias("scan_id"), *(v.cast("long").alias(k) for k, v in mm.items()))
    return out.select("point_id", "scan_id", *((F.col(f"{c}i") / 1000).alias(c) for c in "xyz"))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: users as tracks, values as positions."""
    n = F.get_json_object("props", "$.k").cast("int")
    return _table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("track_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("stamp_us"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("stamp_ns"),
        "event_type", F.col("value").alias("x"), n.cast("double").alias("y"), (F.col("event_id") % 7).cast("double").alias("z"), n.alias("iterations"),
    )


#: Scans of the room: how many, and of each part of scan k's pose in the map m, s and d of (k mod m - s) / d.
ROOM_SCANS = 12
ROOM_POSE = {"tx": (5, 2, 10), "ty": (3, 1, 10), "tz": (4, 1, 10), "roll": (2, 0, 50), "pitch": (3, 1, 50), "yaw": (7, 3, 50)}


def room(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> DataFrame:
    """lineitem, or part, as points of a room's floor and two walls, ten centimetres thick: point_id, x, y, z and the scan each belongs to."""
    if name == "lineitem":
        a, b, c = F.col("l_partkey") * 37 + F.col("l_orderkey") * 11, F.col("l_suppkey") * 53 + F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131, F.col("l_orderkey")
        point, face, scan_ = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey"), F.col("l_linenumber") % 3, F.col("l_suppkey")
    else:
        a, b, c, point, face, scan_ = F.col("p_partkey") * 37, F.col("p_partkey") * 59 + F.col("p_size") * 7, F.col("p_size"), F.col("p_partkey"), F.col("p_partkey") % 3, F.col("p_size") % 2
    u, v, w, thick = (a % 1000) / 100 + 1, (b % 1000) / 100 + 1, (b % 500) / 100 + 1, (c % 11 - 5) / 100 + 1
    place = {"x": F.when(face == 2, thick).otherwise(u), "y": F.when(face == 1, thick).when(face == 2, u).otherwise(v), "z": F.when(face == 0, thick).otherwise(w)}
    out = _table(spark, sf_dir, name).select(point.alias("point_id"), (scan_ % ROOM_SCANS).cast("int").alias("scan_id"), *(p.alias(n) for n, p in place.items()))
    return out.where("point_id is not null")


def room_pose(scan: Column) -> dict[str, Column]:
    """The pose of a scan in the map."""
    return {n: (scan % m - less) / part for n, (m, less, part) in ROOM_POSE.items()}


def room_scans(spark: SparkSession, sf_dir: str, name: str = "lineitem", one: int | None = None) -> DataFrame:
    """Every point of the room as its scan's sensor saw it: moved by the inverse of the scan's pose (or all by that of scan ``one``)."""
    pose = room_pose(F.col("scan_id") if one is None else F.lit(one))
    turn = G.rotation_xyz(pose["roll"], pose["pitch"], pose["yaw"])
    back = [[turn[j][i] for j in range(3)] for i in range(3)]
    x, y, z = G.apply_rigid(back, [F.col(c) - pose[f"t{c}"] for c in "xyz"], (F.lit(0.0),) * 3)
    return room(spark, sf_dir, name).select("point_id", "scan_id", x.alias("x"), y.alias("y"), z.alias("z"))
