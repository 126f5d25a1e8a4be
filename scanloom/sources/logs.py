"""JSON logs and voxel dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.geometry import cells
from scanloom.operators.voxels import gaussians

ITERATION = (
    "iteration:long,pose:array<double>,score:double,nvtl:double,gradient:array<double>,newton_step_norm:double,direction_reversed:boolean,"
    "step_length:double,num_correspondences:long"
)
ALIGNMENT = (
    f"timestamp_ns long, exe_time_ms double, initial_pose array<double>, final_pose array<double>, num_source_points long, iterations array<struct<{ITERATION}>>, "
    "convergence_status string, total_iterations long, final_score double, final_nvtl double, oscillation_count long, num_correspondences long, type string, _corrupt_record string"
)
INIT = (
    "type string, total_time_ms double, startup_time_ms double, guided_time_ms double, num_particles long, num_startup long, best_score_trajectory array<double>, "
    "per_particle_time_ms array<double>, final_score double, final_iterations int, reliable boolean, final_pose array<double>, _corrupt_record string"
)
VOXELS = "resolution float, num_voxels long, voxels array<struct<mean:array<double>,cov:array<array<double>>,inv_cov:array<array<double>>,point_count:long>>"


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records; lines that don't parse and other records are left out."""
    rows = spark.read.schema(ALIGNMENT).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & F.col("timestamp_ns").isNotNull()).drop("_corrupt_record", "type")


def read_inits(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(INIT).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & (F.col("type") == "init")).drop("_corrupt_record")


def iterations(alignments: DataFrame) -> DataFrame:
    """One row for every iteration, with its scan."""
    return alignments.select("timestamp_ns", F.posexplode("iterations").alias("at", "i")).select("timestamp_ns", "at", "i.*")


def append_json(rows: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    rows.write.mode("append").json(path)


def write_voxels(voxels: DataFrame, path: str, resolution: float) -> None:
    """Voxels as JSON lines, one voxel each, covariances to eight digits."""
    matrix = lambda c: F.array(*(F.transform(F.slice(c, 3 * i + 1, 3), lambda v: F.round(v, 8)) for i in range(3)))
    voxels.select(F.lit(float(resolution)).alias("resolution"), "mean", matrix("cov").alias("cov"), matrix("inv_cov").alias("inv_cov"), F.col("n").alias("point_count")).write.mode("overwrite").json(path)


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    """Voxels of a dump, either one document with a list or one voxel a line; the axis is found again from the covariance."""
    line = "resolution float, mean array<double>, cov array<array<double>>, inv_cov array<array<double>>, point_count long"
    whole = spark.read.schema(VOXELS).option("multiLine", True).json(path).where("voxels is not null").select("resolution", F.explode("voxels").alias("v")).select("resolution", "v.*")
    lines = spark.read.schema(line).json(path).where("mean is not null")
    rows = whole.select("resolution", "mean", "cov", F.col("point_count").alias("n")).unionByName(lines.select("resolution", "mean", "cov", F.col("point_count").alias("n")))
    vx, vy, vz = (F.floor(F.col("mean")[i] / F.col("resolution")).cast("int") for i in range(3))
    flat = rows.select(vx.alias("vx"), vy.alias("vy"), vz.alias("vz"), "n", *(F.col("mean")[i].alias(f"m{c}") for i, c in enumerate("xyz")), *(F.col("cov")[i][j].alias(f"c{a}{b}") for i, a in enumerate("xyz") for j, b in enumerate("xyz") if i <= j))
    return gaussians(flat)


def assignment_report(members: DataFrame, path: str) -> None:
    """Cells with counts and sample points, in the order of cells."""
    members.write.mode("overwrite").json(path)
