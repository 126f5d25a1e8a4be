"""The continuous scan matcher: filter, range check, align, gate, publish, diagnose.

Voxels are a versioned table: a new map is built beside the one in use and
takes over between two batches, as one swap of the version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from scanloom.config import EngineConfig
from scanloom.operators.estimation import with_covariance
from scanloom.operators.filters import drop_non_finite, filter_points, publish_gate, scans_in_range
from scanloom.operators.registration import align_batch
from scanloom.operators.scan_pipeline import match_scans


@dataclass
class VersionedMap:
    """The voxels in use and a map being prepared; a failed build leaves the one in use."""

    voxels: DataFrame | None = None
    version: int = 0
    pending: Callable[[], DataFrame] | None = None
    failures: list[str] = field(default_factory=list)

    def prepare(self, build: Callable[[], DataFrame]) -> None:
        """Ask for a new map; an earlier request that hasn't begun is replaced."""
        self.pending = build

    def swap_if_ready(self) -> bool:
        build, self.pending = self.pending, None
        if build is None:
            return False
        try:
            fresh = build().persist()
            fresh.count()
        except Exception as problem:  # noqa: BLE001 - the running map must survive any failed build
            self.failures.append(str(problem)[:500])
            return False
        if self.voxels is not None:
            self.voxels.unpersist()
        self.voxels, self.version = fresh, self.version + 1
        return True


def match_batch(points: DataFrame, poses: DataFrame, voxels: DataFrame, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(alignments with ``published`` and covariance, scans refused for their range)."""
    clean = filter_points(drop_non_finite(points), config.filter)
    reach = scans_in_range(clean, "scan_id", config.filter.required_distance)
    accepted = clean.join(reach.where("accepted").select("scan_id"), "scan_id", "left_semi")
    wanted = poses.join(reach.where("accepted").select("scan_id"), "scan_id", "left_semi")
    found = publish_gate(align_batch(accepted, wanted, voxels, "scan_id", config.match, config.line_search), config.gate)
    return with_covariance(found, accepted, voxels, config), reach.where("not accepted")


#: Conditions of a scan in the order in which they are looked at, with level and message.
CONDITIONS = (
    ("is_activated", "warn", "NDT is not activated"),
    ("is_set_map_points", "warn", "Map points not set"),
    ("is_succeed_interpolate_initial_pose", "warn", "Failed to interpolate initial pose"),
    ("is_succeed_transform_sensor_points", "error", "Failed to transform sensor points"),
)
#: Names of the values in a diagnostics map, and the columns they come from.
VALUES = {
    "iteration_num": "iterations", "local_optimal_solution_oscillation_num": "oscillation",
    "transform_probability": "tp_pairs", "nearest_voxel_transformation_likelihood": "nvtl",
}


def diagnostics(alignments: DataFrame, config: EngineConfig) -> DataFrame:
    """scan_id, level, message and a map of named values, numbers to six digits.

    Conditions that are columns of ``alignments`` are judged; absent ones hold.
    """
    level, message = F.lit("ok"), F.lit("OK")
    wild = F.col("oscillation") > config.gate.max_oscillation
    level = F.when(wild, "warn").otherwise(level)
    message = F.when(wild, F.concat(F.lit("Oscillation detected: "), F.col("oscillation").cast("string"), F.lit(" reversals"))).otherwise(message)
    present = [c for c in CONDITIONS if c[0] in alignments.columns]
    for name, worse, text in reversed(present):
        level, message = F.when(~F.col(name), worse).otherwise(level), F.when(~F.col(name), text).otherwise(message)
    shown = {n: F.format_string("%.6f", c) if alignments.schema[c].dataType.simpleString() == "double" else F.col(c).cast("string") for n, c in VALUES.items()}
    shown |= {"status": F.col("status"), **{c[0]: F.col(c[0]).cast("string") for c in present}}
    values: list[Column] = [x for n, v in shown.items() for x in (F.lit(n), v)]
    return alignments.select("scan_id", level.alias("level"), message.alias("message"), F.create_map(*values).alias("values"))


def run_matcher(scans: DataFrame, map_: VersionedMap, pose_of: Callable[[DataFrame], DataFrame], publish: Callable[[str, DataFrame, int], None], checkpoint: str, config: EngineConfig = EngineConfig(), **trigger) -> StreamingQuery:
    """``scans``: a stream of points with scan_id.  ``pose_of`` gives the initial poses of a batch's scans;
    ``publish`` gets a name (alignments, refused, diagnostics), rows and the batch's number."""

    def each(batch: DataFrame, number: int) -> None:
        map_.swap_if_ready()
        if map_.voxels is None or batch.isEmpty():
            return
        batch.persist()
        found, refused = match_batch(batch, pose_of(batch), map_.voxels, config)
        found = found.withColumn("map_version", F.lit(map_.version)).persist()
        publish("alignments", found, number)
        publish("refused", refused, number)
        publish("diagnostics", diagnostics(found, config), number)
        found.unpersist()
        batch.unpersist()

    return scans.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_scans(messages: DataFrame, map_: VersionedMap, poses: Callable[[], DataFrame], transforms: Callable[[], DataFrame], publish: Callable[[str, DataFrame, int], None], checkpoint: str, config: EngineConfig = EngineConfig(), gnss: Callable[[], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """``messages``: a stream of point cloud messages with vehicle, scan_id, frame and stamp_ns.

    Each batch keeps every vehicle's latest scans (the queue's depth) and goes the
    whole way of ``scan_pipeline.match_scans``, whose tables are published by name,
    with ``diagnostics`` of every message and ``shed`` counters.  ``poses``,
    ``transforms`` and ``gnss`` give the tables as they are when a batch begins.
    """

    def each(batch: DataFrame, number: int) -> None:
        map_.swap_if_ready()
        if map_.voxels is None or batch.isEmpty():
            return
        newest = F.row_number().over(Window.partitionBy("vehicle").orderBy(F.col("stamp_ns").desc(), F.col("scan_id").desc()))
        judged = batch.withColumn("fate", F.when(newest > config.queue.depth, "dropped_overflow").otherwise("processed")).persist()
        out = match_scans(judged.where("fate = 'processed'").drop("fate"), poses(), transforms(), map_.voxels, config, gnss() if gnss else None)
        for name, rows in out.items():
            publish(name, rows, number)
        publish("diagnostics", diagnostics(out["reports"], config), number)
        publish("shed", judged.groupBy("fate").agg(F.count(F.lit(1)).alias("n")), number)
        judged.unpersist()

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def score_windows(alignments: DataFrame, watermark: str = "10 seconds", window: str = "1 minute") -> DataFrame:
    """Count, mean and least score of every event-time window, late rows beyond the watermark dropped."""
    w = F.window("ts", window)
    return alignments.withWatermark("ts", watermark).groupBy(w.alias("window"), "vehicle").agg(F.count(F.lit(1)).alias("n"), F.avg("nvtl").alias("mean_nvtl"), F.min("nvtl").alias("min_nvtl"))
