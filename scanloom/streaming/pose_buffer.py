"""Pose interpolation over two live streams.

``PoseBuffer`` is the state of one vehicle as plain Python, so its rules can be
tested without Spark; ``interpolate_stream`` keeps one for every vehicle with
``applyInPandasWithState``.  A scan waits until a pose at or after it arrives,
or until the event-time watermark passes it by the timeout.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scanloom.config import PoseBufferConfig

Pose = tuple[int, float, float, float, float, float, float, float]  # stamp, position, quaternion


def slerp(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    dot = float(a @ b)
    b, dot = (-b, -dot) if dot < 0 else (b, dot)
    if dot > 0.9999999:
        out = a + t * (b - a)
        return out / np.linalg.norm(out)
    angle = np.arccos(min(dot, 1.0))
    return (np.sin((1 - t) * angle) * a + np.sin(t * angle) * b) / np.sin(angle)


@dataclass
class PoseBuffer:
    """Poses in the order of their stamps."""

    config: PoseBufferConfig = field(default_factory=PoseBufferConfig)
    reset_on_reversal: bool = False
    poses: list[Pose] = field(default_factory=list)

    def push(self, pose: Pose) -> None:
        """Append; a stamp before the last one clears the buffer first, or is sorted in."""
        if self.poses and pose[0] < self.poses[-1][0]:
            if self.reset_on_reversal:
                self.poses.clear()
            else:
                at = next(i for i, p in enumerate(self.poses) if p[0] > pose[0])
                self.poses.insert(at, pose)
                return
        self.poses.append(pose)

    def drop_before(self, stamp: int) -> None:
        """Forget poses older than the stamp, all but one."""
        while len(self.poses) > 1 and self.poses[1][0] <= stamp:
            self.poses.pop(0)

    def clear(self) -> None:
        self.poses.clear()

    def latest(self) -> Pose | None:
        return self.poses[-1] if self.poses else None

    def covers(self, stamp: int) -> bool:
        return bool(self.poses) and self.poses[-1][0] >= stamp

    def at(self, stamp: int) -> Pose | None:
        """The pose at a stamp, by the rules of the batch join."""
        if len(self.poses) < 2 or stamp < self.poses[0][0]:
            return None
        i = max(k for k, p in enumerate(self.poses) if p[0] <= stamp)
        while i and self.poses[i - 1][0] == self.poses[i][0]:
            i -= 1  # of equal stamps the first
        old = self.poses[i]
        new = next((p for p in self.poses if p[0] > stamp), old)
        limit = self.config.timeout_sec * 1e9
        jump = np.linalg.norm(np.subtract(new[1:4], old[1:4]))
        if abs(stamp - old[0]) >= limit or abs(stamp - new[0]) >= limit or jump >= self.config.distance_tolerance:
            return None
        t = min(max((stamp - old[0]) / (new[0] - old[0]), 0.0), 1.0) if new[0] > old[0] else 0.0
        position = np.array(old[1:4]) + t * np.subtract(new[1:4], old[1:4])
        turn = slerp(np.array(old[4:]), np.array(new[4:]), t)
        return (stamp, *position.tolist(), *turn.tolist())


OUT = "vehicle string, scan_id long, stamp_ns long, valid boolean, x double, y double, z double, qx double, qy double, qz double, qw double"


def interpolate_stream(poses: DataFrame, scans: DataFrame, config: PoseBufferConfig = PoseBufferConfig(), watermark: str = "2 seconds", reset_on_reversal: bool = False) -> DataFrame:
    """poses: vehicle, stamp_ns, x .. qw; scans: vehicle, scan_id, stamp_ns; one row out for every scan."""
    values = ["x", "y", "z", "qx", "qy", "qz", "qw"]
    left = poses.select("vehicle", "stamp_ns", F.lit(None).cast("long").alias("scan_id"), *values)
    right = scans.select("vehicle", "stamp_ns", "scan_id", *(F.lit(None).cast("double").alias(v) for v in values))
    both = left.union(right).withColumn("ts", F.timestamp_micros(F.floor(F.col("stamp_ns") / 1000).cast("long"))).withWatermark("ts", watermark)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, waiting = pickle.loads(state.get[0]) if state.exists else (PoseBuffer(config, reset_on_reversal), [])
        for batch in batches:
            rows = batch.sort_values("stamp_ns", kind="stable") if not reset_on_reversal else batch
            for r in rows.itertuples(index=False):
                if pd.isna(r.scan_id):
                    buffer.push((int(r.stamp_ns), *(float(getattr(r, v)) for v in values)))
                else:
                    waiting.append((int(r.stamp_ns), int(r.scan_id)))
        mark = state.getCurrentWatermarkMs() * 1_000_000
        limit = int(config.timeout_sec * 1e9)
        ready = [w for w in waiting if buffer.covers(w[0] + 1) or (state.hasTimedOut or mark >= w[0] + limit)]
        waiting = [w for w in waiting if w not in ready]
        out = []
        for stamp, scan_id in sorted(ready):
            found = buffer.at(stamp)
            out.append((key[0], scan_id, stamp, found is not None, *(found[1:] if found else [None] * 7)))
        oldest = min((w[0] for w in waiting), default=(buffer.latest() or (0,))[0])
        buffer.drop_before(oldest - limit)
        state.update((pickle.dumps((buffer, waiting)),))
        if waiting:
            state.setTimeoutTimestamp(max(mark // 1_000_000 + 1, (min(w[0] for w in waiting) + limit) // 1_000_000 + 1))
        yield pd.DataFrame(out, columns=["vehicle", "scan_id", "stamp_ns", "valid", *values])

    return both.groupBy("vehicle").applyInPandasWithState(run, OUT, "buffer binary", "append", GroupStateTimeout.EventTimeTimeout)
