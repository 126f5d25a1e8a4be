"""Bounded micro-batching of scans with shedding by age and depth.

``ScanQueue`` states the rules as plain Python.  On Spark a trigger makes the
batches; ``shed`` applies age and depth to a batch as DataFrame operations and
``run_queue`` wires it into ``foreachBatch`` with counters.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from scanloom.config import QueueConfig


@dataclass
class ScanQueue:
    config: QueueConfig = field(default_factory=QueueConfig)
    waiting: deque = field(default_factory=deque)
    stats: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("enqueued", "dropped_overflow", "dropped_age", "batches", "processed"), 0))

    def enqueue(self, stamp_ms: float, scan: object) -> None:
        if len(self.waiting) >= self.config.depth:
            self.waiting.popleft()
            self.stats["dropped_overflow"] += 1
        self.waiting.append((stamp_ms, scan))
        self.stats["enqueued"] += 1

    def due(self, now_ms: float, draining: bool = False) -> list:
        """The next batch in the order of stamps, or nothing yet."""
        while self.waiting and now_ms - self.waiting[0][0] > self.config.max_age_ms:
            self.waiting.popleft()
            self.stats["dropped_age"] += 1
        waited = bool(self.waiting) and now_ms - self.waiting[0][0] >= self.config.timeout_ms
        if not self.waiting or not (len(self.waiting) >= self.config.batch or waited or draining):
            return []
        batch = [self.waiting.popleft() for _ in range(min(self.config.batch, len(self.waiting)))]
        self.stats["batches"] += 1
        self.stats["processed"] += len(batch)
        return sorted(batch, key=lambda x: x[0])


def shed(batch: DataFrame, now_ms, config: QueueConfig = QueueConfig(), vehicle: str = "vehicle", arrival: str = "arrival_ms") -> DataFrame:
    """Adds ``fate``: dropped_age, dropped_overflow, or processed; each vehicle keeps its latest ``depth``."""
    old = F.lit(now_ms) - F.col(arrival) > config.max_age_ms
    rank = F.row_number().over(Window.partitionBy(vehicle, old).orderBy(F.col(arrival).desc(), F.col("scan_id").desc()))
    return batch.withColumn("fate", F.when(old, "dropped_age").when(rank > config.depth, "dropped_overflow").otherwise("processed"))


def run_queue(scans: DataFrame, process: Callable[[DataFrame, int], None], record: Callable[[DataFrame, int], None], checkpoint: str, config: QueueConfig = QueueConfig(), clock: Callable[[DataFrame], float] | None = None, **trigger) -> StreamingQuery:
    """Shed, process what is left in the order of stamps, and record counters, batch by batch."""

    def each(batch: DataFrame, number: int) -> None:
        now = clock(batch) if clock else batch.agg(F.max("arrival_ms")).first()[0]
        judged = shed(batch, now if now is not None else 0, config).persist()
        process(judged.where("fate = 'processed'").orderBy("vehicle", "arrival_ms").drop("fate"), number)
        record(judged.groupBy("fate").agg(F.count(F.lit(1)).alias("n")), number)
        judged.unpersist()

    return scans.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
