"""Live frame transforms, an on/off switch and request handlers."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.operators.temporal import lookup_transform
from scanloom.operators.tiles import tile_difference

EDGE = "parent string, child string, stamp_ns long, is_static boolean, tx double, ty double, tz double, qx double, qy double, qz double, qw double"


@dataclass
class TransformBuffer:
    """The last edges of every (parent, child); a static edge replaces what was there."""

    most: int = 100
    edges: dict[tuple[str, str], deque] = field(default_factory=lambda: defaultdict(deque))

    def push(self, rows: DataFrame) -> None:
        """Take a micro-batch of edges (few beside the scans: a vehicle has some dozen frames)."""
        newest = rows.groupBy("parent", "child").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("stamp_ns", "is_static", "tx", "ty", "tz", "qx", "qy", "qz", "qw")))), 1, self.most).alias("e"))
        for row in newest.collect():
            held = self.edges[(row["parent"].lstrip("/"), row["child"].lstrip("/"))]
            for e in reversed(row["e"]):
                if e["is_static"]:
                    held.clear()
                held.append(tuple(e))
                while len(held) > self.most:
                    held.popleft()

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(p, c, *e) for (p, c), held in self.edges.items() for e in held], EDGE)

    def lookup(self, queries: DataFrame) -> DataFrame:
        return lookup_transform(queries, self.table(queries.sparkSession))


@dataclass
class Switch:
    """On or off; turning on runs the reset actions first (such as clearing pose buffers)."""

    enabled: bool = True
    on_enable: list[Callable[[], None]] = field(default_factory=list)

    def set(self, enabled: bool) -> None:
        if enabled:
            for action in self.on_enable:
                action()
        self.enabled = enabled

    def guard(self, process: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function that passes batches over while the switch is off."""
        return lambda batch, number: process(batch, number) if self.enabled else None


def serve_map_request(tiles: DataFrame, x: float, y: float, radius: float, cached: list[str]) -> DataFrame:
    """What a client that holds ``cached`` tiles has to load and drop for a circle."""
    spark = tiles.sparkSession
    held = spark.createDataFrame([(t,) for t in cached], "tile_id string")
    near = (F.col("cx") - x) * (F.col("cx") - x) + (F.col("cy") - y) * (F.col("cy") - y) <= radius * radius
    return tile_difference(tiles.where(near), held)
