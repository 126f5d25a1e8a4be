"""Scans of any size as blocks of packed points, and the sums over them that alignments ask for.

A scan with very many points is dealt to tasks in parts; each task packs its part into
blocks (``functions.blocks.Cloud``) of bounded size.  Alignments of all such scans then go
in step: a round is one job that gives every alignment the sums it asks for, and only
poses and sums go between tasks and driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions.blocks import Cloud
from scanloom.functions.kernels import Steps

#: Points beyond which a scan is dealt to several tasks, and the most points of a block.
LARGE_SCAN, BLOCK_POINTS = 1 << 17, 1 << 19


def pack(points: DataFrame, scan: str, resolution: float) -> DataFrame:
    """Blocks of the points of each partition: scan, block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK_POINTS:
                yield from blocks(held)
                held, size = [], 0
        if size:
            yield from blocks(held)

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        ids = table.column(scan).combine_chunks().dictionary_encode()
        place = np.asarray(ids.indices)
        xyz = np.stack([np.asarray(table.column(c), dtype=float) for c in "xyz"], axis=1)
        for k, value in enumerate(ids.dictionary):
            data = Cloud.of(xyz if len(ids.dictionary) == 1 else xyz[place == k], resolution).to_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([value.as_py()], ids.dictionary.type), pa.array([data], pa.binary())], names=[scan, "block"])

    kept = points.select(scan, *(F.col(c).cast("double").alias(c) for c in "xyz")).where(F.col(scan).isNotNull())
    return kept.mapInArrow(run, f"{scan} {points.schema[scan].dataType.simpleString()}, block binary")


class PackedScans:
    """Points of scans; those with more than ``most`` points are packed once, when an alignment first asks.

    ``points``: scan, x, y, z.  ``sizes`` are the scans that are packed, with their numbers
    of points; ``resolution`` is that of the finest voxels.
    """

    def __init__(self, points: DataFrame, scan: str, resolution: float, most: int | None = None) -> None:
        self.points, self.scan, self.resolution = points.select(scan, "x", "y", "z"), scan, resolution
        self.most = LARGE_SCAN if most is None else most

    @cached_property
    def sizes(self) -> dict:
        counts = self.points.where(F.col(self.scan).isNotNull()).groupBy(self.scan).agg(F.count(F.lit(1)).alias("n"))
        return {r[0]: r[1] for r in counts.where(F.col("n") > self.most).collect()}

    def marks(self) -> DataFrame:
        """The packed scans, as ``_large``."""
        spark, kind = self.points.sparkSession, self.points.schema[self.scan].dataType.simpleString()
        return spark.createDataFrame([(k,) for k in self.sizes], f"_large {kind}")

    def small(self) -> DataFrame:
        """Points of the scans that stay whole."""
        return self.points.join(F.broadcast(self.marks()), F.col(self.scan) == F.col("_large"), "left_anti") if self.sizes else self.points

    @cached_property
    def blocks(self) -> DataFrame:
        """The blocks of the packed scans, a part of one scan in each partition; equal points meet in the same part."""
        spark = self.points.sparkSession
        kind = self.points.schema[self.scan].dataType.simpleString()
        cores = spark.sparkContext.defaultParallelism
        part = min(max(sum(self.sizes.values()) // (2 * cores), LARGE_SCAN), BLOCK_POINTS)
        parts = {k: -(-n // part) for k, n in self.sizes.items()}
        total = sum(parts.values())
        # of the numbers that hash to each partition, the least: the parts are dealt evenly
        hashes = spark.range(32 * total + 1024).groupBy(F.pmod(F.hash("id"), F.lit(total)).alias("p")).agg(F.min("id")).collect()
        free = iter([r[1] for r in hashes] + list(range(total)))
        deal = spark.createDataFrame([(k, [next(free) for _ in range(n)]) for k, n in parts.items()], f"_scan {kind}, _deal array<long>")
        placed = self.points.join(F.broadcast(deal), F.col(self.scan) == F.col("_scan"))
        to = F.element_at("_deal", (F.pmod(F.xxhash64("x", "y", "z"), F.size("_deal")) + 1).cast("int")).alias("_to")
        dealt = placed.select(self.scan, "x", "y", "z", to).repartition(total, "_to")
        return pack(dealt, self.scan, self.resolution).persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        if "blocks" in self.__dict__:
            self.__dict__.pop("blocks").unpersist()

    def _total(self, asked: list[tuple], width: int, run_block) -> np.ndarray:
        """Of every asked thing (its scan first) the sum of what ``run_block`` (cloud, places in ``asked``) gives by block."""
        of: dict = {}
        for i, a in enumerate(asked):
            of.setdefault(a[0], []).append(i)
        scan = self.scan

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for key, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if key in of:
                        for i, row in run_block(Cloud.from_buffer(block.as_buffer()), of[key]):
                            sums[i] = sums[i] + row if i in sums else row
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["i", "sums"])

        wanted = self.blocks.select(scan, "block")
        if len(of) < len(self.sizes) and len(of) <= 1000:
            wanted = wanted.where(F.col(scan).isin(list(of)))
        out = np.zeros((len(asked), width))
        found = wanted.mapInArrow(run, "i int, sums binary").toArrow()
        for i, v in zip(found.column(0).to_pylist(), found.column(1), strict=True):
            out[i] += np.frombuffer(v.as_buffer(), float)
        return out

    def sums(self, asked: list[tuple], index: Broadcast, d1: float, d2: float, metric: str) -> list[tuple[float, np.ndarray, np.ndarray, int]]:
        """Score, gradient, Hessian and pairs of every (scan, pose, order)."""

        def run(cloud: Cloud, places: list[int]) -> Iterator[tuple[int, np.ndarray]]:
            for order in (0, 1, 2):
                if mine := [i for i in places if asked[i][2] == order]:
                    for i, (s, g, h, n) in zip(mine, cloud.sums(index.value, np.stack([asked[i][1] for i in mine]), d1, d2, metric, order), strict=True):
                        yield i, np.concatenate([[s], g, h.reshape(-1), [n]])

        rows = self._total(asked, 44, run)
        return [(float(r[0]), r[1:7], r[7:43].reshape(6, 6), int(round(r[43]))) for r in rows]

    def judged(self, asked: list[tuple], index: Broadcast, d1: float, d2: float) -> list[dict]:
        """The scores of every (scan, pose), as ``kernels.scores`` has them."""

        def run(cloud: Cloud, places: list[int]) -> Iterator[tuple[int, np.ndarray]]:
            for i, row in zip(places, cloud.judged(index.value, np.stack([asked[i][1] for i in places]), d1, d2), strict=True):
                yield i, np.append(row, cloud.total)

        return [scores_of(*row) for row in self._total(asked, 5, run)]

    def aligned(self, steps: dict, scans: dict, index: Broadcast, d1: float, d2: float, metric: str) -> dict:
        """The results of searches (``kernels.align_steps``) by their keys, all in step; ``scans`` has each one's scan."""
        steps: dict[object, Steps] = dict(steps)
        asked, results = {k: next(s) for k, s in steps.items()}, {}
        while asked:
            flat = [(scans[k], pose, order) for k, wanted in asked.items() for pose, order in wanted]
            answers, ahead = iter(self.sums(flat, index, d1, d2, metric)), {}
            for k, wanted in asked.items():
                try:
                    ahead[k] = steps[k].send([next(answers) for _ in wanted])
                except StopIteration as end:
                    results[k] = end.value
            asked = ahead
        return results


def scores_of(score: float, pairs: float, best: float, met: float, points: float) -> dict:
    return {
        "score": float(score), "pairs": int(round(pairs)), "tp_pairs": float(score / pairs) if pairs else 0.0, "tp_points": float(score / points) if points else 0.0,
        "nvtl": float(best / met) if met else 0.0, "unmatched": int(round(points - met)), "points": int(round(points)),
    }
