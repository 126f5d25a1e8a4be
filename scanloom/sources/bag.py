"""Recordings kept as SQLite files (tables ``topics`` and ``messages``), as a Python data source.

``spark.read.format("scan_recording").option("path", ...)`` gives topic, type,
stamp_ns and the payload; each file is one partition, read where it is
scheduled.  Payload decoding is left to the topic's reader (``pointcloud`` or
``scalars``).
"""

from __future__ import annotations

import glob
import sqlite3
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Messages that are Python objects at once.
AT_ONCE = 1024


class RecordingReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(glob.glob(self.path)) or [self.path]]

    def read(self, partition: InputPartition):
        with sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True) as db:
            yield from db.execute("SELECT t.name, t.type, m.timestamp, m.data FROM messages m JOIN topics t ON t.id = m.topic_id ORDER BY m.timestamp, m.id")


class Recording(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scan_recording"

    def schema(self) -> str:
        return "topic string, type string, stamp_ns long, data binary"

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options["path"])


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Recording)
    return spark.read.format("scan_recording").option("path", path).load()


def topics(messages: DataFrame) -> DataFrame:
    """Per topic its type, number of messages, first and last stamp and duration in seconds."""
    return messages.groupBy("topic", "type").agg(F.count(F.lit(1)).alias("messages"), F.min("stamp_ns").alias("first_ns"), F.max("stamp_ns").alias("last_ns"), ((F.max("stamp_ns") - F.min("stamp_ns")) / 1e9).alias("duration_sec"))


def scalars(messages: DataFrame) -> DataFrame:
    """topic, stamp_ns, value of stamped float messages: after a four-byte encapsulation,
    seconds, nanoseconds and a float32.  The header's stamp goes before the recorder's where it is set."""
    schema = "topic string, stamp_ns long, value double"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for topic, stamp, data in zip(batch.column("topic").to_pylist(), batch.column("stamp_ns").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if data is not None and len(data) >= 16:
                    sec, nanosec, value = struct.unpack_from("<iIf", data, 4)
                    out.append((topic, sec * 1_000_000_000 + nanosec if sec or nanosec else stamp, float(value)))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64()), strict=True)], names=["topic", "stamp_ns", "value"])

    return messages.select("topic", "stamp_ns", "data").mapInArrow(run, schema)


def write_recording(rows: list[tuple[str, str, int, bytes]], path: str) -> None:
    """A recording of (topic, type, stamp_ns, data) rows; for fixtures and small exports."""
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE topics (id INTEGER PRIMARY KEY, name TEXT, type TEXT, serialization_format TEXT, offered_qos_profiles TEXT)")
        db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        names = sorted({(t, k) for t, k, _, _ in rows})
        db.executemany("INSERT INTO topics VALUES (?, ?, ?, 'cdr', '')", [(i, t, k) for i, (t, k) in enumerate(names)])
        ids = {t: i for i, (t, _) in enumerate(names)}
        db.executemany("INSERT INTO messages (topic_id, timestamp, data) VALUES (?, ?, ?)", [(ids[t], s, d) for t, _, s, d in rows])


def _after_header(data: bytes) -> tuple[int, int, str, int]:
    """Seconds, nanoseconds and frame of a stamped message, and where its body begins (after the encapsulation's four bytes)."""
    sec, nanosec, n = struct.unpack_from("<iII", data, 4)
    return sec, nanosec, data[16 : 16 + max(n - 1, 0)].decode(), 12 + n


def poses(messages: DataFrame) -> DataFrame:
    """topic, stamp_ns, frame, x .. qw and covariance (36 values or null) of stamped pose messages.

    Fields are aligned to their size, counted from the body's begin; messages too
    short for a pose are left out.
    """
    names = ("x", "y", "z", "qx", "qy", "qz", "qw")
    schema = "topic string, stamp_ns long, frame string, " + ", ".join(f"{n} double" for n in names) + ", covariance array<double>"

    def run(batches):
        import pyarrow as pa

        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            out = []
            for topic, stamp, data in zip(batch.column("topic").to_pylist(), batch.column("stamp_ns").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if data is None or len(data) < 16:
                    continue
                sec, nanosec, frame, at = _after_header(data)
                at = 4 + -(-at // 8) * 8
                if len(data) < at + 56:
                    continue
                covariance = list(struct.unpack_from("<36d", data, at + 56)) if len(data) >= at + 344 else None
                out.append((topic, sec * 1_000_000_000 + nanosec if sec or nanosec else stamp, frame, *struct.unpack_from("<7d", data, at), covariance))
            columns = list(zip(*out, strict=True)) or [[]] * 11
            types = (pa.string(), pa.int64(), pa.string(), *[pa.float64()] * 7, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["topic", "stamp_ns", "frame", *names, "covariance"])

    return messages.select("topic", "stamp_ns", "data").mapInArrow(run, schema)


def integers(messages: DataFrame) -> DataFrame:
    """topic, stamp_ns, value of stamped 32-bit integers, such as iteration counts; in expressions alone."""
    data = F.col("data")
    little = lambda at: F.conv(F.concat(*(F.substring(F.hex(data), 2 * (at + k) + 1, 2) for k in (3, 2, 1, 0))), 16, 10).cast("long")
    signed = lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)
    header = signed(little(4)) * 1_000_000_000 + little(8)
    return messages.where(F.octet_length(data) >= 16).select("topic", F.when(header != 0, header).otherwise(F.col("stamp_ns")).alias("stamp_ns"), signed(little(12)).cast("int").alias("value"))


def encode_pose(stamp_ns: int, frame: str, pose: tuple[float, ...], covariance: list[float] | None = None) -> bytes:
    """A stamped pose message; with 36 values one with covariance."""
    name = frame.encode() + b"\0"
    body = struct.pack("<iII", stamp_ns // 1_000_000_000, stamp_ns % 1_000_000_000, len(name)) + name
    body += b"\0" * (-len(body) % 8) + struct.pack("<7d", *pose) + (struct.pack("<36d", *covariance) if covariance else b"")
    return b"\0\1\0\0" + body


def encode_integer(stamp_ns: int, value: int) -> bytes:
    return b"\0\1\0\0" + struct.pack("<iIi", stamp_ns // 1_000_000_000, stamp_ns % 1_000_000_000, value)


def restamped(messages: DataFrame, stamp: str) -> DataFrame:
    """Messages whose time, and whose header's time where the payload has one, is that of column ``stamp``.

    Null stamps leave a message as it is.  A header is the twelve bytes after the
    encapsulation's begin; shorter payloads have none.
    """
    little = lambda v: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(v), 8, "0"), 2 * k + 1, 2) for k in (3, 2, 1, 0))))
    sec, nanosec = F.floor(F.col(stamp) / 1_000_000_000).cast("long"), F.pmod(F.col(stamp), F.lit(1_000_000_000)).cast("long")
    data = F.concat(F.substring("data", 1, 4), little(sec), little(nanosec), F.expr("substring(data, 13)"))
    moved = F.when(F.col(stamp).isNotNull() & (F.octet_length("data") >= 12), data).otherwise(F.col("data"))
    return messages.withColumns({"data": moved, "stamp_ns": F.coalesce(F.col(stamp), F.col("stamp_ns"))})
