"""Binary point clouds: row-oriented payloads with named float fields.

A message is (height, width, fields, is_bigendian, point_step, row_step, data),
``fields`` being an array of (name, offset, datatype, count); 7 is FLOAT32.
Decoding is one vectorised call per message inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOAT32 = 7
MESSAGE = (
    "height int, width int, fields array<struct<name:string,offset:int,datatype:int,count:int>>, "
    "is_bigendian boolean, point_step int, row_step int, data binary"
)


def decode_payload(message: dict) -> np.ndarray:
    """The finite points of one message, as float32 rows.  Missing fields and short buffers are errors."""
    offsets = {f["name"]: f["offset"] for f in message["fields"] or [] if f["datatype"] == FLOAT32}
    missing = [c for c in "xyz" if c not in offsets]
    if missing:
        raise ValueError(f"point cloud without float field {', '.join(missing)}")
    n, step = message["height"] * message["width"], message["point_step"]
    data = message["data"] or b""
    if len(data) < n * step:
        raise ValueError(f"point cloud of {n} points needs {n * step} bytes, has {len(data)}")
    order = ">" if message["is_bigendian"] else "<"
    layout = np.dtype({"names": list("xyz"), "formats": [f"{order}f4"] * 3, "offsets": [offsets[c] for c in "xyz"], "itemsize": step})
    rows = np.frombuffer(data, dtype=layout, count=n)
    out = np.stack([rows[c].astype(np.float32) for c in "xyz"], axis=1)
    return out[np.isfinite(out).all(axis=1)]


def decode(messages: DataFrame, key: str) -> DataFrame:
    """key, point_id (place among the finite points), x, y, z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one message at a time: a batch of points is one scan
                row = batch.slice(i, 1).to_pylist()[0]
                xyz = decode_payload(row)
                yield pa.RecordBatch.from_arrays([pa.array([row[key]] * len(xyz), batch.schema.field(key).type), pa.array(np.arange(len(xyz))), *(pa.array(xyz[:, k]) for k in range(3))], names=[key, "point_id", "x", "y", "z"])

    kind = messages.schema[key].dataType.simpleString()
    return messages.mapInArrow(run, f"{key} {kind}, point_id long, x float, y float, z float")


def encode_payload(points: np.ndarray, rgb: np.ndarray | None = None) -> dict:
    """A message of x, y, z (12 bytes a point), or with colour as the bits of a float (16 bytes)."""
    names = ["x", "y", "z"] + (["rgb"] if rgb is not None else [])
    rows = np.zeros(len(points), dtype=[(n, "<f4") for n in names])
    for k, n in enumerate("xyz"):
        rows[n] = points[:, k]
    if rgb is not None:
        padded = np.zeros(len(points), dtype="<u4")
        padded[: len(rgb)] = rgb[: len(points)]
        rows["rgb"] = padded.view("<f4")
    step = 4 * len(names)
    return {
        "height": 1, "width": len(points), "fields": [{"name": n, "offset": 4 * k, "datatype": FLOAT32, "count": 1} for k, n in enumerate(names)],
        "is_bigendian": False, "point_step": step, "row_step": step * len(points), "data": rows.tobytes(),
    }


def encode(points: DataFrame, key: str, order: str = "point_id", rgb: str | None = None) -> DataFrame:
    """One message for every key (a scan), points in ``order``; a missing colour is 0."""
    kind = points.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        xyz = np.stack([np.asarray(table.column(c), dtype=np.float32) for c in "xyz"], axis=1)
        colour = np.asarray(table.column(rgb).fill_null(0)).astype(np.uint32) if rgb else None
        message = {key: table.column(key)[0].as_py(), **encode_payload(xyz, colour)}
        return pa.Table.from_pylist([message], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    text = f"{key} {kind}, {MESSAGE}"
    schema = to_arrow_schema(points.sparkSession.createDataFrame([], text).schema)
    wanted = points.select(key, order, "x", "y", "z", *([rgb] if rgb else [])).where(F.col(key).isNotNull())
    return wanted.groupBy(key).applyInArrow(run, text)
