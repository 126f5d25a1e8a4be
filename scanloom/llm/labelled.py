"""A bounded sample of labelled rows for fitting, and Arrow helpers for scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import crc_mod, staged
from scanloom.llm.text_kernels import byte_runs, text_bytes

#: Bound of a sample: rows of each class, and bytes of a row's text; together they
#: bound what a task or the driver gets (some 260 MB, far less in practice).  Rows
#: beyond these are not learnt from; every row is scored.
MAX_ROWS, MAX_BYTES = 4000, 1 << 15


def usable_labels(labels: DataFrame, label: str, id_col: str, modulus: int, held_out: int) -> DataFrame:
    """(id, y) of the labels 0 and 1 that are not held out and don't contradict each other."""
    y = F.col(label).cast("int")
    usable = labels.where(F.col(id_col).isNotNull() & y.isin(0, 1) & (crc_mod(F.col(id_col), modulus) != held_out))
    return usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(y).alias("y"), F.max(y).alias("z")).where("y = z").select("id", "y")


def sample_ids(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, modulus: int, held_out: int, rows: int = MAX_ROWS) -> tuple[DataFrame, list[int]]:
    """(id, y) rows of at most ``rows`` for each class, and the class counts they are drawn from.

    Rows with a null id or label, labels other than 0 and 1, ids with
    contradicting labels and held-out rows are left out, and ids without a
    document of at most ``MAX_BYTES``.  The sample is the rows of smallest hash, so
    that it depends on the rows alone.
    """
    usable = usable_labels(labels, label, id_col, modulus, held_out)
    usable = staged(usable.join(_short(docs, id_col, text_col).select("id"), "id", "left_semi"), even=True)
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("id")
    picked = [r for c in (0, 1) for r in usable.where(F.col("y") == c).orderBy(order, "id").limit(rows).collect()]
    spark = labels.sparkSession
    return spark.createDataFrame([(r["id"], r["y"]) for r in picked], "id long, y int"), [counts.get(0, 0), counts.get(1, 0)]


def _short(docs: DataFrame, id_col: str, text_col: str, keep: tuple[Column, ...] = ()) -> DataFrame:
    rows = docs.where(F.col(id_col).isNotNull() & (F.coalesce(F.octet_length(text_col), F.lit(0)) <= MAX_BYTES))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *keep)


def sample_rows(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, *keep: Column) -> DataFrame:
    """The sample's (id, y, text, *keep); ``sample`` has a bounded number of rows and is broadcast.

    Of rows that repeat an id the one of least text (null first) is taken.
    """
    rows = _short(docs, id_col, text_col, keep)
    others = [c for c in rows.columns if c != "id"]
    first = rows.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min(F.struct(*others)).alias("row"))
    return first.select("id", "y", "row.*")


def scorer(score: Callable[[list[bytes]], "object"], run_bytes: int = 1 << 21):
    """A batch function that appends a score column: columns in, text last, out: the others and the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            texts = text_bytes(batch.column(last))
            for begin, end in byte_runs(texts, run_bytes):
                part = batch.slice(begin, end - begin)
                columns = [part.column(i) for i in range(last)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score(texts[begin:end]), pa.float64())], names=[*batch.schema.names[:last], "score"])

    return run
