"""What the operators of this package share: table access, staged tables, text keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here, as a regex class and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = rf"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a folder of this machine serves in local mode,
    where there is only one machine; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = os.path.join(tempfile.gettempdir(), f"scanloom-{os.getpid()}")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders inside the application's that staged tables go to at present.
_INSIDE: ContextVar[tuple[str, ...]] = ContextVar("inside", default=())


def staging_folder(spark: SparkSession) -> str:
    """Where this application keeps its staged tables."""
    return "/".join([shared_folder(spark), "scanloom", spark.sparkContext.applicationId, *_INSIDE.get()])


def release(spark: SparkSession, folder: str | None = None) -> None:
    """Delete a folder, or all staged tables of this application; results that still read them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder or staging_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """What ``make`` returns, written, and its folder; the tables that were staged to make it are deleted."""
    path, inside = f"{staging_folder(spark)}/{uuid.uuid4().hex}", uuid.uuid4().hex
    token = _INSIDE.set((*_INSIDE.get(), inside))
    try:
        df = make()
        df.write.option("compression", "zstd").parquet(path)
    finally:
        release(spark)
        _INSIDE.reset(token)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, small: bool = False, even: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    It cuts the lineage as ``checkpoint()`` does, but runs the plan once, stores
    columns compressed and lets later reads prune them.  A lost executor costs
    only its running tasks.  ``small`` is for tables whose size is bounded or that
    hold a row for hundreds of the input's: they are dealt to a sixteenth of the
    shuffle partitions first, which saves as many small files.  ``even`` is for
    tables that may be few rows or as many as the input: Spark sizes their
    partitions from what the plan has really made, and splits large ones.
    """
    spark = df.sparkSession
    if small:
        df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    elif even:
        df = df.hint("rebalance")
    path = f"{staging_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting of how many bytes of rows go to a Python worker at once, and what suits whole rows with texts.
ARROW_BYTES, ROWS_AT_ONCE = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 21


def small_batches(spark: SparkSession) -> None:
    """Have rows go to Python workers in small batches from now on.

    An Arrow batch is held outside the heap by the executor, several times while
    it grows and is sent, and once more by the worker.  Spark reads the setting
    when a result is computed, so it holds for the session until it is set back;
    no result depends on it.
    """
    spark.conf.set(ARROW_BYTES, str(ROWS_AT_ONCE))


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased and nothing else.

    ``lower`` is fast and right where every character is one byte; ``translate``
    serves the other texts.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, upper, upper.lower()))


def hash128(*columns: Column) -> Column:
    """Two independent 64-bit hashes as one struct, for use as a key."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("second"), *columns).alias("b"))


def address(id_col: str, text_col: str) -> Column:
    """60 bits of md5 over the id and the text's own md5, as a non-negative number."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def own_name(df: DataFrame, wanted: str) -> str:
    """A column name like ``wanted`` that ``df`` doesn't have (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
