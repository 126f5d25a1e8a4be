"""Sharding by extendible hashing.

A row's address is the bits of a hash.  The directory starts with one shard;
every shard over its byte limit splits on the next bit of the address, until all
fit.  It is grown from one histogram of bytes by address prefix (a level deeper
than the expected depth), whose coarser levels are sums of the finer one; only
prefixes that are still too large are counted again, more deeply.  Directory
and rows are joined on prefixes of even size, so nothing depends on a table that
fits one machine.

Defined results: a null text has 0 bytes.  The address is the hash of the id and
of the text, so that rows that repeat an id spread too.  Rows equal in both share
an address: a shard of one address, be it a single row over the limit, cannot
split, stays as it is, and ``fits`` is false; the same at ``MAX_BITS`` bits.  An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import address, staged

LIMIT, MAX_BITS = 32 << 20, 60


def directory(sizes: DataFrame, limit: int, first: int, step: int = 6) -> DataFrame:
    """(prefix at ``depth``, depth, shard_depth, bytes) for each address prefix that occurs.

    ``sizes``: bits, bytes.  Levels 0 to ``first`` come from one histogram; rows of
    prefixes over the limit go ``step`` bits deeper, and so on.
    """
    done: DataFrame | None = None
    rest, low, high = sizes, 0, min(first, MAX_BITS)
    while True:
        fine = staged(rest.groupBy(F.shiftright("bits", 60 - high).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.min("bits").alias("least"), F.max("bits").alias("most")), even=True)
        # every level's sums at once; a prefix lies in a shard of each level, and
        # its own is the shallowest that fits
        tried = fine.withColumn("shard_depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("shard", F.expr(f"shiftright(prefix, {high} - shard_depth)"))
        totals = tried.groupBy("shard_depth", "shard").agg(F.sum("bytes").alias("shard_bytes"), F.min("least").alias("least"), F.max("most").alias("most"))
        whole = (F.col("shard_bytes") <= limit) | (F.col("least") == F.col("most")) | (F.col("shard_depth") == MAX_BITS)
        leaves = staged(totals.where(whole).drop("least", "most"), even=True)
        found = tried.join(leaves, ["shard_depth", "shard"]).groupBy("prefix").agg(F.min(F.struct("shard_depth", "shard", "shard_bytes")).alias("leaf"))
        found = staged(found.select(F.lit(high).alias("depth"), "prefix", "leaf.*"), even=True)
        done = found if done is None else done.union(found)
        open_ = staged(fine.select("prefix").join(found.select("prefix"), "prefix", "left_anti"), even=True)
        if high == MAX_BITS or open_.isEmpty():
            return done
        rest = rest.join(open_.withColumnRenamed("prefix", "open"), F.shiftright("bits", 60 - high) == F.col("open"), "left_semi")
        low, high = high + 1, min(high + step, MAX_BITS)


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard (the address prefix as bits), shard_bytes and fits of every row."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), size.alias("bytes"), address(id_col, text_col).alias("bits")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth = max(1, (-(-total // limit)).bit_length() + 3)
    leaves = directory(rows.select("bits", "bytes"), limit, depth)
    placed = None
    for (deep,) in sorted(leaves.select("depth").distinct().collect()):
        own = leaves.where(F.col("depth") == deep).drop("depth")
        part = rows.withColumn("prefix", F.shiftright("bits", 60 - deep)).join(own, "prefix")
        placed = part if placed is None else placed.union(part)
    placed = placed if placed is not None else rows.withColumn("prefix", F.col("bits")).join(leaves.drop("depth"), "prefix")
    name = F.when(F.col("shard_depth") == 0, "").otherwise(F.lpad(F.conv(F.col("shard").cast("string"), 10, 2), F.col("shard_depth"), F.lit("0")))
    return placed.select("doc_id", F.col("bytes").alias("n_bytes"), name.alias("shard"), "shard_bytes", (F.col("shard_bytes") <= limit).alias("fits"))
