"""Line dedup: drop lines that many documents repeat, except in one of them.

Lines are exploded with their position; the key of a line (stripped, A-Z
lower-cased) is hashed to 128 bits; distinct documents are counted for each
hash; lines over the threshold lose all their copies but those in the largest
doc_id; what is left is put together by position.  Only hashes and positions are
shuffled for the counting, and positions of dropped lines go back to the
documents.

Defined results: a null or empty text is one empty line and never loses it.
Rows that repeat a doc_id are one document when documents are counted, and each
is treated by itself otherwise.  A null doc_id is no document in the count and
such a row loses no line.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import SPACE_CHARS, ascii_lower, staged

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _marked(lines: Column, drops: Column) -> Column:
    """The lines without the (sorted or unsorted) positions in ``drops``, in n log n.

    Lines and drops are sorted together by position, a drop before its line, so
    that a line is dropped if the item before it is a drop of that position.
    """
    items = F.concat(
        F.transform(drops, lambda p: F.struct(p.alias("p"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("t"))),
        F.transform(lines, lambda t, i: F.struct(i.alias("p"), F.lit(1).alias("k"), t.alias("t"))),
    )
    holds = lambda a: F.filter(a, lambda x, i: (x["k"] == 1) & ~((i > 0) & (F.get(a, i - 1)["p"] == x["p"])))
    # transform over a one-item array names the sorted items, which are thus computed once
    return F.transform(F.flatten(F.transform(F.array(F.array_sort(items)), holds)), lambda x: x["t"])


def dropped_positions(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """drop_id, drop_text (a hash of the row's text), drops: the positions that rows lose; rows that lose none are left out."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("drop_id"), F.xxhash64(text_col).alias("drop_text"), F.posexplode(F.split(text_col, "\n", -1)).alias("at", "line"))
    stripped = lines.withColumn("line", F.btrim("line", F.lit(SPACE_CHARS))).where(F.char_length("line") >= min_chars)
    keyed = stripped.select("drop_id", "drop_text", "at", ascii_lower(F.col("line")).alias("key"))
    hashed = keyed.select("drop_id", "drop_text", "at", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("second"), "key").alias("b"))
    # The first aggregate makes each document count once, the second combines
    # before its shuffle, so that a line found everywhere costs a row a task.
    counted = hashed.select("a", "b", "drop_id").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("drop_id").alias("keep_id"))
    common = staged(counted.where(F.col("n") >= min_docs).select("a", "b", "keep_id"), even=True)
    gone = hashed.join(common, ["a", "b"]).where("drop_id != keep_id")
    return gone.groupBy("drop_id", "drop_text").agg(F.collect_set("at").alias("drops"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row of ``docs``."""
    drops = dropped_positions(docs, id_col, text_col, min_chars, min_docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    same = (rows.doc_id == drops.drop_id) & (F.xxhash64(rows.text) == drops.drop_text)
    found = rows.join(drops, same, "left").withColumn("text", F.coalesce("text", F.lit("")))
    kept = F.when(F.col("drops").isNull(), F.array("text")).otherwise(_marked(F.split("text", "\n", -1), F.col("drops")))
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return found.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.array_size("drops"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("text"))
