"""Exact dedup by content-defined chunk recipes.

A text's key is the text without white space.  The key is cut into chunks whose
borders depend on nearby characters only, so a passage that many texts share
yields the same chunks in each.  Distinct chunks are gathered once, under two
64-bit hashes, and each gets a verified identifier: where all contents under a
hash agree, the hash itself; where they differ, the hash and the content's rank
among them.  A document then is a short ordered list of identifiers (its
recipe), and recipes are compared as values.  Texts move only as distinct
chunks, whole documents never.

Defined results: null and empty texts (and texts of white space only) have the
empty recipe and equal each other.  Repeated rows are rows like others; of rows
that tie in length and doc_id the group counts each, and ``kept`` marks all rows
that carry the kept doc_id with the kept length.  A null doc_id sorts after all
others.  An empty table gives an empty result.  Other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import SPACE_CLASS, own_name, staged

#: Characters of a chunk: least, and most where no border comes.
MIN_CHUNK, MAX_CHUNK = 384, 4096
#: A chunk ends after one of these two-character patterns (roughly one position
#: in a hundred of Latin text, one in 256 of others): letters of a class followed
#: by letters of another, or a character whose code has chosen low bits.
BORDER = r"[aeiou][dkpuvz]|[^\x00-\x{24F}]{2}[\x{400}-\x{4FF}\x{600}-\x{6FF}\x{4E00}-\x{52FF}\x{AC00}-\x{AFFF}]"


def normal_text(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+", "")


def chunks(key: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The ordered chunks of a normalised text; joined they are that text."""
    return F.regexp_extract_all(key, F.lit(rf"(?s).{{{least},{most}}}?(?:{BORDER})|.{{1,{most}}}"), F.lit(0))


def _hashed(chunk: Column, bits: int) -> Column:
    """The chunk's key: two 64-bit hashes; fewer bits only in tests of collisions."""
    first, second = F.xxhash64(chunk), F.xxhash64(F.lit("second"), chunk)
    if bits < 128:
        first, second = F.pmod(first, F.lit(1 << min(bits, 62))), F.lit(0).cast("long")
    return F.struct(first.alias("a"), second.alias("b"))


def recipes(docs: DataFrame, id_col: str, text_col: str, bits: int = 128, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """doc_id, text_id (a hash of the original), n_chars (of the original), text_sha256 and the recipe of each row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars"), normal_text(F.col(text_col)).alias("key"))
    base = base.select("doc_id", "text_id", "n_chars", F.sha2(F.col("key").cast("binary"), 256).alias("text_sha256"), chunks(F.col("key"), least, most).alias("chunk"))
    pieces = base.select(F.explode("chunk").alias("chunk")).select(_hashed(F.col("chunk"), bits).alias("h"), "chunk")
    # One row for each distinct content (combined before the shuffle), then the
    # hashes under which more than one content lies.
    contents = pieces.groupBy("h").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low != high").select("h")
    clashes = staged(contents, even=True)
    if clashes.isEmpty():  # each hash has one content: it is the identifier
        return base.select("doc_id", "text_id", "n_chars", "text_sha256", F.transform("chunk", lambda c: _hashed(c, bits)).alias("recipe"))
    ranked = (
        pieces.join(clashes, "h", "left_semi").distinct().groupBy("h")
        .agg(F.array_sort(F.collect_list("chunk")).alias("contents"))
        .select("h", F.posexplode("contents").alias("rank", "chunk"))
    )
    row = F.struct("doc_id", "text_id", "n_chars", "text_sha256", F.monotonically_increasing_id().alias("n"))
    placed = staged(base.withColumn("row", row).select("row", F.posexplode_outer("chunk").alias("at", "chunk")).withColumn("h", _hashed(F.col("chunk"), bits)))
    known = placed.join(ranked.withColumnRenamed("chunk", "content"), (placed.h == ranked.h) & (placed.chunk == F.col("content")), "left").select("row", "at", placed.h.alias("h"), "rank")
    part = F.struct(F.col("at"), F.struct(F.col("h.a").alias("a"), F.struct(F.col("h.b"), F.coalesce("rank", F.lit(0))).alias("b")).alias("id"))
    listed = known.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), part))).alias("parts"))
    return listed.select("row.doc_id", "row.text_id", "row.n_chars", "row.text_sha256", F.transform("parts", lambda p: p["id"]).alias("recipe"))


def _judged(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """Every row with its group's kept row.

    Both sides of the last join are plain scans, so that adaptive execution can
    split a recipe that a large part of all rows shares.
    """
    listed = staged(recipes(docs, id_col, text_col, bits))
    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("null"), "doc_id")
    groups = listed.groupBy("recipe").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = staged(groups, even=True)
    found = listed.join(groups.withColumnRenamed("recipe", "theirs"), F.col("recipe") == F.col("theirs"), "left")
    kept = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_chars") == -F.col("best.n")))
    keep_id = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return found.select("doc_id", "text_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Of equal texts the row with the most characters stays, then the smallest doc_id.
    """
    return _judged(docs, id_col, text_col, bits).drop("text_id")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, exactly one for each distinct text, with all their columns.

    Rows are told apart by id and text, so other texts under the same (or a null)
    id are not touched; of rows that tie in everything that counts, any one stays.
    """
    judged = staged(_judged(docs, id_col, text_col, 128))
    id_, hash_ = own_name(docs, "dropped_id"), own_name(docs, "dropped_text")
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("text_id").alias(hash_)).distinct()
    left = docs.join(gone, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col)) == F.col(hash_)), "left_anti")
    # Rows that tie in id and length are all marked as kept: rare, and one is enough.
    twice = staged(judged.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1").select(F.col("doc_id").alias(id_)).distinct(), even=True)
    if twice.isEmpty():
        return left
    same = F.col(id_col).eqNullSafe(F.col(id_))
    key = own_name(docs, "text_key")
    single = left.join(twice, same, "left_semi").withColumn(key, normal_text(F.col(text_col))).dropDuplicates([id_col, key]).drop(key)
    return left.join(twice, same, "left_anti").unionByName(single)
