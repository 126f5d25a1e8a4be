"""Packing into optimal length buckets.

Every row is padded to the boundary of its bucket.  The boundaries come from a
dynamic programme over the histogram of all distinct lengths and are optimal: no
other choice of that many buckets pads less (of equally good choices the one
whose last bucket begins earliest, and so on downwards).  Inside a bucket rows
stand in the order of a hash of id and text, and consecutive rows form batches
of at most ``budget`` padded tokens.  Batch numbers come from counts of hashed
parts of bounded size, so no bucket is sorted in one task; only ids, lengths and
hashes move.  What the driver gets is the histogram: one row for each length
that occurs, at most as many as the longest text has tokens.

Defined results: null and empty texts have length 0 and stand in the first
bucket.  A row longer than the budget is a batch of its own, whole.  Rows equal
in id and text share their hash and stand beside each other in any order; more
than ``PART`` of them are ranked in several tasks, after their part's other rows.
Null ids are hashed as empty.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.llm.common import WORD, address, staged

BUCKETS, BUDGET = 16, 16384
#: Rows of a part whose rows are ranked together.
PART = 1 << 16


def word_count(text: Column) -> Column:
    """The default length: words and one end mark for non-empty texts."""
    n = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))
    return F.when(n > 0, n + 1).otherwise(0).cast("long")


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least padding in all.

    ``lengths`` are sorted and distinct.  A bucket of the lengths i to j - 1 pads
    to ``lengths[j - 1]``, so its cost is a line in that length whose slope depends
    on i alone: the best i for rising j is found on the lower hull of the lines,
    in as many steps as there are lengths, for each bucket more.
    """
    n = len(lengths)
    rows = [0]
    for c in counts:
        rows.append(rows[-1] + int(c))
    cost: list[int | None] = [0] + [None] * n  # of the first j lengths
    back = []
    for _ in range(min(buckets, n)):
        # the hull holds (i, cost[i]) whose lines cost[i] - x * rows[i] are lowest somewhere; slopes fall
        hull: list[int] = []
        at, fresh, best = 0, [0] + [None] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            i = j - 1
            if cost[i] is not None:
                while len(hull) - at > 1 and _useless(hull[-2], hull[-1], i, rows, cost):
                    hull.pop()
                hull.append(i)
            x = int(lengths[j - 1])
            value = lambda k: cost[k] - x * rows[k]  # noqa: B023, E731
            while len(hull) - at > 1 and value(hull[at + 1]) < value(hull[at]):
                at += 1
            if hull:
                best[j] = hull[at]
                fresh[j] = value(hull[at]) + x * rows[j]
        back.append(best)
        cost = fresh
    ends, j = [], n
    for best in reversed(back):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = best[j]
    return sorted(ends)


def _useless(a: int, b: int, c: int, rows: list[int], cost: list) -> bool:
    """Whether the line of b is nowhere strictly below those of a and c."""
    return (cost[b] - cost[a]) * (rows[c] - rows[b]) >= (cost[c] - cost[b]) * (rows[b] - rows[a])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, bucket (its padded length), batch (numbered in its bucket) and slot (place in the batch) of every row.

    Columns named in ``keep`` follow, whole: they are staged beside a row number
    and meet their row's place again at the end.
    """
    size = length if length is not None else word_count(F.col(text_col))
    if keep:
        own = [F.col(c).alias(f"kept_{c}") for c in keep]
        rows = staged(docs.select(F.col(id_col).alias("id"), size.alias("n_tokens"), address(id_col, text_col).alias("order"), F.monotonically_increasing_id().alias("row"), *own))
        places = _places(rows.select(F.struct("id", "row").alias("doc_id"), "n_tokens", "order"), buckets, budget)
        places = places.select("doc_id.row", F.col("doc_id.id").alias("doc_id"), "n_tokens", "bucket", "batch", "slot")
        whole = places.join(rows.select("row", *(f"kept_{c}" for c in keep)), "row")
        return whole.select("doc_id", "n_tokens", "bucket", "batch", "slot", *(F.col(f"kept_{c}").alias(c) for c in keep))
    return _places(staged(docs.select(F.col(id_col).alias("doc_id"), size.alias("n_tokens"), address(id_col, text_col).alias("order"))), buckets, budget)


def _places(rows: DataFrame, buckets: int, budget: int) -> DataFrame:
    """doc_id, n_tokens, bucket, batch and slot of (doc_id, n_tokens, order) rows."""
    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").collect()  # one row a length
    total = sum(r["n"] for r in histogram)
    ends = boundaries([r["n_tokens"] for r in histogram], [r["n"] for r in histogram], buckets)
    bucket = F.lit(None).cast("long")
    for end in reversed(ends):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(end).cast("long")).otherwise(bucket)
    parts = max(1, -(-total // PART))
    part = F.floor(F.shiftright("order", 28) * parts / F.lit(1 << 32)).cast("long")
    placed = rows.select("doc_id", "n_tokens", bucket.alias("bucket"), part.alias("part"), "order", F.lit(-1).cast("long").alias("heavy"), F.lit(0).cast("long").alias("share"))
    heavy = rows.groupBy("order").agg(F.ceil(F.count(F.lit(1)) / PART).alias("shares")).where("shares > 1")
    if not (heavy := staged(heavy, small=True)).isEmpty():  # equal rows by the ten thousands: dealt out by their place in the table
        dealt = placed.withColumn("place", F.monotonically_increasing_id()).join(heavy, "order", "left")
        dealt = dealt.withColumn("heavy", F.when(F.col("shares").isNotNull(), F.col("order")).otherwise(-1)).withColumn("share", F.when(F.col("shares").isNotNull(), F.pmod(F.xxhash64("place"), "shares")).otherwise(0))
        placed = staged(dealt.select(placed.columns))
    unit = ["bucket", "part", "heavy", "share"]
    counts = placed.groupBy(*unit).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("bucket").orderBy("part", "heavy", "share")
    before = counts.select(*(F.col(c).alias(f"of_{c}") for c in unit), (F.sum("n").over(running) - F.col("n")).alias("before"))
    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy(*unit).orderBy("order", "doc_id", "n_tokens")))
    same = [F.col(c) == F.col(f"of_{c}") for c in unit]
    rank = ranked.join(staged(before, small=True), same).withColumn("at", F.col("before") + F.col("nth") - 1)
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket", F.lit(1))))
    return rank.select("doc_id", "n_tokens", "bucket", F.floor(F.col("at") / each).alias("batch"), (F.col("at") % each).alias("slot"))
