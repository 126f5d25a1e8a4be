"""Time-series joins and windows over tracks.

As-of joins sort the union of both sides by key and time in one window, so each
track is shuffled once and nothing is multiplied.  A track that is too long for
one task can be cut: pass ``bucket_ns`` and only the last and first poses of each
time bucket travel to the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.config import PoseBufferConfig
from scanloom.functions import geometry as G


def bracket(targets: DataFrame, poses: DataFrame, keys: list[str], stamp: str = "stamp_ns", bucket_ns: int | None = None) -> DataFrame:
    """Each target with the last row at or before it (``prev``) and the first after it (``next``), as structs.

    Rows of equal stamps: the first by the row's values counts as the last at or
    before.  ``targets`` keep all their columns.
    """
    payload = F.struct(stamp, *[c for c in poses.columns if c not in (*keys, stamp)])
    left = targets.select(*keys, F.col(stamp).alias("_t"), F.struct(*targets.columns).alias("_row"), F.lit(None).cast(poses.select(payload.alias("p")).schema["p"].dataType).alias("_p"))
    firsts = poses.groupBy(*keys, stamp).agg(F.min(payload).alias("_p"))
    right = firsts.select(*keys, F.col(stamp).alias("_t"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), "_p")
    both = right.unionByName(left)
    part = [F.col(k) for k in keys]
    if bucket_ns:
        both = both.withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_ns)))
        part = [*part, F.col("_b")]
    # poses stand before targets of the same stamp, for "at or before"; after them for "after"
    target = F.col("_p").isNull().cast("int")
    w = Window.partitionBy(*part).orderBy(F.col("_t"), target)
    # "after" as a running value of the reverse order: a frame that reaches to the
    # end would be computed anew for every row
    back = Window.partitionBy(*part).orderBy(F.col("_t").desc(), target.desc())
    out = both.withColumns({
        "prev": F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "next": F.last("_p", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
    }).where(F.col("_row").isNotNull())
    if bucket_ns:
        edges = both.where("_p is not null").groupBy(*keys, "_b").agg(F.max(F.struct(F.col(f"_p.{stamp}"), "_p")).alias("_hi"), F.min(F.struct(F.col(f"_p.{stamp}"), "_p")).alias("_lo"))
        grid = out.select(*keys, "_b").distinct().join(edges, [*keys, "_b"], "full")
        by, down = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys).orderBy(F.col("_b").desc())
        carried = grid.select(*keys, "_b", F.last("_hi._p", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.last("_lo._p", True).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
        out = out.join(carried, [*keys, "_b"]).withColumns({"prev": F.coalesce("prev", "_before"), "next": F.coalesce("next", "_after")})
    return out.select("_row.*", "prev", "next")


def interpolate_poses(targets: DataFrame, poses: DataFrame, keys: list[str], config: PoseBufferConfig = PoseBufferConfig(), bucket_ns: int | None = None) -> DataFrame:
    """Targets (keys, stamp_ns) with the pose at their time, or nulls.

    Further columns of ``poses`` (such as frame and covariance) come from the pose
    at or before.  Null if the track has under two poses, the target lies before its first, a side
    is as old as the timeout or older, or the two sides are as far apart as the
    tolerance.  Past the last pose that pose itself, within the timeout.
    """
    found = bracket(targets, poses, keys, bucket_ns=bucket_ns)
    sizes = poses.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    found = found.join(sizes, keys, "left")
    prev, next_ = F.col("prev"), F.coalesce(F.col("next"), F.col("prev"))
    t, limit = F.col("stamp_ns"), int(config.timeout_sec * 1e9)
    span = next_["stamp_ns"] - prev["stamp_ns"]
    ratio = F.when(span > 0, F.least(F.greatest((t - prev["stamp_ns"]) / span, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    jump = G.distance([prev[c] for c in "xyz"], [next_[c] for c in "xyz"])
    good = (F.col("_size") >= 2) & prev.isNotNull() & (F.abs(t - prev["stamp_ns"]) < limit) & (F.abs(t - next_["stamp_ns"]) < limit) & (jump < config.distance_tolerance)
    good = F.coalesce(good, F.lit(False))
    position = {c: F.when(good, prev[c] + (next_[c] - prev[c]) * ratio) for c in "xyz"}
    turn = G.slerp([prev[c] for c in ("qx", "qy", "qz", "qw")], [next_[c] for c in ("qx", "qy", "qz", "qw")], ratio)
    turned = {c: F.when(good, v) for c, v in zip(("qx", "qy", "qz", "qw"), turn, strict=True)}
    rest = [c for c in poses.columns if c not in {*keys, "stamp_ns", *position, *turned, *targets.columns}]
    return found.withColumns({**position, **turned, **{c: F.when(good, prev[c]) for c in rest}, "valid": good}).drop("prev", "next", "_size")


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], tolerance_ns: int, strict: bool = False) -> DataFrame:
    """Left rows with the right row nearest in time (``other``), the earlier at ties; pairs beyond the tolerance are dropped."""
    found = bracket(left, right, keys)
    before, after = F.col("stamp_ns") - F.col("prev.stamp_ns"), F.col("next.stamp_ns") - F.col("stamp_ns")
    early = F.col("next").isNull() | (F.col("prev").isNotNull() & (before <= after))
    out = found.withColumn("other", F.when(early, F.col("prev")).otherwise(F.col("next"))).withColumn("gap_ns", F.when(early, before).otherwise(after))
    return out.where((F.col("gap_ns") < tolerance_ns) if strict else (F.col("gap_ns") <= tolerance_ns)).drop("prev", "next")


def lookup_transform(queries: DataFrame, transforms: DataFrame, warn_ns: int = 10_000_000_000) -> DataFrame:
    """queries (query_id, source, target, stamp_ns) with the transform that takes source points to target.

    A row of ``transforms`` says p_parent = T p_child; static ones hold always.
    Found directly, then inverted, then over one of three frames in between.  The
    nearest stamp counts, the latest if the query has none; ``stale`` marks those
    over ``warn_ns`` away.
    """
    q = queries.withColumns({"source": F.ltrim(F.col("source"), F.lit("/")), "target": F.ltrim(F.col("target"), F.lit("/"))})
    edges = transforms.withColumns({"parent": F.ltrim(F.col("parent"), F.lit("/")), "child": F.ltrim(F.col("child"), F.lit("/"))})
    values = F.struct("tx", "ty", "tz", "qx", "qy", "qz", "qw")
    forward = edges.select(F.col("child").alias("f"), F.col("parent").alias("t"), "stamp_ns", "is_static", F.struct(F.lit(0).alias("rank"), values.alias("v")).alias("e"))
    back_turn = G.quaternion_inverse(("qx", "qy", "qz", "qw"))
    back_shift = G.apply_rigid(G.rotation_quaternion(*back_turn), ("tx", "ty", "tz"), (0.0, 0.0, 0.0))
    names = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
    inverse_values = F.struct(*((-c).alias(n) for c, n in zip(back_shift, names[:3], strict=True)), *(c.alias(n) for c, n in zip(back_turn, names[3:], strict=True)))
    backward = edges.select(F.col("parent").alias("f"), F.col("child").alias("t"), "stamp_ns", "is_static", F.struct(F.lit(1).alias("rank"), inverse_values.alias("v")).alias("e"))
    both = forward.unionByName(backward)

    # Null stamps ask for the latest: the end of time.  Each kind of edge is one row
    # for a frame pair (static) or one bracket in time, so that nothing is multiplied.
    late = F.lit((1 << 63) - 1)
    q = q.withColumn("_at", F.coalesce("stamp_ns", late))
    usable = both.where("f is not null and t is not null").select(F.col("f").alias("_src"), F.col("t").alias("_dst"), F.col("stamp_ns").alias("_at"), "is_static", "e")
    fixed = usable.where("is_static").groupBy("_src", "_dst").agg(F.min(F.struct(F.col("e.rank").alias("rank"), F.lit(0).cast("long").alias("gap"), F.col("_at").alias("at"), F.col("e.v").alias("v"), F.lit(True).alias("fixed"))).alias("_fixed"))
    moving = [usable.where((~F.coalesce("is_static", F.lit(False))) & (F.col("e.rank") == r) & F.col("_at").isNotNull()).select("_src", "_dst", "_at", "e") for r in (0, 1)]

    # Every query asks for all its hops at once, a row each: the direct one, and to and from each frame between.
    hops = {"direct": (F.col("source"), F.col("target"))}
    for i, via in enumerate(MIDDLE_FRAMES):
        hops |= {f"a{i}": (F.col("source"), F.lit(via)), f"b{i}": (F.lit(via), F.col("target"))}
    asks = F.array(*(F.struct(F.lit(n).alias("_hop"), f.alias("_src"), t.alias("_dst")) for n, (f, t) in hops.items()))
    asked = q.withColumn("_query", F.monotonically_increasing_id()).withColumn("_ask", F.explode(asks)).select("*", "_ask.*").drop("_ask")
    best = []
    for r, edges_ in enumerate(moving):
        asked = bracket(asked, edges_, ["_src", "_dst"], "_at").withColumnsRenamed({"prev": f"_p{r}", "next": f"_n{r}"})
        for side in (f"_p{r}", f"_n{r}"):
            gap = F.when(F.col("stamp_ns").isNull(), -F.col(f"{side}._at")).otherwise(F.abs(F.col(f"{side}._at") - F.col("stamp_ns")))
            best.append(F.when(F.col(side).isNotNull(), F.struct(F.lit(r).alias("rank"), gap.alias("gap"), F.col(f"{side}._at").alias("at"), F.col(f"{side}.e.v").alias("v"), F.lit(False).alias("fixed"))))
    met = asked.join(fixed.withColumnsRenamed({"_src": "_fs", "_dst": "_fd"}), (F.col("_src") == F.col("_fs")) & (F.col("_dst") == F.col("_fd")), "left")
    met = met.withColumn("_best", F.least(*best, F.col("_fixed")))
    out = met.groupBy("_query").agg(*(F.first(c).alias(c) for c in ("query_id", "source", "target", "stamp_ns")), *(F.max(F.when(F.col("_hop") == n, F.col("_best"))).alias(n) for n in hops))
    chained = [F.when(F.col(f"a{i}").isNotNull() & F.col(f"b{i}").isNotNull(), compose(F.col(f"b{i}.v"), F.col(f"a{i}.v"))) for i in range(len(MIDDLE_FRAMES))]
    route = F.when(F.col("source") == F.col("target"), "same").when(F.col("direct").isNotNull(), F.when(F.col("direct.rank") == 0, "direct").otherwise("inverse"))
    for i, via in enumerate(MIDDLE_FRAMES):
        route = F.coalesce(route, F.when(F.col(f"a{i}").isNotNull() & F.col(f"b{i}").isNotNull(), F.lit(via)))
    same = F.when(F.col("source") == F.col("target"), F.struct(*(F.lit(1.0 if n == "qw" else 0.0).alias(n) for n in names)))
    stale = F.coalesce(~F.col("direct.fixed") & F.col("stamp_ns").isNotNull() & (F.col("direct.gap") > warn_ns), F.lit(False))
    return out.select("query_id", "source", "target", F.coalesce(route, F.lit("none")).alias("route"), F.coalesce(same, F.col("direct.v"), *chained).alias("transform"), stale.alias("stale"))


#: Frames tried between source and target.
MIDDLE_FRAMES = ("base_link", "base_footprint", "sensor_kit_base_link")


def compose(outer: Column, inner: Column) -> Column:
    """The transform that applies ``inner``, then ``outer`` (structs tx .. qw)."""
    t, q = ("tx", "ty", "tz"), ("qx", "qy", "qz", "qw")
    shift = G.apply_rigid(G.rotation_quaternion(*(outer[c] for c in q)), [inner[c] for c in t], [outer[c] for c in t])
    turn = G.quaternion_multiply([outer[c] for c in q], [inner[c] for c in q])
    return F.struct(*(v.alias(n) for v, n in zip([*shift, *turn], [*t, *q], strict=True)))


def oscillation(poses: DataFrame, keys: list[str], order: str, cosine: float = -0.9, limit: int = 10) -> DataFrame:
    """Per track the longest run of consecutive reversals, and whether it exceeds the limit."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = {f"d{c}": F.col(c) - F.lag(c).over(w) for c in "xyz"}
    moved = poses.withColumns(step)
    moved = moved.withColumns({f"p{c}": F.lag(f"d{c}").over(w) for c in "xyz"})
    dot = F.col("dx") * F.col("px") + F.col("dy") * F.col("py") + F.col("dz") * F.col("pz")
    norm = lambda p: F.sqrt(F.col(f"{p}x") * F.col(f"{p}x") + F.col(f"{p}y") * F.col(f"{p}y") + F.col(f"{p}z") * F.col(f"{p}z"))
    flip = F.coalesce((norm("d") >= 1e-10) & (norm("p") >= 1e-10) & (dot / (norm("d") * norm("p")) < cosine), F.lit(False))
    return longest_streak(moved.withColumn("flip", flip), keys, order, "flip").withColumn("oscillating", F.col("streak") > limit)


def longest_streak(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Per track the longest run of true flags (0 without)."""
    w = Window.partitionBy(*keys).orderBy(order)
    islands = df.withColumn("_island", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(*keys, "_island").agg(F.count_if(F.col(flag)).alias("_run"))
    return runs.groupBy(*keys).agg(F.max("_run").alias("streak"))


def running_streak(df: DataFrame, keys: list[str], order: str, flag: str, name: str = "streak") -> DataFrame:
    """Adds the number of true flags in a row up to each row."""
    w = Window.partitionBy(*keys).orderBy(order)
    islands = df.withColumn("_island", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn(name, F.sum(F.col(flag).cast("int")).over(inner)).drop("_island")


def jumps(poses: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``jump``: the distance to the row before (null for the first)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return poses.withColumn("jump", G.distance([F.col(c) for c in "xyz"], [F.lag(c).over(w) for c in "xyz"]))


def first_divergence(pairs: DataFrame, order: str, distance: str, threshold: float = 0.1) -> DataFrame:
    """The first row whose distance exceeds the threshold (an empty result if none does)."""
    return pairs.where(F.col(distance) > threshold).orderBy(order).limit(1)


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``inclusive`` and ``exclusive`` running sums."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(w)
    return df.withColumns({"inclusive": total, "exclusive": total - F.col(value)})


def segments(df: DataFrame, keys: list[str], order: list[str], code: str) -> DataFrame:
    """Run-length segments of equal codes: segment number, code, start (from 0) and length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumns({"_at": F.row_number().over(w) - 1, "_new": F.coalesce(F.lag(code).over(w) != F.col(code), F.lit(True)).cast("int")})
    marked = marked.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy(*keys, "segment").agg(F.first(code).alias("code"), F.min("_at").cast("long").alias("start"), F.count(F.lit(1)).alias("length"))


def map_clock(events: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Stamps mapped through reference points (stamp_ns, clock_ns), linear between and constant outside."""
    found = bracket(events, references.select(*keys, "stamp_ns", "clock_ns"), keys)
    prev, next_ = F.col("prev"), F.col("next")
    share = (F.col("stamp_ns") - prev["stamp_ns"]) / (next_["stamp_ns"] - prev["stamp_ns"])
    inside = prev["clock_ns"] + F.round(share * (next_["clock_ns"] - prev["clock_ns"])).cast("long")
    return found.withColumn("clock_ns", F.when(prev.isNull(), next_["clock_ns"]).when(next_.isNull(), prev["clock_ns"]).otherwise(inside)).drop("prev", "next")


def chained_guesses(alignments: DataFrame, keys: list[str], tolerance: float = 1e-3, order: str = "stamp_ns") -> DataFrame:
    """Whether each alignment began where the one before ended: ``chained`` and ``gap``, null for a track's first.

    ``alignments``: initial position ix, iy, iz and final x, y, z.  A matcher that
    feeds itself has long chains; one with its own odometry has none.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = [F.lag(c).over(w) for c in "xyz"]
    gap = G.distance([F.col(f"i{c}") for c in "xyz"], before)
    return alignments.withColumn("gap", gap).withColumn("chained", F.col("gap") <= tolerance)
