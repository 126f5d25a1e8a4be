"""MinHash near-dedup with exact confirmation.

1. One scan makes, for each document, its number of distinct word shingles, a
   128-bit key of the shingle set, many universal hash minima h(x) = a*x + b
   (mod 2^64), the band keys (hashes of consecutive minima) and the signature
   (one byte of each minimum).  Documents with the same set form a class, whose
   smallest doc_id stands for it from here on.
2. Classes that share a band key form a bucket.  Every member is compared with
   its bucket's smallest member (its centre): signatures first, then the full
   shingle sets.  Confirmed links give components by alternating large-star and
   small-star, or in one task where the edges are few.
3. Buckets whose other members still lie in several components may hide links
   between them.  Where many members do (a template with other words in each),
   a prefix filter comes first: shingles are ordered by rarity, and a link of the
   wanted similarity needs a common shingle among the rarest ones of both sets;
   members that share none with a member of another component drop out, the
   others fall into clusters that share some, and only members of one cluster are
   compared.  In such a bucket the members outside its largest component ask
   all others: tasks hold a block of members and a block of askers, compare
   signatures as matrices, and pass on, for each asker, the list of members in
   other components that the signatures support; a pair is passed on from the
   first band that it shares only.  The full sets decide again, task by task,
   until a link has joined the components in question.  As only components are
   wanted, pairs inside one component need no comparison.  So no bucket is
   capped, pairs are never rows, and no link that shares a band key is lost.

With 32 bands of 5 minima a link at similarity 0.85 is missed with probability
(1 - 0.85^5)^32 < 1e-7; one at 0.8 with (1 - 0.8^5)^32 < 4e-6.  The signature
filter admits what is within six standard deviations of the threshold, so that it
loses a link right at the threshold once in some ten million; the prefix filter
loses none.

Defined results: a document without words has no shingles, is its own component
and stays.  With fewer words than a shingle the whole sequence is one.  Rows that
repeat a doc_id are one document: they share a component, which links of any of
them join.  A row with a null doc_id is linked with nothing, has a null
component and stays.  Other columns of the input are ignored here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.llm.common import own_name, staged
from scanloom.llm.text_kernels import Words, byte_runs, gram_hashes, mix64, sequence_hash, text_bytes

BANDS, ROWS, SHINGLE = 32, 5, 5
#: Members of a block in step 3 and of a task that confirms links with a centre; askers of a block.
BLOCK, ASKERS = 256, 4096
#: Members from which on a bucket goes through the prefix filter; shingles of a row there.
CROWD, PIECE = 1024, 4096
#: Edges up to which one task finds the components.
FEW_EDGES = 1 << 20
_RUN = 1 << 20


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    draw = lambda: rng.integers(0, 1 << 64, size=n, dtype=np.uint64, endpoint=False)
    return draw() | np.uint64(1), draw()


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    for begin, end in byte_runs(texts, _RUN):
        words = Words([x.lower() for x in texts[begin:end]])
        for i in range(end - begin):
            own = words.hashes[words.first[i] : words.first[i + 1]]
            yield np.unique(gram_hashes(own, n)) if len(own) >= n else (np.array([sequence_hash(own)]) if len(own) else own)


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The len(sets) x len(a) minima of a*x + b over each (non-empty) set."""
    out = np.empty((len(a), len(sets)), dtype=np.uint64)
    begin = 0
    while begin < len(sets):  # few enough items at a time to stay in the CPU's cache
        end, size = begin + 1, len(sets[begin])
        while end < len(sets) and size + len(sets[end]) <= 1 << 15:
            size += len(sets[end])
            end += 1
        items = np.concatenate(sets[begin:end])
        at = np.zeros(end - begin, dtype=np.int64)
        np.cumsum([len(x) for x in sets[begin : end - 1]], out=at[1:])
        for k in range(len(a)):
            hashed = items * a[k]
            hashed += b[k]
            out[k, begin:end] = np.minimum.reduceat(hashed, at)
        begin = end
    return out.T


def _sketch(shingle: int, bands: int, rows: int):
    """The batch function of step 1; input id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers(bands * rows)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for begin, end in byte_runs(texts, _RUN):
                sets = list(shingle_sets(texts[begin:end], shingle))
                sizes = np.array([len(x) for x in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                low = np.zeros((len(sets), bands * rows), dtype=np.uint64)
                if len(full):
                    low[full] = minima([sets[i] for i in full], a, b)
                low = mix64(low)
                keys = np.stack([mix64(gram_hashes_rows(low[:, k * rows : (k + 1) * rows]) + np.uint64(k)) for k in range(bands)], axis=1).view(np.int64)
                signature = (low & np.uint64(0xFF)).astype(np.uint8)
                one, two = (np.array([_set_key(x, seed) for x in sets], dtype=np.uint64).view(np.int64) for seed in (1, 2))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin), pa.array(sizes), pa.array(one), pa.array(two),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1))),
                        pa.array([x.tobytes() for x in signature], type=pa.binary()),
                    ],
                    names=["id", "n", "a", "b", "keys", "signature"],
                )

    return run


def gram_hashes_rows(x: np.ndarray) -> np.ndarray:
    """One hash of each row of a matrix."""
    out = np.zeros(len(x), dtype=np.uint64)
    for column in x.T:
        out = mix64(out ^ column) + np.uint64(0x9E3779B97F4A7C15)
    return out


def _set_key(x: np.ndarray, seed: int) -> int:
    """A key of a set: of its items mixed with a seed, their sum, and its size."""
    return int(mix64(mix64(x + np.uint64(seed)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x)))[0])


def _linked(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    if 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
        return False
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(left) + len(right) - both)


def _confirm(shingle: int, percent: int):
    """Of one task's proposals, the links that join components.

    A proposal is a member x with its component and a list of others with theirs.
    A pair whose components are already joined inside the task is passed over.
    """

    def run(proposals: pa.Table, members: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        ids = members.column("id").to_pylist()
        for i, found in zip(ids, shingle_sets(text_bytes(members.column("text").combine_chunks()), shingle), strict=True):
            sets.setdefault(i, []).append(found)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        out = []
        for row in proposals.to_pylist():
            x = row["x"]
            for y, label in zip(row["others"], row["other_labels"], strict=True):
                if (p := top(row["label"])) != (q := top(label)) and any(_linked(s, t, percent) for s in sets.get(x, ()) for t in sets.get(y, ())):
                    root[max(p, q)] = min(p, q)
                    out.append((x, y))
        return pa.table({"x": pa.array([x for x, _ in out], pa.int64()), "y": pa.array([y for _, y in out], pa.int64())})

    return run


PROPOSAL = "task string, x long, label long, others array<long>, other_labels array<long>"


def confirmed(proposed: DataFrame, members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The proposed links (x, y) that full sets confirm.  members: of, id (whose texts each task needs); texts: id, text."""
    held = members.join(texts, "id").select("of", "id", "text")
    return proposed.groupBy("task").cogroup(held.groupBy("of")).applyInArrow(_confirm(shingle, percent), "x long, y long")


def _pieces(shingle: int):
    """Texts of an id to the shingles of each set, cut to rows of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for begin, end in byte_runs(texts, _RUN):
                rows = []
                for i, own in enumerate(shingle_sets(texts[begin:end], shingle)):
                    key = np.array([_set_key(own, 1)], dtype=np.uint64).view(np.int64)[0]
                    rows += [(begin + i, key, len(own), k, own[k : k + PIECE].view(np.int64)) for k in range(0, len(own), PIECE)]
                at, keys, sizes, places, lists = zip(*rows, strict=True) if rows else [()] * 5
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, pa.int64()) for c in (keys, sizes, places)), pa.array(lists, pa.list_(pa.int64()))], names=["id", "label", "own", "n", "place", "hs"])

    return run


def prefix_clusters(crowd: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, label (a cluster) of the ids that may be linked across labels.  crowd: id, label; texts: id, text.

    A pair of sets x and y, x not larger, with 100 both >= percent (x + y - both)
    has both >= 2 percent x / (100 + percent) and both >= percent y / 100.  In any
    common order, its first common shingle thus stands among the first
    x - 2 percent x / (100 + percent) + 1 of x, which asks, and among the first
    y - percent y / 100 + 1 of y.  The order is: shingles of one label only, then
    rarer ones before common ones.
    """
    sets = crowd.join(texts, "id").select("id", "label", "text").mapInArrow(_pieces(shingle), "id long, label long, own long, n long, place long, hs array<long>")
    rows = staged(sets.dropDuplicates(["id", "own", "place"])).select("id", "label", "own", "n", F.explode("hs").alias("h"))
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h", "times")
    each = Window.partitionBy("id", "own")
    ranked = rows.join(shared, "h").withColumn("rank", F.col("n") - F.count(F.lit(1)).over(each) + F.row_number().over(each.orderBy("times", "h")) - 1)
    ask = F.col("n") - F.expr(f"(2 * {percent} * n + {99 + percent}) div {100 + percent}")
    answer = F.col("n") - F.expr(f"({percent} * n + 99) div 100")
    prefix = staged(ranked.where(F.col("rank") <= answer).select("h", "id", "label", (F.col("rank") <= ask).alias("asks")))
    groups = prefix.groupBy("h").agg(F.min("id").alias("x"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("asks").alias("asked")).where("asked and low < high").select("h", "x")
    return components(prefix.join(groups, "h").select("x", F.col("id").alias("y")).distinct())


def _agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal signature bytes of each pair of rows, as counts."""
    return (left[:, None, :] == right[None, :, :]).sum(axis=2, dtype=np.int16)


def _across(least: int):
    """Step 3 in one task: what each asker's signature supports among the members of other components.

    A last row without x lists all ids that the task's proposals name.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        task = ":".join(str(k.as_py()) for k in key)
        id_, label, asks, outside = (np.asarray(table.column(c)) for c in ("id", "label", "asks", "outside"))
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint8).reshape(len(id_), -1)
        keys = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(len(id_), -1)
        band = int((keys[0] == key[0].as_py()).argmax())
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        rows, named = [], set()
        for begin in range(0, len(left), 16):  # a few askers at a time bound the matrices
            own = left[begin : begin + 16]
            count = _agreement(signature[own], signature[right])
            good = (count >= least) & (label[own][:, None] != label[right][None, :])
            good &= ~outside[right][None, :] | (id_[own][:, None] < id_[right][None, :])
            for i in np.flatnonzero(good.any(axis=1)):
                at = np.flatnonzero(good[i])
                at = at[(keys[own[i]][:band] != keys[right[at]][:, :band]).all(axis=1)]
                if len(at):
                    at = right[at[np.argsort(-count[i][at], kind="stable")]]
                    rows.append((task, int(id_[own[i]]), int(label[own[i]]), id_[at].tolist(), label[at].tolist()))
                    named.update([rows[-1][1], *rows[-1][3]])
        if named:
            rows.append((task, None, None, sorted(named), []))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("task", "x", "label", "others", "other_labels"), columns, types, strict=True)})

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All (x, y) edges to (node, label): roots hook onto smaller neighbours, then every node goes to its root."""
    pairs = [np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))]) for b in batches if b.num_rows]
    if not pairs:
        return
    nodes, ends = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
    ends = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        tops = np.sort(label[ends], axis=0)
        tops = tops[:, tops[0] != tops[1]]
        if not tops.shape[1]:
            break
        np.minimum.at(label, tops[1], tops[0])
        while ((above := label[label]) != label).any():
            label = above
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of every node of the (x, y) edges.

    Up to ``FEW_EDGES`` edges (16 MB) are one task's work.  More take alternating
    large-star and small-star: each round is two aggregates and joins over the
    edges, never a group in one task; minima are combined before the shuffle and
    AQE can split a hub's edges in the joins.
    """
    big, small = F.greatest("x", "y"), F.least("x", "y")
    edges = staged(edges.where("x != y").select(big.alias("x"), small.alias("y")).distinct())
    if edges.count() <= FEW_EDGES:
        return staged(edges.coalesce(1).mapInArrow(_joined, "node long, label long"))
    before = None
    while not edges.isEmpty():
        # large-star: every neighbour above u goes to the least of u and its neighbours
        both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = staged(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("u"), F.least("x", "m").alias("m")), even=True)
        large = staged(edges.join(low, F.col("y") == F.col("u")).select("x", F.col("m").alias("y")).where("x != y").distinct(), even=True)
        # small-star: u and its lower neighbours go to the least of those
        least = large.groupBy("x").agg(F.min("y").alias("m")).withColumnRenamed("x", "u")
        lower = large.join(least, F.col("x") == F.col("u")).select(F.col("y").alias("x"), F.col("m").alias("y"))
        edges = staged(lower.union(least.select(F.col("u").alias("x"), F.col("m").alias("y"))).where("x != y").distinct(), even=True)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:  # the edges no longer change: stars
            break
        before = now
    return edges.select(F.col("x").alias("node"), F.col("y").alias("label")).union(edges.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
    shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    hashes, share = bands * rows, percent / 100
    least = int(np.floor(hashes * share - 6 * np.sqrt(hashes * share * (1 - share))))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = "id long, n long, a long, b long, keys array<long>, signature binary"
    base = staged(source.mapInArrow(_sketch(shingle, bands, rows), sketch))

    # 1. classes of equal sets
    known = base.where("n > 0 and id is not null")
    classes = staged(known.groupBy("a", "b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")))
    stands = classes.select(F.col("rep").alias("id"), "a", "b")
    reps = staged(known.join(stands, ["id", "a", "b"], "left_semi").dropDuplicates(["id", "a", "b"]).select("id", "keys", "signature"))

    # 2. buckets, centres, confirmed links with centres
    placed = reps.select("id", F.explode("keys").alias("key"))
    buckets = staged(placed.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre != last").drop("last"))
    filed = staged(placed.join(buckets, "key"), even=True)
    sided = filed.where("id != centre").select(F.col("centre").alias("x"), F.col("id").alias("y")).distinct()
    for side in ("x", "y"):
        sided = sided.join(reps.select(F.col("id").alias(side), F.col("signature").alias(f"of_{side}")), side)
    supported = staged(sided.select("x", "y", "of_x", "of_y").mapInArrow(_supported(least), "x long, y long"))
    parts = staged(supported.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).withColumnRenamed("x", "centre"))
    task = F.concat_ws(":", F.col("x").cast("string"), F.pmod(F.xxhash64("y"), "parts").cast("string"))
    first = supported.join(parts, F.col("x") == F.col("centre")).groupBy(task.alias("task"), "x").agg(F.collect_list("y").alias("others"))
    first = staged(first.select("task", "x", F.col("x").alias("label"), "others", F.col("others").alias("other_labels")))
    needed = first.select(F.col("task").alias("of"), F.explode(F.array_append("others", F.col("x"))).alias("id"))
    texts = staged(source.join(filed.select("id").distinct(), "id", "left_semi"))
    links = staged(confirmed(first, needed, texts, shingle, percent).union(_repeats(known, classes)))
    labels = components(links)

    # 3. links that buckets with several components may still hide
    judged = filed.where("id != centre").join(labels.withColumnRenamed("node", "id"), "id", "left")
    judged = staged(judged.select("key", "id", F.coalesce("label", "id").alias("label")), even=True)
    ajar = _ajar(judged, ["key"])
    full = ajar.where(F.col("n") >= CROWD).select("key")
    crowd = staged(judged.join(full, "key", "left_semi").select("id", "label").distinct())
    close = judged.join(ajar.where(F.col("n") < CROWD), "key").select("key", "id", "label", F.lit(None).cast("long").alias("cluster"))
    if not crowd.isEmpty():
        clusters = prefix_clusters(crowd, texts, shingle, percent).select(F.col("node").alias("id"), F.col("label").alias("cluster"))
        close = close.union(judged.join(full, "key", "left_semi").join(clusters, "id").select("key", "id", "label", "cluster"))
    close = staged(close.withColumn("cluster", F.coalesce("cluster", F.lit(_NONE))), even=True)
    held = close.join(_ajar(close, ["key", "cluster"]), ["key", "cluster"]).join(reps, "id").withColumn("outside", F.col("label") != F.col("main"))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    place = lambda block, round_, asks: F.struct(block.alias("block"), round_.alias("round"), F.lit(asks).alias("asks"))
    answers = F.transform(upto("rounds"), lambda r: place(F.pmod(F.xxhash64("id"), "blocks"), r, False))
    asking = F.transform(upto("blocks"), lambda b: place(b, F.pmod(F.xxhash64(F.lit(1), "id"), "rounds"), True))
    dealt = held.withColumn("at", F.explode(F.when(F.col("outside"), F.concat(answers, asking)).otherwise(answers)))
    dealt = dealt.select("key", "cluster", "at.block", "at.round", "at.asks", "id", "label", "outside", "signature", "keys")
    hidden = staged(dealt.groupBy("key", "cluster", "block", "round").applyInArrow(_across(least), PROPOSAL))
    needed = hidden.where("x is null").select(F.col("task").alias("of"), F.explode("others").alias("id"))
    more = staged(confirmed(hidden.where("x is not null"), needed, texts, shingle, percent))
    if not more.isEmpty():
        labels = components(links.union(more))

    named = staged(classes.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.coalesce("label", "rep").alias("component_id")))
    found = base.join(named, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")) & F.col("id").isNotNull() & (F.col("n") > 0), "left")
    found = found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: The cluster of members of small buckets, which are no id's cluster.
_NONE = -(1 << 63)


def _ajar(members: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose members lie in several components: the largest one, members, blocks and rounds of askers."""
    n = members.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    shares = n.groupBy(*keys).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    return staged(shares.where("n > most").select(*keys, "main", "n", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("most")) / ASKERS).alias("rounds")))


def _supported(least: int):
    """Pairs (x, y, and both signatures) that agree in ``least`` places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array((one == two).sum(axis=1) >= least))

    return run


def _repeats(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (x, y) between the classes of a doc_id that has several texts."""
    key = F.struct("a", "b")
    several = known.groupBy("id").agg(F.min(key).alias("one"), F.max(key).alias("two")).where("one != two").select("id")
    of = staged(known.join(several, "id", "left_semi").select("id", "a", "b").distinct().join(classes.select("a", "b", "rep"), ["a", "b"]).select("id", "rep"), even=True)
    low = staged(of.groupBy("id").agg(F.min("rep").alias("x")), even=True)
    return of.join(low, "id").where("x != rep").select("x", F.col("rep").alias("y"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns."""
    gone = near_groups(docs, id_col, text_col, percent).where(~F.col("kept")).select(F.col("doc_id").alias(theirs := own_name(docs, "dropped_id"))).distinct()
    return docs.join(gone, F.col(id_col) == F.col(theirs), "left_anti")
