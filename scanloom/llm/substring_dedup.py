"""Substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the least of the
hashes of its ``MINIMISER``-word runs; runs that are frequent in the corpus come
last in that order, so that no common phrase draws the windows around it into
one bucket.  Consecutive windows with the same minimiser travel as one packed
string (a super-k-mer) to the minimiser's bucket.

1. One scan counts runs of words in cells of bounded size and reports those that
   are frequent in a cell; their sum names every run with a share of 2 * SHARE or
   more of the corpus, and at most 1 / SHARE of them.
2. A second scan cuts cells into super-k-mers.  Inside a cell equal strings are
   combined: the smallest document asks the bucket, and all larger ones are
   covered without asking.  A cell sends at most one compressed block to a
   bucket, however often a string occurs in it.
   Windows are counted for each bucket before.  A bucket of more than LARGE windows
   gets its windows one by one, dealt by their own hash to parts of some BUCKET
   windows, so that equal windows stay together and no bucket grows with the
   corpus; a part of very many windows is dealt once more, by cell, and what its
   shares keep (one document a window) meets in a second round.
3. A bucket sorts its windows, finds each window's smallest document, compares
   the words of windows with equal hashes, and returns the covered word ranges.
4. Ranges meet their document and the words outside of them are kept.

Defined results: null and empty texts have no words.  Documents shorter than a
window lose nothing.  Windows are judged on the input.  Rows that repeat a
doc_id are one document for the comparison, and each keeps its own words.  A row
with a null doc_id loses nothing and takes nothing from others.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import staged
from scanloom.llm.text_kernels import Words, byte_runs, gram_hashes, mix64, span_hashes, text_bytes

WINDOW, MINIMISER = 13, 3
#: Share of a frequent run, windows of a bucket, windows of a super-k-mer; bytes of a cell.
SHARE, BUCKET, LONGEST, CELL = 2e-5, 1 << 18, 200, 6 << 20
#: Windows from which on a bucket is dealt to parts; a part is dealt to the root of
#: the bucket's number of parts over so many shares.
LARGE, PER_SHARE = 1 << 20, 4
_FIELDS = (("doc", "<i8"), ("row", "<i8"), ("start", "<u4"), ("windows", "<u2"))


def _cells(batches: Iterator[pa.RecordBatch], columns: int, cell: int) -> Iterator[tuple[list[list], list[bytes]]]:
    """Rows gathered to cells: the first ``columns`` columns as lists, the last as bytes."""
    held: list[list] = [[] for _ in range(columns)]
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        more = text_bytes(batch.column(columns))
        values = [batch.column(i).to_pylist() for i in range(columns)]
        for begin, end in byte_runs(more, max(cell // 8, 1)):
            for column, value in zip(held, values, strict=True):
                column.extend(value[begin:end])
            texts.extend(more[begin:end])
            size += sum(map(len, more[begin:end]))
            if size >= cell:
                yield held, texts
                held, texts, size = [[] for _ in range(columns)], [], 0
    if texts:
        yield held, texts


def _frequent(cell: int):
    """Of each cell its words (under a null run) and the runs frequent in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _cells(batches, 0, cell):
            words = Words(texts)
            runs, times = np.unique(gram_hashes(words.hashes, MINIMISER), return_counts=True)
            often = times >= max(2, SHARE * len(words.hashes))
            found = pa.array(runs[often].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(1, pa.int64()), found]), pa.array(np.concatenate([[len(words.hashes)], times[often]]).astype(np.int64))], names=["run", "n"])

    return run


_ONE_SPACE = bytes(32 if i in b"\t\n\x0b\x0c\r " else i for i in range(256))


def _single_spaced(texts: list[bytes]) -> Words:
    """The words of the texts with exactly one space between any two of a text."""
    texts = [x.translate(_ONE_SPACE) for x in texts]
    words = Words(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(words.first))
    if ((words.starts[1:] - words.ends[:-1] > 1) & (text_of[1:] == text_of[:-1])).any():
        words = Words([b" ".join(x.split()) for x in texts])
    return words


def _least_of_runs(order: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive items, in a logarithmic number of passes."""
    have = 1
    while 2 * have <= n:
        order = np.minimum(order[:-have], order[have:])
        have *= 2
    return np.minimum(order[: len(order) - (n - have)], order[n - have :]) if have < n else order


def super_kmers(words: Words, frequent: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser order) of every super-k-mer of a cell."""
    total = len(words.hashes)
    inside = np.zeros(total, dtype=bool)
    for i in range(len(words.first) - 1):
        inside[words.first[i] : max(words.first[i], words.first[i + 1] - WINDOW + 1)] = True
    at = np.flatnonzero(inside)
    if not len(at):
        return at, at, np.zeros(0, dtype=np.uint64)
    runs = gram_hashes(words.hashes, MINIMISER)
    order = mix64(runs) >> np.uint64(1)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)
        order |= (frequent[place] == runs).astype(np.uint64) << np.uint64(63)
    least = _least_of_runs(order, WINDOW - MINIMISER + 1)[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (text_of[at[1:]] != text_of[at[:-1]])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    if count.max() > LONGEST:  # very repetitive text: bounded pieces
        pieces = -(-count // LONGEST)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        count = np.minimum(np.repeat(count, pieces) - nth * LONGEST, LONGEST)
        begin = np.repeat(begin, pieces) + nth * LONGEST
    return at[begin], count, least[begin]


def _strings(texts: list[bytes], often: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a cell, the text of each, and of each super-k-mer its first window, windows, minimiser order and hash."""
    words = _single_spaced(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(words.first))
    at, count, order = super_kmers(words, often, text_of)
    content = span_hashes(words.buf, words.starts[at], words.ends[at + count + WINDOW - 2]) if len(at) else order
    return words, text_of, at, count, order, content


def _bucket_of(order: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(order) % np.uint64(buckets)).astype(np.int64)


def _sizes(frequent, buckets: int, cell: int):
    """Cells to the windows that they send to each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(frequent.value, dtype=np.uint64)
        for _, texts in _cells(batches, 0, cell):
            _, _, _, count, order, content = _strings(texts, often)
            _, one = np.unique(content, return_index=True)
            found, of = np.unique(_bucket_of(order[one], buckets), return_inverse=True)
            n = np.bincount(of, weights=count[one], minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["bucket", "n"])

    return run


def _cut(frequent, buckets: int, large, cell: int):
    """Cells to blocks for buckets, and word ranges that need no asking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(frequent.value, dtype=np.uint64)
        codec = pa.Codec("zstd", compression_level=6)
        for (rows, docs), texts in _cells(batches, 2, cell):
            yield _cell_blocks(np.array(rows, dtype=np.int64), np.array(docs, dtype=np.int64), texts, often, buckets, large.value, codec)

    return run


def _cell_blocks(rows: np.ndarray, docs: np.ndarray, texts: list[bytes], often: np.ndarray, buckets: int, large: np.ndarray, codec: pa.Codec) -> pa.RecordBatch:
    words, text_of, at, count, order, content = _strings(texts, often)
    begin, end = words.starts[at], words.ends[at + count + WINDOW - 2] if len(at) else at
    raw = words.buf.tobytes()
    doc = docs[text_of[at]]
    by = np.lexsort((doc, content))
    same = np.zeros(len(by), dtype=bool)  # same string as the one before it in this order
    hit = np.flatnonzero(content[by[1:]] == content[by[:-1]]) + 1
    b, e = begin[by], end[by]
    same[hit] = [raw[b[i] : e[i]] == raw[b[i - 1] : e[i - 1]] for i in hit.tolist()]
    group = np.cumsum(~same) - 1
    smallest = doc[by][~same]
    larger = np.zeros(len(by), dtype=bool)
    larger[by] = doc[by] > smallest[group] if len(by) else larger
    start = at - words.first[text_of[at]]
    covered = _merged(rows[text_of[at[larger]]], start[larger], start[larger] + count[larger] + WINDOW - 1)

    # what asks a bucket: strings, or the single windows of a large bucket's strings
    ask = np.flatnonzero(~larger)
    bucket = _bucket_of(order[ask], buckets)
    place = np.minimum(np.searchsorted(large[0], bucket), max(len(large[0]) - 1, 0))
    single = large[0][place] == bucket if len(large[0]) else np.zeros(len(ask), dtype=bool)
    first, windows = at[ask], count[ask]
    part, share = np.zeros(len(ask), dtype=np.int64), np.full(len(ask), -1)
    if single.any():
        lone = np.flatnonzero(single)
        entry = np.repeat(lone, windows[lone])
        each = first[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(windows[lone]) - windows[lone], windows[lone])
        parts, shares = large[1:, place[entry]]
        hashed = mix64(span_hashes(words.buf, words.starts[each], words.ends[each + WINDOW - 1]) + np.uint64(1))
        cell = int(mix64(np.array([rows[0] + 1], dtype=np.int64).view(np.uint64))[0] >> np.uint64(2))
        rest = np.flatnonzero(~single)
        first, windows = np.concatenate([first[rest], each]), np.concatenate([windows[rest], np.ones(len(each), dtype=windows.dtype)])
        part = np.concatenate([part[rest], (hashed % parts.astype(np.uint64)).astype(np.int64)])
        share = np.concatenate([share[rest], np.where(shares > 1, cell % shares, -1)])
        bucket = np.concatenate([bucket[rest], bucket[entry]])
    by = np.lexsort((part, bucket))
    first, windows, bucket, part, share = first[by], windows[by], bucket[by], part[by], share[by]
    cuts = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    bounds = np.append(cuts, len(first))
    blocks = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        own = first[low:high]
        owner = text_of[own]
        spans = zip(words.starts[own].tolist(), words.ends[own + windows[low:high] + WINDOW - 2].tolist(), strict=True)
        blocks.append(_block(docs[owner], rows[owner], own - words.first[owner], windows[low:high], b" ".join([raw[x:y] for x, y in spans]), codec))
    n, m = len(blocks), len(covered[0])
    zeros = np.zeros(m, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([bucket[cuts], covered[0] % max(buckets, 1)]), pa.int64()), pa.array(np.concatenate([part[cuts], zeros]), pa.int64()), pa.array(np.concatenate([share[cuts], zeros - 1]), pa.int64()),
            pa.array([*blocks, *[None] * m], pa.binary()), *(pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(c, pa.int64())]) for c in covered),
        ],
        names=["bucket", "part", "share", "block", "row", "low", "high"],
    )


def _block(doc: np.ndarray, row: np.ndarray, start: np.ndarray, windows: np.ndarray, body: bytes, codec: pa.Codec) -> bytes:
    """Entries and their strings, packed and compressed."""
    fields = {"doc": np.diff(doc, prepend=0), "row": row - doc, "start": start, "windows": windows}
    plain = b"".join([len(doc).to_bytes(8, "little"), *(fields[k].astype(t).tobytes() for k, t in _FIELDS), body])
    return len(plain).to_bytes(8, "little") + codec.compress(plain, asbytes=True)


def _merged(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Ranges of the same row that meet, as one."""
    if not len(row):
        return [np.zeros(0, dtype=np.int64)] * 3
    by = np.lexsort((low, row))
    row, low, high = row[by], low[by], high[by]
    new = np.ones(len(row), dtype=bool)
    # ranges come from windows of one length or runs of them: within a row their
    # ends rise with their starts except inside longer ones, hence the running end
    reach = _running_end(row, high)
    new[1:] = (row[1:] != row[:-1]) | (low[1:] > reach[:-1])
    begin = np.flatnonzero(new)
    return [row[begin], low[begin], np.maximum.reduceat(high, begin)]


def _running_end(row: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest end so far within each row (rows are sorted)."""
    nth = np.cumsum(np.diff(row, prepend=row[0]) != 0)
    shift = nth * (int(high.max()) + 1)
    return np.maximum.accumulate(high + shift) - shift


def _resolve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One bucket, part or share: the word ranges that a smaller document covers, and of a share what is left of it."""
    bucket, part, share = (k.as_py() for k in key)
    ready = [table.column(c).drop_null().to_numpy() for c in ("row", "low", "high")]
    blocks = [x for x in table.column("block").to_pylist() if x is not None]
    found, left = _bucket_ranges(blocks, share >= 0) if blocks else ([np.zeros(0, dtype=np.int64)] * 3, None)
    n, more = len(ready[0]) + len(found[0]), [left] if left else []
    ranges = [np.concatenate([a, b]) for a, b in zip(ready, found, strict=True)]
    out = {
        "bucket": pa.array(np.concatenate([ranges[0] % (1 << 20), [bucket] * len(more)]), pa.int64()), "part": pa.array(np.concatenate([np.full(n, -1), [part] * len(more)]), pa.int64()),
        "share": pa.array(np.full(n + len(more), -1), pa.int64()), "block": pa.array([*[None] * n, *more], pa.binary()),
    }
    return pa.table(out | {k: pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(len(more), pa.int64())]) for k, x in zip(("row", "low", "high"), ranges, strict=True)})


def _bucket_ranges(blocks: list[bytes], keep: bool) -> tuple[list[np.ndarray], bytes | None]:
    """The ranges lost; with ``keep`` (entries are single windows) also the entries not lost, as one block."""
    codec = pa.Codec("zstd")
    parts: dict[str, list[np.ndarray]] = {k: [] for k, _ in _FIELDS}
    bodies = []
    for block in blocks:
        plain = codec.decompress(block[8:], int.from_bytes(block[:8], "little"), asbytes=True)
        n, place = int.from_bytes(plain[:8], "little"), 8
        for k, t in _FIELDS:
            parts[k].append(np.frombuffer(plain, dtype=t, count=n, offset=place).astype(np.int64))
            place += n * np.dtype(t).itemsize
        parts["doc"][-1] = np.cumsum(parts["doc"][-1])
        bodies.append(plain[place:])
    doc, row, start, windows = (np.concatenate(parts[k]) for k in ("doc", "row", "start", "windows"))
    row = row + doc
    words = Words([b" ".join(bodies)], hashes=False)
    raw = words.buf.tobytes()
    first = np.cumsum(windows + WINDOW - 1) - (windows + WINDOW - 1)
    entry = np.repeat(np.arange(len(windows)), windows)
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = first[entry] + nth
    begin, end = words.starts[at], words.ends[at + WINDOW - 1]
    content = span_hashes(words.buf, begin, end)
    by = np.argsort(content, kind="stable")
    hit = np.flatnonzero(content[by[1:]] == content[by[:-1]]) + 1
    b, e = begin[by], end[by]
    same = np.zeros(len(by), dtype=bool)
    same[hit] = [raw[b[i] : e[i]] == raw[b[i - 1] : e[i - 1]] for i in hit.tolist()]
    if not same[hit].all():  # different words under one hash: sort those by the words themselves
        clash = np.isin(content, content[by[hit[~same[hit]]]])
        odd = np.flatnonzero(clash)
        spelled = sorted(odd.tolist(), key=lambda i: raw[begin[i] : end[i]])
        by = np.concatenate([by[~clash[by]], np.array(spelled, dtype=by.dtype)])
        b, e = begin[by], end[by]
        same = np.zeros(len(by), dtype=bool)
        same[1:] = [raw[b[i] : e[i]] == raw[b[i - 1] : e[i - 1]] for i in range(1, len(by))]
    owner = doc[entry]
    heads = np.flatnonzero(~same)
    smallest = np.empty(len(by), dtype=np.int64)
    smallest[by] = np.repeat(np.minimum.reduceat(owner[by], heads), np.diff(np.append(heads, len(by))))
    lost = np.flatnonzero(smallest < owner)
    low = start[entry[lost]] + nth[lost]
    left = None
    if keep:
        rest = np.flatnonzero(smallest == owner)
        body = b" ".join([raw[x:y] for x, y in zip(begin[rest].tolist(), end[rest].tolist(), strict=True)])
        left = _block(doc[rest], row[rest], start[rest], windows[rest], body, pa.Codec("zstd", compression_level=6))
    return _merged(row[entry[lost]], low, low + WINDOW), left


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, lows, highs, text to doc_id, n_words, n_removed and the kept words."""
    for batch in batches:
        out = []
        for text, lows, highs in zip(text_bytes(batch.column(3)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            if not lows:
                out.append((len(words), 0, b" ".join(words)))
                continue
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, lows, 1)
            np.add.at(edge, highs, -1)
            keep = np.cumsum(edge[:-1]) == 0
            kept = [words[i] for i in np.flatnonzero(keep).tolist()]
            out.append((len(words), len(words) - len(kept), b" ".join(kept)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "text"],
        )


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, large: int = LARGE, per_share: int = PER_SHARE, cell: int = CELL,
) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (one space between them) of every row."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    repeats = source.where("doc is not null").groupBy("doc").count().where("count > 1")
    plain = repeats.isEmpty() and source.where("doc is null").isEmpty()
    rows = source.withColumn("row", F.col("doc")) if plain else staged(source.withColumn("row", F.monotonically_increasing_id()))
    named = rows.where("doc is not null")

    counts = staged(named.select("text").mapInArrow(_frequent(cell), "run long, n long").groupBy("run").agg(F.sum("n").alias("n")), even=True)
    total = (counts.where("run is null").first() or {"n": 0})["n"]
    often = [r["run"] for r in counts.where((F.col("run").isNotNull()) & (F.col("n") >= max(2, SHARE * total))).collect()]
    frequent = spark.sparkContext.broadcast(np.sort(np.array(often, dtype=np.int64).view(np.uint64)).tobytes())
    buckets = max(8, -(-total // bucket))

    sizes = named.select("text").mapInArrow(_sizes(frequent, buckets, cell), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    over = [(r["bucket"], parts := -(-r["n"] // bucket), max(1, isqrt(parts) // per_share)) for r in sizes.where(F.col("n") > large).collect()]  # at most one for ``large`` windows
    dealt = np.array(sorted(over), dtype=np.int64).reshape(-1, 3).T

    schema = "bucket long, part long, share long, block binary, row long, low long, high long"
    blocks = named.select("row", "doc", "text").mapInArrow(_cut(frequent, buckets, spark.sparkContext.broadcast(dealt), cell), schema)
    ranges = blocks.groupBy("bucket", "part", "share").applyInArrow(_resolve, schema)
    if (dealt[2] > 1).any():
        ranges = ranges.groupBy("bucket", "part", "share").applyInArrow(_resolve, schema)
    ranges = ranges.where("row is not null")
    lost = ranges.groupBy("row").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")).withColumnRenamed("row", "lost_row")
    joined = rows.join(lost, F.col("row") == F.col("lost_row"), "left").select("doc", "lows", "highs", "text")
    return joined.mapInArrow(_strip, "doc_id long, n_words long, n_removed long, text string")
