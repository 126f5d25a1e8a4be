"""Benchmark decontamination by template windows.

A text becomes a sequence of tokens (runs of letters and digits, lower-cased).
Numbers, units after numbers and names are slots: a run of slots of one type
becomes one typed placeholder, whose value is remembered.  Windows are five
consecutive tokens, hashed, once with the words as they are (literal) and once
with placeholders (template).  A capitalised word that opens a text, line or
sentence may be a name or not, so template windows over it are made in both
readings: as a word, and as a name (``opened``).

1. The windows of the benchmark set bits of a bitmap of fixed size; one scan of
   the documents keeps the windows whose bit is set, as one row a document.
2. Candidates: an item that shares a share ``least`` of its windows with a
   document shares one of its rarest (1 - least) + 1 windows.  Only those are
   hash-joined with the documents' windows, so that a phrase that many items use
   makes no pairs.
3. Each candidate is judged on all its windows, of which only the item's own
   travel.  ``literal`` is the share of the item's literal windows that the
   document has.  ``template`` is the share of its template windows found whose
   slots agree with one mapping of the item's slot values to the document's (same
   value to same value, and no two names to one; numbers and units may coincide);
   every alignment of the item with the document is tried, so that a consistent
   copy counts wherever it stands, and of the item's two readings the better one
   counts.  Either at ``least`` or more is a leak: ``verbatim`` or
   ``reparameterised``.  (A changed word that is no slot costs five windows: an
   item of fewer than 29 tokens must be whole but for its slots.)

Defined results: null and empty texts match nothing; an item of fewer than five
tokens is no evidence and never matches.  Rows that repeat a doc_id or an
item_id are judged together, as one document (any of its texts) or one item
(all of its windows).  Rows with a null id match nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import own_name, staged
from scanloom.llm.text_kernels import Words, byte_runs, gram_hashes, mix64, span_hashes, text_bytes

WINDOW, LEAST = 5, 0.8
#: Bits of the bitmap: 4 MB, whatever the benchmark's size.
BITMAP_BITS = 25
_RUN = 1 << 20

#: Unit words that make a slot after a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes "
    "ounce ounces pound pounds lb lbs ml l liter liters litre litres gallon gallons second seconds sec minute minutes min "
    "hour hours day days week weeks month months year years percent degree degrees celsius fahrenheit kelvin dollar dollars "
    "euro euros cent cents usd eur joule joules watt watts kw volt volts amp amps newton newtons hz khz mhz ghz kb mb gb tb "
    "byte bytes bit bits mph kmh meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters"
).split()
_WORD_BYTES = np.ones(256, dtype=bool)
_WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, dtype=np.int32)
_ENDS[[0x0A, 0x21, 0x2E, 0x3A, 0x3F]] = 1
NUMBER, UNIT, NAME = 1, 2, 3


def _unit_hashes() -> np.ndarray:
    words = Words([x.encode() for x in UNITS])
    return np.sort(words.hashes)


class Templates:
    """Literal and template windows of a batch of texts."""

    def __init__(self, texts: list[bytes], units: np.ndarray) -> None:
        words = Words(texts, hashes=False, between=_WORD_BYTES)
        buf, starts, ends = words.buf, words.starts, words.ends
        lower = _LOWER[buf]
        lower[1:][(buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)] += 32  # accented capitals of Latin-1
        self.literal = span_hashes(lower, starts, ends)
        self.first = words.first
        head, second = buf[starts], buf[np.minimum(starts + 1, len(buf) - 1)]
        number = (head >= 48) & (head <= 57)
        capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        ended = np.concatenate([[0], np.cumsum(_ENDS[buf])])
        opening = np.ones(len(starts), dtype=bool)  # first of its text, line or sentence
        opening[1:] = ended[starts[1:]] > ended[ends[:-1]]
        opening[words.first[:-1][words.first[:-1] < len(starts)]] = True
        kind = np.zeros(len(starts), dtype=np.uint8)
        kind[capital & ~opening] = NAME
        kind[number] = NUMBER
        at = np.searchsorted(units, self.literal)
        is_unit = units[np.minimum(at, len(units) - 1)] == self.literal
        is_unit[1:] &= number[:-1]
        is_unit[:1] = False
        opened = kind.copy()
        opened[capital & opening] = NAME
        opened[is_unit & ~(capital & opening)] = UNIT
        kind[is_unit & ~opening] = UNIT
        self.kind, self.opened = kind, opened

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Literal window hashes, template window hashes, and of each template token its type and value."""
        own = slice(self.first[i], self.first[i + 1])
        literal = self.literal[own]
        template, kind, value, _ = _template(literal, self.kind[own])
        return gram_hashes(literal, WINDOW), template, kind, value

    def opened_of(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The reading with opening names, empty where it is the same: template window hashes, of each token its type,
        value and place among the tokens of the other reading, and whether a window differs from that reading's."""
        own = slice(self.first[i], self.first[i + 1])
        literal, changed = self.literal[own], self.opened[own] != self.kind[own]
        if not changed.any():
            return literal[:0], self.kind[:0], literal[:0], np.zeros(0, dtype=np.int64), changed[:0]
        template, kind, value, at = _template(literal, self.opened[own])
        place = np.searchsorted(_begins(self.kind[own]), at, side="right") - 1
        before = np.concatenate([[0], np.cumsum(np.add.reduceat(changed.astype(np.int64), at))])
        return template, kind, value, place, before[WINDOW:][: len(template)] > before[: len(template)]


def _begins(kind: np.ndarray) -> np.ndarray:
    begins = np.ones(len(kind), dtype=bool)
    begins[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1])
    return np.flatnonzero(begins)


def _template(literal: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window hashes, and of each template token its type, value and first word."""
    if not len(literal):
        return literal, kind, literal, np.zeros(0, dtype=np.int64)
    at = _begins(kind)
    value = np.add.reduceat(literal, at)
    token = np.where(kind[at] > 0, mix64(kind[at].astype(np.uint64)), value)
    return gram_hashes(token, WINDOW), kind[at], value, at


def _scan(bitmap):
    """Documents to rows of the windows whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, bits = _unit_hashes(), np.frombuffer(bitmap.value, dtype=np.uint8)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for begin, end in byte_runs(texts, _RUN):
                templates = Templates(texts[begin:end], units)
                rows = []
                for i in range(end - begin):
                    literal, template, kind, value = templates.of(i)
                    literal = np.unique(literal[_known(bits, literal)])
                    at = np.flatnonzero(_known(bits, template))
                    # Windows of the other reading follow, numbered after the tokens of the first
                    opened, opened_kind, opened_value, place, differs = templates.opened_of(i)
                    also = np.flatnonzero(differs & _known(bits, opened))
                    if len(literal) or len(at) or len(also):
                        near, at = np.concatenate([at, place[also]]), np.concatenate([at, also + len(kind)])
                        hashes = np.concatenate([template[at[: len(at) - len(also)]], opened[also]])
                        kind, value = np.concatenate([kind, opened_kind]), np.concatenate([value, opened_value])
                        covered = at[:, None] + np.arange(WINDOW)
                        rows.append((begin + i, literal, hashes, at, near, value[covered].reshape(-1), kind[covered].reshape(-1) == 0))
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in rows])), _lists([x[1] for x in rows]), _windows(rows)], names=["doc_id", "literal", "windows"])

    return run


def _offsets(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(_offsets(parts), pa.array(_signed(parts)))


def _signed(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64) for x in parts])


def _windows(rows: list[tuple]) -> pa.Array:
    """Of each row a list of windows: hash, token, place among the tokens of the first reading, slot values (null: a word)."""
    h, at, near, value = (_signed([x[k] for x in rows]) for k in (2, 3, 4, 5))
    slots = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * WINDOW), pa.array(value, mask=np.concatenate([x[6] for x in rows])))
    return pa.ListArray.from_arrays(_offsets([x[2] for x in rows]), pa.StructArray.from_arrays([pa.array(h), pa.array(at), pa.array(near), slots], names=["h", "at", "near", "slots"]))


def _known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


_ITEM = ("literal", "template", "kind", "value", "opened", "opened_kind", "opened_value", "opened_place")


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    units = _unit_hashes()
    for batch in batches:
        texts = text_bytes(batch.column(1))
        for begin, end in byte_runs(texts, _RUN):
            templates = Templates(texts[begin:end], units)
            rows = []
            for i in range(end - begin):
                own, opened = templates.of(i), templates.opened_of(i)[:4]
                like = np.searchsorted(opened[3], np.arange(len(own[1])), side="right") - 1
                beside = opened[0][like[like < len(opened[0])]] if len(opened[0]) else opened[0]
                beside = np.concatenate([beside, own[1][len(beside) :]])  # the window itself where there's no like
                rows.append((*own, *opened, beside))
            lists = [pa.array([np.asarray(x[k]).astype(np.uint64).view(np.int64) for x in rows], pa.list_(pa.int64())) for k in range(9)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *lists], names=["item_id", *_ITEM, "beside"])


def _judge(least: float):
    """Candidates (a document's windows that an item has, beside the item's) to their two shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                own = set(x["item_literal"])
                literal = len(own & set(x["literal"])) / len(own) if own else 0.0
                out.append((x["doc_id"], x["item_id"], literal, _template_share(x, least)))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "literal", "template"])

    return run


def _template_share(x: dict, least: float) -> float:
    """The share of the item's template windows found with consistent slots: in either reading alone, or in the one
    where words open sentences, with the other's windows for those that aren't found."""
    places: dict[int, list[tuple[int, int]]] = {}
    theirs: dict[int, int] = {}
    for w in x["windows"]:
        places.setdefault(w["h"], []).append((w["near"], w["at"]))
        theirs.update((w["at"] + k, v) for k, v in enumerate(w["slots"]) if v is not None)
    for found in places.values():
        found.sort()
    words = (x["item_template"], x["item_kind"], x["item_value"], range(len(x["item_kind"])))
    opened = (x["item_opened"], x["item_opened_kind"], x["item_opened_value"], x["item_opened_place"])
    ways = [[words], [opened], [words, opened]] if opened[0] else [[words]]
    return max(_share(way, places, theirs, least) for way in ways)


def _nearest(found: list[tuple[int, int]], target: int) -> int:
    """The token of the window nearest to a place (of two the first)."""
    i = bisect_left(found, (target,))
    if i == len(found) or (i and target - found[i - 1][0] <= found[i][0] - target):
        i = bisect_left(found, (found[i - 1][0],))
    return found[i][1]


def _share(readings: list[tuple], places: dict[int, list[tuple[int, int]]], theirs: dict[int, int], least: float) -> float:
    """The best share over all alignments of the item with the document.

    An alignment is the distance of a window found from its place in the item.  A
    copy with ``least`` of the windows has at most so many breaks, each of which
    costs WINDOW - 1 windows, and thus a longest run of one alignment; those with
    less than half as many windows can't be such a copy's and are passed over.
    """
    n = len(readings[0][0])
    if not n:
        return 0.0
    shifts: Counter = Counter()
    for item, _, _, place in readings:
        for p, h in enumerate(item):
            shifts.update({near - place[p] for near, _ in places.get(h, ())})
    runs = (1 - least) * n / (WINDOW - 1) + 1
    bar, best, seen = max(1, int(least * n / runs / 2)), 0.0, set()
    for shift in sorted(shifts, key=lambda s: (-shifts[s], s)):
        if shifts[shift] < bar or best == 1.0:
            break
        found = [{p: _nearest(places[h], place[p] + shift) - p for p, h in enumerate(item) if h in places} for item, _, _, place in readings]
        if (key := tuple(tuple(f.items()) for f in found)) not in seen:
            seen.add(key)
            best = max(best, _agreeing(readings, found, theirs))
    return best


def _agreeing(readings: list[tuple], found: list[dict[int, int]], theirs: dict[int, int]) -> float:
    """The share of the first reading's windows found, itself or its like in the second, under one mapping for all."""
    votes: dict[tuple[int, int], Counter] = {}
    for (_, kind, value, _), at in zip(readings, found, strict=True):
        for p, shift in at.items():
            for q in range(p, p + WINDOW):
                if kind[q]:
                    votes.setdefault((kind[q], value[q]), Counter())[theirs.get(q + shift)] += 1
    chosen = {k: min(v, key=lambda y: (-v[y], str(y))) for k, v in votes.items()}
    used = Counter(v for k, v in chosen.items() if k[0] == NAME)
    good = [
        {p for p, shift in at.items() if all(theirs.get(q + shift) == (c := chosen[(kind[q], value[q])]) and (kind[q] != NAME or used[c] == 1) for q in range(p, p + WINDOW) if kind[q])}
        for at, (_, kind, value, _) in zip(found, readings, strict=True)
    ]
    item = readings[0][0]
    windows = {h for p, h in enumerate(item) if p in good[0] or (len(good) > 1 and bisect_right(readings[1][3], p) - 1 in good[1])}
    return len(windows) / len(set(item))


def _bitmap(windows: DataFrame) -> bytes:
    """The bits of all window hashes: gathered as at most 2^BITMAP_BITS / 63 words."""
    place = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    words = windows.select(F.floor(place / 32).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITMAP_BITS}) % 32 as int))").alias("bit"))
    table = words.groupBy("w").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 5), dtype=np.uint32)
    out[table.column("w").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8).tobytes()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, item_id, literal, template, kind for each document and item that it holds."""
    spark = docs.sparkSession
    source = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    rows = source.mapInArrow(_item_windows, ", ".join(["item_id long", *(f"{c} array<long>" for c in (*_ITEM, "beside"))]))
    items = staged(rows.where("size(literal) > 0 or size(template) > 0 or size(opened) > 0"), small=True)
    windows = items.select("item_id", F.explode(F.array_union(F.array_union("literal", "template"), "opened")).alias("h")).distinct()
    bitmap = spark.sparkContext.broadcast(_bitmap(windows))

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = texts.mapInArrow(_scan(bitmap), "doc_id long, literal array<long>, windows array<struct<h:long,at:long,near:long,slots:array<long>>>")
    held = staged(found.withColumn("row", F.monotonically_increasing_id()))

    # Rarest windows of each item, for each of its three window sets
    often = windows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    # (a template window stands with its likes in the other reading)
    sets = [items.select("item_id", F.lit(kind).alias("set"), F.explode(F.arrays_zip(F.col(kind).alias("h"), F.col(like).alias("like"))).alias("x")) for kind, like in (("literal", "literal"), ("template", "beside"), ("opened", "opened"))]
    likes = sets[0].union(sets[1]).union(sets[2]).groupBy("item_id", "set", F.col("x.h").alias("h")).agg(F.collect_set("x.like").alias("likes"))
    ranked = staged(likes.join(often, "h").groupBy("item_id", "set").agg(F.array_sort(F.collect_list(F.struct("n", "h", "likes"))).alias("all")), small=True)
    enough = F.ceil(F.size("all") * F.lit(least) - 1e-9)
    rare = staged(ranked.select("item_id", F.explode(F.slice("all", F.lit(1), (F.size("all") - enough + 1).cast("int"))).alias("x")).select("item_id", F.explode(F.array_union(F.array("x.h"), "x.likes")).alias("h")).distinct(), small=True)

    # One row for each document and window; a window that a large part of the
    # documents has is an exchange of scans on both sides, which AQE can split.
    known = held.select("doc_id", "row", F.explode(F.array_union("literal", F.col("windows.h"))).alias("h"))
    pairs = staged(known.join(rare, "h").select("doc_id", "row", "item_id").distinct(), even=True)

    # Of each candidate document the windows that the item has, and no others
    wanted = pairs.join(windows, "item_id")
    asked = held.join(pairs.select("row").distinct(), "row", "left_semi")
    words = asked.select("row", F.explode("literal").alias("h"), F.lit(None).cast("struct<h:long,at:long,near:long,slots:array<long>>").alias("w"))
    window = asked.select("row", F.explode("windows").alias("w")).select("row", F.col("w.h").alias("h"), "w")
    evidence = wanted.join(words.union(window), ["row", "h"]).groupBy("doc_id", "row", "item_id")
    evidence = evidence.agg(F.collect_set(F.when(F.col("w").isNull(), F.col("h"))).alias("literal"), F.collect_list("w").alias("windows"))
    sides = items.select("item_id", *(F.col(c).alias(f"item_{c}") for c in _ITEM))
    judged = evidence.join(sides, "item_id").mapInArrow(_judge(least), "doc_id long, item_id long, literal double, template double")
    shares = judged.groupBy("doc_id", "item_id").agg(F.max("literal").alias("literal"), F.max("template").alias("template")).where((F.col("literal") >= least) | (F.col("template") >= least))
    return shares.select("*", F.when(F.col("literal") >= least, "verbatim").otherwise("reparameterised").alias("kind"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; rows with a null id stay."""
    gone = leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(theirs := own_name(docs, "leaking_id"))).distinct()
    return docs.join(gone, F.col(id_col) == F.col(theirs), "left_anti")
