"""Toxicity: a convolutional text classifier trained in numpy.

A text becomes lower-cased runs of letters and digits.  Words hash into
``BUCKETS`` embedding rows, of which only those that the learning rows use often
enough are kept (all others are the zero vector); filters of widths 1, 2 and 3
slide over the embeddings, each filter's maximum over the whole text goes
through a rectifier, and a logistic layer adds them up.  Embeddings, filters and
the last layer are trained together by Adam on cross-entropy; a part of the
rows, left out of the training, picks the pass, calibrates the score and gives
each language its threshold.

Every labelled row that is not held out is learnt from, with its whole text.
The rows are dealt by a hash of their id to shards of some ``SHARD_BYTES`` of
text; a shard is one row of a staged table.  Word counts of the classes are
sums over all shards.  In each pass every shard trains from the same parameters
on all its rows, and the means of the shards' results, by rows, are the next
parameters.  Calibration and thresholds are sums over all rows.  The driver gets
counts, one model and, for each language, a row.

Scoring needs no matrix product: the product of every kept embedding row with
every filter position is precomputed, and a text's activations are sums of table
rows.

Defined results: a null text counts as empty; empty texts are padding alone and
get the score of a text without known words.  The model has a row for the
``MAX_KNOWN`` words that tell the classes apart best.  Without rows of both classes
every score is the share of ones, or 0 without labels.  Of rows that repeat a
doc_id the one of least word sequence is learnt from; an empty table gives an
empty result.  Languages with too few labelled rows, null or unknown ones take
the global threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import crc_mod, staged
from scanloom.llm.labelled import scorer, usable_labels
from scanloom.llm.text_kernels import Words, byte_runs, mix64, span_hashes, text_bytes

BUCKET_BITS, DIM, WIDTHS, FILTERS = 24, 8, (1, 2, 3), 4
#: Kept embedding rows at most (those that tell the classes apart best), and learning
#: rows that must hold a word.
MAX_KNOWN, MIN_TEXTS = 1 << 14, 3
#: Passes over all rows of one shard, and of many; rows and words of a step.
EPOCHS, LEAST_EPOCHS, BATCH, STEP_WORDS, RATE = 10, 4, 32, 1 << 18, 0.02
#: Text of a shard, and the rows that a shard's parameters travel in.
SHARD_BYTES, CHUNKS = 24 << 20, 128

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The embedding bucket of every word, and where each text's words begin."""
    words = Words(texts, hashes=False, between=_BETWEEN)
    hashed = span_hashes(_LOWER[words.buf], words.starts, words.ends)
    return (hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), words.first


@dataclass
class Convolutional:
    """known: sorted buckets of the kept rows; row 0 of ``rows`` is the zero vector."""

    known: np.ndarray
    rows: np.ndarray
    filters: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    calibration: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3

    def tables(self) -> list[np.ndarray]:
        """Of each width: (width, rows, FILTERS), every row's product with every position."""
        rows = self.rows.astype(np.float32)
        return [np.stack([rows @ position.astype(np.float32) for position in f]) for f in self.filters]

    def indices(self, bucket: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, bucket)
        at = np.minimum(at, len(self.known) - 1) if len(self.known) else at
        return np.where(self.known[at] == bucket, at + 1, 0) if len(self.known) else np.zeros(len(bucket), dtype=np.int64)

    def pooled(self, padded: np.ndarray, begins: np.ndarray, ends: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """The greatest activation of every filter in each text; no window reaches into the next text."""
        out, edges = [], np.stack([begins, ends], axis=1).reshape(-1)
        for table in tables:
            width = len(table)
            n = len(padded) - max(WIDTHS) + 1
            active = table[0][padded[:n]]
            for j in range(1, width):
                active += table[j][padded[j : j + n]]
            out.append(np.maximum.reduceat(active, edges, axis=0)[::2] if len(edges) else active[:0])
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def raw(self, bucket: np.ndarray, first: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        return self.pooled(*pad(self.indices(bucket), first), tables) @ self.weights + self.offset

    def scores(self, texts: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
        slope, offset = self.calibration
        return sigmoid(slope * self.raw(*buckets(texts), tables) + offset)

    def lookup(self) -> np.ndarray:
        """``indices`` of every bucket."""
        table = np.zeros(1 << BUCKET_BITS, dtype=np.uint16)
        table[self.known] = np.arange(1, len(self.known) + 1)
        return table

    def vector(self) -> np.ndarray:
        """All parameters."""
        return np.concatenate([x.reshape(-1) for x in (self.rows, *self.filters, self.bias, self.weights, np.array([self.offset]))]).astype(np.float32)

    def of(self, vector: np.ndarray) -> Convolutional:
        """A model of the same words with the parameters of ``vector``, which it doesn't share."""
        shapes = [x.shape for x in (self.rows, *self.filters, self.bias, self.weights)]
        ends = np.cumsum([np.prod(x) for x in shapes])
        *parts, offset = np.split(vector.astype(np.float64), ends)
        rows, *filters, bias, weights = (x.reshape(shape).copy() for x, shape in zip(parts, shapes, strict=True))
        return replace(self, rows=rows, filters=filters, bias=bias, weights=weights, offset=float(offset[0]))


def pad(index: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with as many zero rows after each text as the widest filter has positions, and
    where each text's windows begin and end: the last begins on the first zero row."""
    gap, n = max(WIDTHS), len(first) - 1
    padded = np.zeros(len(index) + gap * n + gap, dtype=np.int64)
    text_of = np.repeat(np.arange(n), np.diff(first))
    padded[np.arange(len(index)) + gap * text_of] = index
    begins = first[:-1] + gap * np.arange(n)
    return padded, begins, begins + np.diff(first) + 1


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class _Adam:
    def __init__(self, *arrays: np.ndarray) -> None:
        self.state = [(a, np.zeros_like(a), np.zeros_like(a)) for a in arrays]
        self.t = 0

    def step(self, gradients: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for (a, m, v), g in zip(self.state, gradients, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def _start(known: np.ndarray, hits: np.ndarray, totals: np.ndarray) -> Convolutional:
    """Random parameters; one embedding direction starts at each word's shrunken log-odds.  hits: the rows of each class with the word."""
    rng = np.random.default_rng(7)
    total = np.maximum(totals, 1.0)
    prior = 4 * (hits[0] + hits[1] + 0.5) / (total[0] + total[1] + 1)
    odds = np.log((hits[1] + prior) / (total[1] + 4)) - np.log((hits[0] + prior) / (total[0] + 4))
    rows = rng.normal(0, 0.05, (len(known) + 1, DIM))
    rows[1:, 0] = odds
    rows[0] = 0
    filters = [rng.normal(0, 0.3, (k, DIM, FILTERS)) for k in WIDTHS]
    filters[0][0, 0, 0], filters[0][0, 1:, 0] = 1.0, 0.0
    bias = np.zeros(len(WIDTHS) * FILTERS)
    bias[0] = -0.5
    weights = rng.normal(0, 0.1, len(bias))
    weights[0] = 2.0
    return Convolutional(known, rows, filters, bias, weights, float(np.log(total[1] / total[0])) - 1.0)


def _steps(of: np.ndarray, first: np.ndarray, rows: int):
    """``of`` in runs of at most ``rows`` texts and STEP_WORDS words; a longer text is a run of its own."""
    size = np.diff(first)[of]
    begin = 0
    while begin < len(of):
        within = np.cumsum(size[begin : begin + rows]) <= STEP_WORDS
        end = begin + max(1, int(within.sum()))
        yield of[begin:end]
        begin = end


def _padded(index: np.ndarray, first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [index[first[i] : first[i + 1]] for i in of]
    return pad(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64))


def _raw(model: Convolutional, index: np.ndarray, first: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The raw scores of the texts ``of``."""
    tables, found = model.tables(), [np.zeros(0)]
    for own in _steps(of, first, 256):
        found.append(model.pooled(*_padded(index, first, own), tables) @ model.weights + model.offset)
    return np.concatenate(found)


def _loss(raw: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(sigmoid(raw), 1e-6, 1 - 1e-6)
    return -float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def _descend(model: Convolutional, index: np.ndarray, first: np.ndarray, y: np.ndarray, of: np.ndarray, batch: int, rate: float, seed: int) -> Convolutional:
    """The model after one pass over the texts ``of``."""
    model.offset = np.array([model.offset])  # an array while it is trained
    adam = _Adam(model.rows, *model.filters, model.bias, model.weights, model.offset)
    for own in _steps(np.random.default_rng(seed).permutation(of), first, batch):
        adam.step(_gradients(model, *_padded(index, first, own), y[own]), rate)
        model.rows[0] = 0
    model.offset = float(model.offset[0])
    return model


def _strongest(table: np.ndarray, padded: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows from begin to end the first greatest activation of each filter: where, and its value."""
    at, top = np.full(FILTERS, begin), np.full(FILTERS, -np.inf)
    for a in range(begin, end, STEP_WORDS):
        b = min(end, a + STEP_WORDS)
        active = sum(table[j][padded[a + j : b + j]] for j in range(len(table)))
        own = active.argmax(axis=0)
        value = active[own, np.arange(FILTERS)]
        at, top = np.where(value > top, a + own, at), np.maximum(top, value)
    return at, top


def _gradients(model: Convolutional, padded: np.ndarray, begins: np.ndarray, ends: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the cross-entropy with a slight pull of everything to zero."""
    tables, n = model.tables(), len(padded) - max(WIDTHS) + 1
    best = []  # of each width the (text, filter) position of the maximum
    pooled = np.empty((len(begins), len(model.bias)))
    for k, table in enumerate(tables):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        if len(begins) == 1:
            at, pooled[:, own] = (x[None] for x in _strongest(table, padded, begins[0], ends[0]))
        else:
            active = table[0][padded[:n]]
            for j in range(1, len(table)):
                active += table[j][padded[j : j + n]]
            at = np.stack([a + active[a:b].argmax(axis=0) for a, b in zip(begins, ends, strict=True)])
            pooled[:, own] = active[at, np.arange(FILTERS)]
        best.append(at)
    pooled += model.bias
    hidden = np.maximum(pooled, 0)
    p = sigmoid(hidden @ model.weights + model.offset[0])
    delta = (p - (0.98 * y + 0.01)) / len(y)  # labels are not all right
    g_hidden = delta[:, None] * model.weights * (pooled > 0)
    g_rows, g_filters = 1e-5 * model.rows, []
    for k, width in enumerate(WIDTHS):
        own = g_hidden[:, k * FILTERS : (k + 1) * FILTERS]
        g = 1e-4 * model.filters[k]
        for j in range(width):
            index = padded[best[k] + j]
            g[j] += np.einsum("tfd,tf->df", model.rows[index], own)
            np.add.at(g_rows, index.reshape(-1), (own[:, :, None] * model.filters[k][j].T[None]).reshape(-1, DIM))
        g_filters.append(g)
    return [g_rows, *g_filters, g_hidden.sum(axis=0), hidden.T @ delta + 1e-4 * model.weights, np.array([delta.sum()])]


GRID = np.arange(5, 100, 5) / 100


def _best_threshold(row) -> float:
    """Of 0.05 to 0.95 the middle of the thresholds with the greatest F1.  row: ones, and of each threshold its hits and right ones."""
    f1 = [2 * row[f"right_{i}"] / max(row[f"hits_{i}"] + row["ones"], 1e-9) for i in range(len(GRID))]
    top = GRID[np.array(f1) >= max(f1) - 1e-9]
    return float(top[len(top) // 2])


def _calibrated(model: Convolutional, raws: DataFrame) -> Convolutional:
    """The model with calibration and thresholds from (raw, y, own_lang) of all rows, whose raw scores are of models that have not seen them."""
    raws = staged(raws, even=True)
    model.calibration = slope, offset = _logistic(raws)
    score = _sigmoid(F.col("raw") * slope + offset)
    whole = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    sums = [whole(F.col("y")).alias("ones"), whole(F.col("y") == 0).alias("zeros")]
    for i, t in enumerate(GRID.tolist()):
        sums += [whole(score >= t).alias(f"hits_{i}"), whole((score >= t) & (F.col("y") == 1)).alias(f"right_{i}")]
    model.threshold = _best_threshold(raws.agg(*sums).first())
    own = raws.where("own_lang != ''").groupBy("own_lang").agg(*sums).where("ones >= 5 and zeros >= 5")
    model.thresholds = {r["own_lang"]: _best_threshold(r) for r in own.orderBy("own_lang").collect()}
    return model


def _sigmoid(x):
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(35.0)), F.lit(-35.0))))


def _logistic(raws: DataFrame) -> tuple[float, float]:
    """Slope and offset by Newton's method over all rows, with a slight pull to (1, 0); decimal sums don't depend on the order of rows."""
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        x, p = F.col("raw"), _sigmoid(F.col("raw") * float(theta[0]) + float(theta[1]))
        g, h = p - F.col("y"), F.greatest(p * (1 - p), F.lit(1e-6))
        found = raws.agg(*(F.sum(c.cast("decimal(28,12)")) for c in (g * x, g, h * x * x, h * x, h))).first()
        gx, g1, hxx, hx, h1 = map(float, found)
        gradient = np.array([gx, g1]) + 0.1 * (theta - [1, 0])
        step = np.linalg.solve(np.array([[hxx, hx], [hx, h1]]) + 0.1 * np.eye(2), gradient)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


@dataclass
class Constant:
    """Where labels of one class or none were given: the share of ones for every text."""

    share: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3

    def tables(self) -> list[np.ndarray]:
        return []

    def scores(self, texts: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
        return np.full(len(texts), self.share)


#: The trainings: without either half of the rows, and with all.
HALVES, ALL = (0, 1), 2
FOLDS = (*HALVES, ALL)
#: A row's part: its half, and 2 more where it is kept aside to pick the pass.
PARTS = 4


def _parts(ids: np.ndarray) -> np.ndarray:
    mixed = mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (mixed % np.uint64(2) + 2 * ((mixed >> np.uint64(8)) % np.uint64(5) == 4).astype(np.uint64)).astype(np.uint8)


SHARD = "shard int, y binary, part binary, first binary, words binary, own_lang array<string>, counts array<long>"


def _packed(words: np.ndarray) -> bytes:
    """Buckets as three bytes each."""
    return np.ascontiguousarray(words.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 3, 4), dtype=np.uint8)
    wide[:, :3] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 3)
    return wide.view("<i4").reshape(-1)


def _sequences(batches):
    """(id, own_lang, shard, text) to the same with the text's buckets in its place."""
    import pyarrow as pa

    for batch in batches:
        texts = text_bytes(batch.column(3))
        for begin, end in byte_runs(texts, 1 << 20):
            bucket, first = buckets(texts[begin:end])
            packed, part = _packed(bucket), batch.slice(begin, end - begin)
            words = pa.array([packed[3 * a : 3 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], words], names=["id", "own_lang", "shard", "words"])


def _gathered(key, docs, labels):
    """One row of a shard's labelled documents, by id."""
    import pyarrow as pa

    label = dict(zip(labels.column("id").to_pylist(), labels.column("y").to_pylist(), strict=True))
    found: dict[int, tuple[bytes, str]] = {}
    for i, lang, words in zip(*(docs.column(c).to_pylist() for c in ("id", "own_lang", "words")), strict=True):
        if i in label and (i not in found or (words, lang or "") < found[i]):
            found[i] = (words, lang or "")
    ids = sorted(found)
    y, part = np.array([label[i] for i in ids], dtype=np.uint8), _parts(np.array(ids, dtype=np.int64))
    first = np.concatenate([[0], np.cumsum([len(found[i][0]) // 3 for i in ids])]).astype("<i8")
    counts = np.bincount(2 * part + y, minlength=2 * PARTS).tolist()
    row = (key[0].as_py(), y.tobytes(), part.tobytes(), first.tobytes(), b"".join(found[i][0] for i in ids), [found[i][1] for i in ids], counts)
    types = {"shard": pa.int32(), "y": pa.binary(), "part": pa.binary(), "first": pa.binary(), "words": pa.binary(), "own_lang": pa.list_(pa.string()), "counts": pa.list_(pa.int64())}
    return pa.table({k: pa.array([v], t) for (k, t), v in zip(types.items(), row, strict=True)})


def learning_shards(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, id_col: str, text_col: str, label: str, lang_col: str | None) -> DataFrame:
    """All labelled rows that are not held out, with the words of their whole texts: a row for each shard."""
    lang = (F.col(lang_col) if lang_col else F.lit(None)).cast("string").alias("own_lang")
    open_ = docs.where(F.col(id_col).isNotNull() & (crc_mod(F.col(id_col), modulus) != held_out))
    size = open_.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-size // SHARD_BYTES)))).cast("int").alias("shard")
    source = open_.select(F.col(id_col).cast("long").alias("id"), lang, F.col(text_col).alias("text")).select("id", "own_lang", shard, "text")
    words = source.mapInArrow(_sequences, "id long, own_lang string, shard int, words binary")
    known = usable_labels(labels, label, id_col, modulus, held_out).select("id", "y", shard)
    return staged(words.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_gathered, SHARD))


def _shards(batches):
    """shard, y, part, first, words and languages of each shard."""
    for batch in batches:
        for r in range(batch.num_rows):
            shard, y, part, first, words, lang = (batch.column(c)[r].as_py() for c in ("shard", "y", "part", "first", "words", "own_lang"))
            yield shard, np.frombuffer(y, np.uint8).astype(int), np.frombuffer(part, np.uint8), np.frombuffer(first, "<i8"), _unpacked(words), lang


def _counted(batches):
    """How many rows of each part and class hold a bucket."""
    import pyarrow as pa

    for _, y, part, first, words, _ in _shards(batches):
        for own in _steps(np.arange(len(y)), first, 1 << 14):
            text = np.repeat(own, np.diff(first)[own])
            pairs = np.unique(text << BUCKET_BITS | words[first[own[0]] : first[own[-1] + 1]])
            bucket, at = np.unique(pairs & ((1 << BUCKET_BITS) - 1), return_inverse=True)
            kind = (2 * part.astype(int) + y)[pairs >> BUCKET_BITS]
            hits = np.bincount(at * (2 * PARTS) + kind, minlength=len(bucket) * 2 * PARTS).reshape(-1, 2 * PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in hits.T)], names=["bucket", *_KINDS])


_KINDS = [f"c{i}" for i in range(2 * PARTS)]


def _begun(hits: DataFrame, learn: np.ndarray, totals: np.ndarray) -> Convolutional:
    """The starting model of a training: its words are those whose shares in the two classes are farthest apart, in standard errors."""
    h0, h1 = (sum((F.col(_KINDS[2 * p + c]) for p in np.flatnonzero(learn).tolist()), F.lit(0)) for c in (0, 1))
    t0, t1 = (float(max(t, 1)) for t in totals)
    share = (F.col("h0") + F.col("h1") + 0.5) / float(totals.sum() + 1)
    apart = F.abs(F.col("h1") / t1 - F.col("h0") / t0) / F.sqrt(share * (1 - share) * (1 / t0 + 1 / t1) + 1e-12)
    often = hits.select("bucket", h0.alias("h0"), h1.alias("h1")).where(F.col("h0") + F.col("h1") >= MIN_TEXTS)
    kept = sorted(map(tuple, often.orderBy(apart.desc(), "bucket").limit(MAX_KNOWN).collect()))
    known, *counts = np.array(kept, dtype=np.int64).reshape(-1, 3).T
    return _start(known.astype(np.int32), np.array(counts), totals)


PASSED = "fold int, chunk int, shard int, n long, loss double, checked long, values array<float>"


def _pass(models: list[Convolutional], learn: list[np.ndarray], check: list[np.ndarray], batch_rows: int, rate: float, epoch: int):
    """Each shard's losses by the models it is given, and its parameters after one pass (a rate of 0: none)."""

    def run(batches):
        import pyarrow as pa

        lookups = [m.lookup() for m in models]
        for shard, y, part, first, words, _ in _shards(batches):
            for fold, model in enumerate(models):
                index, own, aside = lookups[fold][words], np.flatnonzero(learn[fold][part]), np.flatnonzero(check[fold][part])
                loss = _loss(_raw(model, index, first, aside), y[aside])
                vector = np.zeros(0, dtype=np.float32)
                if rate:
                    moved = model.of(model.vector())
                    vector = _descend(moved, index, first, y, own, batch_rows, rate, 1000 * shard + epoch).vector()
                chunks = np.array_split(vector, CHUNKS if rate else 1)
                n, lists = len(chunks), pa.array(chunks, pa.list_(pa.float32()))
                same = ([fold] * n, list(range(n)), [shard] * n, [len(own)] * n, [loss] * n, [len(aside)] * n)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(same, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64()), strict=True)), lists], names=["fold", "chunk", "shard", "n", "loss", "checked", "values"])

    return run


def _mean(table):
    """The mean of the shards' parameters, by rows, and the sum of their losses."""
    import pyarrow as pa

    table = table.sort_by("shard")
    n = np.maximum(table.column("n").to_numpy(), 0).astype(float)
    values, loss = np.zeros(len(table.column("values")[0])), 0.0
    for weight, own, part in zip(n / max(n.sum(), 1), table.column("loss").to_pylist(), table.column("values"), strict=True):
        values += weight * part.values.to_numpy()
        loss += own
    row = (table.column("fold")[0].as_py(), table.column("chunk")[0].as_py(), loss, sum(table.column("checked").to_pylist()), values.astype(np.float32))
    types = {"fold": pa.int32(), "chunk": pa.int32(), "loss": pa.float64(), "checked": pa.int64(), "values": pa.list_(pa.float32())}
    return pa.table({k: pa.array([v], t) for (k, t), v in zip(types.items(), row, strict=True)})


def _unseen(models: list[Convolutional]):
    """(y, own_lang, raw) of every row, by the model that has not seen its half."""

    def run(batches):
        import pyarrow as pa

        lookups = [m.lookup() for m in models]
        for _, y, part, first, words, lang in _shards(batches):
            raw = np.zeros(len(y))
            for half, model in enumerate(models):
                own = np.flatnonzero(part % 2 == half)
                raw[own] = _raw(model, lookups[half][words], first, own)
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(lang, pa.string()), pa.array(raw)], names=["y", "own_lang", "raw"])

    return run


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text",
    label: str = "toxic", lang_col: str | None = "lang",
) -> Convolutional | Constant:
    """A model from all labelled rows that are not held out.

    Three trainings run side by side over the shards: two without either half of
    the rows, whose scores of that half calibrate, and one with all.  Languages
    serve the thresholds alone, never the score.
    """
    shards = learning_shards(docs, labels, modulus, held_out, id_col, text_col, label, lang_col)
    found = shards.agg(F.count(F.lit(1)), *(F.sum(F.col("counts")[i]) for i in range(2 * PARTS))).first()
    count, counts = found[0], np.array([n or 0 for n in found[1:]]).reshape(PARTS, 2)
    totals = counts.sum(axis=0)
    if not totals.all():
        return Constant(float(totals[1] / totals.sum()) if totals.sum() else 0.0)
    hits = shards.mapInArrow(_counted, "bucket int, " + ", ".join(f"{k} long" for k in _KINDS))
    hits = staged(hits.groupBy("bucket").agg(*(F.sum(k).alias(k) for k in _KINDS)), even=True)
    learn, check = [], []
    for fold in FOLDS:
        own, aside = np.arange(PARTS) % 2 != fold if fold != ALL else np.ones(PARTS, dtype=bool), np.arange(PARTS) >= 2
        learn.append(own & ~aside if counts[own & ~aside].sum(axis=0).all() else np.ones(PARTS, dtype=bool))
        check.append(own & aside)
    models = [_begun(hits, rows, counts[rows].sum(axis=0)) for rows in learn]

    epochs = max(LEAST_EPOCHS, EPOCHS // count)
    best: list[tuple[float, Convolutional] | None] = [None] * len(FOLDS)
    for epoch in range(epochs + 1):  # the last one only tells the losses
        rate = RATE / (1 + epoch / 3) if epoch < epochs else 0.0
        passed = shards.mapInArrow(_pass(models, learn, check, BATCH * min(count, 2), rate, epoch), PASSED)
        rows = passed.groupBy("fold", "chunk").applyInArrow(_mean, "fold int, chunk int, loss double, checked long, values array<float>").collect()
        for fold in FOLDS:
            own = sorted((r for r in rows if r["fold"] == fold), key=lambda r: r["chunk"])
            loss = own[0]["loss"] / max(own[0]["checked"], 1)
            if best[fold] is None or loss < best[fold][0]:
                best[fold] = (loss, models[fold])
            if rate:
                models[fold] = models[fold].of(np.concatenate([np.array(r["values"], dtype=np.float32) for r in own]))
    models = [m for _, m in best]
    return _calibrated(models[ALL], shards.mapInArrow(_unseen(models[:ALL]), "y int, own_lang string, raw double"))


def score_toxicity(docs: DataFrame, model: Convolutional | Constant, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """doc_id, score, threshold (of the row's language) and toxic of every row."""
    lang = (F.col(lang_col) if lang_col else F.lit(None)).cast("string").alias("own_lang")
    source = docs.select(F.col(id_col).alias("doc_id"), lang, F.col(text_col).alias("text"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, own_lang string, score double"
    tables = model.tables()
    scored = source.mapInArrow(scorer(lambda texts: model.scores(texts, tables)), schema)
    limit = F.lit(model.threshold)
    for name, value in model.thresholds.items():
        limit = F.when(F.col("own_lang") == name, F.lit(value)).otherwise(limit)
    return scored.withColumn("threshold", limit).select("doc_id", "score", "threshold", (F.col("score") >= F.col("threshold")).alias("toxic"))
