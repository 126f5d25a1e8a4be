"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of statistics (lengths, character classes,
repetition), transformed towards normality.  Each class has a mean and a
covariance, shrunk towards the pooled covariance and its diagonal; the Cholesky
factor of each is computed once, and a text's score comes from the difference
of the two Mahalanobis log-densities, calibrated by a logistic fit.  Shrinkage is
chosen by the likelihood of rows left out of the fit.

Defined results: a null text counts as empty; empty texts have the statistics of
no words and get a score.  Labels are learnt from at most ``MAX_ROWS`` rows a
class, of texts of at most ``MAX_BYTES`` (module ``labelled``).  Without rows of
both classes every score is the share of ones, or 0.5 without labels.  Rows with
null or repeated ids are scored like others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import crc_mod
from scanloom.llm.labelled import MAX_ROWS, sample_ids, sample_rows, scorer
from scanloom.llm.text_kernels import Words, byte_runs, text_bytes

_CLASSES = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "stop": [*b".!?;:,"], "bang": [*b"!?"],
    "symbol": [*b"#$%&*@^~+=<>\\/_"], "bar": [*b"|{}[]"], "space": [32, 9, 10, 11, 12, 13], "line": [10], "high": [*range(128, 256)],
}
_OF = np.zeros((len(_CLASSES), 256), dtype=np.float64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _OF[_i, _bytes] = 1


def statistics(texts: list[bytes]) -> np.ndarray:
    """The transformed statistics of each text, one row each."""
    words = Words(texts)
    offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    out = []
    for i, text in enumerate(texts):
        counts = np.bincount(words.buf[offsets[i] : offsets[i] + len(text)], minlength=256).astype(np.float64)
        size = max(len(text), 1)
        shares = np.log((_OF @ counts + 0.5) / size)
        own = slice(words.first[i], words.first[i + 1])
        n = own.stop - own.start
        if n:
            lengths = (words.ends[own] - words.starts[own]).astype(np.float64)
            hashes = words.hashes[own]
            _, times = np.unique(hashes, return_counts=True)
            share = times / n
            shape = [
                np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log(len(times)) / np.log(n + 1), np.log((times.max() + 0.5) / n),
                np.log(((hashes[1:] == hashes[:-1]).sum() + 0.5) / n), -(share * np.log(share)).sum() / np.log(n + 1),
            ]
        else:
            shape = [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
        lines = [x for x in text.split(b"\n") if x]
        repeated = np.log((len(lines) - len(set(lines)) + 0.5) / (len(lines) + 1))
        present = counts[counts > 0] / size
        entropy = -(present * np.log(present)).sum()
        out.append([np.log1p(n), *shares, *shape, repeated, np.log1p(size / (len(lines) + 1)), entropy])
    return np.array(out, dtype=np.float64).reshape(len(texts), -1)


@dataclass(frozen=True)
class Discriminant:
    """Means, cached inverse Cholesky factors and log determinants of both classes."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    roots: list[np.ndarray]
    logdets: list[float]
    slope: float
    offset: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        density = [-0.5 * (((z - m) @ r.T) ** 2).sum(axis=1) - 0.5 * d for m, r, d in zip(self.means, self.roots, self.logdets, strict=True)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.offset + self.slope * squash(self.difference(x)))


@dataclass(frozen=True)
class Constant:
    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def squash(d: np.ndarray) -> np.ndarray:
    """Log-density differences grow without bound; their sign and order are what counts."""
    return np.sign(d) * np.log1p(np.abs(d))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _gaussians(x: np.ndarray, y: np.ndarray, toward_pool: float, toward_diagonal: float) -> tuple[list, list, list]:
    means = [x[y == c].mean(axis=0) for c in (0, 1)]
    spread = [(x[y == c] - m).T @ (x[y == c] - m) for c, m in enumerate(means)]
    pooled = sum(spread) / max(len(y) - 2, 1)
    roots, logdets = [], []
    for c in (0, 1):
        n = max((y == c).sum() - 1, 1)
        cov = (1 - toward_pool) * spread[c] / n + toward_pool * pooled
        cov = (1 - toward_diagonal) * cov + toward_diagonal * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
        lower = np.linalg.cholesky(cov)
        roots.append(np.linalg.inv(lower))
        logdets.append(2 * float(np.log(np.diag(lower)).sum()))
    return means, roots, logdets


def _logistic(d: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a slight pull to (1, 0)."""
    theta = np.array([1.0, 0.0])
    a = np.stack([d, np.ones_like(d)], axis=1)
    for _ in range(50):
        p = _sigmoid(a @ theta)
        gradient = a.T @ (w * (p - y)) + 0.1 * (theta - [1, 0])
        hessian = (a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(x: np.ndarray, y: np.ndarray, totals: list[int]) -> Discriminant | Constant:
    """Fit on a sample; ``totals`` are the class counts it was drawn from."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Constant(float(totals[1] / sum(totals)) if sum(totals) else 0.5)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - centre) / scale, -12, 12)
    weight = np.where(y == 1, totals[1] / max((y == 1).sum(), 1), totals[0] / max((y == 0).sum(), 1))
    weight = weight / weight.mean()
    fold = np.zeros(len(y), dtype=int)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % 5
    best = None
    for pool in (0.02, 0.1, 0.3, 0.6):
        for diagonal in (0.02, 0.1, 0.3, 0.7):
            d = np.empty(len(y))
            for k in range(5):
                rest = fold != k
                if min((y[rest] == 0).sum(), (y[rest] == 1).sum()) < 2:
                    rest = np.ones(len(y), dtype=bool)
                model = Discriminant(np.zeros(x.shape[1]), np.ones(x.shape[1]), *_gaussians(z[rest], y[rest], pool, diagonal), 1.0, 0.0)
                d[fold == k] = model.difference(z[fold == k])
            slope, offset = _logistic(squash(d), y, weight)
            p = np.clip(_sigmoid(offset + slope * squash(d)), 1e-6, 1 - 1e-6)
            loss = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()
            if best is None or loss < best[0]:
                best = (loss, pool, diagonal, slope, offset)
    _, pool, diagonal, slope, offset = best
    return Discriminant(centre, scale, *_gaussians(z, y, pool, diagonal), slope, offset)


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = MAX_ROWS) -> Discriminant | Constant:
    """A model from the labelled rows that are not held out."""
    sample, totals = sample_ids(docs, labels, label, id_col, text_col, modulus, held_out, rows)
    chosen = sample_rows(docs, sample, id_col, text_col)

    def vectors(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_bytes(batch.column(2))
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(statistics(texts)), pa.list_(pa.float64()))], names=["id", "y", "x"])

    rows_ = chosen.mapInArrow(vectors, "id long, y int, x array<double>").toArrow().sort_by("id")
    y = np.array(rows_.column("y").to_pylist(), dtype=int)
    x = np.array(rows_.column("x").to_pylist(), dtype=float).reshape(len(y), -1 if len(y) else 1)
    return fit(x, y, totals)


def score_quality(docs: DataFrame, model: Discriminant | Constant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(scorer(lambda texts: model.score(statistics(texts))), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Discriminant | Constant, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose score is ``least`` or more, with all their columns; no row is moved."""
    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = text_bytes(batch.column(place))
            for begin, end in byte_runs(texts, 1 << 21):  # so many bytes are looked at together
                good = model.score(statistics(texts[begin:end])) >= least
                if good.any():
                    yield batch.slice(begin, end - begin).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str, modulus: int, remainder: int):
    return (crc_mod(F.col(id_col), modulus) == remainder).alias("held_out")
