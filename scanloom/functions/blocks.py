"""Sums over all point-voxel pairs of a cloud, by groups of near points (numpy only).

A group's points lie in a cell much smaller than a voxel, so they meet the same few
voxels.  With s a point's offset from the middle of its group, the exponent and the
distance of every pair are quadratic polynomials in s, and score, gradient and
Hessian are linear in the moments sum(E s^k), k up to 4, of each group and voxel.
Pairs are therefore never listed: a group is three products of small matrices, and
memory is bounded by the group.  The sums are those of ``kernels.derivatives`` and
``kernels.scores`` but for the order of addition.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np

from scanloom.functions import kernels as K

#: Groups: cells of this part of the resolution, at most so many points, and on average as many as pay for a group's calls.
CELLS_A_VOXEL, MOST_IN_GROUP, LEAST_IN_GROUP = 2, 1024, 32
#: Points at once where pairs are listed, poses at once, and rows of one product (small ones stay in one thread).
LISTED, POSES_AT_ONCE, ROWS = 8192, 16, 32

#: Monomials of x, y, z up to the fourth degree by degree, as sorted tuples of 1, 2, 3.
_TUPLES = [t for k in range(5) for t in combinations_with_replacement((1, 2, 3), k)]
_ROW = {t: i for i, t in enumerate(_TUPLES)}
#: Where each degree ends, and of each monomial the one below and its last factor.
_ENDS = (1, 4, 10, 20, 35)
_BELOW, _LAST = (np.array([0] + [f(t) for t in _TUPLES[1:]]) for f in (lambda t: _ROW[t[:-1]], lambda t: t[-1]))
_times = lambda a, b: _ROW[tuple(sorted(a + b))]
#: The moments that make up the Gram matrices of (1, s) and of the monomials up to degree 2.
_GRAM4, _GRAM10 = (np.array([[_times(a, b) for b in _TUPLES[:k]] for a in _TUPLES[:k]]) for k in (4, 10))
#: The pair of factors of each monomial up to degree 2, with 0 for the constant.
_A, _B = np.array([0, 0, 0, 0, 1, 1, 1, 2, 2, 3]), np.array([0, 1, 2, 3, 1, 2, 3, 2, 3, 3])
_TWICE = np.where(_A == _B, 0.5, 1.0)


def _monomials(offsets: np.ndarray, degree: int) -> np.ndarray:
    """(monomial, point) of (3, n) offsets."""
    out = np.empty((_ENDS[degree], offsets.shape[1]))
    out[0], out[1:4] = 1.0, offsets
    for k in range(1, degree):
        a, b = _ENDS[k], _ENDS[k + 1]
        np.multiply(out[_BELOW[a:b]], out[_LAST[a:b]], out=out[a:b])
    return out


def _quadratic(square: np.ndarray, linear: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """Coefficients of s' A s + 2 b s + c by the monomials."""
    out = np.empty((len(linear), 10))
    out[:, 0], out[:, 1:4] = constant, 2 * linear
    out[:, 4:] = 2 * (square * np.ones((len(linear), 1, 1)))[:, _A[4:] - 1, _B[4:] - 1] * _TWICE[4:]
    return out


def _mixed(rows: np.ndarray) -> np.ndarray:
    """64 bits of each row of doubles."""
    out = np.zeros(len(rows), dtype=np.uint64)
    for column in rows.T:
        out ^= (column + 0.0).view(np.uint64)  # one zero
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xC2B2AE3D27D4EB4F)


class Cloud:
    """Points sorted by group; equal points are kept once, with their number."""

    #: Pairs so near the radius, as a part of its square, are judged by their distance itself.
    EDGE = 1e-10

    def __init__(self, points: np.ndarray, counts: np.ndarray | None, starts: np.ndarray, total: int) -> None:
        self.points, self.counts, self.starts, self.total = points, counts, starts, total

    @classmethod
    def of(cls, points: np.ndarray, resolution: float, tell_equal: bool = True) -> Cloud:
        """``total`` counts points that aren't finite, too; they meet no voxel."""
        total = len(points)
        points = points[np.isfinite(points).all(axis=1)]
        if not len(points):
            return cls(points, None, np.zeros(1, dtype=np.int64), total)
        cells = np.floor(points * (CELLS_A_VOXEL / resolution))
        # cells by the upper half of a key, equal points by the lower; a key met twice only parts a group or leaves equal points apart
        key = (_mixed(cells) & np.uint64(0xFFFFFFFF00000000)) | (_mixed(points) >> np.uint64(32))
        order = np.argsort(key)
        points, cells = points[order], cells[order]
        counts = None
        if tell_equal:
            first = np.flatnonzero(np.concatenate([[True], (points[1:] != points[:-1]).any(axis=1)]))
            if len(first) < len(points):
                counts = np.diff(np.append(first, len(points))).astype(float)
                points, cells = points[first], cells[first]
        edges = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(edges, len(points)))
        parts = -(-sizes // MOST_IN_GROUP)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.append(np.repeat(edges, parts) + within * MOST_IN_GROUP, len(points)).astype(np.int64)
        return cls(points, counts, starts, total)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.points), len(self.starts), self.total, self.counts is not None], dtype=np.int64)
        return b"".join(x.tobytes() for x in (head, self.starts, self.points, *([self.counts] if self.counts is not None else [])))

    @classmethod
    def from_buffer(cls, data) -> Cloud:
        n, g, total, counted = (int(v) for v in np.frombuffer(data, np.int64, 4))
        points = np.frombuffer(data, float, 3 * n, 32 + 8 * g).reshape(-1, 3)
        return cls(points, np.frombuffer(data, float, n, 32 + 8 * g + 24 * n) if counted else None, np.frombuffer(data, np.int64, g, 32), total)

    def _boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Middles and half diagonals of the groups."""
        low, high = (f.reduceat(self.points, self.starts[:-1], axis=0) for f in (np.minimum, np.maximum))
        return (low + high) / 2, np.sqrt(((high - low) ** 2).sum(axis=1)) / 2

    def sparse(self) -> bool:
        """Whether groups are too small to pay, so that pairs are listed."""
        return len(self.points) < LEAST_IN_GROUP * (len(self.starts) - 1)

    def sums(self, index: K.VoxelIndex, poses: np.ndarray, d1: float, d2: float, metric: str = "distribution", order: int = 2) -> list[tuple[float, np.ndarray, np.ndarray, int]]:
        """Score, gradient, Hessian and pairs under each pose; order 1 leaves the Hessian, order 0 the gradient too at zero."""
        out = [[0.0, np.zeros(6), np.zeros((6, 6)), 0] for _ in poses]
        if self.sparse():
            for a in range(0, len(self.points), LISTED):
                part = slice(a, a + LISTED)
                for o, pose in zip(out, poses, strict=True):
                    _add(o, listed(self.points[part], None if self.counts is None else self.counts[part], index, pose, d1, d2, metric))
        elif len(self.points):
            middles, reach = self._boxes()
            for a in range(0, len(poses), POSES_AT_ONCE):
                for o, more in zip(out[a : a + POSES_AT_ONCE], self._grouped(index, poses[a : a + POSES_AT_ONCE], d1, d2, metric, order, middles, reach), strict=True):
                    _add(o, more)
        return [tuple(o) for o in out]

    def _grouped(self, index, poses, d1, d2, metric, order, middles, reach):
        met = _Met(index, poses, middles, reach, d2, metric)
        rows = _ENDS[(0, 2, 4)[order]]
        moments, pairs = np.zeros((len(met.voxel), rows)), np.zeros(len(met.voxel))
        for lo, hi, weight, near, full in self._weights(met, middles, index.resolution, max(2, (0, 2, 4)[order])):
            if d2 > 1:
                weight[d2 * weight > 1] = 0.0
            moments[lo:hi] = weight @ full[:rows].T
            pairs[lo:hi] = near @ full[0]
        return [met.contract(k, moments, pairs, d1, d2, order) for k in range(len(poses))]

    def _weights(self, met, middles, resolution, degree):
        """Of each group: a range of its (pose, voxel), E and nearness of (pose, voxel) and point, and the points' monomials, each times its number."""
        points, counts, starts, offs = self.points, self.counts, self.starts, met.starts
        limit = resolution**2
        for g in np.flatnonzero(np.diff(offs)):
            a, b = starts[g], starts[g + 1]
            base = _monomials(points[a:b].T - middles[g][:, None], degree)
            full = base if counts is None else base * counts[a:b]
            low = base[:10]
            for lo in range(offs[g], offs[g + 1], met.rows):
                hi = min(lo + met.rows, offs[g + 1])
                weight = met.exponent[lo:hi] @ low
                np.exp(weight, out=weight)
                beyond = met.distance[lo:hi] @ low
                near = (beyond <= 0).astype(float)
                if np.abs(beyond, out=beyond).min() < self.EDGE * limit:
                    for i, j in zip(*np.nonzero(beyond < self.EDGE * limit), strict=True):
                        near[i, j] = met.is_near(lo + i, points[a + j], limit)
                weight *= near
                yield lo, hi, weight, near, full

    def judged(self, index: K.VoxelIndex, poses: np.ndarray, d1: float, d2: float) -> np.ndarray:
        """(pose; score, pairs, sum of the points' greatest pair scores, points with a pair)."""
        out = np.zeros((len(poses), 4))
        if self.sparse():
            for a in range(0, len(self.points), LISTED):
                part = slice(a, a + LISTED)
                for o, pose in zip(out, poses, strict=True):
                    o += listed_scores(self.points[part], None if self.counts is None else self.counts[part], index, pose, d1, d2)
        elif len(self.points):
            middles, reach = self._boxes()
            for k, pose in enumerate(poses):
                met = _Met(index, pose[None], middles, reach, d2, "distribution", 1 << 30)
                for _, _, weight, near, full in self._weights(met, middles, index.resolution, 2):
                    n = full[0]
                    out[k] += (-d1 * (weight @ n).sum(), (near @ n).sum(), -d1 * (weight.max(axis=0) @ n), near.max(axis=0) @ n)
        return out


def _add(to: list, more: tuple) -> None:
    for i in range(4):
        to[i] = to[i] + more[i]


def listed(points, counts, index, pose, d1, d2, metric) -> tuple[float, np.ndarray, np.ndarray, int]:
    """The sums with all pairs of a few points as a list; counted points as often as they count."""
    point, voxel = index.pairs(K.transform(points, pose))
    if counts is not None:
        voxel, point = (np.repeat(x, counts[point].astype(np.int64)) for x in (voxel, point))
    return K.pair_derivatives(points[point], index.means[voxel], index.inverse[voxel], pose, d1, d2, index.axes[voxel] if metric == "plane" else None)


def listed_scores(points, counts, index, pose, d1, d2) -> np.ndarray:
    moved = K.transform(points, pose)
    point, voxel = index.pairs(moved)
    d = moved[point] - index.means[voxel]
    pair = -d1 * np.exp(-0.5 * d2 * (np.matmul(index.inverse[voxel], d[:, :, None])[:, :, 0] * d).sum(axis=1))
    best = np.full(len(points), -np.inf)
    np.maximum.at(best, point, pair)
    met = np.isfinite(best)
    n = np.ones(len(points)) if counts is None else counts
    return np.array([pair @ n[point], n[point].sum(), best[met] @ n[met], n[met].sum()])


class _Met:
    """Which voxels each group can meet under each pose, with the polynomials of their pairs."""

    def __init__(self, index: K.VoxelIndex, poses: np.ndarray, middles: np.ndarray, reach: np.ndarray, d2: float, metric: str, rows: int = ROWS) -> None:
        self.poses, self.middles, self.rows = poses, middles, rows
        found = [index.within(K.transform(middles, pose), index.resolution + reach) for pose in poses]
        of, voxel, pose = (np.concatenate(x) for x in ([f[0] for f in found], [f[1] for f in found], [np.full(len(f[0]), k) for k, f in enumerate(found)]))
        order = np.argsort(of, kind="stable")
        self.of, self.voxel, self.pose = of[order], voxel[order], pose[order]
        self.starts = np.searchsorted(self.of, np.arange(len(middles) + 1))
        turn = np.stack([K.rotation(p) for p in poses])[self.pose]
        self.stiff = index.inverse[self.voxel] if metric == "distribution" else index.axes[self.voxel][:, :, None] * index.axes[self.voxel][:, None, :]
        self.turn = turn
        self.shift = np.matmul(turn, middles[self.of][:, :, None])[:, :, 0] + poses[self.pose, :3] - index.means[self.voxel]
        back = turn.transpose(0, 2, 1)
        pull = np.matmul(self.stiff, self.shift[:, :, None])
        self.exponent = -0.5 * d2 * _quadratic(np.matmul(np.matmul(back, self.stiff), turn), np.matmul(back, pull)[:, :, 0], (pull[:, :, 0] * self.shift).sum(axis=1))
        self.means = index.means
        # less the radius
        self.distance = _quadratic(np.eye(3)[None], np.matmul(back, self.shift[:, :, None])[:, :, 0], (self.shift**2).sum(axis=1) - index.resolution**2)

    def is_near(self, i: int, point: np.ndarray, limit: float) -> bool:
        d = K.transform(point[None], self.poses[self.pose[i]])[0] - self.means[self.voxel[i]]
        return bool(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= limit)

    def contract(self, k: int, moments: np.ndarray, pairs: np.ndarray, d1: float, d2: float, order: int) -> tuple[float, np.ndarray, np.ndarray, int]:
        """Score, gradient, Hessian and pairs of one pose from its moments."""
        mine = np.flatnonzero(self.pose == k)
        pose, sums = self.poses[k], moments[mine]
        score, gradient, hessian, n = float(-d1 * sums[:, 0].sum()), np.zeros(6), np.zeros((6, 6)), int(round(pairs[mine].sum()))
        if not order or not len(mine):
            return score, gradient, hessian, n
        stiff, middle = self.stiff[mine], self.middles[self.of[mine]]
        pull = np.matmul(stiff, np.concatenate([self.shift[mine][:, :, None], self.turn[mine]], axis=2))  # S d by (1, s)
        ways = np.zeros((len(mine), 3, 6, 4))  # the derivatives of the moved point, by (1, s)
        ways[:, :, :3, 0] = np.eye(3)
        for a, o in enumerate(K._ORDERS):
            d = K.rotation_derivative(pose, o)
            ways[:, :, 3 + a, 0], ways[:, :, 3 + a, 1:] = middle @ d.T, d
        both = np.matmul(pull.transpose(0, 2, 1), ways.reshape(-1, 3, 24)).reshape(-1, 4, 6, 4).transpose(0, 2, 1, 3)
        bent = (both[:, :, _A, _B] + both[:, :, _B, _A]) * _TWICE  # the derivatives of q / 2, by the monomials
        gradient = np.matmul(bent, sums[:, :10, None]).sum(axis=0)[:, 0]
        if order == 1:
            return score, d1 * d2 * gradient, hessian, n
        gram4 = sums[:, _GRAM4]
        hessian = -d2 * np.matmul(np.matmul(bent, sums[:, _GRAM10]), bent.transpose(0, 2, 1)).sum(axis=0)
        stiffer = np.matmul(stiff, ways.reshape(-1, 3, 24)).reshape(-1, 3, 6, 4)
        spread = np.matmul(ways.reshape(-1, 18, 4), gram4).reshape(-1, 3, 6, 4)
        hessian += np.tensordot(spread.transpose(0, 1, 3, 2).reshape(-1, 6), stiffer.transpose(0, 1, 3, 2).reshape(-1, 6), (0, 0))
        place = np.concatenate([middle[:, :, None], np.broadcast_to(np.eye(3), (len(mine), 3, 3))], axis=2)
        arms = np.matmul(np.matmul(pull, gram4), place.transpose(0, 2, 1)).sum(axis=0)
        for i in range(3):
            for j in range(3):
                o = tuple(x + y for x, y in zip(K._ORDERS[i], K._ORDERS[j], strict=True))
                hessian[3 + i, 3 + j] += (arms * K.rotation_derivative(pose, o)).sum()
        return score, d1 * d2 * gradient, d1 * d2 * hessian, n
