"""Numeric kernels of distribution-based registration (numpy only).

Notation: T(p) = R p + t with R = Rx(roll) Ry(pitch) Rz(yaw); a voxel has mean m
and inverse covariance S; d = T(p) - m; q = d' S d; E = exp(-d2 q / 2).  A pair
scores -d1 E.  All matrices are stacks over pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator

import numpy as np

from scanloom.config import LineSearchConfig, MatchConfig


def gaussian_constants(resolution: float, outlier_ratio: float) -> tuple[float, float]:
    """d1 < 0 < d2 of the mixture of a Gaussian and a uniform share of outliers."""
    c1, c2 = 10.0 * (1.0 - outlier_ratio), outlier_ratio / resolution**3
    d3 = -math.log(c2)
    d1 = -math.log(c1 + c2) - d3
    return d1, -2.0 * math.log((-math.log(c1 * math.exp(-0.5) + c2) - d3) / d1)


def rotation(pose: np.ndarray) -> np.ndarray:
    (sr, cr), (sp, cp), (sy, cy) = ((math.sin(a), math.cos(a)) for a in pose[3:])
    rx = np.array([[1, 0, 0], [0, cr, -sr], [0, sr, cr]])
    ry = np.array([[cp, 0, sp], [0, 1, 0], [-sp, 0, cp]])
    rz = np.array([[cy, -sy, 0], [sy, cy, 0], [0, 0, 1]])
    return rx @ ry @ rz


def transform(points: np.ndarray, pose: np.ndarray) -> np.ndarray:
    return points @ rotation(pose).T + pose[:3]


_ORDERS = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def _axis(axis: int, angle: np.ndarray | float, order: int) -> np.ndarray:
    """The order-th derivative of a rotation about one axis by its angle, or of a stack of them."""
    s, c = np.sin(angle + order * math.pi / 2), np.cos(angle + order * math.pi / 2)
    i, j = (axis + 1) % 3, (axis + 2) % 3
    out = np.zeros((*np.shape(angle), 3, 3))
    out[..., i, i] = out[..., j, j] = c
    out[..., j, i], out[..., i, j] = s, -s
    if order == 0:
        out[..., axis, axis] = 1.0
    return out


def rotation_derivative(pose: np.ndarray, orders: tuple[int, int, int]) -> np.ndarray:
    """The mixed derivative of R by roll, pitch and yaw of the given orders; of a stack of poses a stack."""
    return _axis(0, pose[..., 3], orders[0]) @ _axis(1, pose[..., 4], orders[1]) @ _axis(2, pose[..., 5], orders[2])


def point_derivatives(points: np.ndarray, pose: np.ndarray, second: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(n, 3, 6) Jacobian of T(p) by the pose, and the (n, 3, 3, 3) second derivatives by the angles; ``pose`` is one, or one for each point."""
    n = len(points)
    turned = lambda order: np.matmul(rotation_derivative(pose, order), points[:, :, None])[:, :, 0]
    jacobian = np.zeros((n, 3, 6))
    jacobian[:, :, :3] = np.eye(3)
    for a, order in enumerate(_ORDERS):
        jacobian[:, :, 3 + a] = turned(order)
    if not second:
        return jacobian, None
    curve = np.empty((n, 3, 3, 3))
    for a in range(3):
        for b in range(a, 3):
            order = tuple(x + y for x, y in zip(_ORDERS[a], _ORDERS[b], strict=True))
            curve[:, :, a, b] = curve[:, :, b, a] = turned(order)
    return jacobian, curve


def pair_derivatives(
    points: np.ndarray, means: np.ndarray, inverse: np.ndarray, pose: np.ndarray, d1: float, d2: float, normals: np.ndarray | None = None
) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Summed score, gradient (6), Hessian (6, 6) and number of pairs.

    ``points`` are source points, one for each pair.  With ``normals`` the
    distance is the one to the voxel's plane.  Pairs with an exponent outside
    [0, 1] add nothing and still count.
    """
    if not len(points):
        return 0.0, np.zeros(6), np.zeros((6, 6)), 0
    delta = transform(points, pose) - means
    turned = np.stack([points @ rotation_derivative(pose, o).T for o in _ORDERS], axis=2)  # d(R p) by the angles
    if normals is None:
        along = np.matmul(inverse, delta[:, :, None])[:, :, 0]  # S d
        q = (delta * along).sum(axis=1)
    else:
        off = (delta * normals).sum(axis=1)
        along, q = off[:, None] * normals, off * off
    weight = np.exp(-0.5 * d2 * q)
    good = np.isfinite(weight) & (d2 * weight >= 0) & (d2 * weight <= 1)
    weight = np.where(good, weight, 0.0)
    w = d1 * d2 * weight
    pull = along * w[:, None]
    # every sum over pairs is a product of tall matrices; second derivatives of the
    # rotation act on one 3x3 sum of all pairs
    arms = pull.T @ points
    gradient = np.concatenate([pull.sum(axis=0), [(arms * rotation_derivative(pose, o)).sum() for o in _ORDERS]])
    if normals is None:
        first = np.concatenate([along, np.matmul(along[:, None, :], turned)[:, 0, :]], axis=1)
        bent = np.matmul(inverse, turned) * w[:, None, None]
        hessian = -d2 * (first * w[:, None]).T @ first
        hessian[:3, :3] += (w @ inverse.reshape(-1, 9)).reshape(3, 3)
        cross = bent.sum(axis=0)
        hessian[:3, 3:] += cross
        hessian[3:, :3] += cross.T
        hessian[3:, 3:] += turned.reshape(-1, 3).T @ bent.reshape(-1, 3)
    else:
        direction = np.concatenate([normals, np.matmul(normals[:, None, :], turned)[:, 0, :]], axis=1)
        hessian = (direction * (w * (1 - d2 * q))[:, None]).T @ direction
    for i in range(3):
        for j in range(3):
            order = tuple(x + y for x, y in zip(_ORDERS[i], _ORDERS[j], strict=True))
            hessian[3 + i, 3 + j] += (arms * rotation_derivative(pose, order)).sum()
    return float(-d1 * weight.sum()), gradient, hessian, len(points)


def clamp_covariance(cov: np.ndarray, ratio: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a stack of covariances: which are valid, the clamped ones, their inverses and smallest axes.

    Eigenvalues below ``ratio`` of the greatest are raised to it; a covariance is
    rebuilt only where one was.  The axis' largest component is positive.
    """
    values, vectors = np.linalg.eigh(cov)
    valid = values[:, 2] > 0
    floor = ratio * values[:, 2:3]
    raised = np.where(valid[:, None], np.maximum(values, floor), 1.0)
    rebuilt = np.einsum("nij,nj,nkj->nik", vectors, raised, vectors)
    clamped = np.where((values < floor).any(axis=1)[:, None, None], rebuilt, cov)
    inverse = np.einsum("nij,nj,nkj->nik", vectors, 1.0 / raised, vectors)
    axis = vectors[:, :, 0]
    largest = np.take_along_axis(axis, np.abs(axis).argmax(axis=1)[:, None], axis=1)
    return valid, clamped, inverse, axis * np.where(largest < 0, -1.0, 1.0)


def pseudo_solve(hessian: np.ndarray, rhs: np.ndarray, tolerance: float = 1e-10) -> np.ndarray | None:
    """Least-squares solution by singular values; None if all are below the tolerance (of a stack: a row without numbers)."""
    if hessian.ndim == 2:
        found = pseudo_solve(hessian[None], rhs[None], tolerance)[0]
        return None if np.isnan(found).all() else found
    u, s, vt = np.linalg.svd(hessian)
    kept = np.where(s > tolerance, 1.0 / np.where(s > tolerance, s, 1.0), 0.0)
    inner = kept * np.matmul(u.transpose(0, 2, 1), rhs[:, :, None])[:, :, 0]
    return np.where(s[:, :1] < tolerance, np.nan, np.matmul(vt.transpose(0, 2, 1), inner[:, :, None])[:, :, 0])


def newton_step(gradient: np.ndarray, hessian: np.ndarray, tolerance: float = 1e-10) -> np.ndarray | None:
    return pseudo_solve(hessian, -gradient, tolerance)


def newton_step_regularized(gradient: np.ndarray, hessian: np.ndarray, weight: float, tolerance: float = 1e-10) -> np.ndarray | None:
    return pseudo_solve(hessian + weight * np.eye(hessian.shape[-1]), -gradient, tolerance)


def newton_step_cholesky(gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray | None:
    """By a Cholesky factor where the matrix is positive definite, else by singular values; of a stack, too."""
    try:
        lower = np.linalg.cholesky(hessian)
    except np.linalg.LinAlgError:
        if hessian.ndim == 2:
            return newton_step(gradient, hessian)
        found = [newton_step_cholesky(g, h) for g, h in zip(gradient, hessian, strict=True)]
        return np.array([np.full(len(g), np.nan) if f is None else f for f, g in zip(found, gradient, strict=True)])
    return -np.linalg.solve(np.swapaxes(lower, -1, -2), np.linalg.solve(lower, gradient[..., None]))[..., 0]


def is_negative_definite(matrix: np.ndarray) -> bool | np.ndarray:
    found = (np.linalg.eigvalsh(matrix) < 0).all(axis=-1)
    return found if matrix.ndim > 2 else bool(found)


def is_positive_definite(matrix: np.ndarray) -> bool | np.ndarray:
    found = (np.linalg.eigvalsh(matrix) > 0).all(axis=-1)
    return found if matrix.ndim > 2 else bool(found)


def make_negative_definite(hessian: np.ndarray, limit: float = -1e-3) -> np.ndarray:
    values, vectors = np.linalg.eigh(hessian)
    return (vectors * np.minimum(values, limit)[..., None, :]) @ np.swapaxes(vectors, -1, -2)


def newton_step_ascent(gradient: np.ndarray, hessian: np.ndarray, limit: float = -1e-3, tolerance: float = 1e-10) -> np.ndarray | None:
    """A Newton step towards a maximum, or a stack of them."""
    hessian = 0.5 * (hessian + np.swapaxes(hessian, -1, -2))
    fine = np.asarray(is_negative_definite(hessian))[..., None, None]
    return newton_step(gradient, hessian if fine.all() else np.where(fine, hessian, make_negative_definite(hessian, limit)), tolerance)


def condition_number(matrix: np.ndarray) -> float | np.ndarray:
    s = np.linalg.svd(matrix, compute_uv=False)
    found = np.where(s[..., -1] < 1e-15, math.inf, s[..., 0] / np.where(s[..., -1] < 1e-15, 1.0, s[..., -1]))
    return found if matrix.ndim > 2 else float(found)


def gnss_term(pose: np.ndarray, reference: tuple[float, float], weight: float, pairs: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Penalty on the distance to a reference position along the heading."""
    s, c = math.sin(pose[5]), math.cos(pose[5])
    along = (reference[1] - pose[1]) * s + (reference[0] - pose[0]) * c
    scale = weight * pairs
    gradient, hessian = np.zeros(6), np.zeros((6, 6))
    gradient[:2] = 2 * scale * along * np.array([c, s])
    hessian[:2, :2] = -2 * scale * np.outer([c, s], [c, s])
    return -scale * along * along, gradient, hessian


def armijo(phi0: float, phi: float, slope: float, step: float, mu: float = 1e-4) -> bool:
    """Enough increase of a function to be maximised."""
    return phi >= phi0 + mu * step * slope


def curvature(slope0: float, slope: float, nu: float = 0.9) -> bool:
    return abs(slope) <= nu * abs(slope0)


def strong_wolfe(phi0: float, slope0: float, phi: float, slope: float, step: float, mu: float = 1e-4, nu: float = 0.9) -> bool:
    return armijo(phi0, phi, slope0, step, mu) and curvature(slope0, slope, nu)


#: A search that asks for several values at once, is sent them as a list, and returns its result.
Steps = Generator[list, list, object]


def drive(steps: Steps, f: Callable[[object], object]) -> object:
    """The result of a search whose values ``f`` gives."""
    try:
        asked = next(steps)
        while True:
            asked = steps.send([f(x) for x in asked])
    except StopIteration as end:
        return end.value


def backtrack(f: Callable[[float], float], phi0: float, slope: float, step: float, mu: float = 1e-4, halvings: int = 20) -> float:
    return drive(backtrack_steps(phi0, slope, step, mu, halvings), lambda a: (f(a), 0.0))


def backtrack_steps(phi0: float, slope: float, step: float, mu: float = 1e-4, halvings: int = 20) -> Steps:
    for _ in range(halvings):
        ((phi, _),) = yield [step]
        if armijo(phi0, phi, slope, step, mu):
            return step
        step /= 2
    return step


def choose_candidate(steps: np.ndarray, phis: np.ndarray, slopes: np.ndarray, phi0: float, slope0: float, mu: float = 1e-4, nu: float = 0.9) -> float:
    """Of steps evaluated at once: the first that meets both conditions, else the best with enough increase, else the least."""
    enough = phis >= phi0 + mu * steps * slope0
    both = enough & (np.abs(slopes) <= nu * abs(slope0))
    if both.any():
        return float(steps[both.argmax()])
    if enough.any():
        return float(steps[np.where(enough, phis, -np.inf).argmax()])
    return float(steps.min())


def golden_candidates(first: float = 1.0, n: int = 8, ratio: float = 0.618) -> np.ndarray:
    return first * ratio ** np.arange(n)


def more_thuente(f: Callable[[float], tuple[float, float]], phi0: float, slope0: float, first: float, config: LineSearchConfig = LineSearchConfig()) -> float:
    """A step that meets the strong Wolfe conditions, by safeguarded interpolation.

    ``f`` gives value and slope of the function to be maximised; the search works
    on its negative.  The bracket holds the best step so far and an end; its
    auxiliary function switches to the function itself once a step has enough
    decrease and a rising slope (More and Thuente 1994).
    """
    return drive(more_thuente_steps(phi0, slope0, first, config), f)


def more_thuente_steps(phi0: float, slope0: float, first: float, config: LineSearchConfig = LineSearchConfig()) -> Steps:
    mu, nu = config.mu, config.nu
    slope0 = -slope0
    aux = lambda a, v, s: (v + phi0 - mu * a * slope0, s - mu * slope0)
    step = min(max(first, config.step_min), config.step_max)
    low, low_v, low_s = 0.0, 0.0, slope0 - mu * slope0
    high, high_v, high_s = 0.0, 0.0, low_s
    bracketed, plain = False, False
    for _ in range(config.max_iterations):
        ((v, s),) = yield [step]
        v, s = -v, -s
        psi, dpsi = aux(step, v, s)
        if psi <= 0 and abs(s) <= nu * abs(slope0):
            return step
        if step >= config.step_max and psi <= 0 and dpsi <= 0 or step <= config.step_min and (psi > 0 or dpsi >= 0):
            return step
        if not plain and psi <= 0 and s >= 0:
            plain = True  # from here the function itself, not the auxiliary one
            low_v, low_s = low_v + mu * low * slope0, low_s + mu * slope0
            high_v, high_s = high_v + mu * high * slope0, high_s + mu * slope0
        now_v, now_s = (v + phi0, s) if plain else (psi, dpsi)
        trial = _next_trial(low, low_v, low_s, high, high_v, high_s, step, now_v, now_s, bracketed, config)
        if now_v > low_v:
            high, high_v, high_s, bracketed = step, now_v, now_s, True
        elif now_s * (low - step) > 0:
            low, low_v, low_s = step, now_v, now_s
        else:
            high, high_v, high_s, bracketed = low, low_v, low_s, True
            low, low_v, low_s = step, now_v, now_s
        step = min(max(trial, config.step_min), config.step_max)
        if bracketed and abs(high - low) < 1e-12:
            break
    return step


def _cubic(a: float, fa: float, ga: float, b: float, fb: float, gb: float) -> float:
    """The minimiser of the cubic through two values and slopes; the midpoint where there is none."""
    if a == b:
        return a
    z = 3 * (fa - fb) / (b - a) + ga + gb
    inside = z * z - ga * gb
    if inside < 0:
        return 0.5 * (a + b)
    w = math.copysign(math.sqrt(inside), b - a)
    bottom = gb - ga + 2 * w
    return 0.5 * (a + b) if bottom == 0 else b - (b - a) * (gb + w - z) / bottom


def _next_trial(low, fl, gl, high, fh, gh, at, f, g, bracketed, config) -> float:
    """The four interpolation cases of the trial value."""
    secant = at if g == gl else at - (at - low) * g / (g - gl)
    if f > fl:  # the minimum lies between: cubic or its mean with the quadratic
        cubic = _cubic(low, fl, gl, at, f, g)
        bottom = (fl - f) / (at - low) + gl if at != low else 0.0
        quadratic = low + (at - low) * gl / (2 * bottom) if bottom else cubic
        return cubic if abs(cubic - low) < abs(quadratic - low) else 0.5 * (cubic + quadratic)
    if g * gl < 0:
        cubic = _cubic(low, fl, gl, at, f, g)
        return cubic if abs(cubic - at) >= abs(secant - at) else secant
    if abs(g) <= abs(gl):
        cubic = _cubic(low, fl, gl, at, f, g)
        ahead = (cubic - at) * (at - low) > 0
        if not ahead:
            cubic = config.step_max if at > low else config.step_min
        trial = cubic if (abs(cubic - at) < abs(secant - at)) == bracketed else secant
        if bracketed:
            bound = at + 0.66 * (high - at)
            trial = min(bound, trial) if at > low else max(bound, trial)
        return trial
    return _cubic(high, fh, gh, at, f, g) if bracketed else (config.step_max if at > low else config.step_min)


def count_oscillation(positions: np.ndarray, cosine: float = -0.9) -> int:
    """The longest run of consecutive reversals of direction."""
    streak = longest = 0
    for i in range(2, len(positions)):
        a, b = positions[i] - positions[i - 1], positions[i - 1] - positions[i - 2]
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        streak = streak + 1 if na >= 1e-10 and nb >= 1e-10 and a @ b / (na * nb) < cosine else 0
        longest = max(longest, streak)
    return longest


#: Cells of a bounding box that are kept as a table (4 bytes each).
DENSE_CELLS = 1 << 24


class VoxelIndex:
    """Voxels held in one task, found by packed cell key."""

    def __init__(self, cells: np.ndarray, means: np.ndarray, inverse: np.ndarray, axes: np.ndarray, resolution: float) -> None:
        keys = self.key(cells)
        order = np.argsort(keys)
        self.keys, self.means, self.inverse, self.axes = keys[order], means[order], inverse[order], axes[order]
        self.resolution = resolution
        self.around = np.array([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
        # a table of the bounding box (with a margin of two cells) where it is small
        self.low = cells.min(axis=0).astype(np.int64) - 2
        self.size = cells.max(axis=0).astype(np.int64) + 3 - self.low
        self.table = None
        if int(np.prod(self.size.astype(object))) <= DENSE_CELLS:
            self.table = np.full(int(np.prod(self.size)), -1, dtype=np.int32)
            self.table[self._place(cells[order].astype(np.int64) - self.low)] = np.arange(len(keys))
            self.steps = self._place(self.around.astype(np.int64))

    def _place(self, at: np.ndarray) -> np.ndarray:
        return (at[..., 2] * self.size[1] + at[..., 1]) * self.size[0] + at[..., 0]

    @staticmethod
    def key(cells: np.ndarray) -> np.ndarray:
        c = cells.astype(np.int64) + (1 << 20)
        return (c[..., 2] << 42) | (c[..., 1] << 21) | c[..., 0]

    def pairs(self, points: np.ndarray, within: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(point, voxel) of voxels in the 27 cells around each point, with the mean inside the radius."""
        if not len(points) or not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        cells = np.floor(points.astype(np.float32).astype(np.float64) / self.resolution).astype(np.int64)
        if self.table is not None:
            own = cells - self.low
            inside = np.flatnonzero(((own >= 1) & (own < self.size - 1)).all(axis=1))
            at = self.table[self._place(own[inside])[:, None] + self.steps[None]]
            row, slot = np.nonzero(at >= 0)
            point, voxel = inside[row], at[row, slot]
        else:
            keys = self.key(cells[:, None, :] + self.around[None])
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            point, slot = np.nonzero(self.keys[at] == keys)
            voxel = at[point, slot]
        if within:
            d = points[point] - self.means[voxel]
            near = (d * d).sum(axis=1) <= self.resolution**2
            point, voxel = point[near], voxel[near]
        return point, voxel


    def within(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, voxel) of voxels whose mean is within each point's own radius; sorted by point."""
        if not len(points) or not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        radius = radius * (1 + 1e-9) + 1e-9
        k = max(1, math.ceil(float(radius.max()) / self.resolution))
        around = np.stack(np.meshgrid(*[np.arange(-k, k + 1)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
        cells = np.floor(np.clip(points / self.resolution, -(2.0**19), 2.0**19)).astype(np.int64)
        found = []
        for a in range(0, len(points), 1 << 14):
            keys = self.key(cells[a : a + (1 << 14), None, :] + around[None])
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            point, slot = np.nonzero(self.keys[at] == keys)
            voxel, point = at[point, slot], point + a
            d = points[point] - self.means[voxel]
            near = (d * d).sum(axis=1) <= radius[point] ** 2
            found.append((point[near], voxel[near]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def derivatives(points: np.ndarray, index: VoxelIndex, pose: np.ndarray, d1: float, d2: float, metric: str = "distribution") -> tuple[float, np.ndarray, np.ndarray, int]:
    point, voxel = index.pairs(transform(points, pose))
    return pair_derivatives(points[point], index.means[voxel], index.inverse[voxel], pose, d1, d2, index.axes[voxel] if metric == "plane" else None)


def scores(points: np.ndarray, index: VoxelIndex, pose: np.ndarray, d1: float, d2: float) -> dict[str, float]:
    """score, tp_pairs, tp_points, nvtl and counts of a scan at a pose."""
    moved = transform(points, pose)
    point, voxel = index.pairs(moved)
    d = moved[point] - index.means[voxel]
    pair = -d1 * np.exp(-0.5 * d2 * (np.matmul(index.inverse[voxel], d[:, :, None])[:, :, 0] * d).sum(axis=1))
    best = np.full(len(points), -np.inf)
    np.maximum.at(best, point, pair)
    met = np.isfinite(best)
    total = float(pair.sum())
    return {
        "score": total, "pairs": len(pair), "tp_pairs": total / len(pair) if len(pair) else 0.0, "tp_points": total / len(points) if len(points) else 0.0,
        "nvtl": float(best[met].mean()) if met.any() else 0.0, "unmatched": int((~met).sum()),
    }


def steps_along(phi0: float, slope0: float, first: float, kind: str, config: LineSearchConfig) -> Steps:
    """A step by the line search of a name; asks for value and slope at steps."""
    if kind == "more_thuente":
        return (yield from more_thuente_steps(phi0, slope0, first, config))
    if kind == "backtracking":
        return (yield from backtrack_steps(phi0, slope0, first, config.mu))
    if kind == "candidates":
        steps = golden_candidates(first)
        values = np.array((yield list(steps)))
        return choose_candidate(steps, values[:, 0], values[:, 1], phi0, slope0, config.mu, config.nu)
    raise ValueError(f"no line search {kind!r}")


def align(
    points: np.ndarray, index: VoxelIndex, initial: np.ndarray, config: MatchConfig = MatchConfig(),
    line_search: LineSearchConfig = LineSearchConfig(), gnss: tuple[float, float] | None = None,
    evaluate: Callable[[np.ndarray, int], tuple[float, np.ndarray, np.ndarray, int]] | None = None,
) -> dict:
    """Newton ascent of the score.  ``evaluate`` replaces the local derivatives of a pose up to an order, e.g. by a distributed sum."""
    d1, d2 = gaussian_constants(config.resolution, config.outlier_ratio)
    own = evaluate or (lambda pose, _: derivatives(points, index, pose, d1, d2, config.metric))
    return drive(align_steps(initial, config, line_search, gnss), lambda asked: own(*asked))


def align_steps(initial: np.ndarray, config: MatchConfig = MatchConfig(), line_search: LineSearchConfig = LineSearchConfig(), gnss: tuple[float, float] | None = None) -> Steps:
    """The ascent as a search that asks for (pose, order): score, gradient, Hessian and pairs; order 1 does without the Hessian."""

    def at(poses: list[np.ndarray], order: int) -> Steps:
        found = yield [(pose, order) for pose in poses]
        if gnss is not None and config.regularization_weight > 0:
            more = [gnss_term(pose, gnss, config.regularization_weight, f[3]) for pose, f in zip(poses, found, strict=True)]
            found = [(s + m[0], g + m[1], h + m[2], n) for (s, g, h, n), m in zip(found, more, strict=True)]
        return found

    pose = np.asarray(initial, dtype=float).copy()
    best, log, status = None, [], "max_iterations"
    hessian, pairs, iteration = np.zeros((6, 6)), 0, 0
    for iteration in range(config.max_iterations + 1):
        ((score, gradient, hessian, pairs),) = yield from at([pose], 2)
        entry = {"iteration": iteration, "pose": pose.tolist(), "score": score, "gradient": gradient.tolist(), "num_correspondences": pairs, "step_length": 0.0, "newton_step_norm": 0.0, "direction_reversed": False}
        log.append(entry)
        if pairs < config.min_correspondences:
            status = "no_correspondences"
            break
        if best is None or score > best[0]:
            best = (score, pose.copy(), hessian, pairs)
        if iteration == config.max_iterations:
            break
        step = newton_step_ascent(gradient, hessian, config.max_eigenvalue, config.svd_tolerance)
        if step is None:
            status = "singular"
            break
        norm = float(np.linalg.norm(step))
        entry["newton_step_norm"] = norm
        if norm < config.trans_epsilon:
            status = "converged"
            break
        direction = step / norm
        if gradient @ direction <= 0:
            direction = -direction
            entry["direction_reversed"] = True
        length = min(norm, config.step_size)
        if config.use_line_search:
            search, values = steps_along(score, float(gradient @ direction), length, config.search, line_search), None
            try:
                while True:
                    steps = search.send(values)
                    found = yield from at([pose + a * direction for a in steps], 1)
                    values = [(s, float(g @ direction)) for s, g, _, _ in found]
            except StopIteration as end:
                length = end.value
        entry["step_length"] = length
        pose = pose + length * direction
    if status == "max_iterations" and best is not None:
        score, pose, hessian, pairs = best
    if status == "no_correspondences" and len(log) == 1:
        pose = np.asarray(initial, dtype=float)
    return {
        "pose": pose, "status": status, "score": log[-1]["score"] if status != "max_iterations" else score, "iterations": iteration, "hessian": hessian, "pairs": pairs,
        "oscillation": count_oscillation(np.array([x["pose"][:3] for x in log])), "log": log,
    }
