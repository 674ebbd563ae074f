"""Bounded weighted least squares for many small curves at once.

The curve is y(t) = a * (1 - exp((c - t) / b) / 2) * exp(-d * t). All groups of a
batch share each NumPy call, so Python cost is per iteration and not per group.
A step solves the damped normal equations over the parameters that are free to
move and is then clipped into the bounds.
"""

from __future__ import annotations

import numpy as np

FITTED, FAILED, NO_COVARIANCE, TOO_FEW = 0, 1, 2, 3

_TOLERANCE = 1e-13
_LAST = (100, 1e-5)  # a gain below this share over the last turns counts as converged
_DAMPING = (1e-3, 1e-12, 1e14)
# Rows of a chunk that may differ in length by any factor, and the factor for more.
_FEW, _NEAR = 1024, 1.6
# Cells of the rows that take steps together.
_CELLS_AT_ONCE = 1 << 15


def chunks(lengths: np.ndarray, cells: int = 1 << 17):
    """Row numbers in groups of like length, so that padding and memory stay small."""
    order, begin = np.argsort(lengths, kind="stable"), 0
    while begin < len(order):
        end, near = begin + 1, _NEAR * lengths[order[begin]]
        while end < len(order) and (end + 1 - begin) * lengths[order[end]] <= cells and (end - begin < _FEW or lengths[order[end]] <= near):
            end += 1
        yield order[begin:end]
        begin = end


def curve_values(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    a, b, c, d = (p[:, i, None] for i in range(4))
    return a * (1.0 - np.exp((c - t) / b) / 2.0) * np.exp(-d * t)


def _derivatives(p: np.ndarray, t: np.ndarray, half: np.ndarray, decay: np.ndarray, out: np.ndarray) -> np.ndarray:
    a, b, c, d = (p[:, i, None] for i in range(4))
    by_a, by_b, by_c, by_d = (out[:, i] for i in range(4))
    np.multiply(1.0 - half, decay, out=by_a)
    np.multiply(half * decay, -a / b, out=by_c)
    np.multiply((c - t) / b, by_c, out=by_b)
    np.negative(by_b, out=by_b)
    # Past the ramp the curve no longer depends on b and c, also for b = 0.
    if len(b) and not np.abs(b).min() > 1e-3:
        past = ~(half > 0)
        by_c[past] = by_b[past] = 0.0
    np.multiply(-t * a, by_a, out=by_d)
    return out


def _parts(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, b, c, d = (p[:, i, None] for i in range(4))
    return np.exp((c - t) / b) / 2.0, np.exp(-d * t)


def _loss(p, t, y, w):
    """Loss, residuals and the two parts of the curve."""
    half, decay = _parts(p, t)
    r = y - p[:, 0, None] * (1.0 - half) * decay
    loss = (w * r * r).sum(axis=1)
    return np.where(np.isfinite(loss), loss, np.inf), r, half, decay


def _padded(p, t, w):
    # Padding repeats a harmless day, so that no overflow comes from unused cells.
    return np.where(w > 0, t, t.max(axis=1, keepdims=True))


def fit_batch(t, y, w, start, lower, upper, max_iterations: int = 500):
    """Fit every row of ``t, y, w`` (groups x points; weight 0 marks padding).

    Returns parameters (n, 4), loss, iterations, converged and the weighted
    Jacobian (n, points, 4). Rows take steps together, a part of them at once; where
    some have ended others take their places.
    """
    n, points = t.shape
    lower, upper = np.broadcast_to(lower, (n, 4)), np.broadcast_to(upper, (n, 4))
    p = np.clip(np.array(start, dtype=float), lower, upper)
    t = _padded(p, t, w)
    loss = np.full(n, np.inf)
    iterations = np.zeros(n, dtype=np.int32)
    converged = np.zeros(n, dtype=bool)
    jacobian = np.empty((n, 4, points))
    size = max(1, _CELLS_AT_ONCE // max(1, points))
    with np.errstate(all="ignore"):
        for begin in range(0, n, size):
            part = slice(begin, begin + size)
            loss[part] = _loss(p[part], t[part], y[part], w[part])[0]
        waiting = np.flatnonzero(np.isfinite(loss)) if max_iterations > 0 else np.zeros(0, dtype=np.int64)
        steps = None
        while len(waiting) or steps is not None:
            if len(waiting) and (steps is None or len(steps.rows) <= size - size // 4):
                more = size - (0 if steps is None else len(steps.rows))
                entering, waiting = waiting[:more], waiting[more:]
                fresh = _Steps(entering, p, t, y, w, lower, upper)
                steps = fresh if steps is None else steps.joined(fresh)
            ended = steps.take(max_iterations)
            if ended.any():
                rows = steps.rows[ended]
                p[rows], loss[rows] = steps.p[ended], steps.loss[ended]
                iterations[rows], converged[rows] = steps.iterations[ended], steps.converged[ended]
                steps = None if ended.all() else steps.only(~ended)
        for begin in range(0, n, size):
            part = slice(begin, begin + size)
            _derivatives(p[part], t[part], *_parts(p[part], t[part]), out=jacobian[part])
            jacobian[part] *= np.sqrt(w[part])[:, None, :]
    return p, loss, iterations, converged, jacobian.transpose(0, 2, 1)


class _Steps:
    """Rows that take steps, with the curve's parts at the place of each."""

    _kept = ("rows", "p", "t", "y", "w", "lower", "upper", "reach", "loss", "r", "half", "decay", "damping", "quiet", "iterations", "earlier", "converged")

    def __init__(self, rows, p, t, y, w, lower, upper):
        self.rows, self.p, self.t, self.y, self.w, self.lower, self.upper = rows, p[rows], t[rows], y[rows], w[rows], lower[rows], upper[rows]
        # A quarter of the range at most, or a flat direction leaps between its bounds.
        self.reach = (self.upper - self.lower) / 4.0
        self.loss, self.r, self.half, self.decay = _loss(self.p, self.t, self.y, self.w)
        self.damping, self.quiet = np.full(len(rows), _DAMPING[0]), np.zeros(len(rows), dtype=np.int32)
        self.iterations, self.earlier = np.zeros(len(rows), dtype=np.int32), self.loss.copy()
        self.converged = np.zeros(len(rows), dtype=bool)

    def _with(self, change):
        other = object.__new__(_Steps)
        for name in self._kept:
            setattr(other, name, change(name))
        return other

    def joined(self, other):
        return self._with(lambda name: np.concatenate([getattr(self, name), getattr(other, name)]))

    def only(self, kept):
        return self._with(lambda name: getattr(self, name)[kept])

    def take(self, max_iterations: int) -> np.ndarray:
        """One step of every row; which of them have ended."""
        p, t, lower, upper, old_loss = self.p, self.t, self.lower, self.upper, self.loss
        # The residuals as a fifth row: one product gives the normal matrix and the gradient.
        jac = np.empty((len(p), 5, t.shape[1]))
        _derivatives(p, t, self.half, self.decay, jac[:, :4])
        jac[:, 4] = self.r
        product = (jac[:, :4] * self.w[:, None, :]) @ jac.transpose(0, 2, 1)
        normal, gradient = product[:, :, :4], product[:, :, 4]
        held = ((p <= lower) & (gradient < 0)) | ((p >= upper) & (gradient > 0))
        step = np.clip(_step(normal, gradient, held, self.damping), -self.reach, self.reach)
        trial = np.clip(p + step, lower, upper)
        new_loss, r, half, decay = _loss(trial, t, self.y, self.w)
        better = new_loss < old_loss
        gain = np.where(better, old_loss - new_loss, 0.0)
        # How far the linear model foretold the gain decides the next damping.
        moved = trial - p
        foretold = (moved * (2.0 * gradient - (normal @ moved[:, :, None])[:, :, 0])).sum(axis=1)
        flat = (trial == p + step).all(axis=1) & (foretold >= 0)
        small = np.where(better, gain, np.where(flat, foretold, np.inf)) <= _TOLERANCE * old_loss
        trust = gain / np.where(foretold > 0, foretold, np.inf)
        factor = np.where(trust > 0.75, 0.2, np.where(trust > 0.25, 0.7, 3.0))
        taken = better[:, None]
        self.p, self.loss = np.where(taken, trial, p), np.where(better, new_loss, old_loss)
        for name, new in (("r", r), ("half", half), ("decay", decay)):
            np.copyto(getattr(self, name), new, where=taken)
        self.damping = np.maximum(self.damping * np.where(better, factor, 4.0), _DAMPING[1])
        self.iterations += 1
        self.quiet = np.where(small, self.quiet + 1, np.where(better, 0, self.quiet))
        done = (self.quiet >= 3) | (self.damping > _DAMPING[2]) | (self.loss == 0) | held.all(axis=1)
        if max_iterations > _LAST[0]:
            self.earlier = np.where(self.iterations == max_iterations - _LAST[0], self.loss, self.earlier)
        # Flat ground: what the last turns gained no longer matters.
        level = (self.earlier - self.loss <= _LAST[1] * self.loss) & (max_iterations > _LAST[0])
        last = self.iterations >= max_iterations
        self.converged = done | (last & level)
        return done | last


def _step(normal, gradient, held, damping):
    """Damped step over free parameters; held ones stay where they are."""
    system = np.empty((4, 5, len(normal)))
    system[:, :4], system[:, 4] = normal.transpose(1, 2, 0), gradient.T
    i = np.arange(4)
    # Unit diagonal keeps the four very different magnitudes in one range.
    diagonal = system[i, i]
    scale = np.where(held.T, 0.0, 1.0 / np.sqrt(np.where(diagonal > 0, diagonal, 1.0)))
    system *= scale[:, None]
    system[:, :4] *= scale
    system[i, i] = 1.0 + damping
    usable = np.isfinite(system).all(axis=(0, 1))
    if not usable.all():
        system[:, :, ~usable] = np.eye(4, 5)[:, :, None]
    # The diagonal stays above the damping, so no row has to change its place.
    for k in range(3):
        share = system[k + 1 :, k] / system[k, k]
        system[k + 1 :, k + 1 :] -= share[:, None] * system[k, k + 1 :]
    found = system[:, 4]
    for k in (3, 2, 1, 0):
        if k < 3:
            found[k] -= (system[k, k + 1 : 4] * found[k + 1 :]).sum(axis=0)
        found[k] /= system[k, k]
    return (found * scale).T


def covariance(weighted_jacobian, loss, points, bounded):
    """Covariance of the parameters; NaN where it cannot be estimated.

    It needs more points than parameters. Directions without any information are
    left out in bounded fits and make the covariance unknown in unbounded ones.
    """
    groups = len(loss)
    result = np.full((groups, 4, 4), np.nan)
    rows = np.flatnonzero((points > 4) & np.isfinite(weighted_jacobian).all(axis=(1, 2)) & np.isfinite(loss))
    if len(rows):
        _, size, axes = np.linalg.svd(weighted_jacobian[rows], full_matrices=False)
        least = np.finfo(float).eps * np.maximum(points[rows], 4) * size[:, 0]
        informed = size > least[:, None]
        inverse = np.where(informed, 1.0 / np.where(informed, size, 1.0), 0.0)
        scaled = axes * inverse[:, :, None]
        matrix = np.einsum("gki,gkj->gij", scaled, scaled)
        if not bounded:
            full = informed.sum(axis=1) == 4
            rows, matrix = rows[full], matrix[full]
        result[rows] = matrix * (loss[rows] / (points[rows] - 4))[:, None, None]
    return result
