"""Least squared loss of many small curves inside bounds, by variable projection.

With k = exp((c - t0) / b) / 2, t0 the first day, the curve is

    y(t) = a * exp(-d * t) - a * k * exp(-d * t - (t - t0) / b)

so for fixed b and d it is linear in a and a * k, and the bounds of a and c cut a corner out
of the plane of the two. The inner problem is solved in closed form: the free solution if
it lies in the corner, else the best point of the four edges. What is left is a function of
b and d alone. It is laid out on a whole grid of bounded steps; the general solver goes down
from the floor of every valley of the grid, and the least end is the fit. No start value
of the user's has a part in it.

On the grid b and d form rows and columns, so exponentials are taken per row and per
column, and the sums over days are matrix products.
"""

from __future__ import annotations

import numpy as np

from lactoscope.operators import solver

# Days are whole, so a ramp of a twentieth of a day is over within any two of them.
LEAST_B = 0.05
# Greatest steps of the grid, of log b and of d: on them neighbouring curves are alike enough
# for every valley to show.
STEPS, LEAST_STEPS = (0.2, 1e-4), 24
VALLEYS = 5
# The second look at an end: rounds of steps, and how often it may be followed by a descent.
ROUNDS, AGAIN = 8, 3
# Places on the curve b * d = limit, and rounds that look closer at the best of them.
EDGE, EDGE_ROUNDS = 257, 12
_CELLS = 1 << 18
# Cells of a grid that are laid out at once; the many arrays over them stay in a core's cache.
_CELLS_AT_ONCE = 1 << 15
_KEPT = 30 << 17
_LARGEST, _NOTHING = 300.0, 1e-60


def solvable(lower: np.ndarray, upper: np.ndarray) -> bool:
    """Whether bounds are finite and keep the curve's level and ramp from turning over."""
    return bool(np.isfinite([lower, upper]).all() and lower[0] >= 0 and lower[1] >= 0 and upper[1] > LEAST_B)


def _corner(t0: np.ndarray, b: np.ndarray, lower, upper) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest k for the bounds of c."""
    low, high = (np.exp(np.minimum(np.maximum((c - t0) / b, -_LARGEST), _LARGEST)) / 2.0 for c in (lower[2], upper[2]))
    return low, high


def _finite(values: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(values), values, 0.0)


def inner(t, y, w, b, d, lower, upper):
    """Best (a, a * k) and loss for every pair of the ``b`` (n, q) and ``d`` (n, r) of each row.

    Results have the shape (n, q, r).
    """
    return _inner(t, y, w, b, d, lower, upper, True)


def inner_loss(t, y, w, b, d, lower, upper):
    """The loss alone, a few rows at a time."""
    size = max(1, _CELLS_AT_ONCE // (b.shape[1] * d.shape[1]))
    parts = [slice(begin, begin + size) for begin in range(0, len(t), size)]
    return np.concatenate([_inner(*(x[part] for x in (t, y, w, b, d)), lower, upper, False)[2] for part in parts])


def _inner(t, y, w, b, d, lower, upper, places: bool):
    t0 = t[:, :1]
    ramp = np.exp(-(t - t0)[:, None, :] / b[:, :, None])
    # Beside the first day's 1 such a value is lost in every sum, and its square is slow to reckon with.
    ramp[ramp < _NOTHING] = 0.0
    fall = np.exp(-t[:, None, :] * d[:, :, None])
    fall_w = fall * w[:, None, :]
    square = fall_w * fall
    fall_y = fall_w * y[:, None, :]
    g11 = square.sum(axis=2)[:, None, :]
    r1 = fall_y.sum(axis=2)[:, None, :]
    low, high = (k[:, :, None] for k in _corner(t0, b, lower, upper))
    a_low, a_high = lower[0], upper[0]
    whole = (w * y * y).sum(axis=1)[:, None, None]
    with np.errstate(all="ignore"):
        # Sums over days in parts of g11 and r1: g12 = p * g11, g22 = q * g11, r2 = s * r1.
        across = (square / g11[:, 0, :, None]).transpose(0, 2, 1)
        p, q, s = ramp @ across, (ramp * ramp) @ across, ramp @ (fall_y / r1[:, 0, :, None]).transpose(0, 2, 1)
        # For a ratio k = beta / alpha the best alpha is r1 / g11 * n / m, and the loss falls by r1 * n times it.
        # Where the free solution has alpha > 0 that has one peak over k, at the free solution's ratio, so
        # the best k is that ratio moved into the corner.
        below = s * p
        np.subtract(q, below, out=below)
        plain = below > 0
        k = p - s
        k /= below
        np.maximum(k, low, out=k)
        np.minimum(k, high, out=k)
        n = k * s
        np.subtract(1.0, n, out=n)
        m = np.multiply(k, q, out=below)
        m -= p
        m -= p
        m *= k
        m += 1.0
        part = np.divide(n, m, out=m)
        level = r1 / g11
        too_high = part > a_high / level
        plain &= r1 > 0
        if a_low > 0:
            plain &= part >= a_low / level
        np.maximum(part, 0.0, out=part)
        alpha = part * level if places else None
        beta = k * alpha if places else None
        n *= part
        n *= r1 * level
        loss = np.subtract(whole, n, out=n)
        plain &= np.multiply(p, p, out=part) < np.multiply(q, 1 - 1e-11, out=k)
        # The loss is convex: an alpha above its bound ends on it. All other cells go by their edges.
        too_high &= plain
        for which, solved in ((too_high, _at_level), (~plain, _on_edges)):
            at = np.flatnonzero(which)
            if len(at):
                line, j = np.divmod(at, d.shape[1])
                row = line // b.shape[1]
                by_d = row * d.shape[1] + j
                g, r = g11.take(by_d), r1.take(by_d)
                r2 = s.take(at) * r
                if not r.all():
                    # Nothing can be taken in parts of 0.
                    r2 = (ramp.reshape(-1, t.shape[1])[line] * fall_y[row, j]).sum(axis=1)
                found = solved(g, p.take(at) * g, q.take(at) * g, r, r2, low.take(line), high.take(line), a_low, a_high)
                loss.reshape(-1)[at] = whole.take(row) + found[2]
                if places:
                    alpha.reshape(-1)[at], beta.reshape(-1)[at] = found[:2]
    return alpha, beta, loss


def _loss_of(alpha, beta, g11, g12, g22, r1, r2):
    return alpha * (alpha * g11 - beta * 2.0 * g12 - 2.0 * r1) + beta * (beta * g22 + 2.0 * r2)


def _at_level(g11, g12, g22, r1, r2, low, high, a_low, a_high):
    """Best (alpha, beta) and loss with alpha at its upper bound."""
    beta = np.minimum(np.maximum(_finite((a_high * g12 - r2) / g22), low * a_high), high * a_high)
    return a_high, beta, _loss_of(a_high, beta, g11, g12, g22, r1, r2)


def _on_edges(g11, g12, g22, r1, r2, low, high, a_low, a_high):
    """Best (alpha, beta) and loss: the free solution if it lies in the corner, else the best point of its four edges."""
    sums = g11, g12, g22, r1, r2
    det = g11 * g22 - g12 * g12
    alpha = (r1 * g22 - r2 * g12) / det
    beta = (r1 * g12 - r2 * g11) / det
    free = (det > 1e-11 * g11 * g22) & (alpha >= a_low) & (alpha <= a_high) & (beta >= low * alpha) & (beta <= high * alpha)
    best = [np.where(free, alpha, 0.0), np.where(free, beta, 0.0), np.where(free, _loss_of(alpha, beta, *sums), np.inf)]

    def offer(alpha, beta):
        loss = _loss_of(alpha, beta, *sums)
        better = loss < best[2]
        best[:] = [np.where(better, new, old) for new, old in zip((alpha, beta, loss), best)]

    for k in (low, high):
        bottom = g11 - k * 2.0 * g12 + k * k * g22
        on_edge = np.clip(_finite((r1 - k * r2) / bottom), a_low, a_high)
        offer(on_edge, k * on_edge)
    for level in {a_low, a_high}:
        across_it = _finite((level * g12 - r2) / g22)
        offer(level, np.clip(across_it, low * level, high * level))
    return best


def _valleys(loss: np.ndarray, ds: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places along b where the loss, best in d, has no lower neighbour: row number, b's number and d, each once.

    Between grid values of d the loss is taken as a parabola, so a valley that runs between
    two of them shows. Of level ground only the first place counts, or one plateau would
    take all. ``count`` valleys at most are given for each row, the lowest ones.
    """
    n, rows, columns = loss.shape
    at = loss.argmin(axis=2)
    inner_at = np.clip(at, 1, columns - 2)
    left, middle, right = (np.take_along_axis(loss, inner_at[:, :, None] + k, axis=2)[:, :, 0] for k in (-1, 0, 1))
    bend = left - 2.0 * middle + right
    shift = np.clip(np.nan_to_num(np.where(bend > 0, (left - right) / (2.0 * bend), 0.0)), -1.0, 1.0)
    parabola = middle + shift * (right - left) / 2.0 + shift * shift * bend / 2.0
    edge = (at == 0) & (shift <= -1.0) | (at == columns - 1) & (shift >= 1.0) | (bend <= 0) | ~np.isfinite(parabola)
    value = np.where(edge, np.take_along_axis(loss, at[:, :, None], axis=2)[:, :, 0], np.maximum(parabola, 0.0))
    step = ds[1] - ds[0]
    d = np.where(edge, ds[at], ds[inner_at] + shift * step)
    far = np.full((n, 1), np.inf)
    before, after = np.hstack([far, value[:, :-1]]), np.hstack([value[:, 1:], far])
    lowest = (value * (1 + 1e-9) < before) & (value <= after * (1 + 1e-9))
    ranked = np.where(lowest, value, np.inf)
    ranked[np.arange(n), value.argmin(axis=1)] = -np.inf
    order = np.argsort(ranked, axis=1, kind="stable")[:, :count]
    whose, nth = np.nonzero(np.take_along_axis(ranked, order, axis=1) < np.inf)
    i = order[whose, nth]
    return whose, i, d[whose, i]


def _around(t, y, w, u, d, steps, bounds, lower, upper):
    """The best of 25 places around each (log b, d), again and again in smaller steps."""
    (u_low, u_high), (d_low, d_high) = bounds
    around, every = np.arange(-2, 3), np.arange(len(t))
    u, d, size = u.copy(), d.copy(), np.ones(len(t))
    for _ in range(ROUNDS):
        us = np.clip(u[:, None] + around * (size[:, None] * steps[0]), u_low, u_high)
        ds = np.clip(d[:, None] + around * (size[:, None] * steps[1]), d_low, d_high)
        found = inner_loss(t, y, w, np.exp(us), ds, lower, upper).reshape(-1, 25)
        found = np.where(np.isfinite(found), found, np.inf)
        at = found.argmin(axis=1)
        loss, stays = found[every, at], at == 12
        u, d = us[every, at // 5], ds[every, at % 5]
        size = np.where(stays, size / 3, size)
    return u, d, loss


def _along_limit(t, y, w, limit, bounds, lower, upper):
    """Least loss with d as large as the limit on b * d and its own bound allow: log b, d and loss per row."""
    (u_low, u_high), (d_low, d_high) = bounds
    n, width = len(t), (u_high - u_low) / (EDGE - 1)
    u = np.tile(np.linspace(u_low, u_high, EDGE), (n, 1))
    best_u, best_loss = np.full(n, u_low), np.full(n, np.inf)
    for _ in range(EDGE_ROUNDS):
        d = np.minimum(limit / np.exp(u), d_high)
        many = u.shape[1]
        rows = [np.repeat(x, many, axis=0) for x in (t, y, w)]
        loss = inner_loss(*rows, np.exp(u).reshape(-1, 1), d.reshape(-1, 1), lower, upper).reshape(n, many)
        loss = np.where(np.isfinite(loss) & (d >= d_low), loss, np.inf)
        at = loss.argmin(axis=1)
        better = loss[np.arange(n), at] < best_loss
        best_u, best_loss = np.where(better, u[np.arange(n), at], best_u), np.where(better, loss[np.arange(n), at], best_loss)
        u, width = np.clip(best_u[:, None] + width * np.linspace(-1, 1, 17), u_low, u_high), width / 8
    return best_u, np.minimum(limit / np.exp(best_u), d_high), best_loss


def fit_projected(t, y, w, start, lower, upper, max_iterations: int = 500, limit: float | None = None):
    """Fit every row of ``t, y, w`` (groups x points; weight 0 marks padding) inside bounds.

    Returns parameters (n, 4), loss, iterations, converged and the weighted Jacobian, as the
    general solver does. Rows with values that are not finite do not converge. ``start``
    gives c where the level is 0 and so any c does. ``limit`` bounds b * d: where the least
    end would break it, the least of the ends that keep it and of the curve b * d = limit is
    the fit.
    """
    lower, upper = np.array(lower, dtype=float), np.asarray(upper, dtype=float)
    lower[1] = max(lower[1], LEAST_B)
    n = len(t)
    usable = np.isfinite(np.where(w > 0, y, 0.0)).all(axis=1) & np.isfinite(w).all(axis=1) & (w > 0).any(axis=1)
    y = np.where((w > 0) & np.isfinite(y), y, 0.0)
    first = np.where(w > 0, t, np.inf).min(axis=1, keepdims=True)
    t = np.where(w > 0, t, np.where(np.isfinite(first), first, 1.0))
    order = np.argsort(t, axis=1, kind="stable")
    t, y, w = (np.take_along_axis(x, order, axis=1) for x in (t, y, w))
    u_low, u_high = np.log(lower[1]), np.log(upper[1])
    sizes = [max(LEAST_STEPS, int(np.ceil((high - low) / step))) + 1 for (low, high), step in zip(((u_low, u_high), (lower[3], upper[3])), STEPS)]
    us, ds = np.linspace(u_low, u_high, sizes[0]), np.linspace(lower[3], upper[3], sizes[1])
    steps = (us[1] - us[0]) / 2, (ds[1] - ds[0]) / 2
    start = np.clip(np.broadcast_to(np.asarray(start, dtype=float), (n, 4)), lower, upper)
    size = max(1, _CELLS // (sizes[0] * sizes[1]))
    # Once a block of this size was freed, glibc keeps freed memory of the small arrays instead of fetching it anew.
    np.empty(_KEPT)
    with np.errstate(all="ignore"):
        found = []
        for begin in range(0, n, size):
            part = slice(begin, begin + size)
            many = len(t[part])
            grid = inner_loss(t[part], y[part], w[part], np.tile(np.exp(us), (many, 1)), np.tile(ds, (many, 1)), lower, upper)
            whose, i, d = _valleys(np.where(np.isfinite(grid), grid, np.finfo(float).max / 8), ds, VALLEYS)
            found.append((whose + begin, i, d))
        whose, i, d = (np.concatenate(x) for x in zip(*found))

        def closed(who, u, d):
            """Parameters at places (log b, d), the rest in closed form."""
            alpha, beta, _ = (x[:, 0, 0] for x in inner(t[who], y[who], w[who], np.exp(u)[:, None], d[:, None], lower, upper))
            c = np.exp(u) * np.log(np.maximum(2.0 * beta, 1e-300) / np.where(alpha > 0, alpha, 1.0)) + t[who, 0]
            c = np.where(alpha > 0, np.clip(c, lower[2], upper[2]), start[who, 2])
            return np.column_stack([alpha, np.exp(u), c, d])

        def gone_down(who, u, d):
            return solver.fit_batch(t[who], y[who], w[who], closed(who, u, d), lower, upper, max_iterations)

        ends = list(gone_down(whose, us[i], d))
        if limit is not None:
            ends[1] = np.where(ends[0][:, 1] * ends[0][:, 3] <= limit, ends[1], np.inf)
        # Of each row the end of least loss.
        by_loss = np.lexsort((np.where(np.isfinite(ends[1]), ends[1], np.inf), whose))
        at = by_loss[np.searchsorted(whose[by_loss], np.arange(n))]
        best = [end[at] for end in ends]
        best[2] = np.bincount(whose, ends[2], n).astype(np.int32)
        bounds = ((u_low, u_high), (lower[3], upper[3]))
        # An end on a bound of c may hide a way down that the closed form sees. A row that gains nothing by it is done.
        again = np.arange(n)
        for _ in range(AGAIN):
            u, d, loss = _around(t[again], y[again], w[again], np.log(best[0][again, 1]), best[0][again, 3], steps, bounds, lower, upper)
            lower_still = np.flatnonzero(loss < best[1][again] * (1 - 1e-9) - 1e-9)
            again, u, d = again[lower_still], u[lower_still], d[lower_still]
            if not len(again):
                break
            further = gone_down(again, u, d)
            gains = further[1] < best[1][again]
            if limit is not None:
                gains &= further[0][:, 1] * further[0][:, 3] <= limit
            again = again[gains]
            if not len(again):
                break
            for target, end in zip(best, further):
                target[again] = end[gains]
        if limit is not None:
            u, d, loss = _along_limit(t, y, w, limit, bounds, lower, upper)
            edge = loss < best[1]
            p = closed(np.arange(n), u, d)
            best[0], best[1] = np.where(edge[:, None], p, best[0]), np.where(edge, loss, best[1])
    p, loss, used, _, jacobian = best
    # The least of many ends is the answer, whether or not its own last steps were still gaining.
    return p, loss, used, usable & np.isfinite(loss), jacobian
