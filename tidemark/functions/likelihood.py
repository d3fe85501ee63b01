"""Exact Gaussian likelihood of many ARMA models at once, and its maximum.

Every function takes a batch of models, one per row: (models, ...) arrays. The Kalman recursion of
the state space of Harvey (1989) runs over time, and each of its steps is arithmetic on the whole
batch. The mean is found by generalised least squares inside the likelihood (the recursion filters
a constant beside the series), the variance in closed form, so that only the ``p + q`` partial
autocorrelations are left to the optimiser.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

DOUBLINGS = 40  # of the sum that gives the variance of the first state
STEADY = 1e-15  # a change of the state's variance below which it is taken as final
REACH = 12.0  # bound of the optimiser's variables; tanh(6) = 0.99999
SMALL = 1e-30  # the imaginary step of derivatives
SLOPE, MOST_MOVES, ROUNDING = 1e-12, 60, 1e-13


def coefficients(free: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Stationary AR and invertible MA coefficients from unbounded variables, (models, p + q): these
    become partial autocorrelations, and those coefficients by the recursion of Durbin and
    Levinson."""
    return _levinson(free[:, :p]), -_levinson(free[:, p:])


def _levinson(free: np.ndarray) -> np.ndarray:
    partial = np.tanh(free / 2)
    out = partial[:, :0]
    for k in range(free.shape[1]):
        last = partial[:, k:k + 1]
        out = np.concatenate([out - last * out[:, ::-1], last], axis=1)
    return out


@dataclass
class Filtered:
    """Sums over the rows of each model: ``squares`` [ww, w1, 11] of the errors of the series and of
    the constant, weighted by their variance, ``logs`` of these variances; ``ahead`` the
    predictions of the next row, (models, 2); ``path`` those of every row if kept."""

    squares: np.ndarray
    logs: np.ndarray
    ahead: np.ndarray
    path: np.ndarray | None

    def mean(self, const: bool) -> np.ndarray:
        ww, w1, one = self.squares.T
        return w1 / one if const else np.zeros_like(ww)

    def variance(self, n: np.ndarray, const: bool) -> np.ndarray:
        ww, w1, one = self.squares.T
        return (ww - w1 * w1 / one if const else ww) / n


def kalman(w: np.ndarray, n: np.ndarray, phi: np.ndarray, theta: np.ndarray,
           keep: bool = False) -> Filtered:
    """Filter the first ``n`` values of each row of ``w`` by the model of that row.

    Inside, the models are the last axis, so that every step runs along all of them.
    """
    models, p, q = len(w), phi.shape[1], theta.shape[1]
    r = max(p, q + 1)
    kind = np.result_type(phi, theta, float)
    ar, ma = np.zeros((r, models), kind), np.zeros((r, models), kind)
    ar[:p], ma[0], ma[1:q + 1] = phi.T, 1, theta.T
    noise = ma[:, None] * ma[None]
    rows = np.ascontiguousarray(w.T)

    def moved(x):
        """The transition applied to the first axis: ar_i x_0 + x_(i + 1)."""
        out = ar.reshape(r, *[1] * (x.ndim - 2), models) * x[0]
        out[:-1] += x[1:]
        return out

    state = np.zeros((r, 2, models), kind)  # of the series, of the constant
    spread = _first_variance(ar, noise)
    squares, logs = np.zeros((3, models), kind), np.zeros(models, kind)
    ahead = np.zeros((2, models), kind)
    longest, shortest = int(n.max(initial=0)), int(n.min(initial=0))
    path = np.zeros((longest, 2, models), kind) if keep else None
    steady = False
    for t in range(longest):
        if not steady:
            scale = spread[0, 0]
            gain = moved(spread[:, 0][:, None])[:, 0] / scale
            log, share = np.log(scale), 1 / scale
        if keep:
            path[t] = state[0]
        seen = -state[0]
        seen[0] += rows[t]
        seen[1] += 1
        on = t < n if t >= shortest else True
        weighed = seen * (share if on is True else np.where(on, share, 0))
        squares[:2] += seen * weighed[0]
        squares[2] += seen[1] * weighed[1]
        logs += log if on is True else np.where(on, log, 0)
        state = moved(state)
        state += gain[:, None] * seen
        if t + 1 >= shortest:
            ahead = np.where(t + 1 == n, state[0], ahead)
        if not steady:
            after = moved(moved(spread).transpose(1, 0, 2)) + noise
            after -= gain[:, None] * (gain * scale)
            steady = bool(np.abs(after - spread).max(initial=0) < STEADY)
            spread = after
    return Filtered(squares.T, logs, ahead.T, None if path is None else path.transpose(2, 0, 1))


def _first_variance(ar: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The variance of a stationary state: the sum of T^k noise T'^k, twice as many terms a step."""
    r, models = ar.shape
    step = np.zeros((models, r, r), ar.dtype)
    step[:, :, 0] = ar.T
    step[:, range(r - 1), range(1, r)] = 1
    total = np.ascontiguousarray(noise.transpose(2, 0, 1))
    for _ in range(DOUBLINGS):
        more = step @ total @ step.transpose(0, 2, 1)
        total = total + more
        step = step @ step
        if np.abs(more).max(initial=0) <= 1e-17 * np.abs(total).max(initial=1):
            break
    return np.ascontiguousarray(total.transpose(1, 2, 0))


def cost(found: Filtered, n: np.ndarray, const: bool) -> np.ndarray:
    """-2 log-likelihood at the best mean and variance, but for constants."""
    return n * np.log(found.variance(n, const)) + found.logs


def log_likelihood(found: Filtered, n: np.ndarray, const: bool) -> np.ndarray:
    return -0.5 * (n * (np.log(2 * np.pi) + 1) + cost(found, n, const))


def maximised(w: np.ndarray, n: np.ndarray, p: int, q: int, const: bool,
              like: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coefficients of each model at its largest likelihood, and whether a maximum was found.

    Models with the same number in ``like`` resemble each other (more and more rows of one series):
    the longest of them is fitted first, and the others start from there.
    """
    k = p + q
    if not k:
        return np.zeros((len(w), 0)), np.zeros((len(w), 0)), np.ones(len(w), bool)

    def value(at, free):
        with np.errstate(all="ignore"):
            return cost(kalman(w[at], n[at], *coefficients(free, p)), n[at], const)

    def slope(at, free):
        """Values and derivatives: the imaginary part of the value a tiny imaginary step away
        is the derivative, without the error of a difference."""
        many = np.repeat(at, k)
        moved = np.repeat(free, k, axis=0).astype(complex)
        moved[np.arange(len(many)), np.tile(np.arange(k), len(at))] += 1j * SMALL
        found = value(many, moved).reshape(len(at), k)
        return found[:, 0].real, found.imag / SMALL

    every = np.arange(len(w))
    if like is None:
        leads, leader = every, every
    else:
        longest = np.lexsort((-n, like))
        _, at, group = np.unique(like[longest], return_index=True, return_inverse=True)
        leads = longest[at]
        leader = np.empty(len(w), int)
        leader[longest] = leads[group]
    starts = np.concatenate([np.zeros((1, k)), np.eye(k), -np.eye(k)])
    tried = np.stack([value(leads, np.tile(s, (len(leads), 1))) for s in starts])
    free, done = np.zeros((len(w), k)), np.zeros(len(w), bool)
    curve = np.zeros((len(w), k, k))
    first = starts[np.where(np.isfinite(tried), tried, np.inf).argmin(axis=0)]
    free[leads], curve[leads], done[leads] = minimised(value, slope, leads, first)
    rest = every[leader != every]
    if len(rest):
        free[rest], _, done[rest] = minimised(value, slope, rest, free[leader[rest]],
                                              curve[leader[rest]])
    return *coefficients(free, p), done


def minimised(value: Callable, slope: Callable, models: np.ndarray, free: np.ndarray,
              curve: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The method of Broyden, Fletcher, Goldfarb and Shanno for many functions side by side, each in
    the box of ``REACH``; those that have arrived are left out of further steps. Returns where
    they arrived, the inverse curvature there, and whether the slope is level."""
    k = free.shape[1]
    free, done = free.copy(), np.zeros(len(free), bool)
    on = np.arange(len(free))
    height, down = slope(models, free)
    if curve is None:
        curve = np.tile(np.eye(k), (len(free), 1, 1)) / np.maximum(
            np.abs(down).max(axis=1), 1)[:, None, None]
    curve = curve.copy()
    for _ in range(MOST_MOVES):
        # At the box's edge a slope that leads outside counts as none.
        inside = ~((np.abs(free[on]) >= REACH) & (np.sign(free[on]) == -np.sign(down)))
        level = np.abs(np.where(inside, down, 0)).max(axis=1) <= SLOPE * (1 + np.abs(height))
        done[on[level]] = True
        stay = ~level & np.isfinite(height)
        on, height, down = on[stay], height[stay], down[stay]
        if not len(on):
            break
        way = -np.einsum("mij,mj->mi", curve[on], down)
        fall = (way * down).sum(axis=1)
        way = np.where((fall < 0)[:, None], way, -down)
        fall = (way * down).sum(axis=1)
        best = np.clip(free[on] + way, -REACH, REACH)
        new_height, new_down = slope(models[on], best)
        enough = height + ROUNDING * (1 + np.abs(height))
        waits = np.flatnonzero(~(new_height <= enough + 1e-4 * fall))
        if len(waits):
            size, late = np.ones(len(on)), waits
            for _ in range(40):
                size[waits] /= 2
                trial = np.clip(free[on[waits]] + size[waits, None] * way[waits], -REACH, REACH)
                good = value(models[on[waits]], trial) <= enough[waits] + 1e-4 * (size * fall)[waits]
                best[waits[good]] = trial[good]
                waits = waits[~good]
                if not len(waits):
                    break
            best[waits] = free[on[waits]]
            new_height[late], new_down[late] = slope(models[on[late]], best[late])
        step = best - free[on]
        free[on] = best
        turn = new_down - down
        pull = (step * turn).sum(axis=1)
        fit = pull > 1e-14
        safe = np.where(fit, pull, 1.0)
        left = np.eye(k) - step[:, :, None] * turn[:, None, :] / safe[:, None, None]
        renewed = left @ curve[on] @ left.transpose(0, 2, 1)
        renewed += step[:, :, None] * step[:, None, :] / safe[:, None, None]
        curve[on] = np.where(fit[:, None, None], renewed, curve[on])
        # Steps that no longer count: as near as the arithmetic can tell.
        stuck = np.abs(step).max(axis=1) <= 1e-12
        done[on[stuck]] = np.abs(new_down[stuck]).max(axis=1) <= 1e-6 * (
            1 + np.abs(new_height[stuck]))
        on, height, down = on[~stuck], new_height[~stuck], new_down[~stuck]
        if not len(on):
            break
    return free, curve, done
