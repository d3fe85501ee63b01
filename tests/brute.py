"""Plain refits of the models, to compare with."""

import numpy as np

from tidemark.operators.arima import burn_in


def parts(y, d, const):
    """The d-fold difference and what to add to get the level back."""
    y = np.asarray(y, float)
    base = np.full(len(y), np.nan)
    if d == 0:
        base[:] = y[0] if const else 0.0
    elif d == 1:
        base[1:] = y[:-1]
    else:
        base[2:] = 2 * y[1:-1] - y[:-2]
    return y - base, base


def lagged(columns):
    out = []
    for series, lag in columns:
        shifted = np.full(len(series), np.nan)
        if lag < len(series):
            shifted[lag:] = series[: len(series) - lag]
        out.append(shifted)
    return np.column_stack(out) if out else np.empty((0, 0))


def refit(w, columns, const):
    """Predict every row from a fit on the rows before it."""
    x = lagged(columns) if columns else np.empty((len(w), 0))
    if const:
        x = np.column_stack([np.ones(len(w)), x])
    k = x.shape[1]
    out = np.full(len(w), np.nan)
    known = np.isfinite(w) & np.isfinite(x).all(axis=1)
    for t in range(len(w)):
        use = known[:t]
        if use.sum() >= burn_in(k) and np.isfinite(x[t]).all():
            beta = np.linalg.lstsq(x[:t][use], w[:t][use], rcond=None)[0]
            out[t] = x[t] @ beta
    return out


def forecasts(y, order, const=True):
    p, d, q = order
    w, base = parts(y, d, const)
    columns = [(w, i) for i in range(1, p + 1)]
    if q:
        e = w - refit(w, [(w, i) for i in range(1, max(p, q) + 1)], const)
        columns += [(e, i) for i in range(1, q + 1)]
    if not columns and not const:
        return base
    return base + refit(w, columns, const)


def grid_rmse(y, order, most=4):
    """RMSE on the second half, no constant, on the sample common to all orders."""
    p, d, q = order
    y = np.asarray(y, "float32").astype(float)
    w, base = parts(y, d, False)
    e = w - refit(w, [(w, i) for i in range(1, most + 1)], False)
    common = lagged([(w, i) for i in range(1, most + 1)] + [(e, i) for i in range(1, most + 1)])
    known = np.isfinite(w) & np.isfinite(common).all(axis=1)
    columns = [(w, i) for i in range(1, p + 1)] + [(e, i) for i in range(1, q + 1)]
    x = lagged(columns) if columns else np.zeros((len(y), 1))
    errors = []
    for t in range(int(len(y) * 0.5), len(y)):
        fit = 0.0
        if columns:
            use = known[:t]
            fit = x[t] @ np.linalg.lstsq(x[:t][use], w[:t][use], rcond=None)[0]
        errors.append(y[t] - base[t] - fit)
    return float(np.sqrt(np.mean(np.square(errors))))


def adf(y, maxlag=None):
    """Statistic, lag and observations; lag by AIC on the common sample."""
    y = np.asarray(y, float)
    n = len(y)
    top = int(np.ceil(12 * (n / 100) ** 0.25)) if maxlag is None else maxlag
    top = min(top, n // 2 - 2)
    dy = np.diff(y)

    def design(lag, skip):
        rows = range(skip, len(dy))
        x = [[1.0, y[t], *[dy[t - i] for i in range(1, lag + 1)]] for t in rows]
        return np.array(x), dy[skip:]

    def ssr(x, r):
        beta = np.linalg.lstsq(x, r, rcond=None)[0]
        return beta, float(np.sum((r - x @ beta) ** 2))

    best = None
    for lag in range(top + 1):
        x, r = design(lag, top)
        s = ssr(x, r)[1]
        aic = len(r) * (np.log(2 * np.pi * s / len(r)) + 1) + 2 * x.shape[1]
        if best is None or aic < best[0]:
            best = (aic, lag)
    lag = best[1]
    x, r = design(lag, lag)
    beta, s = ssr(x, r)
    cov = s / (len(r) - x.shape[1]) * np.linalg.inv(x.T @ x)
    return beta[1] / np.sqrt(cov[1, 1]), lag, len(r)
