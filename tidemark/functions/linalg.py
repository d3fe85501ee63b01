"""Small dense helpers that run inside tasks, on batches of rows."""

from __future__ import annotations

import numpy as np

PIVOT_FLOOR = 1e-12


def leading_predictions(gram: np.ndarray, rhs: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Least-squares predictions of every nested model, for a batch of rows.

    ``gram`` is (k, k, rows), ``rhs`` and ``x`` are (k, rows).  Item ``j`` of the
    result is the prediction at ``x`` with the first ``j + 1`` regressors.  One
    forward elimination serves all of them: after eliminating a regressor, its
    share of the prediction is final.  A row whose regressors are collinear gets
    NaN from there on.
    """
    gram, rhs, x = gram.copy(), rhs.copy(), x.copy()
    k = len(gram)
    scale = [gram[i, i].copy() for i in range(k)]
    total = np.zeros(gram.shape[2])
    out = []
    with np.errstate(all="ignore"):
        for i in range(k):
            pivot = gram[i, i]
            usable = np.isfinite(pivot) & (pivot > PIVOT_FLOOR * scale[i])
            share = np.where(usable, 1.0 / pivot, np.nan)
            total = total + x[i] * rhs[i] * share
            out.append(total)
            for a in range(i + 1, k):
                part = gram[i, a] * share
                gram[a, a:] -= part * gram[i, a:]
                rhs[a] -= part * rhs[i]
                x[a] -= part * x[i]
    return out


def leading_residuals(gram: np.ndarray) -> np.ndarray:
    """Sum of squared residuals of every nested model of one augmented Gram
    matrix, whose last row and column belong to the response."""
    gram = gram.copy()
    k = len(gram) - 1
    scale = np.diag(gram).copy()
    out = np.full(k, np.nan)
    for i in range(k):
        pivot = gram[i, i]
        if not np.isfinite(pivot) or pivot <= PIVOT_FLOOR * scale[i]:
            break
        gram[i + 1 :, i + 1 :] -= np.outer(gram[i + 1 :, i], gram[i, i + 1 :]) / pivot
        out[i] = gram[k, k]
    return out


def square(flat: np.ndarray, k: int) -> np.ndarray:
    """Symmetric (k, k, rows) matrices from their upper triangles, (cells, rows)."""
    full = np.empty((k, k, flat.shape[1]))
    up = np.triu_indices(k)
    full[up] = flat
    full[up[1], up[0]] = flat
    return full


def stacked(cells, width: int | None = None) -> np.ndarray:
    """A column of equally long lists as one matrix; a NULL element is NaN."""
    rows = [np.asarray(c, dtype="float64") for c in cells]
    return np.vstack(rows) if rows else np.empty((0, width or 0))
