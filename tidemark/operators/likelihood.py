"""ARIMA(p,d,q) by exact maximum likelihood.

The ``d``-fold difference of a series is an ARMA process around a mean, stationary and invertible;
its Gaussian likelihood comes from a Kalman filter that starts in the stationary state, so that no
row is lost to lags. ``operators.arima`` is the fast form (least squares by running sums); this is
the exact one, for moving averages near the edge and short histories.

A series travels as one array, bounded by the calendar after ``resample``. The refits of a
walk-forward are dealt out in pieces of a series, so that a long one is the work of many tasks, and
the fits of a batch run side by side in vectorised steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.batches import keyed_schema
from tidemark.functions.columns import keys
from tidemark.functions.likelihood import kalman, log_likelihood, maximised
from tidemark.operators.arima import burn_in
from tidemark.operators.resample import STEP_DAYS
from tidemark.operators.series import drop_missing

PIECE = 32  # refits that one row of work holds
CELLS = 1 << 22  # values of all models of a batch handled at a time


def _arrays(df: DataFrame, by: list[str], y: str, ds: str) -> DataFrame:
    """One row per series: its dates and values in order."""
    rows = drop_missing(df, y).groupBy(*by).agg(F.sort_array(F.collect_list(
        F.struct(F.col(ds).alias("ds"), F.col(y).cast("double").alias("y")))).alias("_rows"))
    return rows.select(*by, F.col("_rows.ds").alias("_ds"), F.col("_rows.y").alias("_y"))


def walk_forward_likelihood(df: DataFrame, by, y: str = "y",
                            order: tuple[int, int, int] = (0, 1, 1), const: bool = True,
                            split: float = 0.7, refit: int = 1, ds: str = "ds") -> DataFrame:
    """One-step forecasts of the test part of every series, as ``walk_forward`` makes them, by models
    of largest likelihood on all rows before.

    ``refit`` is the number of test rows that one fit serves; the filter goes on over the rows
    between. Returns the key columns, ``ds``, ``y``, ``yhat``, ``p``, ``d``, ``q``, ``const`` and
    ``status``: ``ok``, ``short``, ``singular`` (a difference that does not vary) or
    ``not_converged`` (with the best forecast found).
    """
    by = keys(by)
    p, d, q = order
    rows = _arrays(df, by, y, ds)
    tests = F.size("_y") - F.floor(F.size("_y") * F.lit(float(split))).cast("int")
    fits = F.ceil(tests / refit).cast("int")
    pieces = F.greatest(F.ceil(fits / PIECE).cast("int"), F.lit(1))
    rows = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    rows = rows.repartition(*by, "_piece") if by else rows.repartition("_piece")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            work = []  # row of the batch, first and last test row of a fit
            for i, (values, piece) in enumerate(zip(batch["_y"], batch["_piece"])):
                first = int(np.floor(len(values) * split))
                starts = range(first, len(values), refit)[piece * PIECE:(piece + 1) * PIECE]
                work += [(i, s, min(s + refit, len(values))) for s in starts]
            for some in _portions(work, max((len(v) for v in batch["_y"]), default=1)):
                yield from forecasts(batch, some)

    def forecasts(batch: pd.DataFrame, work: list) -> Iterator[pd.DataFrame]:
        at, starts, ends = np.array(work).T
        values = [np.asarray(v, float) for v in batch["_y"]]
        w = _padded([np.diff(values[i][:e], d) for i, e in zip(at, ends)])
        n, upto = starts - d, ends - d
        status, phi, theta = _fitted(w, n, p, q, const, at)
        found = kalman(w, n, phi, theta)
        with np.errstate(all="ignore"):
            mean = np.where(status == "singular", w[:, 0], found.mean(const))
        path = kalman(w, upto, phi, theta, keep=True).path
        out = []
        for k, (i, s, e) in enumerate(work):
            t = np.arange(s, e)
            ahead = path[k, t - d] if s >= d else np.zeros((len(t), 2))
            change = mean[k] + ahead[:, 0] - mean[k] * ahead[:, 1]
            base = _base(values[i], t, d)
            known = status[k] in ("ok", "not_converged")
            out.append(pd.DataFrame({
                "_at": i, "ds": np.asarray(batch["_ds"].iloc[i])[s:e], "y": values[i][s:e],
                "yhat": base + change if known else np.nan, "status": status[k]}))
        rows = pd.concat(out, ignore_index=True)
        rows = rows.assign(yhat=rows["yhat"].astype(object).where(rows["yhat"].notna(), None))
        for c in by:
            rows[c] = batch[c].iloc[rows["_at"]].to_numpy()
        yield rows[[*by, "ds", "y", "yhat", "status"]]

    kind = df.schema[ds].dataType.simpleString()
    found = rows.mapInPandas(run, keyed_schema(
        rows, by, f"ds {kind}, y double, yhat double, status string"))
    orders = [F.lit(v).cast("int").alias(c) for c, v in zip("pdq", order)]
    return found.select(*by, F.col("ds").alias(ds), F.col("y").alias(y), "yhat", *orders,
                        F.lit(const).alias("const"), "status")


def fit_likelihood(df: DataFrame, by, y: str = "y", order: tuple[int, int, int] = (0, 1, 1),
                   const: bool = True, freq: str = "D", ds: str = "ds") -> DataFrame:
    """The model of largest likelihood of each whole series: the key columns, ``phi`` and ``theta``
    (coefficients of the lags and of the errors), ``mean`` of the ``d``-fold difference,
    ``variance`` of the errors, ``loglik``, ``aic``, ``n`` (differences used), ``status``, and the
    next step's ``ds`` and ``yhat``."""
    by = keys(by)
    p, d, q = order
    rows = _arrays(df, by, y, ds)
    rows = rows.repartition(*by) if by else rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [np.asarray(v, float) for v in batch["_y"]]
            for some in _portions(list(range(len(values))), max(map(len, values), default=1)):
                mine = [values[i] for i in some]
                w = _padded([np.diff(v, d) for v in mine])
                n = np.array([max(len(v) - d, 0) for v in mine])
                status, phi, theta = _fitted(w, n, p, q, const, np.arange(len(mine)))
                found = kalman(w, n, phi, theta)
                with np.errstate(all="ignore"):
                    mean, variance = found.mean(const), found.variance(n, const)
                    high = log_likelihood(found, n, const)
                change = mean + found.ahead[:, 0] - mean * found.ahead[:, 1]
                base = [_base(np.append(v, np.nan), np.array([len(v)]), d)[0] for v in mine]
                rows = batch[by].iloc[some].assign(
                    phi=list(phi), theta=list(theta), mean=mean, variance=variance, loglik=high,
                    aic=2 * (p + q + const + 1) - 2 * high, n=n, status=status,
                    _last=[batch["_ds"].iloc[i][-1] for i in some], yhat=np.array(base) + change)
                known = rows["status"].isin(["ok", "not_converged"])
                for c in ("phi", "theta", "mean", "variance", "loglik", "aic", "yhat"):
                    rows[c] = rows[c].astype(object).where(known, None)
                yield rows

    kind = df.schema[ds].dataType.simpleString()
    found = rows.mapInPandas(run, keyed_schema(
        rows, by, "phi array<double>, theta array<double>, mean double, variance double, "
                  f"loglik double, aic double, n bigint, status string, _last {kind}, yhat double"))
    return found.select(
        *by, "phi", "theta", "mean", "variance", "loglik", "aic", "n", "status",
        F.date_add("_last", STEP_DAYS[freq]).alias(ds), "yhat")


def likelihood_profile(df: DataFrame, by, y: str = "y", d: int = 1, const: bool = True,
                       models: Sequence[tuple[Sequence[float], Sequence[float]]] = (((), (0.0,)),),
                       ds: str = "ds") -> DataFrame:
    """The exact log-likelihood of given models: the key columns, ``model`` (place in ``models``, each
    (phi, theta)), ``mean``, ``variance`` and ``loglik``, the first two at their best values."""
    by = keys(by)
    rows = _arrays(df, by, y, ds).where(F.size("_y") > d + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [np.diff(np.asarray(v, float), d) for v in batch["_y"]]
            for some in _portions(list(range(len(values))), max(map(len, values), default=1)):
                w = _padded([values[i] for i in some])
                n = np.array([len(values[i]) for i in some])
                for k, (phi, theta) in enumerate(models):
                    at = [np.tile(np.asarray(c, float), (len(some), 1)) for c in (phi, theta)]
                    found = kalman(w, n, *at)
                    yield batch[by].iloc[some].assign(
                        model=k, mean=found.mean(const), variance=found.variance(n, const),
                        loglik=log_likelihood(found, n, const))

    return rows.mapInPandas(run, keyed_schema(
        rows, by, "model int, mean double, variance double, loglik double"))


def _portions(work: list, longest: int) -> Iterator[list]:
    size = max(1, CELLS // max(longest, 1))
    for i in range(0, len(work), size):
        yield work[i:i + size]


def _padded(series: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(series), max((len(s) for s in series), default=0)))
    for row, s in zip(out, series):
        row[:len(s)] = s
    return out


def _base(y: np.ndarray, t: np.ndarray, d: int) -> np.ndarray:
    """What a predicted difference at ``t`` is added to."""
    if d == 0:
        return np.zeros(len(t))
    if (t < d).any():
        return np.full(len(t), np.nan)
    return y[t - 1] if d == 1 else 2 * y[t - 1] - y[t - 2]


def _fitted(w, n, p, q, const, like):
    """Status, phi and theta of each model; the optimiser sees only those with enough rows."""
    status = np.full(len(w), "ok", object)
    inside = np.arange(w.shape[1])[None] < n[:, None]
    top = np.where(inside, w, -np.inf).max(axis=1, initial=-np.inf)
    low = np.where(inside, w, np.inf).min(axis=1, initial=np.inf)
    status[~(top > low) if const or p + q else np.zeros(len(w), bool)] = "singular"
    status[n < burn_in(p + q + const)] = "short"
    phi, theta = np.zeros((len(w), p)), np.zeros((len(w), q))
    good = np.flatnonzero(status == "ok")
    if len(good):
        phi[good], theta[good], done = maximised(w[good], n[good], p, q, const, like[good])
        status[good[~done]] = "not_converged"
    return status, phi, theta
