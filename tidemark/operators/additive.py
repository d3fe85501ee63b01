"""Additive forecast: piecewise-linear trend, seasonalities and holidays.

The model is a penalised linear regression on hinge, Fourier and holiday columns,
the maximum a posteriori estimate of Taylor and Letham (2018) for a normal error:
normal priors on seasonal and holiday effects, a Laplace prior on the changes of
slope, of which many are then exactly zero.  The columns are made by Spark expressions; each
batch of rows is reduced to one matrix of sums of products per series, the matrices are added,
and only that matrix is solved.

Bands are predictive quantiles: beside the error, the trend may go on to change as often, and by
as much, as it did in the history.
"""

from __future__ import annotations

from collections.abc import Mapping
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.batches import by_series, keyed_schema
from tidemark.functions.columns import WHOLE, in_time, keys, ratio, same_key, whole_series
from tidemark.functions.linalg import stacked
from tidemark.operators.features import fourier_terms, hinges, holiday_days
from tidemark.operators.series import split

# Period in days and number of Fourier pairs of each seasonality,
# number of slope changes, share of the history they cover, prior scales.
SEASONALITIES = {"yearly": (365.25, 10), "weekly": (7.0, 3), "monthly": (30.5, 15)}
N_CHANGEPOINTS = 23
CHANGEPOINT_RANGE = 0.8
SCALES = {"seasonality": 0.1, "changepoint": 0.95, "holiday": 10.0, "trend": 5.0}
# The error variance has settled when it moves by no more than this share; the coefficients, when
# the conditions of a minimum hold to this share. Rounds of either that are tried at most.
SETTLED, EXACT, ROUNDS, STEPS = 1e-10, 1e-7, 200, 2_000


def additive_forecast(df: DataFrame, by, y: str = "y",
                      seasonalities: Mapping[str, tuple[float, int]] | None = None,
                      n_changepoints: int = N_CHANGEPOINTS, holidays: DataFrame | None = None,
                      scales: Mapping[str, float] | None = None, holdout: int = 7,
                      ds: str = "ds", interval: float | None = None) -> DataFrame:
    """Fit each series without its last ``holdout`` rows and forecast those.

    Returns the key columns, ``ds``, ``y``, ``yhat`` and ``status`` (``ok``, ``short``, ``singular``
    or ``not_converged``).  The held-out rows keep their own dates, so gaps in the calendar do not
    shift the forecast.  Their ``y`` may be NULL: the rows ``future_frame`` adds can be forecast too.
    ``holidays`` may hold several calendars, stacked.  With ``interval`` (0.8, say) the columns
    ``yhat_lower`` and ``yhat_upper`` follow ``yhat``, between which that share of values is expected.
    """
    rows = additive_components(df, by, y, seasonalities, n_changepoints, holidays, scales, holdout, ds,
                               interval)
    return rows.where("is_test").select(*keys(by), ds, y, "yhat", *_bands(interval), "status")


def _bands(interval: float | None) -> list[str]:
    return [] if interval is None else ["yhat_lower", "yhat_upper"]


def additive_components(df: DataFrame, by, y: str = "y",
                        seasonalities: Mapping[str, tuple[float, int]] | None = None,
                        n_changepoints: int = N_CHANGEPOINTS, holidays: DataFrame | None = None,
                        scales: Mapping[str, float] | None = None, holdout: int = 7,
                        ds: str = "ds", interval: float | None = None) -> DataFrame:
    """The fitted and the forecast rows of the model that ``additive_forecast`` fits: the key
    columns, ``ds``, ``y``, ``is_test``, ``trend``, a column for each seasonality by its name,
    ``holidays``, their sum ``yhat``, the bands that ``interval`` asks for, and ``status``.

    The variance of a row is that of the error and, behind the history, that of the changes of
    slope to come: they are expected as often as there were places for them, with the mean size
    of those found, so that after a time h (the history is 1) it is c 2 b^2 h^3 / 3 for c places.
    """
    by = keys(by)
    if not by:
        one = df.withColumn("_all", F.lit(0))
        return additive_components(one, "_all", y, seasonalities, n_changepoints, holidays, scales,
                                   holdout, ds, interval).drop("_all")
    scales = {**SCALES, **(scales or {})}
    terms = SEASONALITIES if seasonalities is None else seasonalities
    rows = scaled_rows(df, by, y, holdout, n_changepoints, ds)
    rows = hinges(rows, "_t", "_knots", out="_hinges")
    blocks = [F.array(F.lit(1.0), F.col("_t")), F.col("_hinges")]
    waves = [fourier_terms(ds, period, k) for period, k in terms.values()]
    flags, n_flags = None, 0
    if holidays is not None:
        rows, flags, n_flags = _with_flags(rows, holidays, ds)
    blocks += waves + ([flags] if n_flags else [])
    n_waves = sum(2 * k for _, k in terms.values())
    rows = rows.select(
        *by, ds, y, "is_test", "_t", "_scale", (F.col(y) / F.col("_scale")).alias("_y"),
        F.concat(*blocks).alias("_x"),
    )

    train = rows.where(~F.col("is_test") & F.col("_y").isNotNull() & F.col("_t").isNotNull())
    sums = train.select(*by, "_y", "_x").mapInPandas(
        _partial_gram(by), keyed_schema(rows, by, "cells array<double>")
    )
    fits = sums.groupBy(*by).applyInPandas(
        _solve(by, n_waves, n_flags, scales), keyed_schema(rows, by, "beta array<double>, noise double, status string")
    )
    joined = rows.alias("t").join(fits.alias("f"), same_key("t", "f", by), "left")
    joined = joined.select("t.*", "f.beta", "f.noise", "f.status")

    def part(start, count):
        share = F.zip_with(F.slice("_x", start, count), F.slice("beta", start, count),
                           lambda a, b: a * b)
        return F.aggregate(share, F.lit(0.0), lambda acc, v: acc + v) * F.col("_scale")

    n_trend = F.size("_x") - n_waves - n_flags
    pieces, start = {"trend": part(F.lit(1), n_trend)}, n_trend + 1
    for name, (_, k) in terms.items():
        pieces[name] = part(start, F.lit(2 * k))
        start = start + 2 * k
    pieces["holidays"] = part(start, F.lit(n_flags))
    changes = F.slice("beta", F.lit(3), F.greatest(n_trend - 2, F.lit(0)))
    size = ratio(F.aggregate(changes, F.lit(0.0), lambda acc, v: acc + F.abs(v)), F.size(changes).cast("double"))
    beyond = F.greatest(F.col("_t") - 1, F.lit(0.0))
    to_come = F.size(changes) * 2 * F.pow(F.coalesce(size, F.lit(0.0)), 2) * F.pow(beyond, 3) / 3
    found = joined.select(*by, ds, y, "is_test", *[c.alias(n) for n, c in pieces.items()],
                          (F.sqrt(F.col("noise") + to_come) * F.col("_scale")).alias("_deviation"),
                          F.coalesce("status", F.lit("short")).alias("status"))
    whole = sum((F.col(n) for n in list(pieces)[1:]), F.col("trend"))
    found = found.withColumn("yhat", whole)
    if interval is not None:
        reach = NormalDist().inv_cdf((1 + interval) / 2) * F.col("_deviation")
        found = found.withColumns({"yhat_lower": F.col("yhat") - reach, "yhat_upper": F.col("yhat") + reach})
    return found.select(*by, ds, y, "is_test", *pieces, "yhat", *_bands(interval), "status")


def scaled_rows(df: DataFrame, by, y: str = "y", holdout: int = 7,
                n_changepoints: int = N_CHANGEPOINTS, ds: str = "ds") -> DataFrame:
    """Add what the model needs to know of each series' training part: ``_t``, the
    time scaled to 0..1, ``_scale``, the largest absolute value, and ``_knots``, the
    scaled times of the slope changes, spread evenly over the first 80 % of its rows."""
    series, order = whole_series(by, ds), in_time(by, ds)
    rows = split(df, by, last=holdout, ds=ds).where(F.col("is_test") | F.col(y).isNotNull())
    train = ~F.col("is_test")
    rows = rows.withColumns({
        "pos": F.row_number().over(order),
        "n": F.count(F.lit(1)).over(series),
        "_first": F.min(F.when(train, F.col(ds))).over(series),
        "_final": F.max(F.when(train, F.col(ds))).over(series),
        "_scale": F.max(F.when(train, F.abs(y).cast("double"))).over(series),
    }).withColumn("_history", F.floor((F.col("n") - holdout) * F.lit(CHANGEPOINT_RANGE)))
    span = F.datediff("_final", "_first").cast("double")
    rows = rows.withColumn("_t", ratio(F.datediff(ds, "_first").cast("double"), span))
    # Row j * (history - 1) / n rounded half to even, j = 1..n, counted from zero.
    count = F.least(F.lit(n_changepoints), F.col("_history") - 1)
    step = ratio((F.col("_history") - 1).cast("double"), count.cast("double"))
    nth = F.transform(
        F.when(count >= 1, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array()),
        lambda j: F.rint(j * step).cast("int"),
    )
    chosen = F.array_contains(nth, F.col("pos") - 1)
    knots = F.collect_list(F.when(chosen, F.col("_t"))).over(
        order.rowsBetween(*WHOLE)
    )
    return rows.withColumn("_knots", knots).drop("_first", "_final", "_history")


def _with_flags(rows: DataFrame, holidays: DataFrame, ds: str):
    """Add the row's holiday terms.  There is one per holiday and offset, each a column of the
    model, so their names (not the days) come to the driver."""
    days = holiday_days(holidays).distinct()
    named = days.select("holiday", "offset").distinct().collect()
    labels = sorted(f"{r.holiday}|{r.offset}" for r in named)
    label = F.concat_ws("|", "holiday", F.col("offset").cast("string"))
    per_day = days.groupBy(F.col("ds").alias("_day")).agg(F.collect_set(label).alias("_labels"))
    joined = rows.join(per_day, F.col(ds) == F.col("_day"), "left")
    flags = F.array(*[
        F.coalesce(F.array_contains("_labels", n), F.lit(False)).cast("double") for n in labels
    ])
    return joined, flags, len(labels)


def _partial_gram(by):
    """Per batch and series: sums of products of the columns and the response."""

    def run(batches):
        for pdf in batches:
            out = []
            for key, rows in by_series(pdf, by):
                a = np.column_stack([stacked(rows["_x"]), rows["_y"].to_numpy()])
                out.append((*key, (a.T @ a).ravel()))
            yield pd.DataFrame(out, columns=[*by, "cells"])

    return run


def _solve(by, n_waves, n_flags, scales):
    def run(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        cells = sum(np.asarray(c, dtype="float64") for c in parts["cells"])
        width = int(round(len(cells) ** 0.5))
        beta, noise, status = penalised_fit(cells.reshape(width, width), n_waves, n_flags, scales)
        return pd.DataFrame([(*key, beta, noise, status)], columns=[*by, "beta", "noise", "status"])

    return run


def penalised_fit(gram: np.ndarray, n_waves: int, n_flags: int, scales: Mapping[str, float],
                  ) -> tuple[np.ndarray | None, float | None, str]:
    """Coefficients and error variance from the augmented Gram matrix of one series, and ``ok``,
    ``singular`` (then without coefficients) or ``not_converged``.

    For a given error variance the coefficients are the minimum of a quadratic plus the sizes of
    the slope changes; the variance is that of the errors they leave, and both are renewed in
    turn.  Columns without a Laplace prior are eliminated first.
    """
    k = len(gram) - 1
    n = gram[0, 0]
    a, g, yy = gram[:k, :k], gram[:k, k], gram[k, k]
    n_hinges = k - 2 - n_waves - n_flags
    hinge = np.arange(2, 2 + n_hinges)
    rest = np.setdiff1d(np.arange(k), hinge)
    ridge = np.concatenate([
        np.full(2, scales["trend"] ** -2.0), np.full(n_waves, scales["seasonality"] ** -2.0),
        np.full(n_flags, scales["holiday"] ** -2.0)])
    noise, beta, exact = 0.01, np.zeros(k), True
    for _ in range(ROUNDS):
        try:
            solved = np.linalg.solve(a[np.ix_(rest, rest)] + noise * np.diag(ridge),
                                     np.column_stack([a[np.ix_(rest, hinge)], g[rest]]))
            inner = a[np.ix_(hinge, hinge)] - a[np.ix_(hinge, rest)] @ solved[:, :-1]
            beta[hinge], exact = sparse_minimum(
                inner, g[hinge] - a[np.ix_(hinge, rest)] @ solved[:, -1],
                noise / scales["changepoint"], beta[hinge])
        except np.linalg.LinAlgError:
            return None, None, "singular"
        beta[rest] = solved[:, -1] - solved[:, :-1] @ beta[hinge]
        if not np.isfinite(beta).all():
            return None, None, "singular"
        last, noise = noise, max((yy - 2 * beta @ g + beta @ a @ beta) / n, 1e-8)
        if exact and abs(noise - last) <= SETTLED * noise:
            return beta, noise, "ok"
    return beta, noise, "not_converged"


def sparse_minimum(square: np.ndarray, pull: np.ndarray, price: float,
                   start: np.ndarray) -> tuple[np.ndarray, bool]:
    """The minimum of ``b square b / 2 - pull b + price |b|``, and whether it was reached.

    Feature-sign search (Lee et al. 2007): with the signs of the coefficients that are not zero
    held, these solve a linear system; the way there stops at the lowest of the places where one
    of them passes zero. When none does, the zero that is pulled hardest beyond the price joins.
    """
    b = np.where(np.diag(square) > 0, start, 0.0)

    def height(x):
        return x @ square @ x / 2 - pull @ x + price * np.abs(x).sum()

    joined = None
    for _ in range(STEPS):
        sign = np.sign(b)
        if joined is not None:
            sign[joined[0]] = joined[1]
        on = np.flatnonzero(sign)
        goal = np.zeros_like(b)
        if len(on):
            goal[on] = np.linalg.lstsq(square[np.ix_(on, on)], pull[on] - price * sign[on], rcond=None)[0]
        # Steps along the way: where a coefficient passes zero, and the goal.
        passes = np.flatnonzero((b != 0) & (np.sign(goal) != np.sign(b)))
        best, low = goal, height(goal)
        for i in passes:
            here = b + b[i] / (b[i] - goal[i]) * (goal - b)
            here[i] = 0.0
            if height(here) < low:
                best, low = here, height(here)
        settled = not len(passes) and (np.sign(goal[on]) == sign[on]).all()
        if not settled and low >= height(b):
            return b, False
        b, joined = best, None
        if settled:
            slope = pull - square @ b
            over = np.where((b == 0) & (np.diag(square) > 0), np.abs(slope) - price * (1 + EXACT), -1.0)
            if over.max(initial=-1.0) <= 0:
                return b, True
            joined = int(over.argmax()), np.sign(slope[over.argmax()])
    return b, False
