"""Stationarity: the augmented Dickey-Fuller test with a constant."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.batches import keyed_schema
from tidemark.functions.columns import in_time, keys, same_key, whole_series
from tidemark.functions.linalg import leading_residuals
from tidemark.functions.normal import normal_cdf
from tidemark.operators.series import drop_missing

# MacKinnon's published response surfaces for one variable and a constant.
# Critical values (2010): b0 + b1/T + b2/T^2 + b3/T^3.
CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}
# P-values (1994): Phi of a polynomial in the statistic, one for each side of -1.61.
P_LOWEST, P_HIGHEST, P_BREAK = -18.83, 2.74, -1.61
P_LOW_SIDE = (2.1659, 1.4412, 0.038269)
P_HIGH_SIDE = (1.7339, 0.93202, -0.12745, -0.010368)

# Rows of a series that one task reduces at a time, unless its largest lag asks for more.
BLOCK_ROWS = 8192


def critical_values(n: str | Column) -> dict[str, Column]:
    """The 1, 5 and 10 % critical values for ``n`` observations, as columns."""
    t = (F.col(n) if isinstance(n, str) else n).cast("double")
    return {
        name: F.lit(b0) + F.lit(b1) / t + F.lit(b2) / (t * t) + F.lit(b3) / (t * t * t)
        for name, (b0, b1, b2, b3) in CRITICAL.items()
    }


def with_p_value(df: DataFrame, stat: str = "stat") -> DataFrame:
    """Add ``p_value``, the approximate p-value of the statistic."""
    s = F.col(stat)

    def poly(coefs):
        out = F.lit(coefs[-1])
        for c in reversed(coefs[:-1]):
            out = out * s + F.lit(c)
        return out

    # A column of its own, so that it is computed once however often it is named.
    placed = df.withColumn("_z", F.when(s <= P_BREAK, poly(P_LOW_SIDE)).otherwise(poly(P_HIGH_SIDE)))
    share = F.when(s > P_HIGHEST, 1.0).when(s < P_LOWEST, 0.0).otherwise(normal_cdf("_z"))
    return placed.withColumn("p_value", share).drop("_z")


def adf(df: DataFrame, by, y: str = "y", autolag: str | None = "aic", maxlag: int | None = None,
        ds: str = "ds") -> DataFrame:
    """Augmented Dickey-Fuller test per series.

    Returns the key columns, ``stat``, ``p_value``, ``used_lag``, ``n_obs``,
    ``crit_1``, ``crit_5``, ``crit_10``, ``stationary`` and ``status``.  The null
    hypothesis, a unit root, stands when the statistic is above the 5 % critical
    value and the p-value above 0.05.

    The largest lag is ``ceil(12 (n/100)^(1/4))`` unless given, at most ``n/2 - 2``.
    With ``autolag='aic'`` every lag up to it is tried on the common sample and the
    lowest AIC wins; with ``None`` the largest lag is used.  The chosen lag is then
    refitted on all rows it leaves.

    A series is laid out in blocks of rows, each with the last rows of the block before it, as
    many as the largest lag.  A block is reduced to one matrix of sums of products, and the
    matrices are added: a long series is the work of several tasks, and no row carries its lags.
    """
    if autolag not in ("aic", None):
        raise ValueError("autolag is 'aic' or None")
    by = keys(by)
    order, series = in_time(by, ds), whole_series(by, ds)
    rows = drop_missing(df, y).withColumns({
        "_n": F.count(F.lit(1)).over(series),
        "_pos": F.row_number().over(order).cast("bigint"),
        "_prev": F.lag(y).over(order),
        "_start": F.first(y).over(order),
    })
    wanted = F.ceil(12 * F.pow(F.col("_n") / 100, 0.25)) if maxlag is None else F.lit(maxlag)
    top = F.least(wanted.cast("int"), (F.floor(F.col("_n") / 2) - 2).cast("int"))
    rows = rows.withColumn("_top", top).withColumn(
        "_rows", F.greatest(F.lit(BLOCK_ROWS), 2 * F.col("_top")).cast("bigint"))
    block = F.floor((F.col("_pos") - 1) / F.col("_rows"))
    also = (F.col("_pos") - 1) % F.col("_rows") >= F.col("_rows") - F.col("_top")
    rows = rows.select(
        *by, "_pos", "_top", (F.col(y) - F.col("_prev")).cast("double").alias("_dy"),
        # A constant is fitted, so measuring the level from the first value changes nothing
        # but keeps the sums small.
        (F.col("_prev") - F.col("_start")).cast("double").alias("_level"),
        "_rows",
        F.explode(F.when(also, F.array(block, block + 1)).otherwise(F.array(block))).alias("_block"),
    ).withColumn("_own", F.floor((F.col("_pos") - 1) / F.col("_rows")) == F.col("_block"))
    rows = rows.drop("_rows")
    sums = rows.groupBy(*by, "_block").applyInPandas(
        _partial_sums(by), keyed_schema(rows, by, _PARTIAL))
    fits = sums.groupBy(*by).applyInPandas(_choose_and_fit(by, autolag), keyed_schema(rows, by, _FIT))
    stat = F.col("stat")
    report = with_p_value(fits).withColumns(critical_values("n_obs"))
    return report.select(
        *by, "stat", "p_value", "used_lag", "n_obs", "crit_1", "crit_5", "crit_10",
        ((stat <= F.col("crit_5")) | (F.col("p_value") <= 0.05)).alias("stationary"), "status",
    )


_PARTIAL = "top int, kind string, cells array<double>"
_FIT = "stat double, used_lag int, n_obs bigint, status string"


def _partial_sums(by: list[str]):
    """Per block: the sum of products over its rows that have every lag, and, for the few rows at
    the start of a series that have not, the rows themselves.

    The regressors are a constant, the level and the lags; the response is last.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        key = key[:len(by)]
        rows = rows.sort_values("_pos")
        top, pos, own = int(rows["_top"].iloc[0]), rows["_pos"].to_numpy(), rows["_own"].to_numpy()
        dy, level = rows["_dy"].to_numpy(), rows["_level"].to_numpy()
        # One line per series survives even if no row can be used.
        out = [(*key, top, "seen", [])]
        if top >= 0:
            # A difference exists from the second row on, and with it the lags of later rows.
            full = np.flatnonzero(own & (pos >= top + 2))
            total = np.zeros((top + 3, top + 3))
            for i in range(0, len(full), 4096):
                at = full[i:i + 4096]
                past = np.lib.stride_tricks.sliding_window_view(dy, top + 1)[at - top, ::-1]
                a = np.column_stack([np.ones(len(at)), level[at], past[:, 1:], past[:, 0]])
                total += a.T @ a
            if len(full):
                out.append((*key, top, "sums", total.ravel()))
            for i in np.flatnonzero(own & (pos >= 2) & (pos < top + 2)):
                lags = dy[i - pos[i] + 2:i][::-1]
                out.append((*key, top, "row", np.concatenate(([1.0, level[i]], lags, [dy[i]]))))
        return pd.DataFrame(out, columns=[*by, "top", "kind", "cells"])

    return run


def _choose_and_fit(by: list[str], autolag: str | None):
    def run(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        top = int(parts["top"].iloc[0])
        width = top + 3
        total, used = np.zeros((width, width)), 0
        for cells in parts.loc[parts["kind"] == "sums", "cells"]:
            total += np.asarray(cells, dtype="float64").reshape(width, width)
        heads = [np.asarray(c, dtype="float64") for c in parts.loc[parts["kind"] == "row", "cells"]]
        fit = _fit_lags(total, heads, top, autolag)
        return pd.DataFrame([(*key, *fit)], columns=[*by, "stat", "used_lag", "n_obs", "status"])

    return run


def _fit_lags(total: np.ndarray, heads: list[np.ndarray], top: int, autolag: str | None):
    """The lag of lowest AIC and the t statistic of the level at that lag."""
    n = total[0, 0] if top >= 0 else 0.0
    if n <= top + 2:
        return None, None, None, "short"
    lag = top
    if autolag == "aic":
        ssr = leading_residuals(total)[1:]
        with np.errstate(all="ignore"):
            aic = n * (np.log(2 * np.pi * ssr / n) + 1) + 2 * (np.arange(top + 1) + 2)
        if not np.isfinite(aic).any():
            return None, None, None, "singular"
        lag = int(np.nanargmin(np.where(np.isfinite(aic), aic, np.nan)))
    k = lag + 2
    pick = [*range(k), top + 2]
    gram = total[np.ix_(pick, pick)].copy()
    for x in heads:
        if len(x) - 3 >= lag:
            x = np.concatenate((x[:k], x[-1:]))
            gram += np.outer(x, x)
    n = gram[0, 0]
    scale = np.sqrt(np.diag(gram)[:k])
    scaled = gram[:k, :k] / np.outer(scale, scale)
    if not np.isfinite(scaled).all() or np.linalg.cond(scaled) > 1e12 or n <= k:
        return None, None, None, "singular"
    inverse = np.linalg.inv(scaled) / np.outer(scale, scale)
    beta = inverse @ gram[:k, k]
    ssr = gram[k, k] - beta @ gram[:k, k]
    return beta[1] / math.sqrt(ssr / (n - k) * inverse[1, 1]), lag, int(round(n)), "ok"


def stationarity_report(df: DataFrame, by, y: str = "y", window: int = 52, ds: str = "ds",
                        autolag: str | None = "aic") -> DataFrame:
    """Test and rolling statistics of a series, its log and its log difference.

    One row per series and ``stage`` (``level``, ``log``, ``log_diff``): the columns
    of ``adf``, and the smallest and largest rolling mean and deviation, which
    tell how far they wander.
    """
    by = keys(by)
    rows = drop_missing(df, y)
    logs = F.ln(F.col(y).cast("double"))
    before = F.lag(logs).over(in_time(by, ds))
    stages = F.array(
        F.struct(F.lit("level").alias("stage"), F.col(y).cast("double").alias("_value")),
        F.struct(F.lit("log").alias("stage"), logs.alias("_value")),
        F.struct(F.lit("log_diff").alias("stage"), (logs - F.col("_before")).alias("_value")),
    )
    long = rows.withColumn("_before", before).select(*by, ds, F.inline(stages))
    long = long.where(F.col("_value").isNotNull())
    group = [*by, "stage"]

    frame = Window.partitionBy(*group).orderBy(ds).rowsBetween(1 - window, 0)
    full = F.count("_value").over(frame) == window
    rolled = long.withColumns({
        "_mean": F.when(full, F.avg("_value").over(frame)),
        "_std": F.when(full, F.stddev_samp("_value").over(frame)),
    })
    ranges = rolled.groupBy(*group).agg(
        F.min("_mean").alias("rolling_mean_low"), F.max("_mean").alias("rolling_mean_high"),
        F.min("_std").alias("rolling_std_low"), F.max("_std").alias("rolling_std_high"),
    )
    tests = adf(long, group, "_value", autolag=autolag, ds=ds)
    joined = tests.alias("t").join(ranges.alias("r"), same_key("t", "r", group), "left")
    return joined.select("t.*", *[f"r.{c}" for c in ranges.columns if c not in group])
