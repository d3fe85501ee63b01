"""SQL text for expanding least squares, used to check the forecasts.

The statements are written out step by step: lags, running sums of products, and
one common table expression per eliminated regressor.
"""

from __future__ import annotations

from collections.abc import Sequence

ORDER = "PARTITION BY {key} ORDER BY ds"


def base_sql(d: int, const: bool) -> str:
    lag = "lag(y, {}) OVER o"
    if d == 1:
        return lag.format(1)
    if d == 2:
        return f"2 * {lag.format(1)} - {lag.format(2)}"
    return "first(y) OVER o" if const else "0.0::double"


def fit_steps(source: str, tag: str, lags: Sequence[tuple[str, int]], const: bool,
              key: str = "series_id") -> tuple[str, str]:
    """CTEs that add ``fit_<tag>`` to ``source``, which has ``w`` and the lagged
    columns; returns them and the name of the last one."""
    over = "OVER (" + ORDER.format(key=key)
    before = over + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    k = len(lags)
    size = k + const
    names = [f"x{i}_{tag}" for i in range(k)]
    lagged = "".join(f", lag({c}, {i}) {over}) AS {n}" for n, (c, i) in zip(names, lags))
    whole = " AND ".join([f"{n} IS NOT NULL" for n in ["w", *names]])
    ones = [f"CASE WHEN {whole} THEN 1.0::double END"] if const else []
    z = ones + [f"CASE WHEN {whole} THEN {n} END" for n in names]
    at = (["1.0::double"] if const else []) + names
    masked = "".join(f", {c} AS z{i}_{tag}" for i, c in enumerate(z))
    sums = "".join(
        f", sum(z{i}_{tag} * z{j}_{tag}) {before} AS g0_{i}_{j}_{tag}"
        for i in range(size) for j in range(i, size)
    ) + "".join(f", sum(z{i}_{tag} * t_{tag}) {before} AS r0_{i}_{tag}" for i in range(size))
    parts = [
        f"lag_{tag} AS (SELECT *{lagged} FROM {source})",
        f"use_{tag} AS (SELECT *{masked}, CASE WHEN {whole} THEN w END AS t_{tag} FROM lag_{tag})",
        f"sum_{tag} AS (SELECT *{sums}, count(t_{tag}) {before} AS c_{tag}"
        + "".join(f", {a} AS v0_{i}_{tag}" for i, a in enumerate(at))
        + f", 0.0::double AS p0_{tag} FROM use_{tag})",
    ]
    last = f"sum_{tag}"
    for s in range(size):
        more, name = elimination_step(last, tag, s, size)
        parts.append(more)
        last = name
    ready = f"c_{tag} >= greatest(10, 2 * {size})" if size else "true"
    parts.append(
        f"fit_{tag} AS (SELECT *, CASE WHEN {ready} THEN p{size}_{tag} END AS fit_{tag} FROM {last})"
    )
    return ",\n".join(parts), f"fit_{tag}"


def elimination_step(source: str, tag: str, s: int, size: int) -> tuple[str, str]:
    """Eliminate regressor ``s`` and add its share to the prediction."""
    pivot = f"g{s}_{s}_{s}_{tag}"
    safe = f"CASE WHEN {pivot} > 1e-12 * g0_{s}_{s}_{tag} THEN {pivot} END"
    cols = [f"p{s}_{tag} + v{s}_{s}_{tag} * r{s}_{s}_{tag} / ({safe}) AS p{s + 1}_{tag}"]
    for i in range(s + 1, size):
        part = f"g{s}_{s}_{i}_{tag} / ({safe})"
        cols += [
            f"g{s}_{i}_{j}_{tag} - {part} * g{s}_{s}_{j}_{tag} AS g{s + 1}_{i}_{j}_{tag}"
            for j in range(i, size)
        ]
        cols.append(f"r{s}_{i}_{tag} - {part} * r{s}_{s}_{tag} AS r{s + 1}_{i}_{tag}")
        cols.append(f"v{s}_{i}_{tag} - {part} * v{s}_{s}_{tag} AS v{s + 1}_{i}_{tag}")
    name = f"e{s}_{tag}"
    return f"{name} AS (SELECT *, {', '.join(cols)} FROM {source})", name


def forecast_steps(levels: str, order: tuple[int, int, int], const: bool = True,
                   key: str = "series_id", tag: str = "a") -> tuple[str, str]:
    """CTEs from a table of ``key, ds, y`` to one with ``yhat``, and its name."""
    p, d, q = order
    base = base_sql(d, const)
    parts = [
        f"placed_{tag} AS (SELECT {key}, ds, y, {base} AS base, "
        f"row_number() OVER o AS pos, count(*) OVER (PARTITION BY {key}) AS n "
        f"FROM {levels} WINDOW o AS ({ORDER.format(key=key)}))",
        f"diff_{tag} AS (SELECT *, y - base AS w FROM placed_{tag})",
    ]
    source = f"diff_{tag}"
    if q:
        more, fitted = fit_steps(source, f"{tag}1", [("w", i) for i in range(1, max(p, q) + 1)],
                                 const, key)
        parts += [more, f"innov_{tag} AS (SELECT {key}, ds, y, base, pos, n, w, "
                        f"w - fit_{tag}1 AS e FROM {fitted})"]
        source = f"innov_{tag}"
    lags = [("w", i) for i in range(1, p + 1)] + [("e", i) for i in range(1, q + 1)]
    if not p and not q and const:
        before = (f"OVER ({ORDER.format(key=key)} "
                  "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
        parts.append(
            f"fit_{tag}2 AS (SELECT *, CASE WHEN count(w) {before} >= greatest(10, 2 * 1) "
            f"THEN avg(w) {before} END AS fit_{tag}2 FROM {source})"
        )
        fitted = f"fit_{tag}2"
    else:
        more, fitted = fit_steps(source, f"{tag}2", lags, const, key)
        parts.append(more)
    parts.append(f"forecast_{tag} AS (SELECT {key}, ds, y, pos, n, base + fit_{tag}2 AS yhat, "
                 f"pos > floor(n * 0.7::double) AS is_test FROM {fitted})")
    return ",\n".join(parts), f"forecast_{tag}"
