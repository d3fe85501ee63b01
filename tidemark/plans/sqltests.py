"""SQL text for the Dickey-Fuller test and the order grid."""

from __future__ import annotations

from tidemark.plans.sqlfit import ORDER, base_sql, elimination_step, fit_steps

# Fixed values, written here anew so that a wrong one in the operators would show.
CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}
P_LOW_SIDE = (2.1659, 1.4412, 0.038269)
P_HIGH_SIDE = (1.7339, 0.93202, -0.12745, -0.010368)
SQL_LAGS = 18  # enough for 506 rows; the weekly series have at most 345

# The error function as a series of positive terms.
CDF_SQL = """0.5::double * (1 + sign({z}) * (SELECT sum(exp((2 * k + 1) * ln(abs({z}) / sqrt(2))
  - lgamma(k + 1.5) - {z} * {z} / 2)) FROM generate_series(0, 150) t(k)))"""


def critical_sql(n: str) -> str:
    return ", ".join(
        f"round({b0} + {b1} / {n}::double + {b2} / ({n}::double * {n}) "
        f"+ {b3} / ({n}::double * {n} * {n}), 6) AS {name}"
        for name, (b0, b1, b2, b3) in CRITICAL.items()
    )


def p_value_steps(source: str) -> str:
    """CTE ``p_values``: ``source`` with ``p_value`` for its ``stat``."""
    low = " + ".join(f"({c}) * pow(stat, {i})" for i, c in enumerate(P_LOW_SIDE))
    high = " + ".join(f"({c}) * pow(stat, {i})" for i, c in enumerate(P_HIGH_SIDE))
    return f"""p_inner AS (
  SELECT *, CASE WHEN stat <= -1.61 THEN {low} ELSE {high} END AS z FROM {source}),
p_values AS (SELECT *, CASE WHEN stat > 2.74 THEN 1.0 WHEN stat < -18.83 THEN 0.0
  ELSE {CDF_SQL.format(z='z')} END AS p_value FROM p_inner)"""


def _gram(names: list[str]) -> str:
    sums = [f"sum({a} * {b}) AS g0_{i}_{j}_a" for i, a in enumerate(names)
            for j, b in enumerate(names) if i <= j]
    sums += [f"sum({a} * dy) AS r0_{i}_a" for i, a in enumerate(names)]
    return ", ".join([*sums, "sum(dy * dy) AS s0", "count(*)::double AS n_obs"])


def _sweep(tag: str, source: str, size: int, keep: int) -> tuple[str, str]:
    """Eliminate the first ``size - keep`` regressors one by one; regressors that
    are all zero are passed over.  ``s<i>`` is the sum of squares left after ``i``."""
    parts, last = [], source
    for s in range(size - keep):
        share = f"(CASE WHEN g{s}_{s}_{s}_a > 1e-12 * g0_{s}_{s}_a THEN 1 / g{s}_{s}_{s}_a ELSE 0 END)"
        cols = [f"s{s} - r{s}_{s}_a * r{s}_{s}_a * {share} AS s{s + 1}"]
        for i in range(s + 1, size):
            part = f"g{s}_{s}_{i}_a * {share}"
            cols += [f"g{s}_{i}_{j}_a - {part} * g{s}_{s}_{j}_a AS g{s + 1}_{i}_{j}_a"
                     for j in range(i, size)]
            cols.append(f"r{s}_{i}_a - {part} * r{s}_{s}_a AS r{s + 1}_{i}_a")
        parts.append(f"{tag}{s} AS (SELECT *, {', '.join(cols)} FROM {last})")
        last = f"{tag}{s}"
    return ",\n".join(parts), last


def adf_steps(source: str, key: str = "series_id") -> str:
    """CTEs from a table of ``key, ds, y`` to ``p_values`` with the test per key."""
    o = ORDER.format(key=key)
    lags = ", ".join(f"lag(dy, {i}) OVER o AS d{i}" for i in range(1, SQL_LAGS + 1))
    upto = [f"CASE WHEN {i} <= top THEN d{i} ELSE 0.0 END" for i in range(1, SQL_LAGS + 1)]
    chosen = [f"CASE WHEN {i} <= used_lag THEN d{i} ELSE 0.0 END" for i in range(1, SQL_LAGS + 1)]
    size = SQL_LAGS + 2
    first, last_first = _sweep("f", "gram1", size, 0)
    second, last_second = _sweep("h", "gram2", size, 1)
    aic = ", ".join(
        f"{{'l': {i}, 'a': CASE WHEN {i} <= top THEN n_obs * (ln(2 * pi() * s{i + 2} / n_obs) + 1)"
        f" + 2 * ({i} + 2) END}}" for i in range(SQL_LAGS + 1)
    )
    end = size - 1
    return f"""steps AS (
  SELECT {key}, ds, row_number() OVER o AS pos, count(*) OVER (PARTITION BY {key}) AS n,
    y - lag(y) OVER o AS dy, lag(y) OVER o - first(y) OVER o AS lv
  FROM {source} WINDOW o AS ({o})),
laid AS (SELECT *, {lags}, cast(least(ceil(12 * pow(n / 100.0::double, 0.25)), n // 2 - 2) AS int)
  AS top FROM steps WINDOW o AS ({o})),
gram1 AS (SELECT {key}, top, {_gram(['1.0::double', 'lv', *upto])} FROM laid
  WHERE pos >= 2 + top GROUP BY {key}, top),
{first},
tried AS (SELECT {key}, unnest([{aic}]) AS cell FROM {last_first}),
choice AS (SELECT {key}, cell.l AS used_lag FROM (SELECT *, row_number() OVER (
  PARTITION BY {key} ORDER BY cell.a, cell.l) AS spot FROM tried WHERE cell.a IS NOT NULL)
  WHERE spot = 1),
refit AS (SELECT * FROM laid JOIN choice USING ({key}) WHERE pos >= 2 + used_lag),
gram2 AS (SELECT {key}, used_lag, {_gram(['1.0::double', *chosen, 'lv'])} FROM refit
  GROUP BY {key}, used_lag),
{second},
fitted AS (SELECT {key}, used_lag, cast(n_obs AS bigint) AS n_obs,
  r{end}_{end}_a / g{end}_{end}_{end}_a / sqrt(
    (s{end} - r{end}_{end}_a * r{end}_{end}_a / g{end}_{end}_{end}_a)
    / (n_obs - used_lag - 2) / g{end}_{end}_{end}_a) AS stat FROM {last_second}),
{p_value_steps('fitted')}"""


def grid_steps(levels: str, ps, ds, qs) -> str:
    """CTEs to ``grid``: the RMSE of every order per series, no constant, half split."""
    most_p, most_q = max(ps), max(qs)
    o = ORDER.format(key="series_id")
    key = "series_id, d"
    over = f"OVER ({ORDER.format(key=key)}"
    before = f"{over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    variants = " UNION ALL ".join(
        f"SELECT series_id, {d} AS d, ds, y, pos, n, {base_sql(d, False)} AS base "
        f"FROM placed WINDOW o AS ({o})" for d in ds
    )
    parts = [
        f"placed AS (SELECT series_id, ds, cast(cast(y AS float) AS double) AS y, "
        f"row_number() OVER o AS pos, count(*) OVER (PARTITION BY series_id) AS n "
        f"FROM {levels} WINDOW o AS ({o}))",
        f"variants AS ({variants})",
        "diffs AS (SELECT *, y - base AS w FROM variants)",
    ]
    source = "diffs"
    if most_q:
        more, fitted = fit_steps(source, "m", [("w", i) for i in range(1, max(most_p, most_q) + 1)],
                                 False, key)
        parts += [more, f"innov AS (SELECT {key}, ds, y, base, pos, n, w, w - fit_m AS e "
                        f"FROM {fitted})"]
        source = "innov"
    lags = [("e", i) for i in range(1, most_q + 1)] + [("w", i) for i in range(1, most_p + 1)]
    k = len(lags)
    whole = " AND ".join(["w IS NOT NULL", *[f"x{i} IS NOT NULL" for i in range(k)]])
    parts += [
        f"lagged AS (SELECT *, "
        + ", ".join(f"lag({c}, {i}) {over}) AS x{j}" for j, (c, i) in enumerate(lags))
        + f" FROM {source})",
        f"used AS (SELECT *, CASE WHEN {whole} THEN w END AS t, "
        + ", ".join(f"CASE WHEN {whole} THEN x{i} END AS z{i}" for i in range(k)) + " FROM lagged)",
        f"summed AS (SELECT *, count(t) {before} AS c, "
        + ", ".join([f"sum(z{i} * z{j}) {before} AS g{i}_{j}" for i in range(k)
                     for j in range(i, k)] + [f"sum(z{i} * t) {before} AS r{i}" for i in range(k)])
        + " FROM used)",
        "tested AS MATERIALIZED (SELECT * FROM summed WHERE pos > floor(n * 0.5::double))",
    ]
    errors = []
    for q in qs:
        pick = [*range(q), *range(most_q, k)]
        tag = f"q{q}"
        cols = [f"g{a}_{b} AS g0_{i}_{j}_{tag}" for i, a in enumerate(pick)
                for j, b in enumerate(pick) if i <= j]
        cols += [f"r{a} AS r0_{i}_{tag}" for i, a in enumerate(pick)]
        cols += [f"x{a} AS v0_{i}_{tag}" for i, a in enumerate(pick)]
        last = f"take_{tag}"
        parts.append(f"{last} AS (SELECT series_id, d, ds, y, base, c, 0.0::double AS p0_{tag}"
                     + "".join(f", {c}" for c in cols) + " FROM tested)")
        for s in range(len(pick)):
            more, last = elimination_step(last, tag, s, len(pick))
            parts.append(more)
        cells = ", ".join(
            f"{{'p': {p}, 'err': " + (
                f"CASE WHEN c >= greatest(10, 2 * {p + q}) THEN y - base - p{p + q}_{tag} END" if p + q else "y - base")
            + "}" for p in ps)
        errors.append(f"SELECT series_id, d, {q} AS q, unnest([{cells}]) AS cell FROM {last}")
    parts.append("grid AS (SELECT series_id, cell.p AS p, d, q, count(*) AS n, "
                 "CASE WHEN count(cell.err) = count(*) THEN sqrt(avg(cell.err * cell.err)) END "
                 f"AS rmse FROM ({' UNION ALL '.join(errors)}) GROUP BY ALL)")
    return ",\n".join(parts)
