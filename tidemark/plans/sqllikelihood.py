"""SQL text for the exact likelihood of a first difference with one moving-average term.

With errors of variance 1 and coefficient th, the variance of the first prediction's error is
f = 1 + th^2, and from row to row f becomes 1 + th^2 - th^2 / f and the prediction th e / f. The
series and a constant are filtered side by side, which gives the best mean.
"""

from __future__ import annotations

# The step of the numeric derivatives, and the number of Newton rounds from a grid of 0.05.
STEP, ROUNDS = 1e-3, 4
COST = "m * ln((ww - w1 * w1 / oo) / m) + logs"
GRID_COST = "r.k * ln((ww - w1 * w1 / oo) / r.k) + logs"


def differenced(levels: str) -> str:
    """CTE ``moves``: the first differences ``w`` of ``levels``, numbered by ``k`` from 1."""
    return f"""placed AS (
  SELECT series_id, ds, y, row_number() OVER o AS pos, count(*) OVER (PARTITION BY series_id) AS n,
    y - lag(y) OVER o AS w, lag(y) OVER o AS before
  FROM {levels} WINDOW o AS (PARTITION BY series_id ORDER BY ds)),
moves AS (SELECT series_id, pos - 1 AS k, w FROM placed WHERE pos > 1)"""


def filtered(name: str, models: str) -> str:
    """CTE ``name``: the filter over ``models`` (series_id, id, th, m) for the first ``m`` differences
    of each, a row per number of differences seen."""
    return f"""{name} AS (
  SELECT series_id, id, th, m, 0::bigint AS k, 1 + th * th AS f, 0::double AS a, 0::double AS c,
    0::double AS ww, 0::double AS w1, 0::double AS oo, 0::double AS logs FROM {models}
  UNION ALL
  SELECT s.series_id, id, th, m, s.k + 1, 1 + th * th - th * th / f, th * (w - a) / f, th * (1 - c) / f,
    ww + (w - a) * (w - a) / f, w1 + (w - a) * (1 - c) / f, oo + (1 - c) * (1 - c) / f, logs + ln(f)
  FROM {name} s JOIN moves d ON d.series_id = s.series_id AND d.k = s.k + 1 WHERE s.k < m)"""


def best_models(instances: str) -> str:
    """CTEs to ``best``: the filter at the largest likelihood of each of ``instances`` (series_id, id,
    m), at its last row. A grid finds the neighbourhood, Newton's method the place."""
    parts = [
        f"grid_models AS (SELECT DISTINCT i.series_id, 0::bigint AS id, t / 20.0::double AS th, "
        f"max(m) OVER (PARTITION BY i.series_id) AS m FROM {instances} i, generate_series(-19, 19) g(t))",
        filtered("grid_runs", "grid_models"),
        f"near0 AS (SELECT i.series_id, i.id, i.m, arg_min(th, {GRID_COST}) AS th "
        f"FROM {instances} i JOIN grid_runs r ON r.series_id = i.series_id AND r.k = i.m GROUP BY ALL)",
    ]
    h = f"{STEP}::double"
    for r in range(ROUNDS):
        at = [f"max(cost) FILTER (spot = {s})" for s in (-2, -1, 0, 1, 2)]
        slope = f"(({at[0]}) - 8 * ({at[1]}) + 8 * ({at[3]}) - ({at[4]})) / (12 * {h})"
        bend = f"(16 * ({at[1]}) + 16 * ({at[3]}) - ({at[0]}) - ({at[4]}) - 30 * ({at[2]})) / (12 * {h} * {h})"
        parts += [
            f"round{r}_models AS (SELECT series_id, id * 5 + s + 2 AS id, th + s * {h} AS th, m "
            f"FROM near{r}, generate_series(-2, 2) g(s))",
            filtered(f"round{r}_runs", f"round{r}_models"),
            f"round{r}_costs AS (SELECT series_id, id // 5 AS id, id % 5 - 2 AS spot, m, th, "
            f"{COST} AS cost FROM round{r}_runs WHERE k = m)",
            f"near{r + 1} AS (SELECT series_id, id, m, max(th) FILTER (spot = 0) - ({slope}) / ({bend}) "
            f"AS th FROM round{r}_costs GROUP BY ALL)",
        ]
    return ",\n".join([*parts, filtered("best_runs", f"near{ROUNDS}"), f"""best AS (
  SELECT *, w1 / oo AS mean, (ww - w1 * w1 / oo) / m AS variance,
    -0.5::double * (m * (ln(2 * pi()) + 1) + {COST}) AS loglik FROM best_runs WHERE k = m)"""])
