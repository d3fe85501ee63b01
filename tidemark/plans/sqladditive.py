"""SQL text for a small additive model: linear trend with slope changes, the weekly
seasonality and holiday terms."""

from __future__ import annotations

# Fixed values, written here anew so that a wrong one in the model would show.
CHANGEPOINT_RANGE = 0.8
SCALES = {"seasonality": 0.1, "changepoint": 0.95, "holiday": 10.0, "trend": 5.0}
WAVES = 3  # Fourier pairs of the week


def _solve(source: str, size: int, weights: list[str]) -> str:
    """Nested selects that add ``b<i>``, the solution of the penalised equations."""
    name = {(i, j): f"g{min(i, j)}_{max(i, j)}" for i in range(size) for j in range(size)}
    name |= {(i, size): f"r{i}" for i in range(size)}
    first = ", ".join(f"g{i}_{i} + noise * {w} AS m_{i}" for i, w in enumerate(weights))
    sql = f"SELECT *, {first} FROM {source}"
    name |= {(i, i): f"m_{i}" for i in range(size)}
    for s in range(size):
        cols = []
        new = {}
        for i in range(size):
            if i == s:
                continue
            for j in range(s + 1, size + 1):
                new[i, j] = f"m{s}_{i}_{j}"
                cols.append(f"{name[i, j]} - {name[i, s]} * {name[s, j]} / {name[s, s]} "
                            f"AS {new[i, j]}")
        name |= new
        sql = f"SELECT *, {', '.join(cols)} FROM ({sql})"
    answer = ", ".join(f"{name[i, size]} / {name[i, i]} AS b{i}" for i in range(size))
    return f"SELECT *, {answer} FROM ({sql})"


def additive_steps(days: str, changes: int, labels: list[str], holdout: int, rounds: int) -> str:
    """CTEs from a table of ``series_id, ds, y`` and ``touched`` (holiday days) to
    ``additive`` with ``yhat`` for the held-out rows, and ``components`` for all rows."""
    knots = ", ".join(
        f"max(t) FILTER (WHERE pos = 1 + cast(round_even({j} * (floor((n - {holdout}) * "
        f"{CHANGEPOINT_RANGE}::double) - 1) / {changes}::double, 0) AS int)) AS k{j}"
        for j in range(1, changes + 1)
    )
    since = "(t.ds - date '1970-01-01')"
    features = ["1.0::double", "t.t", *[f"greatest(t.t - k{j}, 0)" for j in range(1, changes + 1)]]
    features += [f"{f}(2 * pi() * {i} * {since} / 7.0::double)" for i in range(1, WAVES + 1)
                 for f in ("sin", "cos")]
    features += [f"cast(coalesce(list_contains(h.labels, '{n}'), false) AS double)" for n in labels]
    size = len(features)
    hinge = range(2, 2 + changes)
    weights = [str(SCALES["trend"] ** -2)] * 2 + [f"w{i}" for i in hinge]
    weights += [str(SCALES["seasonality"] ** -2)] * (2 * WAVES)
    weights += [str(SCALES["holiday"] ** -2)] * len(labels)
    sums = ", ".join(
        [f"sum(f{i} * f{j}) AS g{i}_{j}" for i in range(size) for j in range(i, size)]
        + [f"sum(f{i} * u) AS r{i}" for i in range(size)] + ["sum(u * u) AS uu"]
    )
    quad = " + ".join(f"b{i} * b{j} * g{min(i, j)}_{max(i, j)}"
                      for i in range(size) for j in range(size))
    cross = " + ".join(f"b{i} * r{i}" for i in range(size))
    betas = ", ".join(f"b{i}" for i in range(size))
    ends = (0, 2 + changes, 2 + changes + 2 * WAVES, size)
    parts = ", ".join(
        f"({' + '.join(f'f{i} * b{i}' for i in range(a, b))}) * l.scale AS {name}"
        for name, a, b in zip(("trend", "weekly", "holidays"), ends, ends[1:]))
    return f"""placed AS (SELECT series_id, ds, y, row_number() OVER o AS pos,
  count(*) OVER (PARTITION BY series_id) AS n FROM {days}
  WINDOW o AS (PARTITION BY series_id ORDER BY ds)),
spans AS (SELECT series_id, min(ds) AS a, max(ds) AS b, max(abs(y)) AS scale FROM placed
  WHERE pos <= n - {holdout} GROUP BY series_id),
timed AS (SELECT p.*, scale, (ds - a) / (b - a)::double AS t FROM placed p
  JOIN spans USING (series_id)),
knots AS (SELECT series_id, {knots} FROM timed GROUP BY series_id),
marked AS (SELECT ds, list(holiday || '|' || "offset") AS labels FROM touched GROUP BY ds),
laid AS (SELECT t.series_id, t.ds, t.y, t.scale, t.y / t.scale AS u, t.pos > t.n - {holdout}
  AS is_test, {', '.join(f'{f} AS f{i}' for i, f in enumerate(features))}
  FROM timed t JOIN knots k ON k.series_id = t.series_id LEFT JOIN marked h ON h.ds = t.ds),
gram AS (SELECT series_id, {sums} FROM laid WHERE NOT is_test GROUP BY series_id),
iter AS (
  SELECT series_id, 0 AS it, 0.01::double AS noise,
    {', '.join(f"{SCALES['changepoint'] ** -2}::double AS w{i}" for i in hinge)},
    {', '.join(f'0.0::double AS b{i}' for i in range(size))} FROM gram
  UNION ALL
  SELECT series_id, it + 1, greatest(greatest(uu - 2 * ({cross}) + {quad}, 0) / g0_0, 1e-8),
    {', '.join(f"1 / ({SCALES['changepoint']} * greatest(abs(b{i}), 1e-13))" for i in hinge)},
    {betas}
  FROM ({_solve('(SELECT series_id, it, noise, ' + ', '.join(f'w{i}' for i in hinge)
                + f', gram.* EXCLUDE (series_id) FROM iter JOIN gram USING (series_id) '
                + f'WHERE it < {rounds})', size, weights)})),
components AS (SELECT l.series_id, l.ds, l.y, l.is_test, {parts}, l.scale * sqrt(noise
  + {changes} * 2 * pow(({' + '.join(f'abs(b{i})' for i in hinge)}) / {changes}, 2) * pow(greatest(f1 - 1, 0), 3) / 3) AS sd
  FROM laid l JOIN iter i ON i.series_id = l.series_id AND i.it = {rounds}),
additive AS (SELECT series_id, ds, y, trend + weekly + holidays AS yhat FROM components
  WHERE is_test)"""
