"""Common table expressions that several queries' SQL starts from."""

from __future__ import annotations

P = "PARTITION BY run_id, roi"
T = "PARTITION BY run_id, roi ORDER BY t, tie"


def samples(roi: str = "event_type", name: str = "s", where: str = "", run: str = "'events'") -> str:
    return f"{name} AS (SELECT {run} AS run_id, {roi} AS roi, epoch_us(ts) / 1e6 - 1704067200 AS t, value, event_id AS tie FROM events {where})"


def jumps(src: str, out: str, factor: float = 1.5) -> str:
    """out: src with n and jump."""
    return f"""
{out}_n AS (SELECT *, count(*) OVER ({P}) AS n, lead(value) OVER ({T}) - value AS diff FROM {src}),
{out}_l AS (SELECT *, CASE WHEN n >= 25 AND diff IS NOT NULL THEN stddev_pop(diff) OVER ({T} ROWS BETWEEN h PRECEDING AND h FOLLOWING) END AS loc
    FROM (SELECT *, CAST(least(20, n // 5) // 2 AS BIGINT) AS h FROM {out}_n)),
{out}_m AS (SELECT *, quantile_cont(loc, 0.5) OVER ({P}) AS typical FROM {out}_l),
{out} AS (SELECT run_id, roi, t, value, tie, n, CASE WHEN abs(diff) > {factor} * typical THEN diff ELSE 0 END AS jump FROM {out}_m)"""


def dejumped(src: str, out: str) -> str:
    return f"""{jumps(src, out + '_j')},
{out} AS (SELECT run_id, roi, t, tie, value AS raw, value - coalesce(sum(jump) OVER ({T} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS value FROM {out}_j)"""


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def solve3(m: list[list[str]], y: list[str]) -> list[str]:
    whole = _det(m)
    swap = lambda k: [[y[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]
    return [f"{_det(swap(k))} / nullif({whole}, 0)" for k in range(3)]


def quadratic(src: str, out: str) -> str:
    """out: src with trend and trend_mean."""
    sums = ", ".join([*(f"sum(x ** {k}) AS s{k}" for k in range(5)), *(f"sum(x ** {k} * value) AS y{k}" for k in range(3))])
    c = solve3([[f"s{i + j}" for j in range(3)] for i in range(3)], ["y0", "y1", "y2"])
    return f"""
{out}_x AS (SELECT *, coalesce((t - avg(t) OVER ({P})) / nullif(max(t) OVER ({P}) - min(t) OVER ({P}), 0), 0) AS x FROM {src}),
{out}_c AS (SELECT run_id, roi, s0, s1, s2, {c[0]} AS c0, {c[1]} AS c1, {c[2]} AS c2 FROM (SELECT run_id, roi, {sums} FROM {out}_x GROUP BY run_id, roi)),
{out} AS (SELECT x.*, c0 + c1 * x + c2 * x * x AS trend, (c0 * s0 + c1 * s1 + c2 * s2) / s0 AS trend_mean FROM {out}_x AS x JOIN {out}_c USING (run_id, roi))"""


def drift(src: str, out: str, mean: str, percent: float = 1.0) -> str:
    return f"""
{out}_d AS (SELECT run_id, roi, regr_slope(value, t) AS slope, CASE WHEN avg({mean}) > 0 THEN abs(regr_slope(value, t) * (max(t) - min(t))) / avg({mean}) * 100 ELSE 0 END AS drift FROM {src} GROUP BY run_id, roi),
{out} AS (SELECT run_id, roi, t, tie, CASE WHEN drift > {percent} THEN value - slope * t ELSE value END AS value FROM {src} JOIN {out}_d USING (run_id, roi))"""


def detrended(src: str, out: str, with_jumps: bool = True) -> str:
    first = dejumped(f"{out}_many", f"{out}_a") if with_jumps else f"{out}_a AS (SELECT run_id, roi, t, tie, value AS raw, value FROM {out}_many)"
    return f"""
{out}_k AS (SELECT *, count(*) OVER ({P}) AS k FROM {src}),
{out}_many AS (SELECT run_id, roi, t, value, tie FROM {out}_k WHERE k >= 20),
{first},
{quadratic(f"{out}_a", f"{out}_b")},
{out}_q AS (SELECT run_id, roi, t, tie, value AS level, coalesce(value - trend + trend_mean, value) AS value FROM {out}_b),
{drift(f"{out}_q", f"{out}_e", "level")},
{out} AS (SELECT run_id, roi, t, value, tie FROM {out}_e UNION ALL SELECT run_id, roi, t, value, tie FROM {out}_k WHERE k < 20)"""


def baseline(src: str, out: str, minutes: float, multiplier: float, need: int, clamp: bool = False) -> str:
    low = f"avg(value) - {multiplier} * stddev_pop(value)"
    return f"""{out} AS (SELECT run_id, roi, CASE WHEN count(*) >= {need} THEN avg(value) ELSE 0 END AS baseline_mean, CASE WHEN count(*) >= {need} THEN avg(value) + {multiplier} * stddev_pop(value) ELSE 0 END AS upper,
    CASE WHEN count(*) >= {need} THEN {f"greatest(0, {low})" if clamp else low} ELSE 0 END AS lower, CASE WHEN count(*) >= {need} THEN 'success' ELSE 'insufficient_data' END AS status, count(*) AS samples
    FROM (SELECT *, min(t) OVER ({P}) AS t0 FROM {src}) WHERE t < t0 + {minutes} * 60 GROUP BY run_id, roi)"""


def adaptive(src: str, out: str, frames: int, multiplier: float, interval: float) -> str:
    return f"""
{out}_h AS (SELECT * FROM (SELECT *, min(t) OVER ({P}) AS t0, count(*) OVER ({P}) AS total FROM {src}) WHERE {frames} >= total OR t < t0 + {frames} * {interval}),
{out}_m AS (SELECT run_id, roi, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM {out}_h GROUP BY run_id, roi),
{out}_o AS (SELECT run_id, roi, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*) AS outliers FROM {out}_h JOIN {out}_m USING (run_id, roi) GROUP BY run_id, roi),
{out}_v AS (SELECT *, coalesce(mean / nullif(std, 0), 0) AS snr, CASE WHEN mean > 0 THEN std / mean ELSE 1 END AS cv FROM {out}_m JOIN {out}_o USING (run_id, roi)),
{out}_w AS (SELECT *, n >= 10 AS ok, cv > 0.5 OR outliers > 10 AS robust FROM {out}_v),
{out}_y AS (SELECT *, CASE WHEN robust THEN median ELSE mean END AS base, CASE WHEN robust THEN (q3 - q1) / 1.349 ELSE std END AS width,
    {multiplier} * CASE WHEN snr > 10 THEN 0.7 WHEN snr > 5 THEN 1.0 ELSE 1.3 END * CASE WHEN cv > 1 THEN 1 + (cv - 1) / 2 WHEN cv < 0.2 THEN 0.8 + cv ELSE 1 END AS multiplier FROM {out}_w),
{out} AS (SELECT run_id, roi, CASE WHEN ok THEN base ELSE 0 END AS baseline_mean, CASE WHEN NOT ok THEN 0 WHEN base + multiplier * width < 1.1 * base THEN 1.2 * base ELSE base + multiplier * width END AS upper,
    CASE WHEN NOT ok THEN 0 WHEN base - multiplier * width < 0 THEN greatest(0, base - width) ELSE base - multiplier * width END AS lower, CASE WHEN ok THEN 'success' ELSE 'insufficient_analysis_data' END AS status, n AS samples,
    CASE WHEN ok THEN snr END AS snr, CASE WHEN ok THEN cv END AS cv, CASE WHEN ok THEN outliers END AS outliers, CASE WHEN ok THEN robust END AS robust, CASE WHEN ok THEN multiplier END AS multiplier,
    CASE WHEN NOT ok THEN NULL WHEN snr > 10 THEN 'high' WHEN snr > 5 THEN 'medium' ELSE 'low' END AS quality, CASE WHEN NOT ok THEN NULL WHEN cv < 0.2 THEN 'high' WHEN cv < 0.5 THEN 'medium' ELSE 'low' END AS stability FROM {out}_y)"""


def hysteresis(src: str, limits: str, out: str) -> str:
    now = f"({T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
{out}_a AS (SELECT s.*, baseline_mean, upper, lower, CASE WHEN value > upper AND NOT value < lower THEN 1 WHEN value < lower AND NOT value > upper THEN 0 END AS was_set,
    CASE WHEN value > upper THEN 1 WHEN value < lower THEN 0 WHEN value > baseline_mean THEN 1 ELSE 0 END AS begin, CASE WHEN value > upper AND value < lower THEN 1 ELSE 0 END AS flip FROM {src} AS s JOIN {limits} USING (run_id, roi)),
{out}_b AS (SELECT *, sum(flip) OVER {now} AS flips FROM {out}_a),
{out}_c AS (SELECT *, first_value(begin) OVER {now} AS first_state, last_value(was_set IGNORE NULLS) OVER {now} AS last_set, last_value(CASE WHEN was_set IS NOT NULL THEN flips END IGNORE NULLS) OVER {now} AS at_set FROM {out}_b),
{out} AS (SELECT run_id, roi, t, value, tie, CAST((coalesce(last_set, first_state) + flips - coalesce(at_set, 0)) % 2 AS INTEGER) AS state FROM {out}_c)"""


def fractions(src: str, out: str, size: int) -> str:
    return f"""
{out}_t AS (SELECT *, lead(t) OVER ({T}) AS nx FROM {src}),
{out}_e AS (SELECT run_id, roi, min(t) AS t0, max(t) AS tn FROM {src} GROUP BY run_id, roi HAVING count(*) > 1),
{out}_s AS (SELECT run_id, roi, unnest(range(CAST(floor(t0 / {size}) AS BIGINT), CAST(ceil(tn / {size}) AS BIGINT))) AS bin FROM {out}_e),
{out}_x AS (SELECT run_id, roi, t, nx, unnest(range(CAST(floor(t / {size}) AS BIGINT), CAST(floor(nx / {size}) AS BIGINT) + 1)) AS bin FROM {out}_t WHERE state = 1 AND nx > t),
{out}_y AS (SELECT run_id, roi, bin, sum(greatest(0, least(nx, (bin + 1) * {size}) - greatest(t, bin * {size}))) AS spent FROM {out}_x GROUP BY run_id, roi, bin),
{out} AS (SELECT run_id, roi, CAST(bin * {size} AS DOUBLE) AS bin_start, (bin + 0.5) * {size} AS bin_center, least(1.0, coalesce(spent, 0) / {size}) AS fraction FROM {out}_s LEFT JOIN {out}_y USING (run_id, roi, bin))"""


def slept(src: str, out: str, need: int, threshold: float = 0.5) -> str:
    return f"""
{out}_q AS (SELECT *, CASE WHEN fraction < {threshold} THEN 1 ELSE 0 END AS quiescent FROM {src}),
{out}_r AS (SELECT *, row_number() OVER ({P} ORDER BY bin_start) - row_number() OVER ({P}, quiescent ORDER BY bin_start) AS run FROM {out}_q),
{out} AS (SELECT run_id, roi, bin_start, bin_center, fraction, quiescent, CASE WHEN quiescent = 1 AND count(*) OVER ({P}, quiescent, run) >= {need} THEN 1 ELSE 0 END AS sleep FROM {out}_r)"""


def resampled(src: str, out: str, size: float) -> str:
    return f"""
{out}_e AS (SELECT run_id, roi, min(t) AS t0, max(t) AS tn FROM {src} GROUP BY run_id, roi),
{out}_s AS (SELECT run_id, roi, t0, unnest(range(0, greatest(1, CAST(ceil((tn - t0) / {size}) AS BIGINT)))) AS idx FROM {out}_e),
{out}_m AS (SELECT run_id, roi, CAST(floor((t - t0) / {size}) AS BIGINT) AS idx, avg(value) AS mean FROM {src} JOIN {out}_e USING (run_id, roi) GROUP BY 1, 2, 3),
{out} AS (SELECT run_id, roi, idx, t0 + idx * {size} AS t, coalesce(last_value(mean IGNORE NULLS) OVER ({P} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS value FROM {out}_s LEFT JOIN {out}_m USING (run_id, roi, idx))"""


def sinusoid(src: str, out: str, hours: float, period: str) -> str:
    """out: n, yy, a, b, c, amplitude, phase and the sums of each run, roi, period_h. period: an expression over src."""
    at = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    base = ("cs", "sn", "1.0::DOUBLE")
    sums = ", ".join([*(f"sum({base[i]} * {base[j]}) AS m{i}{j}" for i in range(3) for j in range(i, 3)), *(f"sum({base[i]} * value) AS y{i}" for i in range(3))])
    a, b, c = solve3([[at(i, j) for j in range(3)] for i in range(3)], ["y0", "y1", "y2"])
    return f"""
{out}_x AS (SELECT *, cos(idx * (2 * pi() * {hours} / p)) AS cs, sin(idx * (2 * pi() * {hours} / p)) AS sn FROM (SELECT *, CAST({period} AS DOUBLE) AS p FROM {src})),
{out}_m AS (SELECT run_id, roi, p AS period_h, count(*) AS n, sum(value * value) AS yy, {sums} FROM {out}_x GROUP BY run_id, roi, p),
{out}_s AS (SELECT *, {a} AS a, {b} AS b, {c} AS c FROM {out}_m),
{out} AS (SELECT *, sqrt(a * a + b * b) AS amplitude, atan2(b, a) AS phase FROM {out}_s)"""
