"""Registered dashboard telemetry queries (counters, histograms, canary)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import telemetry as T
from vigil.operators.ordered import sliced_running_sum
from vigil.plans.registry import query
from vigil.sources.tables import view

_INC_SQL = """
SELECT service, status, ts,
       CASE WHEN p IS NULL THEN 0 WHEN total >= p THEN total - p ELSE total END AS increase
FROM (SELECT *, lag(total) OVER (PARTITION BY service, status ORDER BY ts, request_id) AS p FROM counters) x"""

_RATE_SQL = f"""
WITH inc AS ({_INC_SQL})
SELECT service, status, time_bucket(INTERVAL 5 minute, ts) AS window_start, sum(increase) / 300.0 AS rate
FROM inc GROUP BY service, status, time_bucket(INTERVAL 5 minute, ts)"""


def _rates(spark, sf):
    return T.counter_rate(view(spark, sf, "counters"), ["service", "status"], "5 minutes",
                          tie="request_id")


@query("counter_rate", _RATE_SQL, ("counters",))
def counter_rate(spark, sf):
    """Reset-aware per-second rate per (service, status), 5-minute windows."""
    return _rates(spark, sf)


@query("rate_by_status", f"""
WITH r AS ({_RATE_SQL})
SELECT status, window_start, sum(rate) AS rate FROM r GROUP BY status, window_start""", ("counters",))
def rate_by_status(spark, sf):
    """Σ rate by status."""
    return T.rate_by(_rates(spark, sf), ["status"])


@query("error_ratio_pct", f"""
WITH r AS ({_RATE_SQL})
SELECT service, window_start,
       CASE WHEN sum(rate) = 0 THEN NULL
            ELSE sum(CASE WHEN status BETWEEN 500 AND 599 THEN rate ELSE 0.0 END) / sum(rate) * 100 END AS error_pct
FROM r GROUP BY service, window_start""", ("counters",))
def error_ratio_pct(spark, sf):
    """5xx share of the request rate, percent."""
    return T.error_ratio_pct(_rates(spark, sf), ["service"])


def hist_quantile_sql(src: str, keys: list[str], qs: list[float]) -> str:
    """SQL twin of ``histogram_quantile`` over a (keys, le, cnt) relation."""
    k = ", ".join(keys)
    on = " AND ".join(f"b.{x} = p.{x}" for x in keys)
    qv = ", ".join(f"({q}::DOUBLE)" for q in qs)
    return f"""
WITH hb AS (
  SELECT {k}, le, cnt, lag(le) OVER w AS prev_le, lag(cnt) OVER w AS prev_cnt,
         max(CASE WHEN le >= 1e9 THEN cnt END) OVER (PARTITION BY {k}) AS total,
         max(CASE WHEN le < 1e9 THEN le END) OVER (PARTITION BY {k}) AS max_finite
  FROM {src} WINDOW w AS (PARTITION BY {k} ORDER BY le)),
hq AS (SELECT hb.*, t.q, t.q * hb.total AS rnk FROM hb, (VALUES {qv}) t(q)),
hp AS (
  SELECT {k}, q, any_value(rnk) AS rnk, any_value(max_finite) AS mf, any_value(total) AS tot,
         min(CASE WHEN cnt >= rnk AND le < 1e9 THEN le END) AS ble
  FROM hq GROUP BY {k}, q),
hs AS (
  SELECT p.*, b.cnt AS bcnt, b.prev_le AS bprev_le, b.prev_cnt AS bprev_cnt
  FROM hp p LEFT JOIN hb b ON {on} AND b.le = p.ble)
SELECT {k}, q,
  CASE WHEN tot IS NULL OR tot = 0 THEN NULL
       WHEN ble IS NULL THEN mf
       WHEN bprev_le IS NULL AND ble <= 0 THEN ble
       ELSE coalesce(bprev_le, 0) + (ble - coalesce(bprev_le, 0)) * (rnk - coalesce(bprev_cnt, 0))
            / (bcnt - coalesce(bprev_cnt, 0)) END AS value
FROM hs"""


@query("histogram_quantile", hist_quantile_sql("buckets", ["service"], [0.5, 0.95, 0.99]),
       ("buckets",))
def histogram_quantile(spark, sf):
    """p50/p95/p99 latency per service from cumulative buckets."""
    return T.histogram_quantile(view(spark, sf, "buckets"), ["service"], [0.5, 0.95, 0.99])


@query("mean_latency_rate", """
WITH c AS (
  SELECT service, ts, request_id,
         sum(latency_ms) OVER (PARTITION BY service ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS lat_total,
         COUNT(*) OVER (PARTITION BY service ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS cnt_total
  FROM requests),
i AS (
  SELECT service, ts,
    CASE WHEN pl IS NULL THEN 0 WHEN lat_total >= pl THEN lat_total - pl ELSE lat_total END AS lat_inc,
    CASE WHEN pc IS NULL THEN 0 WHEN cnt_total >= pc THEN cnt_total - pc ELSE cnt_total END AS cnt_inc
  FROM (SELECT *, lag(lat_total) OVER w AS pl, lag(cnt_total) OVER w AS pc FROM c
        WINDOW w AS (PARTITION BY service ORDER BY ts, request_id)) x)
SELECT service, time_bucket(INTERVAL 1 minute, ts) AS window_start,
       CASE WHEN sum(cnt_inc) = 0 THEN NULL ELSE (sum(lat_inc) / 60.0) / (sum(cnt_inc) / 60.0) END AS mean_latency_ms
FROM i GROUP BY service, time_bucket(INTERVAL 1 minute, ts)""", ("requests",))
def mean_latency_rate(spark, sf):
    """rate(latency sum) / rate(request count) per service and minute."""
    r = view(spark, sf, "requests").select("service", "ts", "request_id", "latency_ms")
    lat = sliced_running_sum(r, ["service"], ["ts", "request_id"], "total", value=F.col("latency_ms"))
    cnt = sliced_running_sum(r, ["service"], ["ts", "request_id"], "total")
    num = T.counter_rate(lat, ["service"], "1 minute", tie="request_id")
    den = T.counter_rate(cnt, ["service"], "1 minute", tie="request_id")
    return T.ratio_of_rates(num, den, ["service"], "mean_latency_ms")


_B = T.LATENCY_BUCKETS_MS
_CANARY_SQL = f"""
WITH s AS (
  SELECT service, CAST(floor(epoch_us(ts) / 30000000) AS BIGINT) AS step, COUNT(*) AS n,
         COUNT(*) FILTER (WHERE status BETWEEN 500 AND 599) AS n5xx,
         {", ".join(f"COUNT(*) FILTER (WHERE latency_ms <= {b}) AS b{i}" for i, b in enumerate(_B))}
  FROM requests GROUP BY ALL),
w AS (
  SELECT service, step, CAST(sum(n) OVER r AS BIGINT) AS n, CAST(sum(n5xx) OVER r AS BIGINT) AS n5xx,
         {", ".join(f"CAST(sum(b{i}) OVER r AS BIGINT) AS b{i}" for i in range(len(_B)))}
  FROM s WINDOW r AS (PARTITION BY service ORDER BY step RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)),
hist AS (
  SELECT service, step, u.le, u.cnt FROM w,
  LATERAL (SELECT unnest([{", ".join(f"{{'le': {b}::DOUBLE, 'cnt': b{i}}}" for i, b in enumerate(_B))}]) AS x) t,
  LATERAL (SELECT t.x.le AS le, t.x.cnt AS cnt) u),
q AS ({hist_quantile_sql("hist", ["service", "step"], [0.95, 0.99])}),
qw AS (SELECT service, step, max(CASE WHEN q = 0.95 THEN value END) AS p95_ms,
              max(CASE WHEN q = 0.99 THEN value END) AS p99_ms FROM q GROUP BY service, step),
m AS (
  SELECT w.service, w.step, w.n, n5xx / n * 100 AS error_pct, (n - n5xx) / n * 100 AS success_pct, p95_ms, p99_ms
  FROM w LEFT JOIN qw ON w.service = qw.service AND w.step = qw.step),
ok AS (
  SELECT *, coalesce(error_pct < 1.0, false) AND coalesce(p95_ms < 200.0, false)
            AND coalesce(p99_ms < 500.0, false) AND coalesce(success_pct > 99.0, false) AS measurement_ok
  FROM m),
f AS (
  SELECT *, CAST(sum(CASE WHEN measurement_ok THEN 0 ELSE 1 END) OVER (PARTITION BY service ORDER BY step
            ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures_so_far FROM ok)
SELECT service, CAST(step * 30 AS BIGINT) AS step_epoch_s, n AS requests, error_pct, success_pct, p95_ms, p99_ms,
       measurement_ok, failures_so_far, failures_so_far > 3 AS analysis_failed
FROM f"""


@query("canary_gate", _CANARY_SQL, ("requests",))
def canary_gate(spark, sf):
    """30 s measurements over a trailing 5-minute window per service."""
    return T.canary_gate(view(spark, sf, "requests"), ["service"])
