"""Registered release-analytics queries over the ``requests`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import release as R
from vigil.plans.registry import query
from vigil.sources.tables import view

_DUR = "(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6"

_PERF_SQL = f"""
SELECT service, COUNT(*) AS requests, COUNT(*) FILTER (WHERE status >= 400) AS failed,
       avg(latency_ms) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms,
       quantile_cont(latency_ms, 0.5) AS p50_ms, quantile_cont(latency_ms, 0.9) AS p90_ms,
       quantile_cont(latency_ms, 0.95) AS p95_ms, quantile_cont(latency_ms, 0.99) AS p99_ms,
       {_DUR} AS duration_s,
       CASE WHEN {_DUR} = 0 THEN NULL ELSE COUNT(*) / ({_DUR}) END AS rate,
       COUNT(*) FILTER (WHERE status >= 400) / COUNT(*) AS error_ratio
FROM requests GROUP BY service"""


@query("perf_summary", _PERF_SQL, ("requests",))
def perf_summary(spark, sf):
    """A9 per service."""
    return R.perf_summary(view(spark, sf, "requests"), ["service"])


@query("perf_gate", f"""
SELECT *, p95_ms_ok AND p99_ms_ok AND error_ratio_ok AND avg_ms_ok AS passed FROM (
  SELECT *, coalesce(p95_ms < 500, false) AS p95_ms_ok, coalesce(p99_ms < 1000, false) AS p99_ms_ok,
         coalesce(error_ratio < 0.01, false) AS error_ratio_ok, coalesce(avg_ms < 200, false) AS avg_ms_ok
  FROM ({_PERF_SQL}) s) g""", ("requests",))
def perf_gate(spark, sf):
    """A24 over A9 per service."""
    return R.perf_gate(R.perf_summary(view(spark, sf, "requests"), ["service"]))


_VM_SQL = f"""
WITH ranked AS (
  SELECT service, version, latency_ms,
         ROW_NUMBER() OVER (PARTITION BY service, version ORDER BY latency_ms) AS rn,
         COUNT(*) OVER (PARTITION BY service, version) AS n
  FROM requests),
q AS (
  SELECT service, version,
         max(CASE WHEN rn = least(floor(n * 0.5) + 1, n) THEN latency_ms END) AS p50_ms,
         max(CASE WHEN rn = least(floor(n * 0.95) + 1, n) THEN latency_ms END) AS p95_ms,
         max(CASE WHEN rn = least(floor(n * 0.99) + 1, n) THEN latency_ms END) AS p99_ms
  FROM ranked GROUP BY service, version),
b AS (
  SELECT service, version, COUNT(*) AS requests, COUNT(*) FILTER (WHERE status >= 400) AS errors,
         {_DUR} AS duration_s,
         CASE WHEN {_DUR} = 0 THEN NULL ELSE COUNT(*) / ({_DUR}) END AS rps,
         sum(latency_ms) / COUNT(*) AS avg_ms,
         COUNT(*) FILTER (WHERE status >= 400) / COUNT(*) AS error_ratio
  FROM requests GROUP BY service, version)
SELECT b.*, q.p50_ms, q.p95_ms, q.p99_ms FROM b JOIN q USING (service, version)"""


@query("version_metrics", _VM_SQL, ("requests",))
def version_metrics(spark, sf):
    """A10 per (service, version): exact sorted[floor(n*q)] percentiles."""
    return R.version_metrics(view(spark, sf, "requests"), ["service", "version"])


_CMP_SQL = f"""
WITH vm AS ({_VM_SQL}),
w AS (
  SELECT service,
    max(CASE WHEN version='old' THEN p95_ms END) o1, max(CASE WHEN version='new' THEN p95_ms END) n1,
    max(CASE WHEN version='old' THEN rps END) o2, max(CASE WHEN version='new' THEN rps END) n2,
    max(CASE WHEN version='old' THEN error_ratio END) o3, max(CASE WHEN version='new' THEN error_ratio END) n3,
    max(CASE WHEN version='old' THEN avg_ms END) o4, max(CASE WHEN version='new' THEN avg_ms END) n4,
    max(CASE WHEN version='old' THEN p99_ms END) o5, max(CASE WHEN version='new' THEN p99_ms END) n5
  FROM vm GROUP BY service),
l AS (
  SELECT service, 'p95 Latency' AS metric, o1 AS old_value, n1 AS new_value, false AS hib FROM w
  UNION ALL SELECT service, 'Throughput', o2, n2, true FROM w
  UNION ALL SELECT service, 'Error Rate', o3, n3, false FROM w
  UNION ALL SELECT service, 'Avg Latency', o4, n4, false FROM w
  UNION ALL SELECT service, 'p99 Latency', o5, n5, false FROM w),
d AS (
  SELECT *, CASE WHEN metric = 'Error Rate' THEN new_value - old_value
                 WHEN old_value = 0 THEN NULL ELSE (new_value - old_value) / old_value * 100 END AS diff
  FROM l)
SELECT service, metric, old_value, new_value, diff,
  CASE WHEN diff IS NULL THEN 'tie'
       WHEN metric = 'Error Rate' AND abs(diff) < 0.001 THEN 'tie'
       WHEN metric <> 'Error Rate' AND abs(diff) < 5 THEN 'tie'
       WHEN hib AND new_value > old_value THEN 'new'
       WHEN NOT hib AND new_value < old_value THEN 'new' ELSE 'old' END AS winner,
  CASE WHEN (CASE WHEN metric = 'Error Rate' THEN diff * 100 ELSE diff END) > 0 THEN '+' ELSE '' END
    || printf('%.1f', CASE WHEN metric = 'Error Rate' THEN diff * 100 ELSE diff END) || '%' AS improvement
FROM d"""


def _comparisons(spark, sf):
    vm = R.version_metrics(view(spark, sf, "requests"), ["service", "version"])
    return R.compare_versions(vm, ["service"])


@query("metric_comparison", _CMP_SQL, ("requests",))
def metric_comparison(spark, sf):
    """J12 + C8: old vs new version per service and metric."""
    return _comparisons(spark, sf)


@query("recommend_release", f"""
WITH c AS ({_CMP_SQL}),
wt AS (SELECT *, CASE metric WHEN 'p95 Latency' THEN 3 WHEN 'Error Rate' THEN 3 WHEN 'Throughput' THEN 2 ELSE 1 END AS w FROM c),
s AS (SELECT service, sum(CASE WHEN winner='new' THEN w ELSE 0 END) AS new_weight,
             sum(CASE WHEN winner='old' THEN w ELSE 0 END) AS old_weight, sum(w) AS total_weight
      FROM wt GROUP BY service)
SELECT service, CAST(new_weight AS INTEGER) AS new_weight, CAST(old_weight AS INTEGER) AS old_weight,
       CAST(total_weight AS INTEGER) AS total_weight,
       CASE WHEN new_weight > old_weight THEN 'promote' WHEN old_weight > new_weight THEN 'rollback' ELSE 'inconclusive' END AS recommendation,
       CASE WHEN new_weight = old_weight THEN 0
            ELSE CAST(least(round(abs(new_weight - old_weight) * 100.0 / total_weight), 95) AS INTEGER) END AS confidence
FROM s""", ("requests",))
def recommend_release(spark, sf):
    """A25 over C8."""
    return R.recommend_release(_comparisons(spark, sf), ["service"])


@query("check_pass_rates", """
SELECT service, chk AS check_name, COUNT(*) FILTER (WHERE ok) AS passes, COUNT(*) FILTER (WHERE NOT ok) AS fails,
       avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS pass_rate
FROM (SELECT service, 'status is 200' AS chk, status = 200 AS ok FROM requests
      UNION ALL SELECT service, 'response time < 500ms', latency_ms < 500 FROM requests) c
GROUP BY service, chk""", ("requests",))
def check_pass_rates(spark, sf):
    """Two load-test checks per request (status 200, latency < 500 ms)."""
    r = view(spark, sf, "requests")
    checks = r.select("service", F.inline(F.array(
        F.struct(F.lit("status is 200").alias("check_name"), (F.col("status") == 200).alias("passed")),
        F.struct(F.lit("response time < 500ms").alias("check_name"),
                 (F.col("latency_ms") < 500).alias("passed")))))
    return R.check_pass_rates(checks, ["service", "check_name"])


_SERIES_SQL = """
SELECT service, time_bucket(INTERVAL 1 minute, ts) + INTERVAL 1 minute AS point_ts,
       quantile_cont(latency_ms, 0.95) AS p95_ms
FROM requests GROUP BY service, time_bucket(INTERVAL 1 minute, ts)"""


@query("deploy_before_after", f"""
WITH s AS ({_SERIES_SQL}),
ba AS (
SELECT d.deploy_id, d.ts, d.service, d.git_sha,
  (SELECT p95_ms FROM s WHERE s.service = d.service AND s.point_ts <= d.ts ORDER BY s.point_ts DESC LIMIT 1) AS latency_before,
  (SELECT p95_ms FROM s WHERE s.service = d.service AND s.point_ts >= d.ts ORDER BY s.point_ts LIMIT 1) AS latency_after
FROM deployments d)
SELECT *, latency_after - latency_before AS latency_delta,
  coalesce(latency_before > 0 AND (latency_after - latency_before) / latency_before > 0.2, false) AS regression
FROM ba""", ("requests", "deployments"))
def deploy_before_after(spark, sf):
    """J7 (as-of) + W9: p95 before/after every deploy, regression flag."""
    series = R.latency_series(view(spark, sf, "requests"), ["service"])
    dep = view(spark, sf, "deployments")
    return R.deploy_before_after(dep, series, ["service"])


@query("snapshot_regression", f"""
WITH s AS ({_SERIES_SQL}),
snap AS (
  SELECT d.deploy_id, d.ts, d.service,
    (SELECT p95_ms FROM s WHERE s.service = d.service AND s.point_ts <= d.ts ORDER BY s.point_ts DESC LIMIT 1) AS p95_ms
  FROM deployments d),
b AS (SELECT *, avg(p95_ms) OVER (PARTITION BY service ORDER BY ts, deploy_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p95_ms_baseline FROM snap)
SELECT *, coalesce(p95_ms > p95_ms_baseline * 1.2, false) AS regression,
          coalesce(p95_ms < p95_ms_baseline * 0.8, false) AS improvement
FROM b""", ("requests", "deployments"))
def snapshot_regression(spark, sf):
    """Deploy snapshot vs mean of the previous five deploy snapshots."""
    series = R.latency_series(view(spark, sf, "requests"), ["service"])
    dep = view(spark, sf, "deployments").select("deploy_id", "ts", "service")
    snap = R.asof_join(dep, series, ["service"], "ts", "point_ts", ["p95_ms"], backward=True)
    return R.snapshot_regression(snap, ["service"], ["ts", "deploy_id"])


@query("comparison_slo", f"""
WITH vm AS ({_VM_SQL})
SELECT *, p95_ms_slo_ok AND p99_ms_slo_ok AND rps_slo_ok AND error_ratio_slo_ok AS slo_met FROM (
  SELECT *, coalesce(p95_ms < 200, false) AS p95_ms_slo_ok, coalesce(p99_ms < 500, false) AS p99_ms_slo_ok,
            coalesce(rps > 1000, false) AS rps_slo_ok, coalesce(error_ratio < 0.01, false) AS error_ratio_slo_ok
  FROM vm) x""", ("requests",))
def comparison_slo(spark, sf):
    """Comparison targets on per-version metrics."""
    vm = R.version_metrics(view(spark, sf, "requests"), ["service", "version"])
    return R.slo_check(vm, R.COMPARISON_SLO)
