"""Registered metric-snapshot queries over the ``metric_samples`` view."""

from __future__ import annotations

from vigil.operators import metrics as M
from vigil.plans.registry import query
from vigil.sources.tables import view


@query("metrics_between", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY project ORDER BY ts DESC, sample_id DESC) AS rn
  FROM metric_samples
  WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00') x
WHERE rn <= 500""", ("metric_samples",))
def metrics_between(spark, sf):
    """inclusive range, most recent 500 per project, ascending."""
    return M.metrics_between(view(spark, sf, "metric_samples"), "2024-01-05 00:00:00",
                             "2024-01-25 12:00:00", 500, keys=["project"], tie="sample_id")


@query("metrics_summary", """
WITH c AS (
  SELECT project, container, COUNT(*) AS container_points,
         avg(cpu_pct) AS avg_cpu_pct, max(cpu_pct) AS max_cpu_pct,
         avg(mem_pct) AS avg_mem_pct, max(mem_pct) AS max_mem_pct,
         min(ts) AS f, max(ts) AS l
  FROM metric_samples GROUP BY project, container),
p AS (
  SELECT project, arg_max(total_requests, ts) AS total_requests_last
  FROM metric_samples GROUP BY project)
SELECT c.project, container, container_points, avg_cpu_pct, max_cpu_pct, avg_mem_pct, max_mem_pct,
       CAST(sum(container_points) OVER (PARTITION BY c.project) AS BIGINT) AS data_points,
       min(f) OVER (PARTITION BY c.project) AS first_ts, max(l) OVER (PARTITION BY c.project) AS last_ts,
       p.total_requests_last
FROM c JOIN p ON c.project = p.project""", ("metric_samples",))
def metrics_summary(spark, sf):
    """A1 per project and container."""
    return M.metrics_summary(view(spark, sf, "metric_samples"), ["project"], order_tie="sample_id")


@query("request_delta", """
SELECT * EXCLUDE (pt, pts),
       CASE WHEN pt IS NULL OR pt = 0 THEN 0 ELSE greatest(0, total_requests - pt) END AS request_delta,
       CASE WHEN (epoch_us(ts) - epoch_us(pts)) / 1e6 > 0 THEN
            (CASE WHEN pt IS NULL OR pt = 0 THEN 0 ELSE greatest(0, total_requests - pt) END) / ((epoch_us(ts) - epoch_us(pts)) / 1e6)
       END AS per_second
FROM (SELECT *, lag(total_requests) OVER w AS pt, lag(ts) OVER w AS pts
      FROM metric_samples WINDOW w AS (PARTITION BY project ORDER BY ts, sample_id)) x""", ("metric_samples",))
def request_delta(spark, sf):
    """Per-project request delta and true per-second rate."""
    return M.request_delta(view(spark, sf, "metric_samples"), ["project"])


@query("rolling_points", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY container ORDER BY ts DESC, sample_id DESC) AS rn
  FROM metric_samples) x WHERE rn <= 60""", ("metric_samples",))
def rolling_points(spark, sf):
    """Last 60 points per container series."""
    return M.rolling_points(view(spark, sf, "metric_samples"), ["container"], 60, tie="sample_id")


@query("dashboard_points", """
SELECT project, time_bucket(INTERVAL 600 second, ts) AS bucket_start,
       avg(cpu_pct) AS cpu_pct, avg(mem_pct) AS mem_pct, COUNT(*) AS samples
FROM (SELECT *, max(ts) OVER (PARTITION BY project) AS now_ts FROM metric_samples) x
WHERE ts > now_ts - INTERVAL 24 hour
GROUP BY project, time_bucket(INTERVAL 600 second, ts)""", ("metric_samples",))
def dashboard_points(spark, sf):
    """The 24 h dashboard window, 144 averaged points per project."""
    d = M.downsample(view(spark, sf, "metric_samples"), ["project"], "24 hours", 144,
                     ["cpu_pct", "mem_pct"])
    return d.select("project", d["bucket.start"].alias("bucket_start"), "cpu_pct", "mem_pct", "samples")


@query("gauge_series", """
SELECT container, time_bucket(INTERVAL 5 minute, ts) AS window_start,
       arg_max(cpu_pct, ts) AS cpu_pct, max(ts) AS sample_ts
FROM metric_samples GROUP BY container, time_bucket(INTERVAL 5 minute, ts)""", ("metric_samples",))
def gauge_series(spark, sf):
    """Last cpu gauge per container per 5-minute window."""
    return M.gauge_series(view(spark, sf, "metric_samples"), ["container"], "cpu_pct",
                          "5 minutes", tie="sample_id")


@query("export_metrics_csv", """
SELECT CAST(epoch_us(ts) // 1000 AS VARCHAR) AS timestamp,
       strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS datetime,
       project AS projectName, container AS containerName,
       printf('%.2f', cpu_pct) AS cpuPercent, printf('%.2f', mem_pct) AS memoryPercent,
       '' AS memoryUsage, '' AS memoryLimit, '' AS networkRx, '' AS networkTx,
       CAST(total_requests AS VARCHAR) AS httpTotalRequests,
       '' AS httpAvgResponseTime, '' AS httpP50, '' AS httpP95, '' AS httpP99, '' AS httpErrorRate,
       '' AS http2xx, '' AS http4xx, '' AS http5xx
FROM metric_samples""", ("metric_samples",))
def export_metrics_csv(spark, sf):
    """CSV export rows of the snapshots (what ``export_csv`` writes)."""
    snaps = M.samples_as_snapshots(view(spark, sf, "metric_samples"))
    return M.export_rows(snaps)
