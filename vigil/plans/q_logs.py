"""Registered log-analytics queries over the ``logs`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import logs as L
from vigil.plans.registry import query
from vigil.sources.tables import view

_LEVEL_SQL = """CASE WHEN contains(lower(message), 'error') OR contains(lower(message), 'exception')
                       OR contains(lower(message), 'fatal') THEN 'error'
                  WHEN contains(lower(message), 'warn') THEN 'warn'
                  WHEN contains(lower(message), 'debug') OR contains(lower(message), 'trace') THEN 'debug'
                  ELSE 'info' END"""


@query("log_levels", f"""
SELECT *, {_LEVEL_SQL} AS level,
       regexp_matches(lower(message), 'error|exception|fatal|panic|fail') AS is_error,
       regexp_matches(lower(message), 'oomkilled|out of memory|heap space|memory limit') AS is_oom,
       regexp_matches(lower(message), 'connection refused|econnrefused|connection reset|timeout') AS is_connection_error
FROM logs""", ("logs",))
def log_levels(spark, sf):
    """Level and line flags for every log line."""
    return L.with_line_flags(L.with_level(view(spark, sf, "logs")))


@query("search_logs", f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY ts DESC, log_id DESC) AS rn FROM (
    SELECT *, {_LEVEL_SQL} AS level FROM logs) l
  WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'
    AND service = 'svc-1' AND level = 'error' AND contains(lower(message), 'refused')) x
WHERE rn <= 500""", ("logs",))
def search_logs(spark, sf):
    """time range, service, level (case-insensitive), text, newest 500."""
    return L.search_logs(view(spark, sf, "logs"), "2024-01-03 00:00:00", "2024-01-20 00:00:00",
                         service="svc-1", level="ERROR", text="REFUSED", tie="log_id")


@query("search_log_store", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY service ORDER BY ts DESC, log_id DESC) AS rn FROM logs
  WHERE contains(message, 'OOMKilled')) x
WHERE rn <= 200""", ("logs",))
def search_log_store(spark, sf):
    """case-sensitive text search, newest 200 per service, ascending."""
    return L.search_logs(view(spark, sf, "logs"), text="OOMKilled", limit=200, keys=["service"],
                         tie="log_id", case_sensitive=True)


@query("service_values", "SELECT DISTINCT service FROM logs", ("logs",))
def service_values(spark, sf):
    """distinct service labels."""
    return L.service_values(view(spark, sf, "logs"))


@query("log_stats", f"""
SELECT 'service' AS dimension, service AS key, COUNT(*) AS entries, min(ts) AS oldest, max(ts) AS newest FROM logs GROUP BY service
UNION ALL
SELECT 'level', {_LEVEL_SQL}, COUNT(*), min(ts), max(ts) FROM logs GROUP BY 2
UNION ALL
SELECT 'all', '*', COUNT(*), min(ts), max(ts) FROM logs""", ("logs",))
def log_stats(spark, sf):
    """A2: entries and time range by service, by level and overall (one scan)."""
    return L.log_stats(view(spark, sf, "logs"))


@query("log_volume", """
SELECT service, time_bucket(INTERVAL 1 minute, ts) AS window_start, COUNT(*) AS lines
FROM logs GROUP BY service, time_bucket(INTERVAL 1 minute, ts)""", ("logs",))
def log_volume(spark, sf):
    """count_over_time per service per minute."""
    return L.log_volume(view(spark, sf, "logs"))


@query("log_retention", """
SELECT * EXCLUDE (dt), strftime(dt, '%Y-%m-%d') AS dt FROM (SELECT *, CAST(ts AS DATE) AS dt FROM logs) l
WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY
  AND dt IN (SELECT dt FROM (SELECT DISTINCT CAST(ts AS DATE) AS dt FROM logs
                             WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY) d
             ORDER BY dt DESC LIMIT 10)""", ("logs",))
def log_retention(spark, sf):
    """7-day retention and at most 10 newest daily chunks."""
    d = view(spark, sf, "logs").withColumn("dt", F.to_date("ts"))
    out = L.apply_retention(d, "2024-01-31 00:00:00", 7, 10, chunk="dt")
    return out.withColumn("dt", F.date_format("dt", "yyyy-MM-dd"))


@query("error_signatures", """
SELECT signature, COUNT(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen FROM (
  SELECT ts, regexp_replace(regexp_replace(regexp_replace(regexp_replace(message,
      '[A-Za-z0-9_.-]+:\\d{2,5}\\b', '{host}:{port}', 'g'),
      '\\b([a-z][a-z0-9]*(?:-[a-z0-9]+)*)-[a-z0-9]{5,10}(?:-[a-z0-9]{5})?\\b', '{service}-{pod_id}', 'g'),
      '\\b[A-Z][A-Za-z0-9]*\\.(?:java|kt|py|ts|js):\\d+', '{class}:{line}', 'g'),
      '\\d+', '{n}', 'g') AS signature
  FROM logs WHERE regexp_matches(lower(message), 'error|exception|fatal|panic|fail')) s
GROUP BY signature""", ("logs",))
def error_signatures(spark, sf):
    """Error lines grouped by normalized signature."""
    return L.error_signatures(view(spark, sf, "logs"))
