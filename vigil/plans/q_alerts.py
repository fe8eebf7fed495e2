"""Registered alerting queries over ``metric_samples`` and the default rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators import alerts as A
from vigil.plans.registry import query
from vigil.sources.tables import view

_RULES_SQL = "(VALUES " + ", ".join(
    f"('{i}', '{n}', '{m}', '{o}', {v}::DOUBLE, NULL::VARCHAR, true, '{s}')"
    for i, n, m, o, v, s in A.DEFAULT_THRESHOLDS) + \
    ") AS r(id, name, metric, operator, value, container, enabled, severity)"

_EVAL_SQL = f"""
WITH l AS (
  SELECT project, ts, sample_id, 'cpu' AS metric, container, CAST(cpu_pct AS DOUBLE) AS value FROM metric_samples
  UNION ALL
  SELECT project, ts, sample_id, 'memory', container, CAST(mem_pct AS DOUBLE) FROM metric_samples)
SELECT l.*, r.id AS threshold_id, r.name AS threshold_name, r.operator, r.value AS threshold, r.severity,
       CASE r.operator WHEN '>' THEN l.value > r.value WHEN '<' THEN l.value < r.value
            WHEN '>=' THEN l.value >= r.value WHEN '<=' THEN l.value <= r.value ELSE false END AS breached
FROM l JOIN {_RULES_SQL}
  ON l.metric = r.metric AND (r.container IS NULL OR l.metric NOT IN ('cpu', 'memory') OR r.container = l.container)
WHERE r.enabled"""


def _evals(spark, sf):
    s = view(spark, sf, "metric_samples")
    return A.evaluate_thresholds(A.samples_long(s), A.default_thresholds(spark))


@query("evaluate_thresholds", _EVAL_SQL, ("metric_samples",))
def evaluate_thresholds(spark, sf):
    """Every sample metric against every enabled default threshold."""
    return _evals(spark, sf)


@query("alert_history")
def alert_history(spark, sf):
    """T1 batch twin: trigger / resolve / 60 s cooldown per (project,
    threshold, container) over the whole sample history."""
    return A.alert_history(_evals(spark, sf))


@query("silenced_alerts")
def silenced_alerts(spark, sf):
    """P10: alerts minus those covered by silences (all thresholds of p0 in
    the first week; memory thresholds everywhere in the second week)."""
    hist = A.alert_history(_evals(spark, sf))
    sch = T.StructType([T.StructField("project", T.StringType()),
                        T.StructField("threshold_pattern", T.StringType()),
                        T.StructField("starts_at", T.TimestampType()),
                        T.StructField("ends_at", T.TimestampType())])
    import datetime as dt
    rows = [("p0", None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 8))] + [
        (p, "memory-%", dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 15)) for p in ("p0", "p1", "p2")]
    sil = spark.createDataFrame(rows, sch)
    return A.silence_alerts(hist, sil)
