"""Registered resilience queries over the ``chaos_results`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import resilience as X
from vigil.plans.registry import query
from vigil.sources.tables import read_table, view

_PTS = """(CASE WHEN passed THEN 15 + CASE WHEN recovery_ms IS NULL THEN 0 WHEN recovery_ms < 5000 THEN 10
      WHEN recovery_ms < 15000 THEN 7 WHEN recovery_ms < 30000 THEN 4 ELSE 1 END ELSE 0 END)"""

_SECS = "CAST((CAST(round(recovery_ms) AS BIGINT) + 50) // 100 // 10 AS VARCHAR) || '.' || " \
        "CAST(((CAST(round(recovery_ms) AS BIGINT) + 50) // 100) % 10 AS VARCHAR)"

_LATEST = """latest AS (
  SELECT project, scenario, arg_max(passed, run_id) AS passed, arg_max(recovery_ms, run_id) AS recovery_ms,
         max(run_id) AS run_id
  FROM chaos_results GROUP BY project, scenario)"""


@query("resilience_score", f"""
SELECT project, CAST(sum({_PTS}) AS BIGINT) AS score, COUNT(*) * 25 AS max_score, COUNT(*) AS scenarios_run,
       CAST(round(sum({_PTS}) * 100.0 / (COUNT(*) * 25)) AS INTEGER) AS percentage
FROM chaos_results GROUP BY project""", ("chaos_results",))
def resilience_score(spark, sf):
    """A7 over every result of a project."""
    return X.resilience_score(view(spark, sf, "chaos_results"))


_TREND_SQL = f"""
WITH e AS (SELECT project, run_id, CAST(sum({_PTS}) AS DOUBLE) / (COUNT(*) * 25) AS pct
           FROM chaos_results GROUP BY project, run_id),
l AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project ORDER BY run_id DESC) AS rn FROM e) x
      WHERE rn <= 5),
a AS (SELECT project, COUNT(*) AS entries, arg_min(pct, run_id) AS first_pct, arg_max(pct, run_id) AS last_pct
      FROM l GROUP BY project)
SELECT *, CASE WHEN entries < 2 THEN 'new' WHEN last_pct - first_pct > 0.05 THEN 'improving'
               WHEN last_pct - first_pct < -0.05 THEN 'declining' ELSE 'stable' END AS trend
FROM a"""


@query("score_trend", _TREND_SQL, ("chaos_results",))
def score_trend(spark, sf):
    """Trend over each project's last five run entries."""
    return X.score_trend(X.score_entries(view(spark, sf, "chaos_results")))


@query("latest_results", f"WITH {_LATEST} SELECT * FROM latest", ("chaos_results",))
def latest_results(spark, sf):
    """Newest result per project and scenario."""
    return X.latest_results(view(spark, sf, "chaos_results"))


@query("untested_scenarios", f"""
WITH {_LATEST}
SELECT p.project, s.scenario FROM (SELECT DISTINCT project FROM latest) p,
  (VALUES ('pod-kill'), ('network-latency'), ('kafka-down'), ('db-latency'), ('memory-pressure')) s(scenario)
WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.project = p.project AND l.scenario = s.scenario)""",
       ("chaos_results",))
def untested_scenarios(spark, sf):
    """Expected scenarios lacking a result per project."""
    return X.untested_scenarios(X.latest_results(view(spark, sf, "chaos_results")))


_RULES = "(VALUES " + ", ".join(
    "('{}', '{}', '{}', '{}', '{}')".format(*r) for r in X.GAP_RULES) + \
    ") AS g(scenario, severity, category, description, recommendation)"


@query("gap_catalog", f"""
WITH {_LATEST}
SELECT l.project, l.scenario, g.category, g.severity, g.description, g.recommendation
FROM latest l JOIN {_RULES} ON l.scenario = g.scenario WHERE NOT l.passed
UNION ALL
SELECT project, scenario, 'Recovery Speed', 'medium',
       'Slow recovery for ' || scenario || ': ' || {_SECS} || 's (target: < 30s)',
       'Optimize startup time, add readiness probes, pre-warm connections'
FROM latest WHERE passed AND recovery_ms > 30000""", ("chaos_results",))
def gap_catalog(spark, sf):
    """Gaps of the latest result per scenario (untested coverage gaps
    are added when scenarios are missing)."""
    return X.gap_catalog(X.latest_results(view(spark, sf, "chaos_results")))


@query("chaos_strengths", f"""
WITH {_LATEST}
SELECT project, scenario,
       CASE WHEN recovery_ms IS NOT NULL AND recovery_ms < 5000
            THEN 'Fast recovery from ' || scenario || ' (' || {_SECS} || 's)'
            ELSE 'Resilient to ' || scenario END AS strength
FROM latest WHERE passed
UNION ALL
SELECT project, NULL, 'Passes all tested chaos scenarios' FROM latest GROUP BY project
HAVING bool_and(passed) AND COUNT(*) >= 3""", ("chaos_results",))
def chaos_strengths(spark, sf):
    """C6 strengths of the latest results."""
    return X.strengths(X.latest_results(view(spark, sf, "chaos_results")))


@query("scorecard", f"""
WITH {_LATEST},
cur AS (SELECT project, CAST(sum({_PTS}) AS BIGINT) AS current_score, COUNT(*) * 25 AS max_score,
               CAST(round(sum({_PTS}) * 100.0 / (COUNT(*) * 25)) AS INTEGER) AS percentage
        FROM latest GROUP BY project),
tr AS ({_TREND_SQL}),
gp AS (SELECT project, COUNT(*) AS gaps FROM (
         SELECT project FROM latest WHERE NOT passed
         UNION ALL SELECT project FROM latest WHERE passed AND recovery_ms > 30000) x GROUP BY project),
st AS (SELECT project, COUNT(*) AS strengths FROM (
         SELECT project FROM latest WHERE passed
         UNION ALL SELECT project FROM latest GROUP BY project HAVING bool_and(passed) AND COUNT(*) >= 3) y
       GROUP BY project)
SELECT cur.*, tr.trend, coalesce(gp.gaps, 0) AS gaps, coalesce(st.strengths, 0) AS strengths
FROM cur LEFT JOIN tr USING (project) LEFT JOIN gp USING (project) LEFT JOIN st USING (project)""",
       ("chaos_results",))
def scorecard(spark, sf):
    """Current score, percentage, trend, gap and strength counts."""
    return X.scorecard(view(spark, sf, "chaos_results"))


_RECS = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in X.SCENARIO_RECOMMENDATIONS) + \
    ") AS r(scenario, recommendation)"


@query("chaos_recommendations", f"""
SELECT DISTINCT project, recommendation FROM (
  SELECT c.project, r.recommendation FROM chaos_results c JOIN {_RECS} ON c.scenario = r.scenario WHERE NOT c.passed
  UNION ALL
  SELECT project, 'Improve recovery time for ' || scenario || ' (currently ' || {_SECS} || 's, target < 30s)'
  FROM chaos_results WHERE NOT passed AND recovery_ms > 30000) x""", ("chaos_results",))
def chaos_recommendations(spark, sf):
    """C7 + U4: distinct recommendations per project."""
    return X.chaos_recommendations(view(spark, sf, "chaos_results"))


_RUN_SQL = """
WITH runs AS (SELECT c.project, c.run_id, c.scenario, e.ts AS start_ts
              FROM chaos_results c JOIN events e ON c.run_id = e.event_id),
agg AS (SELECT r.run_id, COUNT(*) AS requests,
               COUNT(*) FILTER (WHERE NOT (q.status >= 200 AND q.status < 500)) AS errors,
               avg(q.latency_ms) AS avg_latency_ms, quantile_cont(q.latency_ms, 0.99) AS p99_ms
        FROM runs r JOIN requests q ON q.ts >= r.start_ts AND q.ts < r.start_ts + INTERVAL 120 SECOND
        GROUP BY r.run_id),
o AS (SELECT runs.*, coalesce(agg.requests, 0) AS requests, coalesce(agg.errors, 0) AS errors, agg.avg_latency_ms,
             agg.p99_ms,
             CASE WHEN coalesce(agg.requests, 0) > 0 THEN agg.errors / agg.requests
                  WHEN runs.scenario = 'kafka-down' THEN 1.0 ELSE 0.0 END AS error_ratio
      FROM runs LEFT JOIN agg USING (run_id)),
a AS (SELECT o.*, coalesce((SELECT q.status >= 200 AND q.status < 500 FROM requests q
                   WHERE q.ts >= o.start_ts + INTERVAL 120 SECOND ORDER BY q.ts, q.request_id LIMIT 1), false) AS after_ok
      FROM o)
SELECT *, error_ratio < CASE WHEN scenario = 'kafka-down' THEN 0.3 ELSE 0.5 END AND after_ok AS passed
FROM a"""


@query("chaos_run_summary", _RUN_SQL, ("chaos_results", "requests"))
def chaos_run_summary(spark, sf):
    """Probe requests inside each 2-minute chaos window (interval join),
    error ratio, average latency, recovery probe and pass rule."""
    return X.chaos_run_summary(view(spark, sf, "requests"), _runs(spark, sf))


def _runs(spark, sf):
    return (view(spark, sf, "chaos_results").join(
        read_table(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("start_ts")),
        on="run_id", how="inner").select("project", "run_id", "scenario", "start_ts"))


@query("chaos_slo", f"""
WITH s AS ({_RUN_SQL}),
d AS (SELECT s.*, c.recovery_ms FROM s LEFT JOIN chaos_results c USING (run_id))
SELECT *, error_ratio_slo_ok AND p99_ms_slo_ok AND recovery_ms_slo_ok AS slo_met FROM (
  SELECT *, coalesce(error_ratio <= 0.05, false) AS error_ratio_slo_ok, coalesce(p99_ms <= 2000.0, false) AS p99_ms_slo_ok,
            coalesce(recovery_ms <= 60000.0, false) AS recovery_ms_slo_ok FROM d) x""", ("chaos_results", "requests"))
def chaos_slo(spark, sf):
    """Chaos SLOs per run (error <= 5 %, probe p99 <= 2 s, recovery <= 60 s)."""
    summary = X.chaos_run_summary(view(spark, sf, "requests"), _runs(spark, sf))
    return X.chaos_slo(summary, view(spark, sf, "chaos_results"))
