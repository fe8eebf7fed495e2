"""Registered queries for source summaries and the specified extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import extensions as X
from vigil.plans.q_incidents import project_commits, project_logs
from vigil.plans.registry import query
from vigil.sources.tables import read_table, view

_PL = "plogs AS (SELECT l.*, 'p' || CAST(e.user_id % 3 AS STRING) AS project FROM logs l JOIN events e ON l.log_id = e.event_id)"
_PC = "pcommits AS (SELECT c.*, 'p' || CAST(e.user_id % 3 AS STRING) AS project FROM commits c JOIN events e ON c.commit_id = e.event_id)"


@query("source_summary", f"""
WITH {_PL}, {_PC}
SELECT project, 'logs' AS source, 'lines' AS metric, COUNT(*) AS value FROM plogs GROUP BY project
UNION ALL SELECT project, 'logs', 'errors', COUNT(*) FILTER (WHERE regexp_matches(lower(message), 'error|exception|fatal|panic|fail')) FROM plogs GROUP BY project
UNION ALL SELECT project, 'logs', 'warnings', COUNT(*) FILTER (WHERE contains(lower(message), 'warn')) FROM plogs GROUP BY project
UNION ALL SELECT project, 'git', 'commits', COUNT(*) FROM pcommits GROUP BY project""", ("logs", "commits"))
def source_summary(spark, sf):
    """A26 + U2: per-project source counts (logs lines / errors / warnings, commits)."""
    return X.source_summary(project_logs(spark, sf), project_commits(spark, sf))


@query("domain_regression", """
SELECT uri AS domain, quantile_cont(latency_ms, 0.95) FILTER (WHERE version = 'old') AS p95_old,
       quantile_cont(latency_ms, 0.95) FILTER (WHERE version = 'new') AS p95_new,
       coalesce(quantile_cont(latency_ms, 0.95) FILTER (WHERE version = 'new')
                > quantile_cont(latency_ms, 0.95) FILTER (WHERE version = 'old') * 1.2, false) AS regression
FROM requests GROUP BY uri""", ("requests",))
def domain_regression(spark, sf):
    """p95 old vs new version per domain (the request's endpoint)."""
    r = view(spark, sf, "requests")
    return X.domain_regression(r, X.domain_of(F.col("uri"), F.lit("")))


@query("slowest_in_window", """
SELECT service, time_bucket(INTERVAL 1 minute, ts) AS window_start,
       arg_max(request_id, (latency_ms, request_id)) AS slowest_id, max(latency_ms) AS max_latency_ms
FROM requests GROUP BY service, time_bucket(INTERVAL 1 minute, ts)""", ("requests",))
def slowest_in_window(spark, sf):
    """Slowest request per service and minute."""
    return X.slowest_in_window(view(spark, sf, "requests"), ["service"])


@query("error_streaks", """
WITH c AS (SELECT service, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS step,
                  COUNT(*) FILTER (WHERE status BETWEEN 500 AND 599) * 100.0 / COUNT(*) AS error_pct
           FROM requests GROUP BY service, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT)),
b AS (SELECT *, error_pct > 5.0 AS bad FROM c),
b2 AS (SELECT *, CASE WHEN bad <> lag(bad) OVER (PARTITION BY service ORDER BY step)
                          OR step - lag(step) OVER (PARTITION BY service ORDER BY step) > 1 THEN 1 ELSE 0 END AS chg FROM b),
g AS (SELECT *, sum(chg) OVER (PARTITION BY service ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM b2),
r AS (SELECT service, run, min(step) AS f, max(step) AS l, COUNT(*) AS checks FROM g WHERE bad GROUP BY service, run)
SELECT service, f * 60 AS start_epoch_s, l * 60 AS end_epoch_s, checks, 'service degradation' AS classification
FROM r WHERE checks >= 3""", ("requests",))
def error_streaks(spark, sf):
    """Error share above 5 % for three or more consecutive checks."""
    return X.error_streaks(view(spark, sf, "requests"), ["service"])


@query("traffic_gaps", """
SELECT service, prev_ts AS silent_from, ts AS silent_to, (epoch_us(ts) - epoch_us(prev_ts)) / 6e7 AS gap_minutes,
       'dead service' AS classification
FROM (SELECT service, ts, lag(ts) OVER (PARTITION BY service ORDER BY ts, request_id) AS prev_ts FROM requests
      UNION ALL SELECT service, (SELECT max(ts) FROM requests), max(ts) FROM requests GROUP BY service) x
WHERE (epoch_us(ts) - epoch_us(prev_ts)) / 6e7 >= 15""", ("requests",))
def traffic_gaps(spark, sf):
    """No traffic for 15 minutes per service, within or at the end of the range."""
    return X.traffic_gaps(view(spark, sf, "requests"), ["service"])


_VECTOR_SQL = """
WITH u AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]),
                   lambda x: x / CASE WHEN sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))) > 0
                                 THEN sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))) ELSE 1.0 END) AS u
           FROM embeddings),
p AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_dot_product(a.u, b.u) AS cosine
      FROM u a JOIN u b ON a.vec_id < b.vec_id),
q AS (SELECT id_a AS vec_id, id_b AS similar_id, cosine FROM p WHERE cosine >= 0.75
      UNION ALL SELECT id_b, id_a, cosine FROM p WHERE cosine >= 0.75)
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY cosine DESC, similar_id) AS rank FROM q) x
WHERE rank <= 5"""


@query("vector_similar", _VECTOR_SQL)
def vector_similar(spark, sf):
    """Embedding pairs with cosine >= 0.75 (exact), top 5."""
    return X.vector_similar(read_table(spark, sf, "embeddings"))


@query("vector_similar_loose", _VECTOR_SQL.replace("0.75", "0.25"))
def vector_similar_loose(spark, sf):
    """P7 at a cosine of 0.25, which the vectors of the table do reach."""
    return X.vector_similar(read_table(spark, sf, "embeddings"), min_cos=0.25)
