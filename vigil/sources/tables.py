"""Driver tables (parquet) and the derived telemetry views built on them.

The views give the driver's TPC-H-ish / event tables the shape of the
engine's record types (requests, metric samples, logs, counters, ...).  The
same SQL text is used for the DuckDB oracle, so both engines see identical
inputs.  The two running-count views (``metric_samples``, ``counters``) are
built with the sliced running count so no project holds a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.ordered import sliced_running_sum

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# View texts shared by Spark and the DuckDB oracle.
VIEW_SQL: dict[str, str] = {
    "requests": """
SELECT event_id AS request_id, ts, 'svc-' || CAST(user_id % 5 AS STRING) AS service, event_type AS uri,
       value AS latency_ms, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status,
       CASE WHEN user_id % 2 = 0 THEN 'old' ELSE 'new' END AS version
FROM events""",
    "metric_samples": """
SELECT event_id AS sample_id, ts, 'p' || CAST(user_id % 3 AS STRING) AS project, 'c' || CAST(user_id AS STRING) AS container,
       value % 100 AS cpu_pct, (value * 7) % 100 AS mem_pct,
       10 * ROW_NUMBER() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS total_requests
FROM events""",
    "logs": """
SELECT event_id AS log_id, ts, 'svc-' || CAST(user_id % 5 AS STRING) AS service,
       CASE event_type WHEN 'error' THEN 'Exception: connection refused ' WHEN 'signup' THEN 'WARN slow query '
            WHEN 'click' THEN 'debug trace ' WHEN 'purchase' THEN 'OOMKilled memory limit ' ELSE 'info ok ' END || props AS message
FROM events""",
    "counters": """
SELECT service, status, ts, request_id,
       COUNT(*) OVER (PARTITION BY service, status ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS total
FROM requests""",
    "buckets": """
SELECT r.service, b.le, COUNT(*) AS cnt
FROM requests r JOIN (VALUES (10.0), (50.0), (100.0), (200.0), (500.0), (1.0E9)) AS b(le) ON r.latency_ms <= b.le
GROUP BY r.service, b.le""",
    "deployments": """
SELECT event_id AS deploy_id, ts, 'svc-' || CAST(user_id % 5 AS STRING) AS service,
       SUBSTR(MD5(CAST(event_id AS STRING)), 1, 7) AS git_sha
FROM events WHERE event_type = 'signup'""",
    "commits": """
SELECT event_id AS commit_id, ts, SUBSTR(MD5(CAST(event_id AS STRING)), 1, 7) AS sha, 'Commit ' || props AS message
FROM events WHERE event_type = 'purchase'""",
    "incidents": """
SELECT d.doc_id AS incident_id, d.source AS project, SUBSTR(d.text, 1, 80) AS title, d.text AS description,
       d.lang AS tag, CASE WHEN l.quality = 1 THEN 'resolved' WHEN l.quality = 0 THEN 'open' ELSE 'investigating' END AS status,
       CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.toxic = 0 THEN 'resolved' END AS fix_outcome
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "handled_incidents": """
SELECT incident_id, project, title, description, tag, status, fix_outcome,
       CASE WHEN status = 'resolved' THEN 'Applied the runbook of ' || project END AS resolution,
       CASE WHEN incident_id % 5 = 0 THEN 'Known cause in ' || project END AS root_cause
FROM incidents""",
    "chaos_results": """
SELECT 'p' || CAST(user_id % 3 AS STRING) AS project, event_id AS run_id,
       CASE event_type WHEN 'error' THEN 'pod-kill' WHEN 'signup' THEN 'network-latency' WHEN 'click' THEN 'kafka-down'
            WHEN 'view' THEN 'db-latency' ELSE 'memory-pressure' END AS scenario,
       value < 150 AS passed, value * 200 AS recovery_ms
FROM events""",
    "engagement": """
SELECT event_id, ts, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id,
       CASE event_type WHEN 'purchase' THEN 'view_complete' WHEN 'signup' THEN 'rating' WHEN 'view' THEN 'view_start'
            WHEN 'click' THEN 'search' ELSE 'other' END AS event_type, value / 100 AS value
FROM events""",
    "catalog": """
SELECT p_partkey AS id, p_name AS title, split(p_type, ' ') AS genres, split(p_name, ' ') AS tags,
       CAST(1 + p_partkey % 10 AS DOUBLE) AS rating
FROM part""",
    "articles": """
SELECT page_id % 40 AS id, page_id AS version, url, regexp_extract(html, '<title>([^<]*)', 1) AS title, page_id % 1000 AS score
FROM pages""",
    "chat": """
SELECT conv_id, turn, role AS author, text AS body FROM conversations""",
}

VIEW_DEPS = {"counters": ["requests"], "buckets": ["requests"], "handled_incidents": ["incidents"]}
_BASE = {
    "requests": ["events"], "metric_samples": ["events"], "logs": ["events"],
    "deployments": ["events"], "commits": ["events"], "incidents": ["documents", "labels"],
    "chaos_results": ["events"], "engagement": ["events"], "catalog": ["part"],
    "articles": ["pages"], "chat": ["conversations"], "counters": [], "buckets": [], "handled_incidents": [],
}


def oracle_with(sql: str, *views: str) -> str:
    """``WITH`` clause holding the named views (and their dependencies)."""
    order: list[str] = []

    def add(v):
        for d in VIEW_DEPS.get(v, []):
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in order)
    body = sql.strip()
    if not order:
        return body
    if body[:4].upper() == "WITH" and body[4:5].isspace():
        return f"WITH {ctes},\n{body[5:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a derived view as a Spark DataFrame."""
    if name == "metric_samples":
        ev = read_table(spark, sf_dir, "events")
        d = ev.select(
            F.col("event_id").alias("sample_id"), "ts",
            F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project"),
            F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("container"),
            (F.col("value") % 100).alias("cpu_pct"),
            ((F.col("value") * 7) % 100).alias("mem_pct"))
        d = sliced_running_sum(d, ["project"], ["ts", "sample_id"], "_rn")
        return d.withColumn("total_requests", F.col("_rn") * 10).drop("_rn")
    if name == "counters":
        r = view(spark, sf_dir, "requests").select("service", "status", "ts", "request_id")
        return sliced_running_sum(r, ["service", "status"], ["ts", "request_id"], "total")
    for dep in VIEW_DEPS.get(name, []):
        view(spark, sf_dir, dep).createOrReplaceTempView(dep)
    for t in _BASE.get(name, []):
        read_table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(VIEW_SQL[name])
