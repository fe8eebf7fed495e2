"""Registered ingest queries: raw records rendered from the driver tables
are parsed back into typed rows by the ingest jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.text import TOPIC_KEYWORDS
from vigil.operators import ingest as G
from vigil.operators import recommender as RC
from vigil.plans.registry import query
from vigil.sources.tables import read_table, view

_ISO = "yyyy-MM-dd'T'HH:mm:ss"


def log_lines(spark, sf):
    """``service  | 2024-01-01T00:00:00Z message`` lines."""
    l = view(spark, sf, "logs")
    return l.select(F.concat(F.col("service"), F.lit("  | "), F.date_format("ts", _ISO), F.lit("Z "),
                             F.col("message")).alias("value"))


@query("container_logs", """
WITH l AS (SELECT service || '  | ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z ' || message AS value FROM logs),
m AS (SELECT regexp_extract(value, '^([^\\s|]+)\\s*\\|\\s*(.*)$', 1) AS svc,
             regexp_extract(value, '^([^\\s|]+)\\s*\\|\\s*(.*)$', 2) AS msg FROM l WHERE trim(value) <> ''),
t AS (SELECT svc, msg, regexp_extract(msg, '^(\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}[^\\s]*)\\s*', 1) AS ts_text FROM m)
SELECT trim(svc) AS service,
       trim(regexp_replace(msg, '^(\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}[^\\s]*)\\s*', '')) AS message,
       strptime(ts_text, '%Y-%m-%dT%H:%M:%SZ') AS ts, ts_text
FROM t""", ("logs",))
def container_logs(spark, sf):
    """Container log lines -> service, timestamp, message."""
    return G.structure_container_logs(log_lines(spark, sf))


@query("commit_lines", """
WITH l AS (SELECT sha || '|unknown|' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z|' || message AS value FROM commits),
p AS (SELECT string_split(value, '|') AS p FROM l)
SELECT p[1] AS sha, p[2] AS author, p[3] AS date, array_to_string(p[4:], '|') AS message,
       strptime(p[3], '%Y-%m-%dT%H:%M:%SZ') AS ts
FROM p WHERE len(p) >= 4""", ("commits",))
def commit_lines(spark, sf):
    """``sha|author|date|message`` lines -> commits."""
    c = view(spark, sf, "commits")
    lines = c.select(F.concat(F.col("sha"), F.lit("|unknown|"), F.date_format("ts", _ISO), F.lit("Z|"),
                              F.col("message")).alias("value"))
    return G.structure_commits(lines)


@query("container_stats", """
WITH j AS (
  SELECT container AS name, printf('%.2f', cpu_pct) || '%' AS c, printf('%.2f', mem_pct) || '%' AS m,
         printf('%.2f', mem_pct * 20) || 'MiB / 2GiB' AS mu,
         CAST(total_requests AS VARCHAR) || 'kB / ' || CAST(total_requests // 10 AS VARCHAR) || 'MB' AS nio
  FROM metric_samples)
SELECT name, CAST(replace(c, '%', '') AS DOUBLE) AS cpu_pct, CAST(replace(m, '%', '') AS DOUBLE) AS mem_pct,
       CAST(regexp_extract(trim(split_part(mu, '/', 1)), '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+))', 1) AS DOUBLE) * 1048576 AS mem_usage,
       2.0 * 1073741824 AS mem_limit,
       CAST(regexp_extract(trim(split_part(nio, '/', 1)), '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+))', 1) AS DOUBLE) * 1024 AS net_rx,
       CAST(regexp_extract(trim(split_part(nio, '/', 2)), '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+))', 1) AS DOUBLE) * 1048576 AS net_tx
FROM j""", ("metric_samples",))
def container_stats(spark, sf):
    """I3 + E6: container stats JSON -> percents and byte sizes."""
    s = view(spark, sf, "metric_samples")
    js = s.select(F.to_json(F.struct(
        F.col("container").alias("Name"),
        F.concat(F.format_string("%.2f", "cpu_pct"), F.lit("%")).alias("CPUPerc"),
        F.concat(F.format_string("%.2f", "mem_pct"), F.lit("%")).alias("MemPerc"),
        F.concat(F.format_string("%.2f", F.col("mem_pct") * 20), F.lit("MiB / 2GiB")).alias("MemUsage"),
        F.concat(F.col("total_requests").cast("string"), F.lit("kB / "),
                 (F.col("total_requests") / 10).cast("long").cast("string"), F.lit("MB")).alias("NetIO"))).alias("value"))
    return G.structure_container_stats(js)


_EXPO_SQL = """
WITH q AS (
  SELECT service, quantile_cont(latency_ms, 0.5) / 1000 AS q50, quantile_cont(latency_ms, 0.95) / 1000 AS q95,
         quantile_cont(latency_ms, 0.99) / 1000 AS q99 FROM requests GROUP BY service),
c AS (SELECT service, status, COUNT(*) AS n FROM requests GROUP BY service, status),
lines AS (
  SELECT service, 'http_server_requests_seconds{quantile="0.5",uri="/"} ' || CAST(q50 AS VARCHAR) AS value FROM q
  UNION ALL SELECT service, 'http_server_requests_seconds{quantile="0.95",uri="/"} ' || CAST(q95 AS VARCHAR) FROM q
  UNION ALL SELECT service, 'http_server_requests_seconds{quantile="0.99",uri="/"} ' || CAST(q99 AS VARCHAR) FROM q
  UNION ALL SELECT service, 'http_server_requests_seconds_count{status="' || status || '",uri="/"} ' || CAST(n AS VARCHAR) || '.0' FROM c
  UNION ALL SELECT service, '# TYPE http_server_requests_seconds summary' FROM q),
p AS (
  SELECT service,
    CASE WHEN starts_with(value, 'http_server_requests_seconds{') THEN TRY_CAST(regexp_extract(value, 'quantile="([^"]+)"', 1) AS DOUBLE) END AS qq,
    CASE WHEN starts_with(value, 'http_server_requests_seconds_count{') THEN TRY_CAST(regexp_extract(value, 'status="(\\d+)"', 1) AS INTEGER) END AS st,
    TRY_CAST(regexp_extract(value, '\\}\\s+([-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?)', 1) AS DOUBLE) AS v
  FROM lines WHERE NOT starts_with(value, '#')),
g AS (
  SELECT service, max(CASE WHEN qq = 0.5 THEN v END) * 1000 AS p50_ms, max(CASE WHEN qq = 0.95 THEN v END) * 1000 AS p95_ms,
         max(CASE WHEN qq = 0.99 THEN v END) * 1000 AS p99_ms,
         sum(CASE WHEN st BETWEEN 200 AND 299 THEN v ELSE 0.0 END) AS status_2xx,
         sum(CASE WHEN st BETWEEN 400 AND 499 THEN v ELSE 0.0 END) AS status_4xx,
         sum(CASE WHEN st BETWEEN 500 AND 599 THEN v ELSE 0.0 END) AS status_5xx
  FROM p GROUP BY service)
SELECT *, CASE WHEN status_2xx + status_4xx + status_5xx > 0
               THEN status_5xx / (status_2xx + status_4xx + status_5xx) * 100 ELSE 0.0 END AS error_rate_pct
FROM g"""


@query("exposition_metrics", _EXPO_SQL, ("requests",))
def exposition_metrics(spark, sf):
    """I4: text exposition (rendered per service from the requests) ->
    latency quantiles, status-class counts and error %."""
    r = view(spark, sf, "requests")
    q = r.groupBy("service").agg(*[(F.percentile("latency_ms", F.lit(p)) / 1000).alias(f"q{i}")
                                   for i, p in ((50, 0.5), (95, 0.95), (99, 0.99))])
    c = r.groupBy("service", "status").agg(F.count(F.lit(1)).alias("n"))
    lines = q.select("service", F.inline(F.array(*[
        F.struct(F.concat(F.lit(f'http_server_requests_seconds{{quantile="{p}",uri="/"}} '),
                          F.col(f"q{i}").cast("string")).alias("value"))
        for i, p in ((50, "0.5"), (95, "0.95"), (99, "0.99"))])))
    lines = lines.unionByName(c.select("service", F.concat(
        F.lit('http_server_requests_seconds_count{status="'), F.col("status").cast("string"), F.lit('",uri="/"} '),
        F.col("n").cast("string"), F.lit(".0")).alias("value")))
    lines = lines.unionByName(q.select("service", F.lit("# TYPE http_server_requests_seconds summary").alias("value")))
    return G.structure_exposition(lines, ["service"])


@query("log_store_response", "SELECT service, ts, message FROM logs", ("logs",))
def log_store_response(spark, sf):
    """Log-store JSON responses (one stream per line) -> rows."""
    l = view(spark, sf, "logs")
    ns = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    resp = l.select(F.to_json(F.struct(F.struct(F.array(F.struct(
        F.create_map(F.lit("service"), F.col("service")).alias("stream"),
        F.array(F.array(ns, F.col("message"))).alias("values"))).alias("result")).alias("data"))).alias("value"))
    return G.structure_log_store_response(resp)


def _stories(spark, sf):
    p = read_table(spark, sf, "pages")
    js = p.select(F.to_json(F.struct(
        F.col("page_id").alias("id"), F.lit("story").alias("type"),
        F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.col("url"),
        (F.col("page_id") % 1000).alias("score"), F.col("page_id").alias("time"))).alias("value"))
    return G.structure_stories(js)


_TOPICS_SQL = "[" + ", ".join(
    "{'t': '" + t + "', 'k': [" + ", ".join("'" + k + "'" for k in kws) + "]}" for t, kws in TOPIC_KEYWORDS) + "]"
_TAGS = f"list_transform(list_filter({_TOPICS_SQL}, lambda x: len(list_filter(x.k, lambda k: instr(lower(title), k) > 0)) > 0), lambda x: x.t)"
_STORIES_SQL = f"""
WITH s AS (SELECT 'hn-' || CAST(page_id AS VARCHAR) AS id, regexp_extract(html, '<title>([^<]*)', 1) AS title,
                  url, CAST(page_id % 1000 AS INTEGER) AS score, page_id AS time FROM pages)
SELECT *, {_TAGS} AS tag_list FROM s WHERE title IS NOT NULL AND title <> ''"""


@query("stories", f"SELECT * EXCLUDE (tag_list), array_to_string(tag_list, ',') AS tags FROM ({_STORIES_SQL}) x")
def stories(spark, sf):
    """I13 + E7: story records -> articles with topic tags."""
    return _stories(spark, sf).withColumn("tags", F.array_join("tags", ","))


@query("articles_to_catalog", f"""
SELECT id, title,
       array_to_string(CASE WHEN len(tag_list) > 0 THEN tag_list[1:3] ELSE ['tech'] END, ',') AS genres,
       array_to_string(tag_list, ',') AS tags, 2024 AS year,
       round(least(greatest(log10(score + 1) / log10(1001.0) * 9 + 1, 1.0), 10.0), 1) AS rating
FROM ({_STORIES_SQL}) x""")
def articles_to_catalog(spark, sf):
    """I14 + E8: articles -> catalog items (genres, rating from score)."""
    c = RC.articles_to_catalog(_stories(spark, sf), 2024)
    return c.withColumn("genres", F.array_join("genres", ",")).withColumn("tags", F.array_join("tags", ","))
