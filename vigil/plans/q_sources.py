"""Registered queries of the file sources: the tables are written as the
records that a source reads, and read back by it."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import scalar as E
from vigil.operators import metrics as M
from vigil.plans.registry import query
from vigil.session import scratch_path
from vigil.sources import files
from vigil.sources.tables import view


@query("metric_files", """
SELECT project, container, CAST(epoch_ms(CAST(ts AS TIMESTAMP)) AS BIGINT) AS timestamp, cpu_pct, mem_pct,
       CAST(total_requests AS DOUBLE) AS total_requests FROM metric_samples""", ("metric_samples",))
def metric_files(spark, sf):
    """S1 + S15: snapshots appended as JSON lines by day, read under the explicit
    schema and flattened to samples again."""
    path = scratch_path(spark, "metric-files")
    files.append_metrics(M.samples_as_snapshots(view(spark, sf, "metric_samples")), path)
    good, _ = files.split_quarantine(files.read_jsonl(spark, path, files.METRICS_SCHEMA))
    return M.snapshots_to_samples(good).select("project", "container", "timestamp", "cpu_pct", "mem_pct", "total_requests")


@query("log_files", """
SELECT service, message, CAST(epoch_ms(CAST(ts AS TIMESTAMP)) AS BIGINT) AS ms, FALSE AS quarantined FROM logs
UNION ALL SELECT NULL, '{"service": "cut off ' || log_id, -1, TRUE FROM logs WHERE log_id % 50 = 0""", ("logs",))
def log_files(spark, sf):
    """S2 + S15: log rows appended as JSON lines, every fiftieth followed by a
    line that was cut off, which the reader quarantines."""
    logs = view(spark, sf, "logs").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "log-files")
    files.append_logs(logs.select("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
                                  "service", "message", F.lit("info").alias("level")), path)
    logs.where("log_id % 50 = 0").select(F.concat(F.lit('{"service": "cut off '), F.col("log_id").cast("string"))) \
        .write.mode("append").text(f"{path}/dt=1970-01-01")
    good, bad = files.split_quarantine(files.read_jsonl(spark, path, files.LOGS_SCHEMA))
    ms = F.unix_millis(F.try_to_timestamp("timestamp"))
    return good.select("service", "message", ms.alias("ms"), F.lit(False).alias("quarantined")).unionByName(
        bad.select(F.lit(None).cast("string").alias("service"), F.col(files.CORRUPT).alias("message"),
                   F.lit(-1).cast("long").alias("ms"), F.lit(True).alias("quarantined")))


@query("engagement_columns", "SELECT user_id, item_id, event_type, value FROM engagement", ("engagement",))
def engagement_columns(spark, sf):
    """The four training columns of the stored engagement table."""
    path = scratch_path(spark, "engagement-table")
    view(spark, sf, "engagement").write.parquet(path)
    return files.read_engagement(spark, path)


@query("scalar_maps", r"""
SELECT request_id,
  CASE WHEN code BETWEEN 100 AND 199 THEN '1xx' WHEN code BETWEEN 200 AND 299 THEN '2xx' WHEN code BETWEEN 300 AND 399 THEN '3xx'
       WHEN code BETWEEN 400 AND 499 THEN '4xx' WHEN code BETWEEN 500 AND 599 THEN '5xx' ELSE 'unknown' END AS status_class,
  regexp_replace(regexp_replace(regexp_replace(path, '/hello/[^/]+', '/hello/{name}', 'g'), '/users/[^/]+', '/users/{id}', 'g'),
                 '/\d+', '/{id}', 'g') AS uri,
  CASE WHEN latency_ms >= 70 THEN 'HIGH' WHEN latency_ms >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE WHEN status = 200 AND latency_ms < 100 THEN 'healthy' ELSE 'unhealthy' END AS health,
  CASE WHEN request_id % 3 <> 0 THEN latency_ms / (request_id % 3) * 100 END AS ratio,
  CASE WHEN request_id % 4 = 0 THEN 0 ELSE 2 END AS genres
FROM (SELECT *, CASE WHEN request_id % 10 = 0 THEN request_id % 1000 ELSE status END AS code,
             CASE request_id % 3 WHEN 0 THEN '/hello/' || service || '/x' WHEN 1 THEN '/users/' || service || '/orders/' || request_id
                                 ELSE '/orders/' || request_id END AS path FROM requests) r""", ("requests",))
def scalar_maps(spark, sf):
    """E4, E5, E14, E17, E18, E19 over all requests."""
    rid = F.col("request_id")
    code = F.when(rid % 10 == 0, rid % 1000).otherwise(F.col("status"))
    path = (F.when(rid % 3 == 0, F.concat(F.lit("/hello/"), "service", F.lit("/x")))
            .when(rid % 3 == 1, F.concat(F.lit("/users/"), "service", F.lit("/orders/"), rid.cast("string")))
            .otherwise(F.concat(F.lit("/orders/"), rid.cast("string"))))
    up = [F.when(ok, "UP").otherwise("DOWN") for ok in (F.col("status") == 200, F.col("latency_ms") < 100)]
    genres = F.when(rid % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.col("service")))
    return view(spark, sf, "requests").select(
        "request_id", E.status_class(code).alias("status_class"), E.normalize_uri(path).alias("uri"),
        E.fix_priority("latency_ms").alias("priority"),
        E.health_rollup(F.create_map(F.lit("api"), up[0], F.lit("speed"), up[1])).alias("health"),
        E.scale_ratio("latency_ms", rid % 3).alias("ratio"),
        F.size(E.genres_split(E.genres_join(genres))).alias("genres"))
