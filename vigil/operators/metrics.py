"""Metric snapshots: time-range scans, summaries, deltas, rolling points,
gauges and the CSV export layout (F1, A1, A22, W1, W2, W3, S16, S17).

Two shapes are accepted:

* native snapshots ``(timestamp ms, projectName, containers[], http{})``
  as stored by the reference (``snapshots_to_samples`` flattens them), and
* long-form samples ``(ts, project, container, cpu_pct, mem_pct,
  total_requests, ...)`` which every operator here consumes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.ordered import sliced_lag, top_n

# --- fixed values (must equal the reference's rules) ---------------------
# CSV export header (one row per container; HTTP columns repeated)
CSV_COLUMNS = ["timestamp", "datetime", "projectName", "containerName", "cpuPercent",
               "memoryPercent", "memoryUsage", "memoryLimit", "networkRx", "networkTx",
               "httpTotalRequests", "httpAvgResponseTime", "httpP50", "httpP95", "httpP99",
               "httpErrorRate", "http2xx", "http4xx", "http5xx"]
# dashboard time windows: span -> number of points shown
DASHBOARD_WINDOWS = {"1m": ("1 minute", 60), "5m": ("5 minutes", 60), "15m": ("15 minutes", 90),
                     "1h": ("1 hour", 120), "24h": ("24 hours", 144)}
EXPORT_ROW_CAP = 100000
# --------------------------------------------------------------------------


def snapshots_to_samples(snaps: DataFrame) -> DataFrame:
    """Flatten native snapshots into one row per (snapshot, container)."""
    d = snaps.withColumn("ts", F.timestamp_millis(F.col("timestamp")))
    d = d.select("timestamp", "ts", F.col("projectName").alias("project"), "http",
                 F.explode_outer("containers").alias("c"))
    return d.select(
        "timestamp", "ts", "project",
        F.col("c.name").alias("container"), F.col("c.cpuPercent").alias("cpu_pct"),
        F.col("c.memoryPercent").alias("mem_pct"), F.col("c.memoryUsage").alias("mem_usage"),
        F.col("c.memoryLimit").alias("mem_limit"), F.col("c.networkRx").alias("net_rx"),
        F.col("c.networkTx").alias("net_tx"),
        F.col("http.totalRequests").alias("total_requests"),
        F.col("http.avgResponseTime").alias("avg_response_ms"),
        F.col("http.p50Latency").alias("p50_ms"), F.col("http.p95Latency").alias("p95_ms"),
        F.col("http.p99Latency").alias("p99_ms"), F.col("http.errorRate").alias("error_rate_pct"))


def metrics_between(samples: DataFrame, start=None, end=None, limit: int = 1000,
                    keys: list[str] | None = None, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """inclusive time range, the most recent ``limit`` rows per key,
    returned in ascending time (the reference's Q2 quirk is not kept)."""
    d = samples
    if start is not None:
        d = d.filter(F.col(ts) >= F.lit(start).cast(d.schema[ts].dataType))
    if end is not None:
        d = d.filter(F.col(ts) <= F.lit(end).cast(d.schema[ts].dataType))
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie else [])
    d = top_n(d, keys or [], order, limit, salt_col=tie)
    return d.orderBy(ts, *([tie] if tie else []))


def metrics_summary(samples: DataFrame, keys: list[str] = ["project"],
                    ts: str = "ts", order_tie: str | None = None) -> DataFrame:
    """A1: per project data points, first/last time, per container avg/max
    cpu and memory, and the HTTP total requests of the **last** snapshot.

    One shuffle of the sample table (partial + final aggregate at
    ``(project, container)``); the project roll-up runs on that small
    aggregate only.
    """
    order = F.struct(F.col(ts), *( [F.col(order_tie)] if order_tie else []))
    per_c = samples.groupBy(*keys, "container").agg(
        F.count(F.lit(1)).alias("container_points"),
        F.avg("cpu_pct").alias("avg_cpu_pct"), F.max("cpu_pct").alias("max_cpu_pct"),
        F.avg("mem_pct").alias("avg_mem_pct"), F.max("mem_pct").alias("max_mem_pct"),
        F.min(ts).alias("_first"), F.max(ts).alias("_last"),
        F.max_by(F.struct(order.alias("o"), F.col("total_requests").alias("v")), order).alias("_lastreq"))
    w = Window.partitionBy(*keys)
    return (per_c
            .withColumn("data_points", F.sum("container_points").over(w))
            .withColumn("first_ts", F.min("_first").over(w))
            .withColumn("last_ts", F.max("_last").over(w))
            .withColumn("total_requests_last", F.max("_lastreq").over(w)["v"])
            .drop("_first", "_last", "_lastreq"))


def request_delta(samples: DataFrame, keys: list[str] = ["project"], ts: str = "ts",
                  tie: str = "sample_id", total: str = "total_requests") -> DataFrame:
    """Requests since the previous snapshot of the same series, clamped at
    0 and 0 without a (non-zero) previous value; ``per_second`` divides by the
    real time gap (the reference shows the raw delta, quirk Q13)."""
    d = sliced_lag(samples, keys, [ts, tie], [total, ts], prefix="_prev_")
    prev = F.col("_prev_" + total)
    delta = F.when(prev.isNull() | (prev == 0), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col(total) - prev))
    gap = (F.unix_micros(F.col(ts).cast("timestamp"))
           - F.unix_micros(F.col("_prev_" + ts).cast("timestamp"))) / 1e6
    return (d.withColumn("request_delta", delta)
            .withColumn("per_second", F.when(gap > 0, F.col("request_delta") / gap))
            .drop("_prev_" + total, "_prev_" + ts))


def rolling_points(samples: DataFrame, keys: list[str], n: int, ts: str = "ts",
                   tie: str | None = None) -> DataFrame:
    """The last ``n`` points per series (exact, salted top-n)."""
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie else [])
    return top_n(samples, keys, order, n, salt_col=tie)


def downsample(samples: DataFrame, keys: list[str], span: str, points: int,
               value_cols: list[str], ts: str = "ts", now=None) -> DataFrame:
    """Average per bucket of ``span / points`` over the last ``span``
    before ``now`` (default: latest sample per key)."""
    t = F.col(ts).cast("timestamp")
    d = samples.withColumn("_t", t)
    if now is None:
        # latest sample per key as a grouped aggregate (partial max per task),
        # not a window over the raw samples
        latest = d.groupBy(*keys).agg(F.max("_t").alias("_now"))
        if keys:
            d = d.join(latest, keys)
        else:   # one-row table on a constant key
            d = d.withColumn("_k", F.lit(1)).join(F.broadcast(latest.withColumn("_k", F.lit(1))), "_k").drop("_k")
    else:
        d = d.withColumn("_now", F.lit(now).cast("timestamp"))
    span_us = F.expr(f"INTERVAL {span}")
    d = d.filter(F.col("_t") > F.col("_now") - span_us)
    width = f"{span_seconds(span) / points:g} seconds"
    return (d.groupBy(*keys, F.window("_t", width).alias("bucket"))
            .agg(*[F.avg(c).alias(c) for c in value_cols], F.count(F.lit(1)).alias("samples")))


def gauge_series(samples: DataFrame, keys: list[str], value: str, width: str = "5 minutes",
                 ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The last value of a gauge per key per tumbling window."""
    order = F.struct(F.col(ts), *([F.col(tie)] if tie else []))
    return (samples.groupBy(*keys, F.window(F.col(ts).cast("timestamp"), width).alias("w"))
            .agg(F.max_by(F.col(value), order).alias(value), F.max(ts).alias("sample_ts"))
            .select(*keys, F.col("w.start").alias("window_start"), value, "sample_ts"))


_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def span_seconds(span: str) -> float:
    """'24 hours' -> 86400.0"""
    n, unit = span.split()
    return float(n) * _UNIT_SECONDS[unit.rstrip("s")]


def _fixed(c: Column, digits: int) -> Column:
    # format_string renders null as the text "null": keep nulls null
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c))


def export_rows(snaps: DataFrame) -> DataFrame:
    """The 19-column CSV layout as string columns: one row per container,
    HTTP columns repeated; a snapshot without containers but with HTTP gives
    one row; cpu/memory/latency with 2 decimals, error rate 4; missing ->
    empty (0 stays 0, quirk Q7)."""
    d = snaps.select("timestamp", "projectName", "http",
                     F.explode_outer("containers").alias("c"))
    d = d.filter(F.col("c").isNotNull() | F.col("http").isNotNull())
    e = F.lit("")

    def s(c: Column) -> Column:
        return F.coalesce(c.cast("string"), e)

    h = F.col("http")
    return d.select(
        F.col("timestamp").cast("string").alias("timestamp"),
        F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("datetime"),
        F.col("projectName"),
        s(F.col("c.name")).alias("containerName"),
        F.coalesce(_fixed(F.col("c.cpuPercent"), 2), e).alias("cpuPercent"),
        F.coalesce(_fixed(F.col("c.memoryPercent"), 2), e).alias("memoryPercent"),
        s(F.col("c.memoryUsage").cast("long")).alias("memoryUsage"),
        s(F.col("c.memoryLimit").cast("long")).alias("memoryLimit"),
        s(F.col("c.networkRx").cast("long")).alias("networkRx"),
        s(F.col("c.networkTx").cast("long")).alias("networkTx"),
        s(h["totalRequests"].cast("long")).alias("httpTotalRequests"),
        F.coalesce(_fixed(h["avgResponseTime"], 2), e).alias("httpAvgResponseTime"),
        F.coalesce(_fixed(h["p50Latency"], 2), e).alias("httpP50"),
        F.coalesce(_fixed(h["p95Latency"], 2), e).alias("httpP95"),
        F.coalesce(_fixed(h["p99Latency"], 2), e).alias("httpP99"),
        F.coalesce(_fixed(h["errorRate"], 4), e).alias("httpErrorRate"),
        s(h["status2xx"].cast("long")).alias("http2xx"),
        s(h["status4xx"].cast("long")).alias("http4xx"),
        s(h["status5xx"].cast("long")).alias("http5xx"),
    )


def export_csv(snaps: DataFrame, path: str, start=None, end=None) -> None:
    """S17 sink: header + rows, written by the executors (no driver pass)."""
    d = snaps
    if start is not None:
        d = d.filter(F.col("timestamp") >= start)
    if end is not None:
        d = d.filter(F.col("timestamp") <= end)
    export_rows(d).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def export_json(snaps: DataFrame, path: str) -> None:
    """JSON lines."""
    snaps.write.mode("overwrite").json(path)


def samples_as_snapshots(samples: DataFrame) -> DataFrame:
    """Long-form samples -> native snapshot records (one container each)."""
    return samples.select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.col("project").alias("projectName"),
        F.array(F.struct(
            F.col("container").alias("name"), F.col("cpu_pct").alias("cpuPercent"),
            F.col("mem_pct").alias("memoryPercent"), F.lit(None).cast("double").alias("memoryUsage"),
            F.lit(None).cast("double").alias("memoryLimit"), F.lit(None).cast("double").alias("networkRx"),
            F.lit(None).cast("double").alias("networkTx"))).alias("containers"),
        F.struct(F.col("total_requests").cast("double").alias("totalRequests"),
                 F.lit(None).cast("double").alias("avgResponseTime"),
                 F.lit(None).cast("double").alias("p50Latency"),
                 F.lit(None).cast("double").alias("p95Latency"),
                 F.lit(None).cast("double").alias("p99Latency"),
                 F.lit(None).cast("double").alias("errorRate"),
                 F.lit(None).cast("double").alias("status2xx"),
                 F.lit(None).cast("double").alias("status4xx"),
                 F.lit(None).cast("double").alias("status5xx")).alias("http"))
