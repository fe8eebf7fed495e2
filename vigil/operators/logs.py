"""Log analytics: levels, search, statistics, volume, retention and error
signatures (E1-E3, F2, F3, F5, A2, A21, S18, S19, P6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.text import (detect_level, is_connection_error_line, is_error_line,
                                  is_oom_line)
from vigil.operators.ordered import top_n

# --- fixed values (must equal the reference's rules) ---------------------
LOG_SEARCH_LIMIT = 500
LOG_STORE_LIMIT = 200
LOG_RETENTION_DAYS = 7
LOG_MAX_CHUNKS = 10
EVENT_TTL_DAYS = 90
# error-signature templates (specification): host:port, pod ids, class:line
SIGNATURE_RULES = [
    (r"[A-Za-z0-9_.-]+:\d{2,5}\b", "{host}:{port}"),
    (r"\b([a-z][a-z0-9]*(?:-[a-z0-9]+)*)-[a-z0-9]{5,10}(?:-[a-z0-9]{5})?\b", "{service}-{pod_id}"),
    (r"\b[A-Z][A-Za-z0-9]*\.(?:java|kt|py|ts|js):\d+", "{class}:{line}"),
]
# --------------------------------------------------------------------------


def with_level(logs: DataFrame, message: str = "message", level: str = "level") -> DataFrame:
    """Fill a missing level from the message text; stored levels are
    compared case-insensitively (quirk Q4)."""
    lv = F.lower(F.col(level)) if level in logs.columns else F.lit(None).cast("string")
    return logs.withColumn(level, F.coalesce(lv, detect_level(message)))


def with_line_flags(logs: DataFrame, message: str = "message") -> DataFrame:
    """E2/E3."""
    return (logs.withColumn("is_error", is_error_line(message))
            .withColumn("is_oom", is_oom_line(message))
            .withColumn("is_connection_error", is_connection_error_line(message)))


def search_logs(logs: DataFrame, start=None, end=None, service: str | None = None,
                level: str | None = None, text: str | None = None,
                limit: int = LOG_SEARCH_LIMIT, keys: list[str] | None = None,
                ts: str = "ts", tie: str | None = None, case_sensitive: bool = False) -> DataFrame:
    """F2 (case-insensitive) / F3 (case-sensitive): filters pushed to the
    scan, then the most recent ``limit`` rows (per key when given), returned
    in ascending time."""
    d = logs
    if start is not None:
        d = d.filter(F.col(ts) >= F.lit(start).cast(d.schema[ts].dataType))
    if end is not None:
        d = d.filter(F.col(ts) <= F.lit(end).cast(d.schema[ts].dataType))
    if service is not None:
        d = d.filter(F.col("service") == service)
    if level is not None:
        d = with_level(d).filter(F.col("level") == level.lower())
    if text:
        d = d.filter(F.col("message").contains(text) if case_sensitive
                     else F.lower(F.col("message")).contains(text.lower()))
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie else [])
    d = top_n(d, keys or [], order, limit, salt_col=tie)
    return d.orderBy(ts, *([tie] if tie else []))


def service_values(logs: DataFrame, keys: list[str] = [], start=None, end=None,
                   ts: str = "ts") -> DataFrame:
    """distinct service labels (per project) in a time range."""
    d = logs
    if start is not None:
        d = d.filter(F.col(ts) >= F.lit(start).cast(d.schema[ts].dataType))
    if end is not None:
        d = d.filter(F.col(ts) <= F.lit(end).cast(d.schema[ts].dataType))
    return d.select(*keys, "service").distinct()


def log_stats(logs: DataFrame, ts: str = "ts") -> DataFrame:
    """A2: entries and oldest/newest per service, per level (missing level ->
    info) and overall, in one scan: each row is expanded to its three
    grouping keys before a single partial/final aggregate."""
    d = logs
    lvl = F.coalesce(F.lower(F.col("level")), F.lit("info")) if "level" in d.columns \
        else detect_level("message")
    d = d.select(F.col(ts).alias("_ts"), F.inline(F.array(
        F.struct(F.lit("service").alias("dimension"), F.col("service").alias("key")),
        F.struct(F.lit("level").alias("dimension"), lvl.alias("key")),
        F.struct(F.lit("all").alias("dimension"), F.lit("*").alias("key")))))
    return d.groupBy("dimension", "key").agg(
        F.count(F.lit(1)).alias("entries"), F.min("_ts").alias("oldest"), F.max("_ts").alias("newest"))


def log_volume(logs: DataFrame, keys: list[str] = ["service"], width: str = "1 minute",
               ts: str = "ts") -> DataFrame:
    """count_over_time per key per tumbling window."""
    return (logs.groupBy(*keys, F.window(F.col(ts).cast("timestamp"), width).alias("w"))
            .agg(F.count(F.lit(1)).alias("lines"))
            .select(*keys, F.col("w.start").alias("window_start"), "lines"))


def apply_retention(df: DataFrame, now, days: int = LOG_RETENTION_DAYS,
                    max_chunks: int | None = LOG_MAX_CHUNKS, chunk: str | None = None,
                    ts: str = "ts") -> DataFrame:
    """Keep rows newer than ``now - days``; with ``chunk`` keep only the
    ``max_chunks`` newest chunks (e.g. rotated files or ``dt`` partitions).
    On a ``dt``-partitioned table the time predicate prunes partitions."""
    t = F.col(ts).cast("timestamp")
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    d = df.filter(t >= cutoff)
    if chunk and max_chunks:
        newest = (d.select(chunk).distinct()
                  .withColumn("_r", F.dense_rank().over(Window.orderBy(F.col(chunk).desc())))
                  .filter(F.col("_r") <= max_chunks).select(chunk))
        # at most max_chunks keys: a bounded broadcast
        d = d.join(F.broadcast(newest), on=chunk, how="left_semi")
    return d


def ttl(df: DataFrame, now, days: int = EVENT_TTL_DAYS, ts: str = "ts") -> DataFrame:
    """Table TTL."""
    return apply_retention(df, now, days, None, None, ts)


def error_signature(message_col: str = "message"):
    """Message -> template with hosts/ports, pod ids and class:line
    replaced, then digits collapsed."""
    m = F.col(message_col)
    for pat, rep in SIGNATURE_RULES:
        m = F.regexp_replace(m, pat, rep)
    return F.regexp_replace(m, r"\d+", "{n}")


def error_signatures(logs: DataFrame, keys: list[str] = [], ts: str = "ts") -> DataFrame:
    """Group error lines by signature: first/last seen and count."""
    d = logs.filter(is_error_line("message")).withColumn("signature", error_signature("message"))
    return d.groupBy(*keys, "signature").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"))
