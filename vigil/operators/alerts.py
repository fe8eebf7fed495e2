"""Threshold alerting: rule evaluation (J1), the trigger / resolve / cooldown
state machine as a batch job (T1 batch twin, W10) and silences (P10).

State machine per (project, threshold, container), samples in time order,
cooldown C = 60 s:

* condition true, no active alert, and the last trigger of the key is at
  least C old -> **trigger** (new active alert);
* condition false and an alert is active -> **resolve**;
* a missing sample leaves the state unchanged.

The cooldown makes this a recurrence, but it has synchronisation points: a
true run that starts at least C after the key's previous true sample always
triggers (every earlier trigger is at least C old and nothing is active).
The batch job therefore (1) marks run starts, resolve candidates and sync
points with sliced window passes, (2) keeps only rows that can change the
state (run starts, the first false after a run, true rows inside the first
C of a run and the first true row after it), and (3) folds each
``(key, segment between sync points)`` independently: segments are hash-
partitioned, sorted within partitions and folded by one ``mapInPandas``
stream per partition.
No key's history goes to one task; a segment only grows when a key flaps
with gaps shorter than C, and then only its state-changing rows are kept.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.scalar import threshold_op
from vigil.operators.ordered import SLICE, add_slices, sliced_last_value, sliced_prev
from vigil.session import cut_lineage

COOLDOWN_MS = 60000

# --- fixed values (must equal the reference's rules) ---------------------
# default thresholds: id, name, metric, operator, value, severity (all enabled)
DEFAULT_THRESHOLDS = [
    ("cpu-high", "High CPU Usage", "cpu", ">", 80.0, "warning"),
    ("cpu-critical", "Critical CPU Usage", "cpu", ">", 95.0, "critical"),
    ("memory-high", "High Memory Usage", "memory", ">", 80.0, "warning"),
    ("memory-critical", "Critical Memory Usage", "memory", ">", 95.0, "critical"),
    ("error-rate-warning", "Elevated Error Rate", "errorRate", ">", 1.0, "warning"),
    ("error-rate-critical", "High Error Rate", "errorRate", ">", 5.0, "critical"),
    ("p95-latency-warning", "High p95 Latency", "p95Latency", ">", 500.0, "warning"),
    ("p99-latency-warning", "High p99 Latency", "p99Latency", ">", 1000.0, "warning"),
]
# --------------------------------------------------------------------------

THRESHOLD_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("metric", T.StringType()), T.StructField("operator", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("container", T.StringType()),
    T.StructField("enabled", T.BooleanType()), T.StructField("severity", T.StringType()),
])

MAX_BROADCAST_RULES = 100_000
PER_CONTAINER = ("cpu", "memory")


def default_thresholds(spark: SparkSession) -> DataFrame:
    rows = [(i, n, m, o, v, None, True, s) for i, n, m, o, v, s in DEFAULT_THRESHOLDS]
    return spark.createDataFrame(rows, THRESHOLD_SCHEMA)


def samples_long(samples: DataFrame, keys: list[str] = ["project"], ts: str = "ts",
                 tie: str = "sample_id") -> DataFrame:
    """Wide samples -> one row per (sample, metric).  cpu / memory are per
    container; errorRate / p95Latency / p99Latency are per snapshot (container
    null) and only present when the sample carries them."""
    parts = [F.struct(F.lit("cpu").alias("metric"), F.col("container").alias("container"),
                      F.col("cpu_pct").cast("double").alias("value")),
             F.struct(F.lit("memory").alias("metric"), F.col("container").alias("container"),
                      F.col("mem_pct").cast("double").alias("value"))]
    for metric, col in (("errorRate", "error_rate_pct"), ("p95Latency", "p95_ms"),
                        ("p99Latency", "p99_ms")):
        if col in samples.columns:
            parts.append(F.struct(F.lit(metric).alias("metric"),
                                  F.lit(None).cast("string").alias("container"),
                                  F.col(col).cast("double").alias("value")))
    d = samples.select(*keys, ts, tie, F.inline(F.array(*parts)))
    return d.filter(F.col("value").isNotNull())   # missing HTTP value -> no evaluation


def evaluate_thresholds(long_samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Enabled rules x samples on metric; a rule with a container only
    applies to that container (cpu / memory).  The rule table is broadcast
    after a size check (it is configuration, but the check keeps the bound
    explicit)."""
    r = rules.filter(F.col("enabled")).select(
        F.col("id").alias("threshold_id"), F.col("name").alias("threshold_name"),
        F.col("metric").alias("_rm"), F.col("operator"), F.col("value").alias("threshold"),
        F.col("container").alias("_rc"), "severity")
    n = r.count()
    rb = F.broadcast(r) if n <= MAX_BROADCAST_RULES else r
    cond = (F.col("metric") == F.col("_rm")) & (
        F.col("_rc").isNull() | ~F.col("metric").isin(*PER_CONTAINER) | (F.col("_rc") == F.col("container")))
    d = long_samples.join(rb, cond, "inner").drop("_rm", "_rc")
    return d.withColumn("breached", threshold_op("operator", "value", "threshold"))


_EVENT_SCHEMA = T.StructType([
    T.StructField("threshold_id", T.StringType()), T.StructField("container", T.StringType()),
    T.StructField("triggered_ms", T.LongType()), T.StructField("resolved_ms", T.LongType()),
    T.StructField("value", T.DoubleType()),
])


def _fold_stream(keys: list[str], cooldown_ms: int):
    """Fold sorted rows of many segments in one pass; state resets when the
    (key, segment) changes and carries across Arrow batches."""
    gcols = [*keys, "threshold_id", "_ckey", "_c_sync_ms"]
    out_cols = [*keys, "threshold_id", "container", "triggered_ms", "resolved_ms", "value"]

    def run(batches):
        cur = None
        active = None       # [*keys, threshold_id, container, trig_ms, resolved_ms, value]
        last = None
        for pdf in batches:
            out = []
            g = list(zip(*[pdf[c].to_numpy() for c in gcols]))
            ms_a, c_a, v_a = pdf["_ms"].to_numpy(), pdf["breached"].to_numpy(), pdf["value"].to_numpy()
            cont_a = pdf["container"].to_numpy()
            for i in range(len(pdf)):
                if g[i] != cur:
                    if active is not None:
                        out.append(active)
                    cur, active, last = g[i], None, None
                ms = int(ms_a[i])
                if c_a[i]:
                    if active is None and (last is None or ms - last >= cooldown_ms):
                        active = [*g[i][:len(keys) + 1], cont_a[i], ms, None, float(v_a[i])]
                        last = ms
                elif active is not None:
                    active[len(keys) + 3] = ms
                    out.append(active)
                    active = None
            yield pd.DataFrame(out, columns=out_cols)
        if active is not None:
            yield pd.DataFrame([active], columns=out_cols)
    return run


def alert_history(evals: DataFrame, keys: list[str] = ["project"], ts: str = "ts",
                  tie: str = "sample_id", cooldown_ms: int = COOLDOWN_MS) -> DataFrame:
    """T1 (batch): every alert with its trigger time, resolve time (null while
    still active at the end of the input) and triggering value."""
    k = keys + ["threshold_id", "_ckey"]
    d = (evals.withColumn("_ms", F.unix_millis(F.col(ts).cast("timestamp")))
         .withColumn("_tie", F.col(tie))
         .withColumn("_ckey", F.coalesce(F.col("container"), F.lit("")))
         .select(*keys, "threshold_id", "container", "_ckey", "_ms", "_tie", "breached", "value"))
    order = ["_ms", "_tie"]
    d = add_slices(cut_lineage(d), "_ms")     # one quantile job shared by both passes
    d = d.withColumn("_true_ms", F.when(F.col("breached"), F.col("_ms")))
    # pass 1: previous row (breached, time) and the last true sample before the row
    d = sliced_prev(d, k, order, ["breached", "_ms"], ["_true_ms"], prefix="_p")
    # a row that is false after a false one neither starts, ends nor carries anything
    d = d.filter(F.col("breached") | F.coalesce(F.col("_pbreached"), F.lit(False)))
    d = cut_lineage(d.withColumnRenamed("_p_true_ms", "_p_last_true_ms"))
    run_start = F.col("breached") & ~F.coalesce(F.col("_pbreached"), F.lit(False))
    sync = run_start & (F.col("_p_last_true_ms").isNull()
                        | (F.col("_ms") - F.col("_p_last_true_ms") >= cooldown_ms))
    d = (d.withColumn("_run_start_ms", F.when(run_start, F.col("_ms")))
         .withColumn("_sync_ms", F.when(sync, F.col("_ms"))))
    d = sliced_last_value(d, k, order, ["_run_start_ms", "_sync_ms"], prefix="_c")       # pass 2
    rs = F.col("_c_run_start_ms")
    resolve_cand = ~F.col("breached") & F.coalesce(F.col("_pbreached"), F.lit(False))
    in_window = F.col("breached") & (F.col("_ms") < rs + cooldown_ms)
    boundary = (F.col("breached") & F.coalesce(F.col("_pbreached"), F.lit(False))
                & (F.col("_ms") >= rs + cooldown_ms) & (F.col("_p_ms") < rs + cooldown_ms))
    keep = d.filter(F.col("_c_sync_ms").isNotNull() & (run_start | resolve_cand | in_window | boundary)).drop(SLICE)
    meta = (evals.select("threshold_id", "threshold_name", "metric", "threshold", "severity")
            .dropDuplicates(["threshold_id"]))
    schema = T.StructType([*[keep.schema[c] for c in keys], *_EVENT_SCHEMA.fields])
    gcols = [*keys, "threshold_id", "_ckey", "_c_sync_ms"]
    n = int(keep.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    folded = (keep.select(*keys, "threshold_id", "container", "_ckey", "_c_sync_ms", "_ms", "_tie",
                          "breached", "value")
              .repartition(n, *gcols)
              .sortWithinPartitions(*gcols, "_ms", "_tie")
              .mapInPandas(_fold_stream(keys, cooldown_ms), schema))
    out = folded.join(F.broadcast(meta), on="threshold_id", how="left")
    return (out.withColumn("triggered_at", F.timestamp_millis("triggered_ms"))
            .withColumn("resolved_at", F.timestamp_millis("resolved_ms"))
            .withColumn("alert_id", F.concat_ws("-", "threshold_id", *keys,
                                                F.coalesce("container", F.lit("")),
                                                F.col("triggered_ms").cast("string"))))


def active_alerts(history: DataFrame) -> DataFrame:
    """Alerts still active at the end of the input."""
    return history.filter(F.col("resolved_ms").isNull())


def silence_alerts(alerts: DataFrame, silences: DataFrame, keys: list[str] = ["project"]) -> DataFrame:
    """P10: drop alerts covered by an active silence: a silence row
    ``(project, threshold_pattern, starts_at, ends_at)`` with a null
    pattern silences all thresholds; otherwise the pattern is a SQL LIKE
    pattern on the threshold id; only alerts triggered inside the silence
    window are dropped."""
    s = silences.select(*[F.col(k).alias("_s_" + k) for k in keys], "threshold_pattern",
                        "starts_at", "ends_at")
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col("_s_" + k))
    cond = cond & (F.col("threshold_pattern").isNull()
                   | F.expr("threshold_id LIKE threshold_pattern")) \
        & (F.col("triggered_at") >= F.col("starts_at")) & (F.col("triggered_at") < F.col("ends_at"))
    return alerts.join(s, cond, "left_anti")
