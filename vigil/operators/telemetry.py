"""Dashboard telemetry maths: counter rates, ratios, histogram quantiles and
the canary gate (A16-A20, A23, E19).

Counters are long-form samples ``(labels..., ts, total)``; histograms are
cumulative bucket counts ``(labels..., le, cnt)`` with ``le = 1e9``
standing for ``+Inf``.

Difference to the metrics server: a rate is the reset-aware increase of the
samples that fall in a window divided by the window length; the increase of
a sample is measured against the previous sample of the series (wherever
it lies), and there is no extrapolation to the window borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.metrics import span_seconds
from vigil.operators.ordered import sliced_lag

INF_BUCKET = 1.0e9

# --- fixed values (must equal the reference's rules) ---------------------
# canary analysis: 5 m rate window, evaluated every 30 s, failureLimit 3;
# error% < 1, p95 < 0.2 s, p99 < 0.5 s, success% > 99
CANARY = {"window": "5 minutes", "step_s": 30, "failure_limit": 3,
          "error_pct_max": 1.0, "p95_ms_max": 200.0, "p99_ms_max": 500.0,
          "success_pct_min": 99.0}
LATENCY_BUCKETS_MS = [10.0, 50.0, 100.0, 200.0, 500.0, INF_BUCKET]
# --------------------------------------------------------------------------


def counter_increase(series: DataFrame, labels: list[str], ts: str = "ts", total: str = "total",
                     tie: str | None = None) -> DataFrame:
    """Per-sample reset-aware increase: ``total - prev`` or ``total`` after a
    reset (``total < prev``); 0 for the first sample of a series."""
    order = [ts] + ([tie] if tie else [])
    d = sliced_lag(series, labels, order, [total], prefix="_prev_")
    prev = F.col("_prev_" + total)
    inc = (F.when(prev.isNull(), F.lit(0)).when(F.col(total) >= prev, F.col(total) - prev)
           .otherwise(F.col(total)))
    return d.withColumn("increase", inc).drop("_prev_" + total)


def counter_rate(series: DataFrame, labels: list[str], width: str = "5 minutes", ts: str = "ts",
                 total: str = "total", tie: str | None = None) -> DataFrame:
    """Per-second rate per label set per tumbling window."""
    secs = span_seconds(width)
    d = counter_increase(series, labels, ts, total, tie)
    return (d.groupBy(*labels, F.window(F.col(ts).cast("timestamp"), width).alias("w"))
            .agg((F.sum("increase") / F.lit(secs)).alias("rate"))
            .select(*labels, F.col("w.start").alias("window_start"), "rate"))


def rate_by(rates: DataFrame, by: list[str]) -> DataFrame:
    """Σ rate grouped by ``by`` (e.g. status) per window."""
    return rates.groupBy(*by, "window_start").agg(F.sum("rate").alias("rate"))


def error_ratio_pct(rates: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Σ rate(status 5xx) / Σ rate × 100, null when there is no traffic."""
    s = F.col(status).cast("int")
    return rates.groupBy(*by, "window_start").agg(
        (F.try_divide(F.sum(F.when(s.between(500, 599), F.col("rate")).otherwise(0.0)),
                      F.sum("rate")) * 100).alias("error_pct"))


def ratio_of_rates(num: DataFrame, den: DataFrame, keys: list[str], out: str) -> DataFrame:
    """rate(sum) / rate(count) per key and window (e.g. mean pause or
    mean latency)."""
    n = num.withColumnRenamed("rate", "_num")
    d = den.withColumnRenamed("rate", "_den")
    return (n.join(d, on=keys + ["window_start"], how="inner")
            .select(*keys, "window_start", F.try_divide(F.col("_num"), F.col("_den")).alias(out)))


def histogram_quantile(buckets: DataFrame, keys: list[str], qs: list[float],
                       le: str = "le", cnt: str = "cnt") -> DataFrame:
    """Quantile from cumulative buckets with linear interpolation inside
    the bucket (the metrics server's rule): rank = q x count(+Inf); first
    finite bucket with count >= rank; the +Inf bucket returns the highest
    finite bound; the first bucket interpolates from 0.

    The bucket table is an aggregate (series x buckets), so the per-series
    window here is small by construction.
    """
    w = Window.partitionBy(*keys).orderBy(le)
    d = (buckets.withColumn("_prev_le", F.lag(le).over(w))
         .withColumn("_prev_cnt", F.lag(cnt).over(w))
         .withColumn("_total", F.max(F.when(F.col(le) >= INF_BUCKET, F.col(cnt))).over(Window.partitionBy(*keys)))
         .withColumn("_max_finite", F.max(F.when(F.col(le) < INF_BUCKET, F.col(le))).over(Window.partitionBy(*keys))))
    qarr = F.array(*[F.lit(float(q)) for q in qs])
    d = d.withColumn("q", F.explode(qarr)).withColumn("_rank", F.col("q") * F.col("_total"))
    hit = (F.col(cnt) >= F.col("_rank")) & (F.col(le) < INF_BUCKET)
    picked = d.groupBy(*keys, "q").agg(
        F.min_by(F.struct(F.col(le).alias("le"), F.col(cnt).cast("double").alias("cnt"),
                          F.col("_prev_le").alias("prev_le"),
                          F.col("_prev_cnt").cast("double").alias("prev_cnt")),
                 F.when(hit, F.col(le))).alias("b"),
        F.first("_rank").alias("_rank"), F.first("_max_finite").alias("_max_finite"),
        F.first("_total").alias("_total"))
    start = F.coalesce(F.col("b.prev_le"), F.lit(0.0))
    below = F.coalesce(F.col("b.prev_cnt"), F.lit(0.0))
    interp = start + (F.col("b.le") - start) * F.try_divide(F.col("_rank") - below, F.col("b.cnt") - below)
    val = (F.when(F.col("_total").isNull() | (F.col("_total") == 0), F.lit(None).cast("double"))
           .when(F.col("b").isNull(), F.col("_max_finite"))
           .when(F.col("b.prev_le").isNull() & (F.col("b.le") <= 0), F.col("b.le"))
           .otherwise(interp))
    return picked.select(*keys, "q", val.alias("value"))


def bucket_counts(requests: DataFrame, keys: list[str], latency: str = "latency_ms",
                  bounds: list[float] = LATENCY_BUCKETS_MS) -> DataFrame:
    """Cumulative latency buckets per key (one pass, conditional counts)."""
    aggs = [F.count_if(F.col(latency) <= F.lit(b)).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = requests.groupBy(*keys).agg(*aggs)
    arr = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cnt"))
                    for i, b in enumerate(bounds)])
    return wide.select(*keys, F.inline(arr))


def canary_gate(requests: DataFrame, keys: list[str], ts: str = "ts", latency: str = "latency_ms",
                status: str = "status", cfg: dict | None = None) -> DataFrame:
    """Every 30 s step a measurement over the trailing 5 minutes:
    error% < 1, p95 < 200 ms, p99 < 500 ms, success% > 99 (5xx is an error).
    The analysis fails when more than ``failure_limit`` measurements fail.

    Requests are first reduced to (key, 30 s step) partial counts with the
    latency buckets; the 5-minute window slides over that compact series
    (``rangeBetween``) instead of copying every request into ten windows.
    Returns one row per (key, step) with the measurement and the running
    analysis verdict.
    """
    c = dict(CANARY, **(cfg or {}))
    step = int(c["step_s"])
    nsteps = int(span_seconds(c["window"]) // step)
    s = F.col(status).cast("int")
    d = requests.withColumn("step", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(step * 1_000_000)))
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(s.between(500, 599)).alias("n5xx")]
    aggs += [F.count_if(F.col(latency) <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(LATENCY_BUCKETS_MS)]
    per_step = d.groupBy(*keys, "step").agg(*aggs)
    w = Window.partitionBy(*keys).orderBy("step").rangeBetween(-(nsteps - 1), 0)
    cols = ["n", "n5xx"] + [f"b{i}" for i in range(len(LATENCY_BUCKETS_MS))]
    win = per_step.select(*keys, "step", *[F.sum(x).over(w).alias(x) for x in cols])
    hist = win.select(*keys, "step", F.inline(F.array(*[
        F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cnt"))
        for i, b in enumerate(LATENCY_BUCKETS_MS)])))
    q = histogram_quantile(hist, keys + ["step"], [0.95, 0.99])
    qw = q.groupBy(*keys, "step").agg(
        F.max(F.when(F.col("q") == 0.95, F.col("value"))).alias("p95_ms"),
        F.max(F.when(F.col("q") == 0.99, F.col("value"))).alias("p99_ms"))
    m = win.join(qw, on=keys + ["step"], how="left")
    m = (m.withColumn("error_pct", F.try_divide(F.col("n5xx"), F.col("n")) * 100)
         .withColumn("success_pct", F.try_divide(F.col("n") - F.col("n5xx"), F.col("n")) * 100))
    ok = (F.coalesce(F.col("error_pct") < c["error_pct_max"], F.lit(False))
          & F.coalesce(F.col("p95_ms") < c["p95_ms_max"], F.lit(False))
          & F.coalesce(F.col("p99_ms") < c["p99_ms_max"], F.lit(False))
          & F.coalesce(F.col("success_pct") > c["success_pct_min"], F.lit(False)))
    m = m.withColumn("measurement_ok", ok)
    run = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("failures_so_far", F.sum((~F.col("measurement_ok")).cast("int")).over(run))
    m = m.withColumn("analysis_failed", F.col("failures_so_far") > c["failure_limit"])
    return m.select(*keys, (F.col("step") * step).cast("long").alias("step_epoch_s"),
                    F.col("n").alias("requests"), "error_pct", "success_pct", "p95_ms", "p99_ms",
                    "measurement_ok", "failures_so_far", "analysis_failed")


def gauge_ratio(num: Column, den: Column, factor: float = 100.0) -> Column:
    """E19 helper re-exported for dashboards (cpu x 100, free/total x 100)."""
    return F.try_divide(num, den) * F.lit(factor)
