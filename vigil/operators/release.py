"""Release analytics: load-test summaries, gates, version comparison, deploy
before/after and regression flags (A9-A11, A24, A25, C8, J7, J12, W9, P1, P8, P9).

Input is a request table ``(ts, <group keys>, latency_ms, status)``; every
operator groups by caller-supplied keys so all services / versions are
processed in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.scalar import format_pct_change
from vigil.operators.ordered import exact_percentiles, exact_rank_values, sliced_last_value

# --- fixed values (must equal the reference's rules) ---------------------
# perf gate: p95 < 500 ms, p99 < 1000 ms, error ratio < 0.01, avg < 200 ms
PERF_GATE = {"p95_ms": 500.0, "p99_ms": 1000.0, "error_ratio": 0.01, "avg_ms": 200.0}
# release recommendation weights per compared metric
METRIC_WEIGHTS = {"p95 Latency": 3, "Error Rate": 3, "Throughput": 2,
                  "Avg Latency": 1, "p99 Latency": 1}
TIE_PCT = 5.0          # |relative diff| below 5 % is a tie
ERROR_TIE_ABS = 0.001  # error ratio difference below 0.001 is a tie
REGRESSION_RATIO = 0.2  # deploy regression: (after - before) / before > 0.2
# comparison targets and chaos SLOs from the product specification
COMPARISON_SLO = {"p95_ms": 200.0, "p99_ms": 500.0, "rps": 1000.0, "error_ratio": 0.01,
                  "cpu_pct": 80.0, "memory_bytes": 1024.0 ** 3, "resilience_pct": 80.0}
CHAOS_SLO = {"error_ratio": 0.05, "p99_ms": 2000.0, "recovery_ms": 60000.0}
# --------------------------------------------------------------------------


def _seconds(ts_hi: Column, ts_lo: Column) -> Column:
    return (F.unix_micros(ts_hi.cast("timestamp")) - F.unix_micros(ts_lo.cast("timestamp"))) / 1e6


def perf_summary(requests: DataFrame, keys: list[str], latency: str = "latency_ms",
                 status: str = "status", ts: str = "ts") -> DataFrame:
    """Count, duration, rate, failed ratio (status >= 400), avg/min/max and
    interpolated p50/p90/p95/p99 latency per key.

    Percentiles are exact order statistics computed with a sliced running
    count (``exact_percentiles``), so no service's latencies are gathered in
    one task.
    """
    failed = F.col(status) >= 400
    lat = F.col(latency)
    out = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.count_if(failed).alias("failed"),
        F.avg(lat).alias("avg_ms"), F.min(lat).alias("min_ms"), F.max(lat).alias("max_ms"))
    pct = exact_percentiles(requests, keys, latency,
                            {"p50_ms": 0.5, "p90_ms": 0.9, "p95_ms": 0.95, "p99_ms": 0.99})
    if keys:
        out = out.join(pct, keys, "left")
    else:   # one-row tables on a constant key
        out = out.withColumn("_k", F.lit(1)).join(pct.withColumn("_k", F.lit(1)), "_k").drop("_k")
    dur = _seconds(F.col("last_ts"), F.col("first_ts"))
    return (out.withColumn("duration_s", dur)
            .withColumn("rate", F.try_divide(F.col("requests").cast("double"), F.col("duration_s")))
            .withColumn("error_ratio", F.col("failed") / F.col("requests"))
            .drop("first_ts", "last_ts"))


def perf_gate(summary: DataFrame, gate: dict | None = None) -> DataFrame:
    """Every threshold must pass (strict comparisons)."""
    g = gate or PERF_GATE
    d = summary
    for k, lim in g.items():
        d = d.withColumn(f"{k}_ok", F.coalesce(F.col(k) < F.lit(lim), F.lit(False)))
    return d.withColumn("passed", F.expr(" AND ".join(f"{k}_ok" for k in g)))


def version_metrics(requests: DataFrame, keys: list[str], latency: str = "latency_ms",
                    status: str = "status", ts: str = "ts") -> DataFrame:
    """A10: per key requests, rps = count / elapsed seconds, avg = sum / count,
    error ratio (status >= 400) and p50/p95/p99 = ``sorted[floor(n*q)]``
    (exact order statistics, computed without sorting a group in one task)."""
    base = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(latency).alias("_lat_sum"),
        F.count_if(F.col(status) >= 400).alias("errors"),
        F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    ranks = exact_rank_values(requests, keys, latency, {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    d = base.join(ranks.drop("n"), on=keys, how="left")
    return (d.withColumn("duration_s", _seconds(F.col("_t1"), F.col("_t0")))
            .withColumn("rps", F.try_divide(F.col("requests").cast("double"), F.col("duration_s")))
            .withColumn("avg_ms", F.col("_lat_sum") / F.col("requests"))
            .withColumn("error_ratio", F.col("errors") / F.col("requests"))
            .drop("_lat_sum", "_t0", "_t1"))


_METRICS = [
    # name, column, higher is better
    ("p95 Latency", "p95_ms", False),
    ("Throughput", "rps", True),
    ("Error Rate", "error_ratio", False),
    ("Avg Latency", "avg_ms", False),
    ("p99 Latency", "p99_ms", False),
]


def compare_versions(metrics: DataFrame, keys: list[str], version_col: str = "version",
                     old: str = "old", new: str = "new") -> DataFrame:
    """J12 + C8: one row per (keys, metric) with old/new value, relative
    difference in percent (absolute difference for the error ratio), winner
    and the formatted change.  Old/new are paired with a conditional
    aggregate (no self-join); a zero old value gives a null difference and a
    tie (see quirk Q8)."""
    aggs = []
    for _, c, _ in _METRICS:
        aggs.append(F.max(F.when(F.col(version_col) == old, F.col(c))).alias(f"old_{c}"))
        aggs.append(F.max(F.when(F.col(version_col) == new, F.col(c))).alias(f"new_{c}"))
    wide = metrics.groupBy(*keys).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(f"old_{c}").alias("old_value"),
                 F.col(f"new_{c}").alias("new_value"), F.lit(hib).alias("_hib"))
        for name, c, hib in _METRICS])
    d = wide.select(*keys, F.inline(rows))
    is_err = F.col("metric") == "Error Rate"
    diff = F.when(is_err, F.col("new_value") - F.col("old_value")).otherwise(
        F.try_divide(F.col("new_value") - F.col("old_value"), F.col("old_value")) * 100)
    tie = F.when(is_err, F.abs(F.col("diff")) < ERROR_TIE_ABS).otherwise(F.abs(F.col("diff")) < TIE_PCT)
    better_new = F.when(F.col("_hib"), F.col("new_value") > F.col("old_value")) \
        .otherwise(F.col("new_value") < F.col("old_value"))
    d = d.withColumn("diff", diff)
    d = d.withColumn("winner", F.when(F.col("diff").isNull() | tie, "tie")
                     .when(better_new, "new").otherwise("old"))
    d = d.withColumn("improvement", F.when(is_err, format_pct_change(F.col("diff") * 100))
                     .otherwise(format_pct_change(F.col("diff"))))
    return d.drop("_hib")


def recommend_release(comparisons: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted wins -> promote / rollback / inconclusive with
    confidence = min(round(|new - old| / total * 100), 95); a tie gives 0."""
    wm = F.create_map(*[x for k, w in METRIC_WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    w = F.coalesce(wm[F.col("metric")], F.lit(1))
    d = comparisons.groupBy(*keys).agg(
        F.sum(F.when(F.col("winner") == "new", w).otherwise(0)).alias("new_weight"),
        F.sum(F.when(F.col("winner") == "old", w).otherwise(0)).alias("old_weight"),
        F.sum(w).alias("total_weight"))
    conf = F.least(F.round(F.abs(F.col("new_weight") - F.col("old_weight")) * 100.0
                           / F.col("total_weight")), F.lit(95.0)).cast("int")
    return (d.withColumn("recommendation", F.when(F.col("new_weight") > F.col("old_weight"), "promote")
                         .when(F.col("old_weight") > F.col("new_weight"), "rollback")
                         .otherwise("inconclusive"))
            .withColumn("confidence", F.when(F.col("recommendation") == "inconclusive", 0).otherwise(conf)))


def check_pass_rates(checks: DataFrame, keys: list[str], passed: str = "passed") -> DataFrame:
    """Passes / (passes + fails) per check."""
    return checks.groupBy(*keys).agg(
        F.count_if(F.col(passed)).alias("passes"),
        F.count_if(~F.col(passed)).alias("fails"),
        F.avg(F.col(passed).cast("double")).alias("pass_rate"))


def latency_series(requests: DataFrame, keys: list[str], width: str = "1 minute",
                   latency: str = "latency_ms", ts: str = "ts") -> DataFrame:
    """p95 latency per key per tumbling window, stamped at the window end
    (exact distributed percentile per (key, window))."""
    w = requests.withColumn("point_ts", F.window(F.col(ts).cast("timestamp"), width)["end"])
    return exact_percentiles(w, keys + ["point_ts"], latency, {"p95_ms": 0.95})


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
              values: list[str], backward: bool = True, tie: str | None = None) -> DataFrame:
    """For each left row the last right row at or before (``backward``)
    or the first right row at or after its time, per key.

    Of several right rows at that time the one with the largest ``tie``
    (forward: the smallest) counts; without ``tie`` the values decide.

    Union + sliced ``last(ignorenulls)`` carry; no key holds a task and no
    pair is enumerated.
    """
    lcols = left.columns
    # one row per key and time; a right row without a time never qualifies (as in `point_ts <= ts`)
    pick = F.max_by if backward else F.min_by
    by = F.col(tie) if tie else F.struct(*values)
    right = right.filter(F.col(right_ts).isNotNull()).groupBy(*keys, right_ts).agg(
        *[pick(F.col(v), F.when(F.col(v).isNotNull(), by)).alias(v) for v in values])
    l2 = left.select(*[F.col(c) for c in lcols],
                     F.col(left_ts).cast("timestamp").alias("_t"),
                     F.lit(1 if backward else 0).alias("_side"),
                     *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    r2 = right.select(*keys, F.col(right_ts).cast("timestamp").alias("_t"), F.lit(0 if backward else 1).alias("_side"),
                      *values)
    u = l2.unionByName(r2, allowMissingColumns=True)
    if backward:
        u = sliced_last_value(u, keys, ["_t", "_side"], values, prefix="_asof_")
    else:
        # next value: reverse time so "first after" becomes "last before"
        u = u.withColumn("_rt", -F.unix_micros("_t")).withColumn("_rs", -F.col("_side"))
        u = sliced_last_value(u, keys, ["_rt", "_rs"], values, prefix="_asof_")
    out = u.filter(F.col("_side") == (1 if backward else 0))
    return out.select(*lcols, *[F.col("_asof_" + v).alias(v) for v in values])


def deploy_before_after(deploys: DataFrame, series: DataFrame, keys: list[str],
                        deploy_ts: str = "ts", point_ts: str = "point_ts",
                        value: str = "p95_ms") -> DataFrame:
    """J7 + W9: p95 before = last point at/before the deploy, after = first
    point at/after it; delta = after - before; regression iff before > 0 and
    delta / before > 0.2 (strict); no before -> false."""
    b = asof_join(deploys, series.withColumnRenamed(value, "latency_before"), keys,
                  deploy_ts, point_ts, ["latency_before"], backward=True)
    a = asof_join(b, series.withColumnRenamed(value, "latency_after"), keys,
                  deploy_ts, point_ts, ["latency_after"], backward=False)
    return deploy_regression(a)


def deploy_regression(df: DataFrame, before: str = "latency_before",
                      after: str = "latency_after") -> DataFrame:
    """W9."""
    delta = F.col(after) - F.col(before)
    reg = F.coalesce((F.col(before) > 0) & (F.try_divide(delta, F.col(before)) > REGRESSION_RATIO),
                     F.lit(False))
    return df.withColumn("latency_delta", delta).withColumn("regression", reg)


def snapshot_regression(snapshots: DataFrame, keys: list[str], order: list[str],
                        thresholds: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Compare each deploy snapshot with the mean of the previous five:
    p95 +20 %, p99 +30 %, error +5 points, lag +50 % flag a regression and the
    same margins downwards an improvement.

    The baseline is the mean over ``rows between 5 preceding and 1
    preceding`` per key, computed with the sliced rolling mean so a busy
    service's deploy history is spread over slices.
    """
    th = thresholds or {"p95_ms": ("rel", 0.20), "p99_ms": ("rel", 0.30),
                        "error_pct": ("abs", 5.0), "lag": ("rel", 0.50)}
    from vigil.operators.ordered import sliced_rolling_mean
    d = snapshots
    regs, imps = [], []
    for c, (kind, m) in th.items():
        if c not in d.columns:
            continue
        d = sliced_rolling_mean(d, keys, order, c, 5, f"{c}_baseline")
        base = F.col(f"{c}_baseline")
        if kind == "rel":
            regs.append(F.col(c) > base * (1 + m))
            imps.append(F.col(c) < base * (1 - m))
        else:
            regs.append(F.col(c) > base + m)
            imps.append(F.col(c) < base - m)
    anyf = (lambda xs: F.coalesce(F.greatest(*[x.cast("int") for x in xs]) == 1, F.lit(False))
            if len(xs) > 1 else F.coalesce(xs[0], F.lit(False)))
    return d.withColumn("regression", anyf(regs)).withColumn("improvement", anyf(imps))


def slo_check(summary: DataFrame, slo: dict[str, float], at_most: bool = False) -> DataFrame:
    """Per-metric SLO predicates plus an overall flag.  Throughput and
    resilience are floors, everything else a ceiling (strict unless
    ``at_most``)."""
    floors = {"rps", "resilience_pct"}
    d = summary
    names = []
    for k, lim in slo.items():
        if k not in d.columns:
            continue
        if k in floors:
            p = F.col(k) > lim if not at_most else F.col(k) >= lim
        else:
            p = F.col(k) < lim if not at_most else F.col(k) <= lim
        d = d.withColumn(f"{k}_slo_ok", F.coalesce(p, F.lit(False)))
        names.append(f"{k}_slo_ok")
    return d.withColumn("slo_met", F.expr(" AND ".join(names)) if names else F.lit(True))
