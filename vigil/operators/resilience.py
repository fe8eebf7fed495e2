"""Resilience (chaos) analytics: scores, trends, gaps, recommendations,
scorecards and per-run request summaries (A7, A8, J10, J11, W4, W5, C6, C7,
U4, P9)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.ordered import top_n
from vigil.session import cut_lineage

WINDOW_SLICE_ROWS = 100_000      # probes of a slice of the time line

# --- fixed values (must equal the reference's rules) ---------------------
SCENARIOS = ["pod-kill", "network-latency", "kafka-down", "db-latency", "memory-pressure"]
MAX_PER_SCENARIO = 25
PASS_POINTS = 15
# recovery bonus: < 5 s -> 10, < 15 s -> 7, < 30 s -> 4, otherwise 1; no recovery time -> 0
RECOVERY_BONUS = [(5000, 10), (15000, 7), (30000, 4)]
RECOVERY_BONUS_ELSE = 1
SLOW_RECOVERY_MS = 30000
FAST_RECOVERY_MS = 5000
TREND_WINDOW = 5
TREND_MARGIN = 0.05
# scenario -> (severity, category, description, recommendation) for a failed scenario
GAP_RULES = [
    ("pod-kill", "critical", "Self-healing",
     "Application does not recover from container termination",
     "Add restart policy, health checks, and graceful shutdown handlers"),
    ("network-latency", "high", "Network Resilience",
     "Application fails under network latency conditions",
     "Implement request timeouts, retries with backoff, and circuit breakers"),
    ("kafka-down", "high", "Dependency Isolation",
     "Application does not gracefully degrade when Kafka is unavailable",
     "Add circuit breaker for event publishing, implement local fallback queue"),
    ("db-latency", "high", "Database Resilience",
     "Application fails under database latency conditions",
     "Configure connection pool timeouts, add query timeouts, consider read caching"),
    ("memory-pressure", "medium", "Resource Management",
     "Application crashes under memory pressure",
     "Set JVM heap limits, implement bounded caches, add memory monitoring"),
]
SLOW_GAP = ("Recovery Speed", "medium", "Optimize startup time, add readiness probes, pre-warm connections")
# failed scenario -> recommendation texts, in order
SCENARIO_RECOMMENDATIONS = [
    ("pod-kill", "Add restart policy and health checks to ensure container auto-recovery"),
    ("pod-kill", "Consider implementing graceful shutdown handlers"),
    ("network-latency", "Add request timeouts and retry logic with exponential backoff"),
    ("network-latency", "Consider implementing circuit breakers for downstream calls"),
    ("kafka-down", "Add circuit breaker for Kafka event publishing"),
    ("kafka-down", "Implement fallback behavior when Kafka is unavailable (e.g., queue locally)"),
    ("kafka-down", "Ensure health endpoint reports degraded (not down) when Kafka is unavailable"),
    ("db-latency", "Configure connection pool timeouts to handle slow database responses"),
    ("db-latency", "Add database query timeouts to prevent thread exhaustion"),
    ("db-latency", "Consider implementing read-through caching for frequently accessed data"),
    ("memory-pressure", "Set appropriate JVM heap limits (-Xmx) relative to container limits"),
    ("memory-pressure", "Implement memory-aware caching with eviction policies"),
    ("memory-pressure", "Add memory usage monitoring and alerting"),
]
# chaos run pass rule: error ratio below 0.5 (kafka-down: 0.3) and recovered;
# a probe is ok when 200 <= status < 500
ERROR_RATIO_LIMIT = {"kafka-down": 0.3}
ERROR_RATIO_DEFAULT = 0.5
# --------------------------------------------------------------------------


def secs_1dp(ms: Column) -> Column:
    """Milliseconds -> seconds text with one decimal, rounded half up on the
    whole millisecond count (integer arithmetic, identical in every engine)."""
    tenths = F.floor((F.round(ms).cast("long") + 50) / 100).cast("long")
    return F.concat((tenths / 10).cast("long").cast("string"), F.lit("."),
                    (tenths % 10).cast("string"))


def scenario_points(passed: Column, recovery_ms: Column) -> Column:
    """A7 per result: 0 when failed, else 15 + recovery bonus."""
    bonus = F.lit(RECOVERY_BONUS_ELSE)
    for lim, pts in reversed(RECOVERY_BONUS):
        bonus = F.when(recovery_ms < lim, F.lit(pts)).otherwise(bonus)
    bonus = F.when(recovery_ms.isNull(), F.lit(0)).otherwise(bonus)
    return F.when(passed, F.lit(PASS_POINTS) + bonus).otherwise(F.lit(0))


def resilience_score(results: DataFrame, keys: list[str] = ["project"]) -> DataFrame:
    """score = Σ points, max = 25 x results, percentage = round(score /
    max x 100)."""
    d = results.groupBy(*keys).agg(
        F.sum(scenario_points(F.col("passed"), F.col("recovery_ms"))).alias("score"),
        (F.count(F.lit(1)) * MAX_PER_SCENARIO).alias("max_score"),
        F.count(F.lit(1)).alias("scenarios_run"))
    return d.withColumn("percentage", F.when(F.col("max_score") > 0, F.round(
        F.col("score") * 100.0 / F.col("max_score")).cast("int")).otherwise(0))


def score_entries(results: DataFrame, run: str = "run_id") -> DataFrame:
    """Score history entries: one per run with its score and max score."""
    return results.groupBy("project", run).agg(
        F.sum(scenario_points(F.col("passed"), F.col("recovery_ms"))).alias("score"),
        (F.count(F.lit(1)) * MAX_PER_SCENARIO).alias("max_score"))


def score_trend(entries: DataFrame, keys: list[str] = ["project"], order: str = "run_id") -> DataFrame:
    """Over the last five entries, last% - first% > 0.05 improving,
    < -0.05 declining, else stable; fewer than two entries -> new."""
    last5 = top_n(entries, keys, [F.col(order).desc()], TREND_WINDOW, salt_col=order)
    pct = F.when(F.col("max_score") > 0, F.col("score") / F.col("max_score")).otherwise(0.0)
    d = last5.withColumn("_pct", pct).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"),
        F.min_by("_pct", F.col(order)).alias("first_pct"),
        F.max_by("_pct", F.col(order)).alias("last_pct"))
    diff = F.col("last_pct") - F.col("first_pct")
    return d.withColumn("trend", F.when(F.col("entries") < 2, "new")
                        .when(diff > TREND_MARGIN, "improving")
                        .when(diff < -TREND_MARGIN, "declining").otherwise("stable"))


def latest_results(results: DataFrame, keys: list[str] = ["project"], run: str = "run_id") -> DataFrame:
    """The newest result per (project, scenario) (partial aggregate)."""
    r = results.groupBy(*keys, "scenario").agg(
        F.max_by(F.struct("passed", "recovery_ms", run), F.col(run)).alias("r"))
    return r.select(*keys, "scenario", "r.passed", "r.recovery_ms", f"r.{run}")


def _gap_table(spark: SparkSession) -> DataFrame:
    sch = "scenario string, severity string, category string, description string, recommendation string"
    return spark.createDataFrame(GAP_RULES, sch)


def untested_scenarios(latest: DataFrame, keys: list[str] = ["project"]) -> DataFrame:
    """Expected scenarios without a result (projects x 5, left-anti)."""
    expected = latest.select(*keys).distinct().select(
        *keys, F.explode(F.array(*[F.lit(s) for s in SCENARIOS])).alias("scenario"))
    return expected.join(latest.select(*keys, "scenario"), on=keys + ["scenario"], how="left_anti")


def gap_catalog(latest: DataFrame, keys: list[str] = ["project"]) -> DataFrame:
    """Failed scenarios -> catalogued gap (broadcast rule join); passed
    with recovery > 30 s -> 'Recovery Speed' gap; untested -> 'Coverage'."""
    rules = F.broadcast(_gap_table(latest.sparkSession))
    failed = (latest.filter(~F.col("passed")).join(rules, on="scenario", how="inner")
              .select(*keys, "scenario", "category", "severity", "description", "recommendation"))
    slow = (latest.filter(F.col("passed") & (F.col("recovery_ms") > SLOW_RECOVERY_MS))
            .select(*keys, "scenario", F.lit(SLOW_GAP[0]).alias("category"),
                    F.lit(SLOW_GAP[1]).alias("severity"),
                    F.concat(F.lit("Slow recovery for "), F.col("scenario"), F.lit(": "),
                             secs_1dp(F.col("recovery_ms")), F.lit("s (target: < 30s)")).alias("description"),
                    F.lit(SLOW_GAP[2]).alias("recommendation")))
    untested = (untested_scenarios(latest, keys).groupBy(*keys)
                .agg(F.array_join(F.array_sort(F.collect_list("scenario")), ", ").alias("_u"))
                .select(*keys, F.lit(None).cast("string").alias("scenario"),
                        F.lit("Coverage").alias("category"), F.lit("low").alias("severity"),
                        F.concat(F.lit("Untested scenarios: "), F.col("_u")).alias("description"),
                        F.lit("Run full FMEA suite: chaos").alias("recommendation")))
    return failed.unionByName(slow).unionByName(untested)


def strengths(latest: DataFrame, keys: list[str] = ["project"]) -> DataFrame:
    """C6 strengths: fast recovery (< 5 s) or resilient per passed scenario;
    'Passes all tested chaos scenarios' when all passed and >= 3 tested."""
    per = (latest.filter(F.col("passed"))
           .select(*keys, "scenario", F.when(
               F.col("recovery_ms").isNotNull() & (F.col("recovery_ms") < FAST_RECOVERY_MS),
               F.concat(F.lit("Fast recovery from "), F.col("scenario"), F.lit(" ("),
                        secs_1dp(F.col("recovery_ms")), F.lit("s)")))
               .otherwise(F.concat(F.lit("Resilient to "), F.col("scenario"))).alias("strength")))
    allp = (latest.groupBy(*keys).agg(F.bool_and("passed").alias("_all"), F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_all") & (F.col("_n") >= 3))
            .select(*keys, F.lit(None).cast("string").alias("scenario"),
                    F.lit("Passes all tested chaos scenarios").alias("strength")))
    return per.unionByName(allp)


def scorecard(results: DataFrame, keys: list[str] = ["project"], run: str = "run_id") -> DataFrame:
    """Per project the current score over the latest result of each
    scenario, percentage, trend (W4 over run entries), gap and strength
    counts."""
    latest = latest_results(results, keys, run)
    cur = resilience_score(latest.withColumnRenamed(run, "_run"), keys) \
        .select(*keys, F.col("score").alias("current_score"), "max_score", "percentage")
    trend = score_trend(score_entries(results, run), keys, run).select(*keys, "trend")
    gaps = gap_catalog(latest, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("gaps"))
    strong = strengths(latest, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("strengths"))
    return (cur.join(trend, keys, "left").join(gaps, keys, "left").join(strong, keys, "left")
            .fillna(0, ["gaps", "strengths"]))


def chaos_recommendations(results: DataFrame, keys: list[str] = ["project"]) -> DataFrame:
    """C7 + U4: distinct recommendation texts per project for failed results
    and recoveries above 30 s."""
    recs = F.broadcast(results.sparkSession.createDataFrame(SCENARIO_RECOMMENDATIONS,
                                                             "scenario string, recommendation string"))
    failed = results.filter(~F.col("passed"))
    a = failed.join(recs, on="scenario", how="inner").select(*keys, "recommendation")
    b = (failed.filter(F.col("recovery_ms") > SLOW_RECOVERY_MS)
         .select(*keys, F.concat(F.lit("Improve recovery time for "), F.col("scenario"),
                                 F.lit(" (currently "), secs_1dp(F.col("recovery_ms")),
                                 F.lit("s, target < 30s)")).alias("recommendation")))
    return a.unionByName(b).distinct()


def chaos_slo(summary: DataFrame, results: DataFrame) -> DataFrame:
    """Chaos SLOs per run — error ratio <= 5 %, probe p99 <= 2000 ms,
    recovery <= 60 s (all inclusive)."""
    from vigil.operators.release import CHAOS_SLO, slo_check
    d = summary.join(results.select("run_id", "recovery_ms"), "run_id", "left")
    return slo_check(d, CHAOS_SLO, at_most=True)


def _not_ok() -> Column:
    return ~((F.col("_st") >= 200) & (F.col("_st") < 500))


def _joined_windows(p: DataFrame, r: DataFrame, window_s: int) -> DataFrame:
    """Requests, errors, mean and p99 latency of the probes ``p`` in the windows
    of each run id of ``r``: each run is expanded to the minute buckets its
    window covers and equi-joined on (bucket); the residual keeps exact bounds."""
    p = p.withColumn("_b", F.floor(F.unix_seconds("_pt") / 60))
    r = r.withColumn("_end", F.col("_start") + F.expr(f"INTERVAL {int(window_s)} SECONDS"))
    r = r.withColumn("_b", F.explode(F.sequence(F.floor(F.unix_seconds("_start") / 60),
                                                F.floor((F.unix_seconds("_end") - 1) / 60))))
    j = r.join(p, on="_b", how="inner").filter((F.col("_pt") >= F.col("_start")) & (F.col("_pt") < F.col("_end")))
    return j.groupBy("run_id").agg(F.count(F.lit(1)).alias("requests"),
                                   F.count_if(_not_ok()).alias("errors"), F.avg("_lat").alias("avg_latency_ms"),
                                   F.percentile("_lat", F.lit(0.99)).alias("p99_ms"))


def _sliced_windows(p: DataFrame, windows: DataFrame, window_s: int) -> DataFrame:
    """The same for ``windows`` (run_id, t: start in microseconds, times: how
    often the window counts).  The time line is cut at quantiles of the probes; a
    window goes to the slice it starts in, a probe to each slice with a window
    that may hold it."""
    width = int(window_s) * 1_000_000
    p = p.where("_pt IS NOT NULL").select(F.unix_micros("_pt").alias("t"), F.coalesce(_not_ok(), F.lit(False)).alias("bad"),
                                          F.col("_lat").cast("double").alias("lat"))
    n = max(1, p.count() // WINDOW_SLICE_ROWS)
    cuts = p.select(F.col("t").cast("double")).approxQuantile("t", [i / n for i in range(1, n)], min(0.001, 0.25 / n)) if n > 1 else []
    splits = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]

    def sliced(df: DataFrame, col: str, of: Column) -> DataFrame:
        b = Bucketizer(splits=splits, inputCol="_x", outputCol="_y")
        return b.transform(df.withColumn("_x", of.cast("double"))).withColumn(col, F.col("_y").cast("int")).drop("_x", "_y")
    w = sliced(windows, "slice", F.col("t"))
    p = sliced(sliced(p, "_a", F.col("t") - (width - 1)), "_b", F.col("t"))
    p = p.select(F.explode(F.sequence("_a", "_b")).alias("slice"), "t", "bad", "lat")

    def stats(w: pa.Table, p: pa.Table) -> pa.Table:
        p = p.sort_by("t")
        t, start = p.column("t").to_numpy(), w.column("t").to_numpy()
        bad = np.append(0, np.cumsum(p.column("bad").to_numpy()))
        has = np.append(0, np.cumsum(p.column("lat").is_valid().to_numpy()))
        lat = p.column("lat").drop_null().to_numpy()
        lo, hi = np.searchsorted(t, start), np.searchsorted(t, start + width)
        out = []
        for run, k, a, b in zip(w.column("run_id").to_pylist(), w.column("times").to_pylist(), lo.tolist(), hi.tolist()):
            if a == b:
                continue
            some, mean, p99 = lat[has[a]:has[b]], None, None
            if len(some):
                at = 0.99 * (k * len(some) - 1)
                low, high = math.floor(at), math.ceil(at)
                x, y = np.partition(some, sorted({low // k, high // k}))[[low // k, high // k]].tolist()
                mean, p99 = float(some.sum() / len(some)), x if low == high or x == y else (high - at) * x + (at - low) * y
            out.append((run, k * (b - a), k * int(bad[b] - bad[a]), mean, p99))
        types = [w.schema.field("run_id").type, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, x) for c, x in zip(zip(*out) if out else [[]] * 5, types)],
                        names=["run_id", "requests", "errors", "avg_latency_ms", "p99_ms"])
    kind = dict(windows.dtypes)["run_id"]
    return w.groupBy("slice").cogroup(p.groupBy("slice")).applyInArrow(
        stats, f"run_id {kind}, requests long, errors long, avg_latency_ms double, p99_ms double")


def chaos_run_summary(probes: DataFrame, runs: DataFrame, window_s: int = 120,
                      ts: str = "ts", status: str = "status", latency: str = "latency_ms", tie: str = "request_id") -> DataFrame:
    """Probe requests during each chaos window ``[start, start + window)``
    -> count, error ratio (ok = 200 <= status < 500; no probes -> 0, kafka-down
    -> 1), average latency; passed = ratio below the scenario limit and the
    first probe after the window is ok (of probes at one time that with the
    smallest ``tie``).

    Windows and probes meet in slices of the time line (``_sliced_windows``), so
    a probe is not copied once a window that holds it; runs of one id with
    several start times are joined (``_joined_windows``).
    """
    p = probes.select(F.col(ts).cast("timestamp").alias("_pt"), F.col(status).alias("_st"),
                      F.col(latency).alias("_lat"))
    r = runs.select("run_id", F.col("start_ts").cast("timestamp").alias("_start")).where("run_id IS NOT NULL AND _start IS NOT NULL")
    at = F.unix_micros("_start")
    ids = cut_lineage(r.groupBy("run_id").agg(F.count(F.lit(1)).alias("times"), F.min(at).alias("t"), F.max(at).alias("_last")))
    agg = _sliced_windows(p, ids.where("t = _last").drop("_last"), window_s)
    several = ids.where("t < _last").select("run_id")
    if not several.isEmpty():
        agg = agg.unionByName(_joined_windows(p, r.join(several, "run_id", "left_semi"), window_s))
    out = runs.join(agg, on="run_id", how="left").fillna(0, ["requests", "errors"])
    lim = F.coalesce(F.create_map(*[x for k, v in ERROR_RATIO_LIMIT.items() for x in (F.lit(k), F.lit(v))])[
        F.col("scenario")], F.lit(ERROR_RATIO_DEFAULT))
    ratio = F.when(F.col("requests") > 0, F.col("errors") / F.col("requests")) \
        .otherwise(F.when(F.col("scenario") == "kafka-down", 1.0).otherwise(0.0))
    out = out.withColumn("error_ratio", ratio)
    # first probe at or after the window end (as-of forward on the probe stream)
    from vigil.operators.release import asof_join
    probes_ok = probes.select(F.col(ts).cast("timestamp").alias("_probe_ts"),
                              ((F.col(status) >= 200) & (F.col(status) < 500)).alias("after_ok"),
                              F.col(tie).alias("_tie"), F.lit(0).alias("_k"))
    ends = (out.withColumn("_end_ts", F.col("start_ts").cast("timestamp") + F.expr(f"INTERVAL {int(window_s)} SECONDS"))
            .withColumn("_k", F.lit(0)))
    after = asof_join(ends, probes_ok, ["_k"], "_end_ts", "_probe_ts", ["after_ok"], backward=False, tie="_tie")
    # no probe after the window: not recovered
    after = after.withColumn("after_ok", F.coalesce(F.col("after_ok"), F.lit(False)))
    return after.withColumn("passed", (F.col("error_ratio") < lim) & F.col("after_ok")).drop("_end_ts", "_k")
