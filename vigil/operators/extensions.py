"""Operators the reference only specifies (P2-P4, P7, P11, P13) plus source
summaries (A26, U2), fix lookup (J6) and batch recommendation (M10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.text import is_error_line
from vigil.operators.ordered import sliced_lag, top_n
from vigil.operators.simjoin import top_cosine

# --- fixed values (specification) ----------------------------------------
DOMAIN_REGRESSION = 0.20        # p95 +20 %
MONITOR_P95_FACTOR = 2.0        # p95 > 2 x baseline after a deploy
MONITOR_ERROR_PCT, MONITOR_STREAK = 5.0, 3
MONITOR_LAG = 10_000
MONITOR_SILENCE_MIN = 15
VECTOR_MIN_COS, VECTOR_LIMIT = 0.75, 5
DLQ_ATTEMPTS = 3
# suggestion ranking: incident frequency, severity, ease of fix, confidence
RANKING_WEIGHTS = {"frequency": 0.3, "severity": 0.3, "ease": 0.2, "confidence": 0.2}
SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}
# --------------------------------------------------------------------------


def source_summary(logs: DataFrame, commits: DataFrame, keys: list[str] = ["project"]) -> DataFrame:
    """A26 + U2: per project and source the counts the collectors report —
    logs (lines, error lines, warnings) and git (commits) — as one long table
    (union of per-source aggregates)."""
    lg = logs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(is_error_line("message")).alias("errors"),
        F.count_if(F.lower("message").contains("warn")).alias("warnings"))
    lg = lg.select(*keys, F.lit("logs").alias("source"), F.inline(F.array(
        F.struct(F.lit("lines").alias("metric"), F.col("lines").alias("value")),
        F.struct(F.lit("errors").alias("metric"), F.col("errors").alias("value")),
        F.struct(F.lit("warnings").alias("metric"), F.col("warnings").alias("value")))))
    gt = commits.groupBy(*keys).agg(F.count(F.lit(1)).alias("value")) \
        .select(*keys, F.lit("git").alias("source"), F.lit("commits").alias("metric"), "value")
    return lg.unionByName(gt)


def fix_lookup(incidents: DataFrame, fixes: DataFrame, id_col: str = "incident_id") -> DataFrame:
    """Attach each incident's latest fix record (by applied time)."""
    f = fixes.groupBy(id_col).agg(F.max_by(F.struct(*[c for c in fixes.columns if c != id_col]),
                                           F.col("applied_at")).alias("fix"))
    return incidents.join(f, id_col, "left")


def domain_of(tag, class_name) -> F.Column:
    """The domain tag, else the package segment after 'controller'."""
    seg = F.regexp_extract(class_name, r"\.controller\.([A-Za-z0-9_]+)", 1)
    return F.coalesce(F.nullif(tag, F.lit("")), F.nullif(seg, F.lit("")), F.lit("unknown"))


def domain_regression(requests: DataFrame, domain: F.Column, version: str = "version",
                      old: str = "old", new: str = "new") -> DataFrame:
    """p95 per domain for the old and the new version; regression when
    the new p95 exceeds the old by more than 20 %."""
    from vigil.operators.ordered import exact_percentiles
    r = requests.withColumn("domain", domain).filter(F.col(version).isin(old, new))
    p = exact_percentiles(r, ["domain", version], "latency_ms", {"p95": 0.95})
    d = p.groupBy("domain").agg(F.max(F.when(F.col(version) == old, F.col("p95"))).alias("p95_old"),
                                F.max(F.when(F.col(version) == new, F.col("p95"))).alias("p95_new"))
    return d.withColumn("regression", F.coalesce(
        F.col("p95_new") > F.col("p95_old") * (1 + DOMAIN_REGRESSION), F.lit(False)))


def slowest_in_window(requests: DataFrame, keys: list[str], width: str = "1 minute",
                      id_col: str = "request_id") -> DataFrame:
    """The slowest request (link id) per key and window."""
    return (requests.groupBy(*keys, F.window(F.col("ts").cast("timestamp"), width).alias("w"))
            .agg(F.max_by(F.col(id_col), F.struct("latency_ms", F.col(id_col))).alias("slowest_id"),
                 F.max("latency_ms").alias("max_latency_ms"))
            .select(*keys, F.col("w.start").alias("window_start"), "slowest_id", "max_latency_ms"))


def error_streaks(requests: DataFrame, keys: list[str], width_s: int = 60) -> DataFrame:
    """Checks (one per minute with traffic) whose 5xx share is above 5 %
    for at least three consecutive checks -> 'service degradation'.  The
    check series is an aggregate (keys x minutes), so the run-length window
    over it is small."""
    c = requests.withColumn("step", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / width_s)) \
        .groupBy(*keys, "step").agg(
            (F.count_if(F.col("status").between(500, 599)) * 100.0 / F.count(F.lit(1))).alias("error_pct"))
    w = Window.partitionBy(*keys).orderBy("step")
    c = c.withColumn("bad", F.col("error_pct") > MONITOR_ERROR_PCT)
    # a minute without a check ends a run
    new_run = (F.col("bad") != F.lag("bad").over(w)) | (F.col("step") - F.lag("step").over(w) > 1)
    c = c.withColumn("_chg", F.when(new_run, 1).otherwise(0))
    c = c.withColumn("_run", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = c.filter("bad").groupBy(*keys, "_run").agg(
        F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count(F.lit(1)).alias("checks"))
    return runs.filter(F.col("checks") >= MONITOR_STREAK).select(
        *keys, (F.col("first_step") * width_s).alias("start_epoch_s"),
        (F.col("last_step") * width_s).alias("end_epoch_s"), "checks",
        F.lit("service degradation").alias("classification"))


def traffic_gaps(requests: DataFrame, keys: list[str], minutes: int = MONITOR_SILENCE_MIN,
                 tie: str = "request_id") -> DataFrame:
    """P4: 'dead service' — no traffic for 15 minutes between consecutive
    requests of a key (sliced lag, no key in one task), or from its last
    request to the end of the range (the newest request of all keys)."""
    d = sliced_lag(requests.select(*keys, "ts", tie), keys, ["ts", tie], ["ts"], prefix="prev_")
    between = d.select(*keys, F.col("prev_ts").alias("silent_from"), F.col("ts").alias("silent_to"))
    last = requests.groupBy(*keys).agg(F.max("ts").alias("silent_from"), F.lit(0).alias("_k"))
    end = requests.agg(F.max("ts").alias("silent_to")).withColumn("_k", F.lit(0))
    after = last.join(F.broadcast(end), "_k").select(*keys, "silent_from", "silent_to")   # one row
    gap = (F.unix_micros(F.col("silent_to").cast("timestamp"))
           - F.unix_micros(F.col("silent_from").cast("timestamp"))) / 6e7
    return (between.unionByName(after).withColumn("gap_minutes", gap).filter(F.col("gap_minutes") >= minutes)
            .withColumn("classification", F.lit("dead service")))


def latency_regressions(deploy_ba: DataFrame) -> DataFrame:
    """p95 after a deploy above twice the p95 before it."""
    return deploy_ba.filter(F.col("latency_after") > F.col("latency_before") * MONITOR_P95_FACTOR) \
        .withColumn("classification", F.lit("performance regression"))


def consumer_backpressure(lag: DataFrame, keys: list[str]) -> DataFrame:
    """Consumer lag above 10k -> 'backpressure', slowest consumer first."""
    return lag.filter(F.col("lag") > MONITOR_LAG).withColumn("classification", F.lit("backpressure"))


def vector_similar(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding",
                   min_cos: float = VECTOR_MIN_COS, k: int = VECTOR_LIMIT) -> DataFrame:
    """For each vector at most five others with cosine >= 0.75, exact
    (``simjoin.top_cosine``).  Zero vectors and nulls have no partner."""
    usable = F.col(vec).isNotNull() & F.exists(vec, lambda x: x != 0)
    rows = vectors.where(usable).select(F.col(id_col).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    return top_cosine(rows, k, min_cos).select(
        F.col("id").alias(id_col), F.col("other").alias("similar_id"), F.col("score").alias("cosine"), "rank")


def dead_letter(attempts: DataFrame, key: str = "message_id", max_attempts: int = DLQ_ATTEMPTS
                ) -> tuple[DataFrame, DataFrame]:
    """Messages that failed ``max_attempts`` times go to the dead-letter
    table; returns (dead letters, count per topic)."""
    f = attempts.groupBy(key, "topic").agg(F.count_if(~F.col("ok")).alias("failures"),
                                           F.bool_or("ok").alias("delivered"),
                                           F.max_by("payload", "attempt").alias("payload"))
    dl = f.filter(~F.col("delivered") & (F.col("failures") >= max_attempts))
    return dl, dl.groupBy("topic").agg(F.count(F.lit(1)).alias("dead_letters"))


def rank_suggestions(s: DataFrame, keys: list[str] = []) -> DataFrame:
    """Rank suggestions by incident frequency, severity, ease of fix and
    confidence (each scaled to 0..1; frequency by the maximum per key), the
    best first."""
    sev = F.create_map(*[x for k, v in SEVERITY_WEIGHT.items() for x in (F.lit(k), F.lit(v))])
    mx = s.groupBy(*keys).agg(F.max("frequency").alias("_mx")) if keys else \
        s.agg(F.max("frequency").alias("_mx")).withColumn("_k", F.lit(1))
    d = s.join(mx, keys) if keys else s.withColumn("_k", F.lit(1)).join(F.broadcast(mx), "_k").drop("_k")
    d = d.withColumn("_f", F.col("frequency") / F.col("_mx")).drop("_mx")
    score = (RANKING_WEIGHTS["frequency"] * F.coalesce("_f", F.lit(0.0))
             + RANKING_WEIGHTS["severity"] * F.coalesce(sev[F.col("severity")], F.lit(0.0))
             + RANKING_WEIGHTS["ease"] * F.col("ease") + RANKING_WEIGHTS["confidence"] * F.col("confidence"))
    return d.withColumn("priority_score", score).drop("_f").orderBy(
        *keys, F.desc("priority_score"), "description")


def batch_recommend_all(recs: DataFrame, model_version: str, path: str | None = None,
                        now: Column | None = None) -> DataFrame:
    """Persist the top-K rows of every user with the model version as a
    replacing table keyed by (user_id, item_id): rows are appended, readers take
    the latest ``timestamp`` of a key (``warehouse.recs_for_user``, F8)."""
    out = recs.withColumn("model_ver", F.lit(model_version)) \
        .withColumn("timestamp", F.current_timestamp() if now is None else now) \
        .withColumn("genres", F.array_join("genres", ",") if "genres" in recs.columns else F.lit(""))
    if path:
        out.sortWithinPartitions("user_id", "item_id").write.mode("append").parquet(path)
    return out
