"""Ingest jobs: raw text / JSON records -> typed rows.

Each parser is a column-expression pipeline over a DataFrame of raw
records (``value`` string column), so it runs as a narrow map stage right
after the scan; unparsable records are kept with null fields or dropped
exactly as the reference does, never handled row by row in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.scalar import leading_number, percent_to_double, size_to_bytes
from vigil.functions.text import topic_tags

_LOG_LINE = r"^([^\s|]+)\s*\|\s*(.*)$"
_LEADING_TS = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^\s]*)\s*"


def structure_container_logs(lines: DataFrame, value: str = "value", ingest_ts=None) -> DataFrame:
    """``service | [ISO timestamp] message``; unmatched lines -> service
    'unknown' and the whole trimmed line; blank lines dropped; the leading
    timestamp (if any) becomes ``ts`` (else the ingest time)."""
    now = F.current_timestamp() if ingest_ts is None else F.lit(ingest_ts).cast("timestamp")
    v = F.col(value)
    d = lines.select(v.alias("_l")).filter(F.trim(F.col("_l")) != "")
    m = F.col("_l").rlike(_LOG_LINE)
    msg = F.regexp_extract("_l", _LOG_LINE, 2)
    ts_s = F.regexp_extract(msg, _LEADING_TS, 1)
    clean = F.when(ts_s != "", F.regexp_replace(msg, _LEADING_TS, "")).otherwise(msg)
    return d.select(
        F.when(m, F.trim(F.regexp_extract("_l", _LOG_LINE, 1))).otherwise(F.lit("unknown")).alias("service"),
        F.when(m, F.trim(clean)).otherwise(F.trim(F.col("_l"))).alias("message"),
        F.when(m & (ts_s != ""), F.try_to_timestamp(ts_s)).otherwise(now).alias("ts"),
        F.when(m & (ts_s != ""), ts_s).alias("ts_text"))


def structure_commits(lines: DataFrame, value: str = "value") -> DataFrame:
    """``sha|author|date|message`` with at least four parts; the message
    keeps any further ``|``."""
    d = lines.select(F.col(value).alias("_l")).filter(F.trim(F.col("_l")) != "")
    p = d.select(F.split("_l", r"\|", 4).alias("p")).filter(F.size("p") >= 4)
    return p.select(F.col("p")[0].alias("sha"), F.col("p")[1].alias("author"), F.col("p")[2].alias("date"),
                    F.col("p")[3].alias("message"),
                    F.try_to_timestamp(F.col("p")[2]).alias("ts"))


_STATS_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                              ("Name", "CPUPerc", "MemPerc", "MemUsage", "NetIO")])


def structure_container_stats(lines: DataFrame, value: str = "value") -> DataFrame:
    """Container stats JSON lines -> cpu / memory percent as numbers,
    ``used / limit`` and ``rx / tx`` sizes in bytes (1024 multipliers)."""
    j = lines.select(F.from_json(F.col(value), _STATS_SCHEMA).alias("j")).filter(F.col("j.Name").isNotNull())
    mem = F.split(F.col("j.MemUsage"), "/")
    net = F.split(F.col("j.NetIO"), "/")
    return j.select(
        F.col("j.Name").alias("name"),
        percent_to_double(F.col("j.CPUPerc")).alias("cpu_pct"),
        percent_to_double(F.col("j.MemPerc")).alias("mem_pct"),
        size_to_bytes(F.trim(mem[0])).alias("mem_usage"),
        size_to_bytes(F.trim(F.try_element_at(mem, F.lit(2)))).alias("mem_limit"),
        size_to_bytes(F.trim(net[0])).alias("net_rx"),
        size_to_bytes(F.trim(F.try_element_at(net, F.lit(2)))).alias("net_tx"))


def structure_exposition(lines: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """I4: text exposition -> per key p50/p95/p99 (seconds x 1000),
    2xx/4xx/5xx counts and error % = 5xx / (2xx + 4xx + 5xx) x 100 (0 when
    none).  Quantile and status lines are read with a full float pattern,
    and status counts come from one metric family only (quirk Q9)."""
    l = F.col(value)
    q = F.regexp_extract(l, r'quantile="([^"]+)"', 1).try_cast("double")
    v = F.regexp_extract(l, r"\}\s+([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")
    st = F.regexp_extract(l, r'status="(\d+)"', 1).try_cast("int")
    is_q = l.startswith("http_server_requests_seconds{") & q.isNotNull() & v.isNotNull()
    is_c = l.startswith("http_server_requests_seconds_count{") & st.isNotNull() & v.isNotNull()
    d = lines.filter(~l.startswith("#")).select(*keys, is_q.alias("is_q"), is_c.alias("is_c"),
                                                q.alias("q"), v.alias("v"), st.alias("st"))
    g = d.groupBy(*keys).agg(
        (F.max(F.when(F.col("is_q") & (F.col("q") == 0.5), F.col("v"))) * 1000).alias("p50_ms"),
        (F.max(F.when(F.col("is_q") & (F.col("q") == 0.95), F.col("v"))) * 1000).alias("p95_ms"),
        (F.max(F.when(F.col("is_q") & (F.col("q") == 0.99), F.col("v"))) * 1000).alias("p99_ms"),
        F.sum(F.when(F.col("is_c") & F.col("st").between(200, 299), F.col("v")).otherwise(0.0)).alias("status_2xx"),
        F.sum(F.when(F.col("is_c") & F.col("st").between(400, 499), F.col("v")).otherwise(0.0)).alias("status_4xx"),
        F.sum(F.when(F.col("is_c") & F.col("st").between(500, 599), F.col("v")).otherwise(0.0)).alias("status_5xx"))
    tot = F.col("status_2xx") + F.col("status_4xx") + F.col("status_5xx")
    return g.withColumn("error_rate_pct", F.when(tot > 0, F.col("status_5xx") / tot * 100).otherwise(0.0))


def measurements_avg_ms(meas: DataFrame, keys: list[str]) -> DataFrame:
    """I4: avg response time = TOTAL_TIME / COUNT x 1000 (0 without count)."""
    g = meas.groupBy(*keys).agg(
        F.max(F.when(F.col("statistic") == "COUNT", F.col("value"))).alias("total_requests"),
        F.max(F.when(F.col("statistic") == "TOTAL_TIME", F.col("value"))).alias("_tt"))
    return g.withColumn("avg_response_ms", F.when(F.col("total_requests") > 0,
                                                  F.col("_tt") / F.col("total_requests") * 1000).otherwise(0.0)).drop("_tt")


_STREAMS = T.StructType([T.StructField("data", T.StructType([T.StructField("result", T.ArrayType(T.StructType([
    T.StructField("stream", T.MapType(T.StringType(), T.StringType())),
    T.StructField("values", T.ArrayType(T.ArrayType(T.StringType())))])))]))])


def structure_log_store_response(resp: DataFrame, value: str = "value") -> DataFrame:
    """Log-store query responses -> rows (ns timestamp, message,
    service = label service, else container, else 'unknown')."""
    j = resp.select(F.from_json(F.col(value), _STREAMS).alias("j"))
    s = j.select(F.explode("j.data.result").alias("s"))
    r = s.select(F.coalesce(F.col("s.stream")["service"], F.col("s.stream")["container"],
                            F.lit("unknown")).alias("service"), F.explode("s.values").alias("v"))
    ns = F.col("v")[0].try_cast("decimal(20,0)")
    return r.select("service", F.timestamp_micros((ns / 1000).cast("long")).alias("ts"),
                    F.col("v")[1].alias("message"))


_K8S_EVENT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("reason", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("count", T.LongType()),
    T.StructField("lastTimestamp", T.StringType()), T.StructField("eventTime", T.StringType()),
    T.StructField("involvedObject", T.StructType([T.StructField("kind", T.StringType()),
                                                  T.StructField("name", T.StringType())]))])


def structure_orchestrator_events(items: DataFrame, keys: list[str] = [], value: str = "value",
                                  last_n: int = 30, warnings_n: int = 10) -> DataFrame:
    """I8: orchestrator events -> (type, reason, message, object 'kind/name',
    ts = lastTimestamp or eventTime, count) with the newest 30 events and a
    ``is_recent_warning`` flag on the newest 10 warnings per key."""
    from vigil.operators.ordered import top_n
    e = items.select(*keys, F.from_json(F.col(value), _K8S_EVENT).alias("e"))
    d = e.select(*keys, "e.type", "e.reason", "e.message", "e.count",
                 F.concat_ws("/", "e.involvedObject.kind", "e.involvedObject.name").alias("object"),
                 F.try_to_timestamp(F.coalesce("e.lastTimestamp", "e.eventTime")).alias("ts"))
    recent = top_n(d, keys, [F.col("ts").desc_nulls_last()], last_n, rank_col="recent_rank")
    warn = top_n(d.filter(F.col("type") == "Warning"), keys, [F.col("ts").desc_nulls_last()], warnings_n,
                 rank_col="warning_rank")
    return recent.unionByName(warn, allowMissingColumns=True)


_POD = T.StructType([
    T.StructField("metadata", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("status", T.StructType([
        T.StructField("phase", T.StringType()),
        T.StructField("conditions", T.ArrayType(T.StructType([T.StructField("type", T.StringType()),
                                                              T.StructField("status", T.StringType())]))),
        T.StructField("containerStatuses", T.ArrayType(T.StructType([
            T.StructField("restartCount", T.LongType())])))]))])


def structure_pods(items: DataFrame, value: str = "value") -> DataFrame:
    """ready = Ready condition True; restarts = Σ restartCount;
    unhealthy = not ready or phase != Running."""
    p = items.select(F.from_json(F.col(value), _POD).alias("p"))
    ready = F.coalesce(F.exists("p.status.conditions", lambda c: (c["type"] == "Ready") & (c["status"] == "True")),
                       F.lit(False))
    restarts = F.aggregate(F.coalesce("p.status.containerStatuses", F.array().cast(
        "array<struct<restartCount:bigint>>")), F.lit(0).cast("long"),
        lambda a, c: a + F.coalesce(c["restartCount"], F.lit(0).cast("long")))
    return p.select(F.col("p.metadata.name").alias("name"), F.col("p.status.phase").alias("phase"),
                    ready.alias("ready"), restarts.alias("restarts"),
                    (~ready | (F.coalesce(F.col("p.status.phase"), F.lit("")) != "Running")).alias("unhealthy"))


_RUN = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("result", T.StringType()),
    T.StructField("durationMillis", T.LongType()), T.StructField("timestamp", T.LongType()),
    T.StructField("stages", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("durationMillis", T.LongType())])))])


def structure_pipeline_runs(items: DataFrame, value: str = "value") -> DataFrame:
    """Run result SUCCESS / FAILURE / null -> success / failure / running,
    one row per stage with status lower-cased and seconds = round(ms/1000)."""
    r = items.select(F.from_json(F.col(value), _RUN).alias("r"))
    status = (F.when(F.col("r.result") == "SUCCESS", "success").when(F.col("r.result") == "FAILURE", "failure")
              .when(F.col("r.result").isNull(), "running").otherwise(F.lower("r.result")))
    return r.select(F.col("r.id").alias("run_id"), status.alias("status"),
                    F.round(F.col("r.durationMillis") / 1000).cast("long").alias("duration_s"),
                    F.explode_outer("r.stages").alias("s")).select(
        "run_id", "status", "duration_s", F.col("s.name").alias("stage"),
        F.lower("s.status").alias("stage_status"),
        F.round(F.col("s.durationMillis") / 1000).cast("long").alias("stage_s"))


def structure_service_state(items: DataFrame, keys: list[str] = ["project"], value: str = "value") -> DataFrame:
    """Container State / Health -> running & unhealthy -> unhealthy;
    running -> running; else stopped; project running iff some container
    runs and none is unhealthy."""
    sch = T.StructType([T.StructField("Service", T.StringType()), T.StructField("State", T.StringType()),
                        T.StructField("Health", T.StringType())])
    c = items.select(*keys, F.from_json(F.col(value), sch).alias("c"))
    st = (F.when((F.col("c.State") == "running") & (F.col("c.Health") == "unhealthy"), "unhealthy")
          .when(F.col("c.State") == "running", "running").otherwise("stopped"))
    d = c.select(*keys, F.col("c.Service").alias("service"), st.alias("state"))
    p = d.groupBy(*keys).agg((F.bool_or(F.col("state") == "running")
                              & ~F.bool_or(F.col("state") == "unhealthy")).alias("project_running"))
    return d.join(p, keys, "left")


def structure_environments(items: DataFrame, value: str = "value") -> DataFrame:
    """Application environments: 7-character revision, sync / health
    status with 'Unknown' defaults, PR environments by the 'pr-' name prefix."""
    sch = T.StructType([T.StructField("name", T.StringType()), T.StructField("revision", T.StringType()),
                        T.StructField("sync", T.StringType()), T.StructField("health", T.StringType())])
    e = items.select(F.from_json(F.col(value), sch).alias("e"))
    return e.select(F.col("e.name").alias("name"), F.substring("e.revision", 1, 7).alias("revision"),
                    F.coalesce("e.sync", F.lit("Unknown")).alias("sync"),
                    F.coalesce("e.health", F.lit("Unknown")).alias("health"),
                    F.regexp_extract("e.name", r"(?:^|-)pr-(\d+)", 1).alias("pr_number"),
                    F.col("e.name").rlike(r"(^|-)pr-\d+").alias("is_pr"))


_STORY = T.StructType([T.StructField("id", T.LongType()), T.StructField("type", T.StringType()),
                       T.StructField("title", T.StringType()), T.StructField("url", T.StringType()),
                       T.StructField("score", T.LongType()), T.StructField("time", T.LongType())])


def structure_stories(items: DataFrame, value: str = "value") -> DataFrame:
    """I13 + E7: keep type = story with a title; id 'hn-<id>'; url falls back
    to the discussion page; score / time default 0; topic tags from the
    title."""
    s = items.select(F.from_json(F.col(value), _STORY).alias("s")).filter(
        (F.col("s.type") == "story") & F.col("s.title").isNotNull() & (F.col("s.title") != ""))
    return s.select(
        F.concat(F.lit("hn-"), F.col("s.id").cast("string")).alias("id"), F.col("s.title").alias("title"),
        F.coalesce(F.nullif(F.col("s.url"), F.lit("")),
                   F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("s.id").cast("string"))).alias("url"),
        F.coalesce(F.col("s.score"), F.lit(0)).cast("int").alias("score"),
        F.coalesce(F.col("s.time"), F.lit(0)).alias("time"),
        topic_tags(F.col("s.title")).alias("tags"))


def parse_number(s):
    """parseFloat-style prefix number (re-exported for ingest callers)."""
    return leading_number(s)
