"""Registered Structured Streaming queries: the driver tables are staged as
file streams and each streaming job runs to completion (availableNow)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import alerts as A
from vigil.operators import recommender as RC
from vigil.plans.q_classifier import CLASSIFIED, conversation_messages, conversation_model
from vigil.plans.registry import query
from vigil.sources.tables import read_table, view
from vigil.streaming import jobs as S


def _stream_of(spark, df, name, order="ts", per_batch=None):
    """The table as a file stream; ``per_batch`` files make a micro-batch."""
    path, schema = S.stage_files(df, name, order=order)
    return S.read_stream(spark, path, "parquet", schema, max_files=per_batch)


@query("alert_state_stream")
def alert_state_stream(spark, sf):
    """Stateful trigger / resolve / cooldown events over the streamed
    metric samples."""
    s = view(spark, sf, "metric_samples").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.run_to_table(S.alert_state_stream(_stream_of(spark, s, "samples"), A.default_thresholds(spark)),
                          "alert_state")


@query("log_volume_stream", """
SELECT service, time_bucket(INTERVAL 1 minute, ts) AS window_start, COUNT(*) AS lines FROM logs
GROUP BY service, time_bucket(INTERVAL 1 minute, ts)
HAVING time_bucket(INTERVAL 1 minute, ts) + INTERVAL 1 minute <= (SELECT max(ts) FROM logs) - INTERVAL 10 minute""",
       ("logs",))
def log_volume_stream(spark, sf):
    """T5: per-minute log volume per service with a 10-minute watermark
    (windows still open when the stream ends are not emitted)."""
    l = view(spark, sf, "logs").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.run_to_table(S.log_volume_stream(_stream_of(spark, l, "logs")), "log_volume")


@query("request_rate_stream", """
WITH w AS (SELECT service, status, unnest(range(0, 10)) AS i, CAST(floor(epoch_us(ts) / 3e7) AS BIGINT) AS step FROM requests)
SELECT service, status, make_timestamp((step - i) * 30000000) AS window_start, COUNT(*) / 300.0 AS rate FROM w
GROUP BY service, status, step - i
HAVING make_timestamp((step - i) * 30000000) + INTERVAL 5 minute
       <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM requests) - INTERVAL 10 minute""", ("requests",))
def request_rate_stream(spark, sf):
    """Sliding 5-minute / 30-second request rate per service and status."""
    r = view(spark, sf, "requests").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.run_to_table(S.request_rate_stream(_stream_of(spark, r, "requests")), "request_rate")


@query("classify_stream", CLASSIFIED.format(out="""
SELECT "eventId" AS key, category FROM p"""))
def classify_stream(spark, sf):
    """T2 + S10: the conversations streamed as event payloads, classified in
    four micro-batches by the job; read back from its sink."""
    from vigil.session import scratch_path
    sink = scratch_path(spark, "predictions")
    stream = _stream_of(spark, conversation_messages(spark, sf), "event-msgs", order=None, per_batch=2)
    S.classify_stream(stream, conversation_model(spark, sf), sink).awaitTermination()
    got = spark.read.schema("key string, value string, batch long").json(sink)
    return got.select("key", F.get_json_object("value", "$.category").alias("category"))


def _run_batches(spark, stream, name, fn):
    S.foreach_batch(stream, name, fn).awaitTermination()


@query("engagement_ingest_stream", """
SELECT event_id, ts, user_id, item_id, event_type, value, CAST(strftime(ts, '%Y%m') AS INTEGER) AS yyyymm
FROM engagement
WHERE item_id IN (SELECT id FROM catalog) AND event_type IN ('view_start', 'view_complete', 'rating', 'search')""",
       ("engagement", "catalog"))
def engagement_ingest_stream(spark, sf):
    """T4 + I15 + S13 + M9: the engagement stream validated and appended by
    month (rejects quarantined, retrain counter kept); returns the table."""
    from vigil.session import scratch_path
    e = view(spark, sf, "engagement").withColumn("ts", F.col("ts").cast("timestamp"))
    out, bad, ctr = (scratch_path(spark, x) for x in ("eng-events", "eng-bad", "eng-counter"))
    catalog, models = view(spark, sf, "catalog"), []

    def retrain():       # M9 calls back into the trainer with all events so far
        models.append(RC.fit_als(RC.engagement_matrix(spark.read.parquet(out), catalog), rank=8, max_iter=2))
    fn = S.engagement_ingest_batch(catalog, out, bad, ctr, retrain)
    _run_batches(spark, _stream_of(spark, e, "engagement", per_batch=3), "engagement", fn)
    return spark.read.parquet(out).drop("batch")


@query("event_fanout_stream", """
SELECT CAST(event_id AS VARCHAR) AS "eventId", event_type AS "eventType", CAST(ts AS VARCHAR) AS "occurredAt",
       CAST(NULL AS VARCHAR) AS name
FROM events WHERE event_type IS NOT NULL""")
def event_fanout_stream(spark, sf):
    """Every raw event payload to one sink, decodable typed events to a
    second; returns the typed sink."""
    from vigil.session import scratch_path
    ev = read_table(spark, sf, "events")
    msgs = ev.select(F.to_json(F.struct(
        F.col("event_id").cast("string").alias("eventId"), F.col("event_type").alias("eventType"),
        F.col("ts").cast("string").alias("occurredAt"))).alias("value"))
    raw, typed = scratch_path(spark, "fan-raw"), scratch_path(spark, "fan-typed")
    _run_batches(spark, _stream_of(spark, msgs, "fanout", order=None, per_batch=3), "fanout", S.event_fanout_batch(raw, typed))
    return spark.read.schema("eventId string, eventType string, occurredAt string, name string, batch long").json(typed).drop("batch")


@query("metrics_ingest_stream")
def metrics_ingest_stream(spark, sf):
    """T7 + S15 + J1: metric snapshots appended by day, thresholds evaluated
    per micro-batch; returns the evaluations."""
    from vigil.operators.metrics import samples_as_snapshots
    from vigil.session import scratch_path
    snaps = samples_as_snapshots(view(spark, sf, "metric_samples"))
    snap_path, eval_path = scratch_path(spark, "snapshots"), scratch_path(spark, "evaluations")
    fn = S.metrics_ingest_batch(snap_path, eval_path, A.default_thresholds(spark))
    _run_batches(spark, _stream_of(spark, snaps, "snapshots", order="timestamp", per_batch=3), "metrics", fn)
    return spark.read.parquet(eval_path).drop("batch")


def _samples_and_acknowledgements(spark, sf):
    """All metric samples, and an acknowledgement of all alerts of a project at
    every thousandth sample of it."""
    s = view(spark, sf, "metric_samples").withColumn("ts", F.col("ts").cast("timestamp"))
    s = s.withColumn("acknowledged", F.lit(False))
    acks = s.where(F.col("total_requests") % 10000 == 0).select(
        "project", "ts", "sample_id", F.lit(True).alias("acknowledged"))
    return s.unionByName(acks, allowMissingColumns=True)


@query("alert_ingest_stream")
def alert_ingest_stream(spark, sf):
    """T1 + T7: trigger / resolve state with the cooldown and acknowledge-all
    carried over four micro-batches of samples and acknowledgements; returns
    the alerts table."""
    from vigil.session import scratch_path
    path = scratch_path(spark, "alerts")
    rows = _samples_and_acknowledgements(spark, sf)
    _run_batches(spark, _stream_of(spark, rows, "alert-rows", per_batch=2), "alerts",
                 S.alert_ingest_batch(path, A.default_thresholds(spark)))
    return S.alerts_table(spark, path).read()


@query("retention_upsert", """
WITH d AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE value END AS value FROM events)
SELECT * FROM d WHERE CAST(ts AS TIMESTAMP) >= TIMESTAMP '2024-01-11 00:00:00'""")
def retention_upsert(spark, sf):
    """S18 + U6: events in a table cut by day; every seventh event is replaced
    by key, then days before the cut-off go.  Each step runs twice, as a
    replayed job would, and rewrites only the days it touches."""
    from vigil.operators.versioned import VersionedTable, day_part
    from vigil.session import scratch_path
    ev = read_table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    table = VersionedTable(spark, scratch_path(spark, "events-by-day"), ev.schema, day_part("ts"))
    fixed = ev.where(F.col("event_id") % 7 == 0).withColumn("value", F.lit(-1.0))
    old = F.col("ts").cast("timestamp") < F.lit("2024-01-11 00:00:00").cast("timestamp")
    for _ in range(2):
        table.upsert(ev, ["event_id"], 0)
    for _ in range(2):
        table.upsert(fixed, ["event_id"], 1)
    for _ in range(2):
        table.delete(old, 2)
    return table.read()


@query("article_ingest_stream")
def article_ingest_stream(spark, sf):
    """T3 + I13 + S14 + I14: story records upserted into the articles change
    log and the catalog rebuilt from the latest articles; returns the
    catalog."""
    from vigil.session import scratch_path
    p = read_table(spark, sf, "pages")
    js = p.select(F.to_json(F.struct(
        F.col("page_id").alias("id"), F.lit("story").alias("type"),
        F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.col("url"),
        (F.col("page_id") % 1000).alias("score"), F.col("page_id").alias("time"))).alias("value"))
    log, cat = scratch_path(spark, "articles-log"), scratch_path(spark, "catalog")
    _run_batches(spark, _stream_of(spark, js, "stories", order=None, per_batch=3), "articles", S.article_ingest_batch(log, cat, 2024))
    return S.catalog_table(spark, cat).read().withColumn("genres", F.array_join("genres", ",")) \
        .withColumn("tags", F.array_join("tags", ","))
