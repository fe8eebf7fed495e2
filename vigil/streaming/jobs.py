"""Structured Streaming jobs.

Sources and sinks take a ``fmt`` argument: ``kafka`` uses the options built
by ``kafka_source_options`` / ``kafka_sink_options``; any file format
(json / parquet / text) is the local stand-in.  Every query has a
checkpoint location below the shared ``spark.checkpoint.dir`` unless one is
given, so restarts resume exactly where they stopped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigil.operators import alerts as A
from vigil.operators import classifier as C
from vigil.operators import ingest as G
from vigil.operators import recommender as RC
from vigil.operators import warehouse as W
from vigil.operators.release import asof_join
from vigil.operators.versioned import VersionedTable, hash_part
from vigil.session import cut_lineage, scratch_path

# --- fixed values (must equal the reference's rules) ---------------------
EVENTS_TOPIC, PREDICTIONS_TOPIC = "events", "predictions"
CONTENT_EVENTS_TOPIC, RECOMMENDATIONS_TOPIC, ARTICLES_TOPIC = "content-events", "recommendations", "scraped-articles"
WATERMARK = "10 minutes"
# --------------------------------------------------------------------------


def kafka_source_options(bootstrap: str, topic: str, starting: str = "latest",
                         fail_on_data_loss: bool = False, group: str | None = None) -> dict[str, str]:
    """S7 / S8 / S11 option map (batch: earliest -> latest; stream: latest)."""
    o = {"kafka.bootstrap.servers": bootstrap, "subscribe": topic, "startingOffsets": starting,
         "failOnDataLoss": str(fail_on_data_loss).lower()}
    if group:
        o["kafka.group.id"] = group
    return o


def kafka_sink_options(bootstrap: str, topic: str) -> dict[str, str]:
    """S9 / S10 option map."""
    return {"kafka.bootstrap.servers": bootstrap, "topic": topic}


def read_stream(spark: SparkSession, path_or_topic: str, fmt: str = "json", schema=None,
                options: dict | None = None, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    if fmt == "kafka":
        return r.load()
    if schema is not None:
        r = r.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path_or_topic)


def _checkpoint(spark: SparkSession, name: str, given: str | None) -> str:
    return given or scratch_path(spark, f"stream-{name}")


# ---------------------------------------------------------------- T1 -------
_ALERT_OUT = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("threshold_id", T.StringType()),
    T.StructField("container", T.StringType()), T.StructField("event", T.StringType()),
    T.StructField("at_ms", T.LongType()), T.StructField("value", T.DoubleType())])
# JSON: [project, threshold_id, container, active, last_trigger_ms]
_ALERT_STATE = T.StructType([T.StructField("keys", T.StringType())])
ALERT_GROUPS = 4096


def _alert_fold(cooldown_ms: int):
    def fn(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(p, i, c): (active, last) for p, i, c, active, last in json.loads(state.get[0])} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["_ms", "_tie"], kind="mergesort")
        out = []
        for k, ms, b, v in zip(zip(rows["project"], rows["threshold_id"], rows["container"]),
                               rows["_ms"].to_numpy(), rows["breached"].to_numpy(), rows["value"].to_numpy()):
            active, last = held.get(k, (False, None))
            ms = int(ms)
            if b:
                if not active and (last is None or ms - last >= cooldown_ms):
                    held[k] = True, ms
                    out.append((k[0], k[1], k[2] or None, "triggered", ms, float(v)))
            elif active:
                held[k] = False, last
                out.append((k[0], k[1], k[2] or None, "resolved", ms, float(v)))
        state.update((json.dumps([[*k, *x] for k, x in held.items()]),))
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in _ALERT_OUT.fields])
    return fn


def alert_state_stream(samples: DataFrame, rules: DataFrame, cooldown_ms: int = A.COOLDOWN_MS,
                       tie: str = "sample_id") -> DataFrame:
    """Trigger / resolve events per (project, threshold, container) with
    the 60 s cooldown, state kept per key across micro-batches
    (``applyInPandasWithState``); rows of a key inside one micro-batch are
    folded in event-time order.  A group costs far more than its rows, so keys
    share a fixed number of groups by their hash, and a group's state holds
    each of its keys' own.  Matches the batch ``alert_history`` when
    each key's samples arrive in time order."""
    ev = A.evaluate_thresholds(A.samples_long(samples, tie=tie), rules)
    ev = ev.select("project", "threshold_id", F.coalesce("container", F.lit("")).alias("container"),
                   F.unix_millis(F.col("ts").cast("timestamp")).alias("_ms"), F.col(tie).alias("_tie"),
                   "breached", "value")
    group = F.pmod(F.xxhash64("project", "threshold_id", "container"), F.lit(ALERT_GROUPS))
    return ev.withColumn("_group", group).groupBy("_group").applyInPandasWithState(
        _alert_fold(cooldown_ms), _ALERT_OUT, _ALERT_STATE, "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- T2 -------
def classify_batch(model: C.EventModel, sink: str, fmt: str = "json", sink_options: dict | None = None
                   ) -> Callable[[DataFrame, int], None]:
    """T2 + S10: one micro-batch parsed, classified (a join with the model's
    terms, which holds no state) and serialized; files are written once a
    batch, a topic (``fmt="kafka"``) gets them at least once."""
    def fn(batch: DataFrame, epoch: int) -> None:
        out = C.serialize_predictions(C.classify_events(C.parse_events(batch), model))
        if fmt == "kafka":
            out.write.format(fmt).options(**(sink_options or {})).save()
        else:
            write_batch(out, sink, epoch, fmt=fmt)
    return fn


def classify_stream(raw: DataFrame, model: C.EventModel, sink: str, fmt: str = "json",
                    checkpoint: str | None = None, sink_options: dict | None = None, trigger: dict | None = None):
    """T2 + S10: the classification job over a stream of event payloads."""
    return foreach_batch(raw, "classify", classify_batch(model, sink, fmt, sink_options), checkpoint, trigger)


# ---------------------------------------------------------------- T5 / T6 --
def log_volume_stream(logs: DataFrame, width: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """T5: lines per service per tumbling minute; the watermark bounds state
    and closes windows (append emits each window once)."""
    d = logs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return (d.groupBy(F.window("ts", width).alias("w"), "service").agg(F.count(F.lit(1)).alias("lines"))
            .select("service", F.col("w.start").alias("window_start"), "lines"))


def request_rate_stream(requests: DataFrame, width: str = "5 minutes", step: str = "30 seconds",
                        watermark: str = WATERMARK) -> DataFrame:
    """Per-second request rate by service and status over a sliding
    window evaluated every step."""
    from vigil.operators.metrics import span_seconds
    d = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return (d.groupBy(F.window("ts", width, step).alias("w"), "service", "status")
            .agg((F.count(F.lit(1)) / F.lit(span_seconds(width))).alias("rate"))
            .select("service", "status", F.col("w.start").alias("window_start"), "rate"))


# ---------------------------------------------------------------- T3/T4/T7/T8
def foreach_batch(stream: DataFrame, name: str, fn: Callable[[DataFrame, int], None],
                  checkpoint: str | None = None, trigger: dict | None = None):
    return (stream.writeStream.foreachBatch(fn)
            .option("checkpointLocation", _checkpoint(stream.sparkSession, name, checkpoint))
            .trigger(**(trigger or {"availableNow": True})).start())


def write_batch(df: DataFrame, path: str, epoch: int, partition_by: list[str] = [], sort: list[str] = [],
                fmt: str = "parquet") -> None:
    """Exactly-once append of one micro-batch: its rows lie in partitions of
    their own (``batch``), and writing a batch again replaces just these."""
    d = df.withColumn("batch", F.lit(epoch).cast("long"))
    d = d.sortWithinPartitions(*sort) if sort else d
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt) \
        .partitionBy(*partition_by, "batch").save(path)


CATALOG = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("genres", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("year", T.IntegerType()), T.StructField("rating", T.DoubleType())])


def catalog_table(spark: SparkSession, path: str) -> VersionedTable:
    """The catalog as readers see it: whole versions, one a micro-batch."""
    return VersionedTable(spark, path, CATALOG, hash_part(["id"]))


def article_ingest_batch(articles_log: str, catalog_path: str, year: int) -> Callable[[DataFrame, int], None]:
    """Story records -> articles change log (by batch; latest-wins on read)
    -> the catalog's rows of the batch's ids replaced in a new version."""
    def fn(batch: DataFrame, epoch: int) -> None:
        st = G.structure_stories(batch).withColumn("scraped_epoch", F.lit(epoch))
        write_batch(st, articles_log, epoch, sort=["id"])
        latest = W.latest_wins(st, ["id"], "scraped_epoch")
        catalog_table(batch.sparkSession, catalog_path).upsert(RC.articles_to_catalog(latest, year), ["id"], epoch)
    return fn


def engagement_ingest_batch(catalog: DataFrame, events_path: str, quarantine_path: str,
                            counter_path: str, retrain: Callable[[], None] | None = None
                            ) -> Callable[[DataFrame, int], None]:
    """T4 + S13 + M9: validate, write accepted events by month (sorted by user
    and time), quarantine rejects, and call ``retrain`` once 50 or more
    accepted events arrived since the last retrain.

    The ledger (one row a batch: accepted events, whether it retrained) decides
    that, so it holds across restarts, and a batch that runs again neither
    counts twice nor retrains again after its row is written."""
    spark = catalog.sparkSession
    ledger = "n long, retrained boolean, batch long"
    spark.createDataFrame([(0, False, -1)], ledger).write.mode("ignore").partitionBy("batch").parquet(counter_path)

    def fn(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        ok, bad = RC.validate_engagement(batch, catalog)
        from pyspark.sql import Observation
        obs = Observation(f"engagement-{epoch}")
        ok_obs = W.with_month(ok).observe(obs, F.count(F.lit(1)).alias("n"))
        write_batch(ok_obs, events_path, epoch, ["yyyymm"], ["user_id", "ts"])
        write_batch(bad, quarantine_path, epoch)
        n = int(obs.get.get("n", 0))
        rows = spark.read.schema(ledger).parquet(counter_path)
        last = F.coalesce(F.max(F.when(F.col("retrained") & (F.col("batch") < epoch), F.col("batch"))), F.lit(-2))
        before = rows.agg(last.alias("last"), F.bool_or(F.col("retrained") & (F.col("batch") == epoch)).alias("done")).first()
        since = F.coalesce(F.sum(F.when((F.col("batch") > before.last) & (F.col("batch") < epoch), F.col("n"))), F.lit(0))
        due = retrain is not None and rows.agg(RC.retrain_due(since + n)).first()[0]
        if due and not before.done:
            retrain()
        write_batch(spark.createDataFrame([(n, bool(due))], "n long, retrained boolean"), counter_path, epoch)
    return fn


ALERTS = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("threshold_id", T.StringType()),
    T.StructField("container", T.StringType()), T.StructField("triggered_ms", T.LongType()),
    T.StructField("resolved_ms", T.LongType()), T.StructField("value", T.DoubleType())])
_ALERT_KEYS = ["project", "threshold_id", "container"]


def alerts_table(spark: SparkSession, path: str) -> VersionedTable:
    """Alerts with their trigger and resolve times; the newest one of a key is
    the key's state."""
    return VersionedTable(spark, path, ALERTS, hash_part(_ALERT_KEYS))


def alert_ingest_batch(alerts_path: str, rules: DataFrame, cooldown_ms: int = A.COOLDOWN_MS
                       ) -> Callable[[DataFrame, int], None]:
    """T1 + T7 across micro-batches: threshold state kept in the alerts table.

    Batches hold samples, or acknowledgements of all alerts of a project (rows
    with ``acknowledged`` true), each with a ``ts``.  The newest alert of each
    key comes back as the samples that made it (one that triggers and, once
    resolved, one that does not), so a batch continues where the last one
    stopped; its alerts replace those of the same trigger time.  Samples of a
    key must arrive in time order from batch to batch.  A replayed batch starts
    from the version before it and writes the same version again."""
    def fn(batch: DataFrame, epoch: int) -> None:
        table = alerts_table(batch.sparkSession, alerts_path)
        held = table._read(table.manifest(below=epoch))
        newest = held.groupBy(*_ALERT_KEYS).agg(
            F.max_by(F.struct("triggered_ms", "resolved_ms", "value"), "triggered_ms").alias("a")) \
            .select(*_ALERT_KEYS, "a.*")
        acks = batch.where(F.coalesce("acknowledged", F.lit(False))).select("project", "ts")
        long = A.samples_long(batch.where(~F.coalesce("acknowledged", F.lit(False))))
        evals = A.evaluate_thresholds(long, rules).withColumn("container", F.coalesce("container", F.lit("")))
        meta = ["threshold_id", "threshold_name", "metric", "threshold", "severity"]
        names = evals.select(*meta).unionByName(_rule_names(rules).select(*meta)).dropDuplicates(["threshold_id"])
        cols = [*_ALERT_KEYS, "ts", "sample_id", "breached", "value"]

        def made(ms: str, breached: bool) -> DataFrame:
            return newest.where(F.col(ms).isNotNull()).select(
                *_ALERT_KEYS, F.timestamp_millis(ms).alias("ts"), F.lit(-1).cast("long").alias("sample_id"),
                F.lit(breached).alias("breached"), "value")
        # only the first acknowledgement at or after a sample that may trigger can resolve its alert
        acks = acks.select("project", F.col("ts").cast("timestamp").alias("_ack"),
                           F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("_at")).where("_at IS NOT NULL")
        may = evals.where("breached").select(*_ALERT_KEYS, F.unix_millis(F.col("ts").cast("timestamp")).alias("_ms")) \
            .unionByName(newest.select(*_ALERT_KEYS, F.col("triggered_ms").alias("_ms"))).where("_ms IS NOT NULL")
        times = may.select("project", "_ms").distinct().withColumn("_t0", F.timestamp_millis("_ms"))
        first = asof_join(times, acks, ["project"], "_t0", "_at", ["_ack"], backward=False, tie="_ack") \
            .where("_ack IS NOT NULL").select("project", "_ms", "_ack")
        quiet = may.join(first, ["project", "_ms"]).select(*_ALERT_KEYS, "_ack").distinct().select(
            *_ALERT_KEYS, F.col("_ack").alias("ts"), F.lit(1 << 62).alias("sample_id"),
            F.lit(False).alias("breached"), F.lit(None).cast("double").alias("value"))
        rows = evals.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("sample_id", F.col("sample_id").cast("long")) \
            .select(*cols).unionByName(made("triggered_ms", True)).unionByName(made("resolved_ms", False)).unionByName(quiet)
        out = A.alert_history(rows.join(names, "threshold_id"), cooldown_ms=cooldown_ms)
        out = out.select(*[F.col(f.name).cast(f.dataType) for f in ALERTS.fields])
        table.upsert(cut_lineage(out), [*_ALERT_KEYS, "triggered_ms"], epoch)
    return fn


def _rule_names(rules: DataFrame) -> DataFrame:
    return rules.select(F.col("id").alias("threshold_id"), F.col("name").alias("threshold_name"), "metric",
                        F.col("value").alias("threshold"), "severity")


def metrics_ingest_batch(snapshots_path: str, evaluations_path: str, rules: DataFrame,
                         alerts_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """T7 + S15: write snapshots that carry at least one container (by day),
    evaluate the thresholds of the batch and, with ``alerts_path``, carry the
    trigger / resolve state on (``alert_ingest_batch``)."""
    def fn(batch: DataFrame, epoch: int) -> None:
        from vigil.operators.metrics import snapshots_to_samples
        keep = batch.filter(F.size("containers") > 0)
        keep = keep.withColumn("dt", F.to_date(F.timestamp_millis("timestamp")))
        write_batch(keep, snapshots_path, epoch, ["dt"], ["projectName", "timestamp"])
        s = snapshots_to_samples(keep).withColumn("sample_id", F.col("timestamp"))
        write_batch(A.evaluate_thresholds(A.samples_long(s), rules), evaluations_path, epoch)
        if alerts_path is not None:
            alert_ingest_batch(alerts_path, rules)(s.withColumn("acknowledged", F.lit(False)), epoch)
    return fn


def event_fanout_batch(raw_path: str, typed_path: str) -> Callable[[DataFrame, int], None]:
    """Every raw event to the first sink; decodable events also to the
    typed sink."""
    def fn(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        write_batch(batch, raw_path, epoch, fmt="json")
        parsed = C.parse_events(batch)
        typed = parsed.filter(~F.col("is_malformed") & F.col("eventType").isNotNull()).drop("is_malformed")
        write_batch(typed, typed_path, epoch, fmt="json")
        batch.unpersist()
    return fn


def run_to_table(df: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Drive an append-mode streaming DataFrame to completion (availableNow)
    into a parquet table in the shared folder and return it as a batch
    DataFrame (nothing passes through the driver)."""
    spark = df.sparkSession
    out = scratch_path(spark, f"sink-{name}")
    q = (df.writeStream.outputMode("append").format("parquet")
         .option("checkpointLocation", _checkpoint(spark, name, checkpoint))
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def stage_files(df: DataFrame, name: str, files: int = 8, order: str | None = None) -> tuple[str, T.StructType]:
    """Write a batch DataFrame as a directory of parquet files to feed a file
    stream (the local stand-in for a topic); returns (path, schema)."""
    path = scratch_path(df.sparkSession, f"stage-{name}")
    d = df.repartitionByRange(files, order) if order else df.repartition(files)
    d.write.mode("overwrite").parquet(path)
    return path, d.schema
