"""foreachBatch jobs (T3, T4, T7, T8) and the windowed stream (T5)."""
import datetime as dt
import json

from pyspark.sql import functions as F

from vigil.operators import alerts as A
from vigil.streaming import jobs as S


def _text_stream(spark, path, lines):
    path.mkdir(parents=True, exist_ok=True)
    (path / "part-0.txt").write_text("\n".join(lines) + "\n")
    return spark.readStream.format("text").load(str(path))


def test_event_fanout(spark, tmp_path):
    good = json.dumps({"eventId": "1", "eventType": "greeting", "name": "hi"})
    raw = _text_stream(spark, tmp_path / "in", [good, "garbage"])
    q = S.foreach_batch(raw, "fanout", S.event_fanout_batch(str(tmp_path / "raw"), str(tmp_path / "typed")),
                        checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.json(str(tmp_path / "raw")).count() == 2
    assert spark.read.json(str(tmp_path / "typed")).count() == 1


def test_engagement_ingest_and_retrain(spark, tmp_path):
    cat = spark.createDataFrame([(1, "a", ["x"], ["y"], 5.0)], "id long, title string, genres array<string>, "
                                                               "tags array<string>, rating double")
    rows = [(i, dt.datetime(2024, 1, 1 + i % 20), 7, 1, "view_start", 1.0) for i in range(60)]
    rows += [(100, dt.datetime(2024, 1, 2), 7, 2, "view_start", 1.0), (101, dt.datetime(2024, 1, 2), 7, 1, "bogus", 1.0)]
    src = tmp_path / "ev"
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, item_id long, event_type string, "
                                "value double").write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    calls = []
    fn = S.engagement_ingest_batch(cat, str(tmp_path / "events"), str(tmp_path / "bad"), str(tmp_path / "ctr"),
                                   retrain=lambda: calls.append(1))
    S.foreach_batch(stream, "eng", fn, checkpoint=str(tmp_path / "ck")).awaitTermination()
    ev = spark.read.parquet(str(tmp_path / "events"))
    assert ev.count() == 60 and "yyyymm" in ev.columns
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2
    assert calls == [1]


def test_metrics_ingest_skips_http_only(spark, tmp_path):
    from vigil.sources.files import METRICS_SCHEMA
    snaps = [{"timestamp": 1704067200000, "projectName": "p", "containers": [{"name": "c", "cpuPercent": 97.0,
                                                                              "memoryPercent": 10.0}]},
             {"timestamp": 1704067260000, "projectName": "p", "containers": [], "http": {"totalRequests": 5}}]
    d = tmp_path / "in"
    d.mkdir()
    (d / "m.json").write_text("\n".join(json.dumps(x) for x in snaps))
    stream = spark.readStream.schema(METRICS_SCHEMA).json(str(d))
    fn = S.metrics_ingest_batch(str(tmp_path / "snap"), str(tmp_path / "eval"), A.default_thresholds(spark))
    S.foreach_batch(stream, "met", fn, checkpoint=str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 1
    ev = spark.read.parquet(str(tmp_path / "eval"))
    assert ev.filter(F.col("breached")).select("threshold_id").distinct().count() == 2   # cpu-high, cpu-critical


def test_article_ingest_latest_wins(spark, tmp_path):
    items = [{"id": 1, "type": "story", "title": "Rust compiler news", "score": 10, "time": 1},
             {"id": 2, "type": "job", "title": "hiring", "score": 1, "time": 1},
             {"id": 3, "type": "story", "title": "", "score": 1, "time": 1}]
    raw = _text_stream(spark, tmp_path / "in", [json.dumps(x) for x in items])
    fn = S.article_ingest_batch(str(tmp_path / "articles"), str(tmp_path / "catalog"), 2024)
    S.foreach_batch(raw, "art", fn, checkpoint=str(tmp_path / "ck")).awaitTermination()
    cat = S.catalog_table(spark, str(tmp_path / "catalog")).read().collect()
    assert len(cat) == 1 and cat[0].id == "hn-1" and cat[0].genres == ["rust", "systems"]


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_replayed_batches_change_nothing(spark, tmp_path):
    """Every foreachBatch sink is given batch 0, batch 1 and batch 1 again."""
    cat = spark.createDataFrame([(1, "a", ["x"], ["y"], 5.0)], "id long, title string, genres array<string>, "
                                                               "tags array<string>, rating double")
    schema = "event_id long, ts timestamp, user_id long, item_id long, event_type string, value double"
    parts = [spark.createDataFrame([(100 * b + i, dt.datetime(2024, 1 + b, 1), 7, 1 + i % 2, "view_start", 1.0)
                                    for i in range(60)], schema) for b in range(3)]
    calls = []
    paths = [str(tmp_path / x) for x in ("events", "bad", "ctr")]
    fn = S.engagement_ingest_batch(cat, *paths, retrain=lambda: calls.append(1))
    for epoch, b in ((0, parts[0]), (1, parts[1]), (1, parts[1]), (2, parts[2])):
        fn(b, epoch)
    assert spark.read.parquet(paths[0]).count() == 90 and spark.read.parquet(paths[1]).count() == 90
    # 30, 60 (due), again 60 (its row is there), 30 since then
    assert calls == [1]
    assert sorted((r.batch, r.n, r.retrained) for r in spark.read.parquet(paths[2]).collect()) == [
        (-1, 0, False), (0, 30, False), (1, 30, True), (2, 30, False)]
    raw = [spark.createDataFrame([(json.dumps({"eventId": str(b), "eventType": "greeting"}),)], "value string") for b in range(2)]
    fan = S.event_fanout_batch(str(tmp_path / "raw"), str(tmp_path / "typed"))
    for epoch in (0, 1, 1):
        fan(raw[epoch], epoch)
    assert spark.read.json(str(tmp_path / "raw")).count() == 2
    assert spark.read.json(str(tmp_path / "typed")).count() == 2


def test_catalog_versions_touch_only_changed_parts(spark, tmp_path):
    def stories(ids, score):
        return spark.createDataFrame([(json.dumps({"id": i, "type": "story", "title": f"Rust {i}", "score": score, "time": 1}),)
                                      for i in ids], "value string")
    fn = S.article_ingest_batch(str(tmp_path / "log"), str(tmp_path / "cat"), 2024)
    fn(stories(range(300), 10), 0)
    before = _files(tmp_path / "cat" / "data")
    for _ in range(2):
        fn(stories([5, 500], 900), 1)
    after = _files(tmp_path / "cat" / "data")
    assert all(after[p] == t for p, t in before.items())            # nothing that a reader uses was rewritten
    assert len({p for p in after if "/v=1/" in p}) <= 2
    rows = {r.id: r.rating for r in S.catalog_table(spark, str(tmp_path / "cat")).read().collect()}
    assert len(rows) == 301 and rows["hn-5"] == rows["hn-500"] > rows["hn-6"]
    assert spark.read.parquet(str(tmp_path / "log")).count() == 302


def test_versioned_table_upsert_delete_and_replay(spark, tmp_path):
    from vigil.operators.versioned import VersionedTable, day_part
    schema = "id long, ts timestamp, v string"
    rows = [(i, dt.datetime(2024, 1, 1 + i % 5, 3), f"a{i}") for i in range(50)]
    df = spark.createDataFrame(rows, schema)
    t = VersionedTable(spark, str(tmp_path / "t"), df.schema, day_part("ts"))
    assert t.read().count() == 0
    t.upsert(df, ["id"], 0)
    new = spark.createDataFrame([(0, rows[0][1], "b0"), (5, rows[5][1], "b5"), (0, rows[0][1], "c0")], schema)
    one = t.upsert(new, ["id"], 1, [F.col("v")])
    assert t.upsert(new, ["id"], 1, [F.col("v")]) == one and len(one) == 1
    got = {r.id: r.v for r in t.read().collect()}
    assert len(got) == 50 and got[0] == "c0" and got[5] == "b5" and got[1] == "a1"
    for _ in range(2):
        gone = t.delete(F.col("ts") < F.lit("2024-01-03").cast("timestamp"), 2)
    assert len(gone) == 2 and {r.id % 5 for r in t.read().collect()} == {2, 3, 4}
    assert t.upsert(df.limit(0), ["id"], 3) == [] and t.read().count() == 30


def test_alert_state_over_batches_equals_the_whole_history(spark, tmp_path):
    """Samples in time order, cut into batches anywhere, with acknowledgements
    and a replayed batch, against one fold over everything."""
    import random
    rng = random.Random(8)
    rows, acks = [], []
    t0 = 1704067200000
    for i in range(240):
        ms = t0 + i * 7000
        for c in ("c1", "c2"):
            rows.append(("p", c, ms, 2 * i + (c == "c2"), rng.choice([10.0, 97.0, 97.0]), 50.0))
        if i % 50 == 33:
            acks.append(("p", ms + 1))
    active, last, want = {}, {}, []
    events = [(ms, 0, k, (c, cpu)) for _, c, ms, k, cpu, _ in rows] + [(ms, 1, 0, None) for _, ms in acks]
    limits = {"cpu-high": 80.0, "cpu-critical": 95.0}
    rules = A.default_thresholds(spark)
    limits = {r.id: r.value for r in rules.filter("metric = 'cpu'").collect()}
    for ms, ack, _, x in sorted(events, key=lambda e: e[:3]):
        if ack:
            for k in list(active):
                want.append((*k, active.pop(k), ms))
            continue
        for rule, limit in limits.items():
            k = (rule, x[0])
            if x[1] > limit:
                if k not in active and ms - last.get(k, -10**15) >= A.COOLDOWN_MS:
                    active[k] = last[k] = ms
            elif k in active:
                want.append((*k, active.pop(k), ms))
    want += [(*k, ms, None) for k, ms in active.items()]
    schema = "project string, container string, ms long, sample_id long, cpu_pct double, mem_pct double"
    s = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ms")).drop("ms").withColumn("acknowledged", F.lit(False))
    a = spark.createDataFrame(acks, "project string, ms long").select("project", F.timestamp_millis("ms").alias("ts"),
                                                                      F.lit(True).alias("acknowledged"))
    both = s.unionByName(a, allowMissingColumns=True)
    fn = S.alert_ingest_batch(str(tmp_path / "alerts"), rules)
    cuts = [t0, t0 + 400_000, t0 + 407_000, t0 + 1_100_000, t0 + 10**9]
    for epoch, (x, y) in enumerate(zip(cuts, cuts[1:])):
        part = both.where((F.unix_millis("ts") >= x) & (F.unix_millis("ts") < y))
        for _ in range(2 if epoch == 2 else 1):
            fn(part, epoch)
    got = [(r.threshold_id, r.container, r.triggered_ms, r.resolved_ms)
           for r in S.alerts_table(spark, str(tmp_path / "alerts")).read().filter("threshold_id LIKE 'cpu%'").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[3] is None for r in want)


def test_acknowledgements_are_not_paired_with_all_keys(spark, tmp_path, monkeypatch):
    import datetime as dt
    t0, rows = dt.datetime(2024, 1, 1), []
    s = spark.createDataFrame([(i, t0 + dt.timedelta(seconds=i), "p", f"c{i % 10}", 99.0 if i == 7 else 1.0, 1.0) for i in range(20)],
                              "sample_id long, ts timestamp, project string, container string, cpu_pct double, mem_pct double")
    a = spark.createDataFrame([("p", t0 + dt.timedelta(seconds=i, milliseconds=500), True) for i in range(200)],
                              "project string, ts timestamp, acknowledged boolean")
    plain = S.A.alert_history

    def counted(evals, **kw):
        rows.append(evals.count())
        return plain(evals, **kw)
    monkeypatch.setattr(S.A, "alert_history", counted)
    S.alert_ingest_batch(str(tmp_path / "alerts"), S.A.default_thresholds(spark))(
        s.withColumn("acknowledged", F.lit(False)).unionByName(a, allowMissingColumns=True), 0)
    got = {(r.threshold_id, r.resolved_ms - r.triggered_ms) for r in S.alerts_table(spark, str(tmp_path / "alerts")).read().collect()}
    assert got == {("cpu-high", 500), ("cpu-critical", 500)} and rows[0] <= 20 * 4 + 4
