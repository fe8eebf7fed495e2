"""Ingest parsers and warehouse upserts on hand-written records."""
import json

from pyspark.sql import functions as F

from vigil.operators import ingest as G
from vigil.operators import warehouse as W
from vigil.operators import classifier as C


def lines(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "value string")


def test_container_logs(spark):
    d = G.structure_container_logs(lines(spark, [
        "api  | 2024-01-01T00:00:00Z boom", "   ", "no separator here"]), ingest_ts="2024-02-02 00:00:00")
    r = {x.service: (x.message, str(x.ts)) for x in d.collect()}
    assert r["api"] == ("boom", "2024-01-01 00:00:00")
    assert r["unknown"] == ("no separator here", "2024-02-02 00:00:00")


def test_commits_keep_pipes(spark):
    d = G.structure_commits(lines(spark, ["abc|me|2024-01-01T00:00:00+02:00|fix | pipes", "bad|line"]))
    r = d.collect()
    assert len(r) == 1 and r[0].message == "fix | pipes" and str(r[0].ts) == "2023-12-31 22:00:00"


def test_pods_and_runs(spark):
    pod = {"metadata": {"name": "p"}, "status": {"phase": "Running",
           "conditions": [{"type": "Ready", "status": "False"}], "containerStatuses": [{"restartCount": 2},
                                                                                     {"restartCount": 3}]}}
    r = G.structure_pods(lines(spark, [json.dumps(pod)])).first()
    assert (r.ready, r.restarts, r.unhealthy) == (False, 5, True)
    run = {"id": "7", "result": None, "durationMillis": 1500, "stages": [{"name": "b", "status": "SUCCESS",
                                                                        "durationMillis": 400}]}
    r = G.structure_pipeline_runs(lines(spark, [json.dumps(run)])).first()
    assert (r.status, r.duration_s, r.stage_status, r.stage_s) == ("running", 2, "success", 0)


def test_upsert_field_merge(spark):
    cur = spark.createDataFrame([(1, "open", "t1", None, 0)], "id long, status string, title string, "
                                                               "resolved_at long, v long")
    ch = spark.createDataFrame([(1, "resolved", None, 5), (1, None, "t2", 7)], "id long, status string, title string, v long")
    r = W.upsert(cur, ch, ["id"], "v", stamp_resolved="resolved_at").first()
    assert (r.status, r.title, r.resolved_at) == ("resolved", "t2", 5)


def test_latest_wins(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")], "id long, v long, s string")
    assert sorted(map(tuple, W.latest_wins(d, ["id"], "v").collect())) == [(1, 3, "c"), (2, 1, "x")]


def test_classifier_edges(spark):
    m = C.fit_event_classifier(C.training_frame(spark))
    raw = lines(spark, [json.dumps({"eventId": "e1", "name": "hello"}), "not json at all", json.dumps({})])
    got = {r.eventId: (r.category, r.confidence) for r in C.classify_events(C.parse_events(raw), m).collect()}
    assert got["e1"][0] == "greeting"
    assert got["unknown"] is not None
    meta = C.classifier_metadata(C.training_frame(spark)).first()
    assert (meta.n_samples, meta.n_classes) == (36, 5)


def test_greetings_by_name(spark):
    g = spark.createDataFrame([(1, "Alice"), (2, "ALICE"), (3, "bob")], "id long, name string")
    assert sorted(r.id for r in W.greetings_by_name(g, "alice").collect()) == [1, 2]
