"""Specified-only operators and small record parsers."""
import json

from pyspark.sql import functions as F

from vigil.operators import extensions as X
from vigil.operators import ingest as G
from vigil.operators import release as R


def test_dead_letter(spark):
    a = spark.createDataFrame([("m1", "t", 1, False, "x"), ("m1", "t", 2, False, "x"), ("m1", "t", 3, False, "x"),
                               ("m2", "t", 1, False, "y"), ("m2", "t", 2, True, "y")],
                              "message_id string, topic string, attempt int, ok boolean, payload string")
    dl, cnt = X.dead_letter(a)
    assert [r.message_id for r in dl.collect()] == ["m1"] and cnt.first().dead_letters == 1


def test_rank_suggestions(spark):
    s = spark.createDataFrame([("a", 10, "critical", 0.5, 0.9), ("b", 5, "low", 1.0, 0.1)],
                              "description string, frequency long, severity string, ease double, confidence double")
    r = {x.description: x.priority_score for x in X.rank_suggestions(s).collect()}
    assert abs(r["a"] - (0.3 + 0.3 + 0.1 + 0.18)) < 1e-12 and r["a"] > r["b"]


def test_fix_lookup_latest(spark):
    inc = spark.createDataFrame([(1, "t")], "incident_id long, title string")
    fx = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "incident_id long, outcome string, applied_at long")
    assert X.fix_lookup(inc, fx).first().fix.outcome == "new"


def test_snapshot_regression_and_slo(spark):
    rows = [(i, 100.0) for i in range(5)] + [(5, 125.0), (6, 70.0)]
    d = spark.createDataFrame([("s", i, v) for i, v in rows], "service string, o long, p95_ms double")
    r = {x.o: (x.regression, x.improvement) for x in R.snapshot_regression(d, ["service"], ["o"]).collect()}
    assert r[5] == (True, False) and r[0] == (False, False)
    s = spark.createDataFrame([(0.04, 1999.0, 60000.0)], "error_ratio double, p99_ms double, recovery_ms double")
    assert R.slo_check(s, R.CHAOS_SLO, at_most=True).first().slo_met is True


def test_exposition_and_stats(spark):
    lines = spark.createDataFrame([("a", 'http_server_requests_seconds{quantile="0.95",uri="/x"} 1.5E-1'),
                                   ("a", 'http_server_requests_seconds_count{status="200",uri="/x"} 98.0'),
                                   ("a", 'http_server_requests_seconds_count{status="503",uri="/x"} 2.0'),
                                   ("a", "# HELP x")], "svc string, value string")
    r = G.structure_exposition(lines, ["svc"]).first()
    assert abs(r.p95_ms - 150.0) < 1e-9 and r.status_5xx == 2.0 and abs(r.error_rate_pct - 2.0) < 1e-12
    st = spark.createDataFrame([(json.dumps({"Name": "c", "CPUPerc": "1.5%", "MemPerc": "2%",
                                             "MemUsage": "512MiB / 2GiB", "NetIO": "1kB / 2MB"}),)], "value string")
    s = G.structure_container_stats(st).first()
    assert (s.cpu_pct, s.mem_usage, s.mem_limit, s.net_rx, s.net_tx) == (1.5, 512 * 1024 ** 2, 2 * 1024 ** 3, 1024.0,
                                                                          2 * 1024 ** 2)


def test_orchestrator_service_environment(spark):
    ev = [json.dumps({"type": t, "reason": "r", "message": "m", "count": 1, "lastTimestamp": f"2024-01-01T00:00:{i:02d}Z",
                      "involvedObject": {"kind": "Pod", "name": f"p{i}"}}) for i, t in
          enumerate(["Normal"] * 35 + ["Warning"] * 12)]
    d = G.structure_orchestrator_events(spark.createDataFrame([(x,) for x in ev], "value string"))
    assert d.filter(F.col("recent_rank").isNotNull()).count() == 30
    assert d.filter(F.col("warning_rank").isNotNull()).count() == 10
    sv = spark.createDataFrame([("p", json.dumps({"Service": "a", "State": "running", "Health": "unhealthy"})),
                                ("p", json.dumps({"Service": "b", "State": "running"})),
                                ("q", json.dumps({"Service": "c", "State": "running"}))], "project string, value string")
    r = {(x.project, x.service): (x.state, x.project_running) for x in G.structure_service_state(sv).collect()}
    assert r[("p", "a")] == ("unhealthy", False) and r[("q", "c")] == ("running", True)
    env = spark.createDataFrame([(json.dumps({"name": "app-pr-42", "revision": "abcdef123"}),)], "value string")
    e = G.structure_environments(env).first()
    assert (e.revision, e.sync, e.is_pr, e.pr_number) == ("abcdef1", "Unknown", True, "42")


def test_vector_similar_equals_brute_force(spark):
    import random
    rnd = random.Random(11)
    centers = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(160):
        c = centers[i % 4]
        rows.append((i, [float(x + rnd.gauss(0, 0.6)) for x in c]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.similar_id) for r in X.vector_similar(df).collect()}

    def unit(v):
        import math
        v = [float(__import__("numpy").float32(x)) for x in v]
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]
    us = {i: unit(v) for i, v in rows}
    cand = {}
    for a in us:
        for b in us:
            if a != b:
                c = sum(x * y for x, y in zip(us[a], us[b]))
                if c >= 0.75:
                    cand.setdefault(a, []).append((-c, b))
    exp = {(a, b) for a, lst in cand.items() for _, b in sorted(lst)[:5]}
    assert len(exp) > 50 and got == exp
