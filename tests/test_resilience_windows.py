"""Probe statistics of chaos windows: slices against a join and plain loops."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import resilience as X

T0 = dt.datetime(2024, 1, 1)


def _tables(spark, n=400):
    rng = random.Random(3)
    at = [T0 + dt.timedelta(seconds=rng.randrange(1500), microseconds=rng.choice([0, 1, 500000])) for _ in range(n)]
    probes = [(i, t, rng.choice([200, 404, 500, None]), rng.choice([None, rng.random() * 300, 50.0])) for i, t in enumerate(at)]
    probes += [(9000, None, 200, 1.0)]
    runs = [("p", i, "pod-kill", t) for i, t in enumerate(at[:60])]
    runs += [("p", 5, "pod-kill", at[5]), ("p", 6, "pod-kill", at[90]), ("p", None, "pod-kill", at[3]),
             ("p", 700, "kafka-down", T0 + dt.timedelta(days=2)), ("p", 701, "kafka-down", None)]
    return (spark.createDataFrame(probes, "request_id long, ts timestamp, status int, latency_ms double"),
            spark.createDataFrame(runs, "project string, run_id long, scenario string, start_ts timestamp"))


@pytest.mark.parametrize("rows", [100_000, 40])
def test_sliced_windows_equal_the_join(spark, monkeypatch, rows):
    monkeypatch.setattr(X, "WINDOW_SLICE_ROWS", rows)
    probes, runs = _tables(spark)
    got = {r.run_id: r for r in X.chaos_run_summary(probes, runs).collect() if r.run_id is not None}
    p = probes.select(F.col("ts").alias("_pt"), F.col("status").alias("_st"), F.col("latency_ms").alias("_lat"))
    r = runs.where("run_id IS NOT NULL AND start_ts IS NOT NULL").withColumnRenamed("start_ts", "_start")
    want = {r.run_id: r for r in X._joined_windows(p, r, 120).collect()}
    assert len(want) > 50
    for i, g in got.items():
        w = want.get(i)
        assert (g.requests, g.errors) == ((w.requests, w.errors) if w else (0, 0))
        for c in ("avg_latency_ms", "p99_ms"):
            assert getattr(g, c) == (pytest.approx(getattr(w, c)) if w and getattr(w, c) is not None else None)


def test_a_probe_is_not_copied_once_a_window(spark, monkeypatch):
    def joined(*_):
        raise AssertionError("runs of one start time each need no join")
    monkeypatch.setattr(X, "_joined_windows", joined)
    probes, runs = _tables(spark)
    runs = runs.where("run_id IN (1, 2, 3, 700)")
    assert X.chaos_run_summary(probes, runs).count() == 4
