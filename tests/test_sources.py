"""File sources: permissive reads, quarantine, validation, fallbacks."""
import json

from vigil.sources import files as S


def test_metrics_quarantine(spark, tmp_path):
    p = tmp_path / "metrics-2024.jsonl"
    good = {"timestamp": 1, "projectName": "a", "containers": [{"name": "c", "cpuPercent": 1.0}]}
    p.write_text(json.dumps(good) + "\n\n{broken\n" + json.dumps(dict(good, timestamp=2)) + "\n")
    ok, bad = S.read_metrics(spark, str(tmp_path))
    assert sorted(r.timestamp for r in ok.collect()) == [1, 2]
    assert bad.count() == 1


def test_deployments_validated_newest_first(spark, tmp_path):
    rows = [{"id": str(i), "timestamp": i, "projectName": "a", "gitSha": "abc", "status": "success",
             "regression": False} for i in range(60)]
    rows.append({"id": "x", "timestamp": 99, "projectName": "a", "gitSha": "abc", "status": "weird",
                 "regression": False})
    p = tmp_path / "deployments.jsonl"
    p.write_text("\n".join(json.dumps(r) for r in rows) + "\nnot json\n")
    ok, bad = S.read_deployments(spark, str(p))
    ts = [r.timestamp for r in ok.collect()]
    assert len(ts) == 50 and max(ts) == 59 and 99 not in ts
    assert bad.count() == 2


def test_patterns_fallback_and_missing(spark, tmp_path):
    builtin = S.read_patterns(spark, str(tmp_path / "none.json"))
    assert sorted(r["ord"] for r in builtin.select("ord").collect()) == list(range(8))
    assert S.read_json_array(spark, str(tmp_path / "none.json"), S.INCIDENT_SCHEMA).count() == 0


def test_latest_run_file(spark, tmp_path):
    for name in ("perf-2024-01-01.json", "perf-2024-02-01.json"):
        (tmp_path / name).write_text(json.dumps({"duration": name}))
    from pyspark.sql import types as T
    runs = S.read_run_results(spark, str(tmp_path), T.StructType([T.StructField("duration", T.StringType())]))
    assert S.latest_run(runs).first().duration == "perf-2024-02-01.json"


def test_csv_export_sink(spark, tmp_path):
    from vigil.operators import metrics as M
    snaps = spark.createDataFrame(
        [(1704067200000, "p", [("c", 12.345, 50.0, None, None, None, None)],
          (5.0, None, None, None, None, None, None, None, None))], S.METRICS_SCHEMA)
    M.export_csv(snaps, str(tmp_path / "csv"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert len(rows) == 1 and rows[0].cpuPercent in ("12.35", "12.34") and rows[0].httpTotalRequests == "5"
    assert list(rows[0].asDict()) == M.CSV_COLUMNS
