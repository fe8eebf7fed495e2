"""Root-cause analysis composite on hand-made projects."""
import datetime as dt

from vigil.operators import incidents as I
from vigil.plans import analysis as AN

T0 = dt.datetime(2024, 1, 1)


def test_analyze_quiet_and_noisy_projects(spark):
    logs = [(i, T0 + dt.timedelta(minutes=i), "api", "error: OOMKilled memory limit reached", "noisy") for i in range(3)]
    logs += [(10 + i, T0 + dt.timedelta(minutes=i), "api", "all fine", "quiet") for i in range(3)]
    logs = spark.createDataFrame(logs, "log_id long, ts timestamp, service string, message string, project string")
    samples = spark.createDataFrame([(1, T0, "noisy", "c1", 10.0, 10.0), (2, T0, "quiet", "c2", 10.0, 10.0)],
                                    "sample_id long, ts timestamp, project string, container string, "
                                    "cpu_pct double, mem_pct double")
    commits = spark.createDataFrame([(100, T0 + dt.timedelta(minutes=30), "abcdef123", "fix", "noisy")],
                                    "commit_id long, ts timestamp, sha string, message string, project string")
    incidents = spark.createDataFrame([(1, "old OOMKilled outage", "container memory limit exceeded", "en")],
                                      "incident_id long, title string, description string, tag string")
    r = {x.project: x for x in AN.analyze(logs, samples, commits, incidents, I.patterns_df(spark)).collect()}
    assert r["quiet"].finding == "No issues detected" and r["quiet"].confidence == 90
    n = r["noisy"]
    assert n.finding == "Memory exhaustion detected" and n.severity == "critical"
    assert n.top_pattern == "OOMKilled Container" and n.root_cause == "Memory leak"
    assert n.correlations >= 1 and 20 < n.confidence <= 95
    assert n.top_fix == "Increase container memory limits"
    rec = AN.record_incidents(AN.analyze(logs, samples, commits, incidents, I.patterns_df(spark))).collect()
    assert [x.project for x in rec] == ["noisy"]
