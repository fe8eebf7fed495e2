"""Gaps, ties and copies: cases with a brute-force answer."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vigil.operators import extensions as X
from vigil.operators import incidents as I
from vigil.operators import release as R

T0 = dt.datetime(2024, 1, 1)


def _at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def _requests(spark, rows):
    return spark.createDataFrame([(i, s, _at(m), st) for i, (s, m, st) in enumerate(rows)],
                                 "request_id long, service string, ts timestamp, status int")


def test_bad_minutes_far_apart_are_no_streak(spark):
    r = _requests(spark, [("a", 0, 500), ("a", 120, 500), ("a", 240, 500),
                          ("b", 5, 500), ("b", 6, 500), ("b", 7, 500)])
    got = X.error_streaks(r, ["service"]).collect()
    assert [(g.service, g.checks) for g in got] == [("b", 3)]


def test_service_silent_until_the_end_is_reported(spark):
    r = _requests(spark, [("a", 0, 200), ("b", 0, 200), ("b", 10, 200), ("b", 20, 200), ("b", 30, 200)])
    got = X.traffic_gaps(r, ["service"]).collect()
    assert [(g.service, g.silent_from, g.silent_to, g.gap_minutes) for g in got] == [("a", _at(0), _at(30), 30.0)]


def test_asof_tie_column_decides(spark):
    left = spark.createDataFrame([("k", _at(5))], "k string, t timestamp")
    right = spark.createDataFrame([("k", _at(5), 1, "first"), ("k", _at(5), 2, "second")],
                                  "k string, p timestamp, n int, v string")
    for backward, want in ((False, "first"), (True, "second")):
        out = R.asof_join(left, right, ["k"], "t", "p", ["v"], backward=backward, tie="n").collect()
        assert [r.v for r in out] == [want]


def test_similar_incidents_equal_brute_force_with_copies(spark):
    rng = random.Random(5)
    words = [f"word{i:02d}" for i in range(60)]
    texts = [" ".join(rng.sample(words, rng.randint(1, 25))) for _ in range(60)] + ["copy of this text"] * 9 + ["", "a b"]
    inc = spark.createDataFrame([(i, "", t, "") for i, t in enumerate(texts)],
                                "incident_id long, title string, description string, tag string")
    sets = [{w for w in t.split() if len(w) > 3} for t in texts]
    want = set()
    for i, a in enumerate(sets):
        sims = [(-len(a & b) / len(a | b), j) for j, b in enumerate(sets) if j != i and a | b]
        for n, (s, j) in enumerate(sorted(x for x in sims if -x[0] > 0.1)[:5]):
            want.add((i, j, round(-s, 9), n + 1))
    got = {(r.incident_id, r.similar_id, round(r.similarity, 9), r.rank) for r in I.similar_incidents(inc).collect()}
    assert got == want


def test_similar_incidents_of_empty_table(spark):
    inc = spark.createDataFrame([], "incident_id long, title string, description string, tag string")
    assert I.similar_incidents(inc).count() == 0


def test_suggestions_come_best_first(spark):
    s = spark.createDataFrame([("x", 1, "low", 0.1, 0.1), ("y", 4, "high", 0.9, 0.9)],
                              "description string, frequency long, severity string, ease double, confidence double")
    got = X.rank_suggestions(s).select("description", F.col("priority_score")).collect()
    assert [g.description for g in got] == ["y", "x"]
