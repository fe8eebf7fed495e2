"""Histogram quantile edge cases (server rule)."""
from vigil.operators import telemetry as T


def q(spark, buckets, qs):
    df = spark.createDataFrame([("s", le, c) for le, c in buckets], "service string, le double, cnt long")
    return {r.q: r.value for r in T.histogram_quantile(df, ["service"], qs).collect()}


def test_interpolation_and_inf(spark):
    b = [(10.0, 5), (50.0, 10), (100.0, 10), (T.INF_BUCKET, 12)]
    r = q(spark, b, [0.25, 0.5, 0.99])
    assert r[0.25] == 0 + (10 - 0) * (3 / 5)             # first bucket interpolates from 0
    assert r[0.5] == 10 + (50 - 10) * ((6 - 5) / (10 - 5))
    assert r[0.99] == 100.0                                 # lands in +Inf -> highest finite bound


def test_empty(spark):
    assert q(spark, [(10.0, 0), (T.INF_BUCKET, 0)], [0.5]) == {0.5: None}
