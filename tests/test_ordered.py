"""Sliced window helpers equal the plain window functions."""
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.operators.ordered import (exact_rank_values, sliced_lag, sliced_last_value,
                                     sliced_running_sum, top_n)


def data(spark, n=2000, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "b", "c"] + ["hot"] * 6), rnd.randint(0, 10_000),
             rnd.choice([None, 1.0, 2.0, 3.0])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k string, t long, v double")


def test_lag_running_sum_last(spark):
    d = data(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    exp = d.select("id", F.lag("v").over(w).alias("pv"),
                   F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rc"),
                   F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("lv"))
    got = sliced_lag(d, ["k"], ["t", "id"], ["v"], prefix="p", n_slices=7) \
        .join(sliced_running_sum(d, ["k"], ["t", "id"], "rc", n_slices=5).select("id", "rc"), "id") \
        .join(sliced_last_value(d, ["k"], ["t", "id"], ["v"], prefix="l", n_slices=9).select("id", "lv"), "id") \
        .select("id", F.col("pv"), "rc", "lv")
    assert sorted(map(tuple, exp.collect())) == sorted(map(tuple, got.collect()))


def test_top_n_and_ranks(spark):
    d = data(spark)
    w = Window.partitionBy("k").orderBy(F.col("t").desc(), "id")
    exp = d.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("id")
    got = top_n(d, ["k"], [F.col("t").desc(), F.col("id")], 5, salt_col="id").select("id")
    assert sorted(r.id for r in exp.collect()) == sorted(r.id for r in got.collect())
    ranks = exact_rank_values(d, ["k"], "t", {"p50": 0.5, "p99": 0.99}).collect()
    for r in ranks:
        vals = sorted(x.t for x in d.filter(F.col("k") == r.k).collect())
        n = len(vals)
        assert r.p50 == vals[min(int(n * 0.5), n - 1)] and r.p99 == vals[min(int(n * 0.99), n - 1)]


def test_rolling_mean(spark):
    from vigil.operators.ordered import sliced_rolling_mean
    d = data(spark, 1500, seed=4)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(-5, -1)
    exp = {r.id: r.m for r in d.select("id", F.avg("v").over(w).alias("m")).collect()}
    got = {r.id: r.m for r in sliced_rolling_mean(d, ["k"], ["t", "id"], "v", 5, "m", n_slices=11).collect()}
    assert exp.keys() == got.keys()
    assert all((exp[i] is None and got[i] is None) or abs(exp[i] - got[i]) < 1e-9 for i in exp)


def test_exact_percentiles_match_percentile(spark):
    from vigil.operators.ordered import exact_percentiles
    d = data(spark, 3000, seed=9).withColumn("t", (F.col("t") % 97).cast("double"))   # many duplicates
    exp = {r.k: (r.a, r.b) for r in d.groupBy("k").agg(F.percentile("t", F.lit(0.5)).alias("a"),
                                                      F.percentile("t", F.lit(0.99)).alias("b")).collect()}
    got = {r.k: (r.a, r.b) for r in exact_percentiles(d, ["k"], "t", {"a": 0.5, "b": 0.99}).collect()}
    assert exp.keys() == got.keys()
    assert all(abs(exp[k][i] - got[k][i]) < 1e-9 for k in exp for i in (0, 1))


def test_null_ordering_values(spark):
    d = spark.createDataFrame([(1, "a", None, 1.0), (2, "a", 5, 2.0), (3, "a", 3, 3.0), (4, "b", None, 4.0),
                               (5, "b", 1, 5.0)], "id long, k string, t long, v double")
    w = Window.partitionBy("k").orderBy("t", "id")
    exp = {r.id: (r.p, r.c) for r in d.select("id", F.lag("v").over(w).alias("p"),
                                              F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
                                              .alias("c")).collect()}
    lag = {r.id: r.prev_v for r in sliced_lag(d, ["k"], ["t", "id"], ["v"], n_slices=4).collect()}
    rc = {r.id: r.rc for r in sliced_running_sum(d, ["k"], ["t", "id"], "rc", n_slices=4).collect()}
    assert {i: (lag[i], rc[i]) for i in exp} == exp
