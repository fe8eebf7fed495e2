"""Golden cases for column expressions."""
from pyspark.sql import functions as F

from vigil.functions import scalar as S
from vigil.functions import text as X


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_levels_and_flags(spark):
    assert one(spark, X.detect_level("x"), "Fatal exception") == "error"
    assert one(spark, X.detect_level("x"), "WARNING disk") == "warn"
    assert one(spark, X.detect_level("x"), "trace id") == "debug"
    assert one(spark, X.detect_level("x"), "all good") == "info"
    assert one(spark, X.is_error_line("x"), "request FAILED") is True
    assert one(spark, X.is_oom_line("x"), "Java heap space") is True
    assert one(spark, X.is_connection_error_line("x"), "ECONNREFUSED 1.2.3.4") is True


def test_status_uri_units(spark):
    assert one(spark, S.status_class("x"), 503, "x int") == "5xx"
    assert one(spark, S.status_class("x"), 99, "x int") == "unknown"
    assert one(spark, S.normalize_uri("x"), "/hello/bob/12") == "/hello/{name}/{id}"
    assert one(spark, S.normalize_uri("x"), "/users/7") == "/users/{id}"
    assert one(spark, S.size_to_bytes("x"), "1.5GiB") == 1.5 * 1024 ** 3
    assert one(spark, S.size_to_bytes("x"), "12kB") == 12 * 1024
    assert one(spark, S.size_to_bytes("x"), "junk") == 0.0
    assert one(spark, S.percent_to_double("x"), "12.5%") == 12.5
    assert one(spark, S.duration_to_ms("x"), "2m") == 120000
    assert one(spark, S.duration_to_ms("x"), "soon") == 30000


def test_maps_and_rules(spark):
    assert one(spark, S.event_weight("x", F.lit(2.0)), "rating") == 6.0
    assert one(spark, S.event_weight("x", F.lit(2.0)), "other") == 2.0
    assert one(spark, S.sentiment_of("x"), "greeting") == "positive"
    assert one(spark, S.sentiment_of("x"), "zzz") == "neutral"
    assert one(spark, S.rating_from_score("x"), 1000, "x int") == 10.0
    assert one(spark, S.rating_from_score("x"), 0, "x int") == 1.0
    assert one(spark, S.threshold_op(F.lit(">="), F.lit(5.0), F.lit(5.0)), "a") is True
    assert one(spark, S.threshold_op(F.lit("=="), F.lit(5.0), F.lit(5.0)), "a") is False
    assert one(spark, S.format_pct_change("x"), 12.34, "x double") == "+12.3%"
    assert one(spark, S.fix_priority("x"), 70, "x int") == "HIGH"
    assert one(spark, X.word_set(F.col("x")), "The quick  quick brown fox") == ["quick", "brown"]
    assert one(spark, X.topic_tags("x"), "Rust and Kubernetes on AWS") == ["rust", "cloud"]
    assert one(spark, S.health_rollup(F.create_map(F.lit("db"), F.lit("UP"), F.lit("k"), F.lit("DOWN"))), "a") \
        == "unhealthy"
