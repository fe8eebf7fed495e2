"""File sources and sinks for the platform's native records (S1-S6, S15,
S16, S21).

Schemas are explicit (never inferred).  JSON lines are read in PERMISSIVE
mode with a ``_corrupt_record`` column; ``split_quarantine`` separates bad
lines into a quarantine DataFrame instead of failing the job (quirk Q14).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.session import cut_lineage

CORRUPT = "_corrupt_record"

_CONTAINER = T.StructType([T.StructField(n, T.StringType() if n == "name" else T.DoubleType())
                           for n in ("name", "cpuPercent", "memoryPercent", "memoryUsage", "memoryLimit",
                                     "networkRx", "networkTx")])
_HTTP = T.StructType([T.StructField(n, T.DoubleType()) for n in (
    "totalRequests", "avgResponseTime", "p50Latency", "p95Latency", "p99Latency", "errorRate",
    "status2xx", "status4xx", "status5xx")])
METRICS_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType()), T.StructField("projectName", T.StringType()),
    T.StructField("containers", T.ArrayType(_CONTAINER)), T.StructField("http", _HTTP)])
LOGS_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("timestamp", "service", "message", "level")])
DEPLOYMENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("timestamp", T.LongType()),
    T.StructField("projectName", T.StringType()), T.StructField("gitSha", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("latencyBefore", T.DoubleType()),
    T.StructField("latencyAfter", T.DoubleType()), T.StructField("latencyDelta", T.DoubleType()),
    T.StructField("regression", T.BooleanType()), T.StructField("jaegerTraceUrl", T.StringType())])
_FIX = T.StructType([T.StructField(n, T.StringType()) for n in (
    "id", "incidentId", "description", "type", "outcome", "appliedAt", "resolvedAt", "diff", "prUrl")])
INCIDENT_SCHEMA = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("id", "timestamp", "project", "type", "severity", "title",
                                                 "description", "rootCause", "resolution", "status")],
    T.StructField("sources", T.ArrayType(T.StructType([T.StructField("type", T.StringType()),
                                                       T.StructField("summary", T.StringType()),
                                                       T.StructField("data", T.StringType())]))),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("relatedIncidents", T.ArrayType(T.StringType())),
    T.StructField("fix", _FIX), T.StructField("createdAt", T.StringType()), T.StructField("resolvedAt", T.StringType())])
SCORE_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("maxScore", T.DoubleType()),
    T.StructField("scenarioResults", T.MapType(T.StringType(), T.StructType([
        T.StructField("passed", T.BooleanType()), T.StructField("recoveryMs", T.DoubleType())])))])
DEPLOY_STATUSES = ["pending", "success", "failed"]
DEPLOYMENTS_LIMIT = 50


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, bad lines
    land in ``_corrupt_record``."""
    return (spark.read.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the corrupt column, quarantined raw lines)."""
    d = cut_lineage(df)     # Spark requires materialisation before filtering on the corrupt column alone
    good = d.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = d.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)
    return good, bad


def read_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Every ``metrics*.jsonl`` below ``path``."""
    return split_quarantine(read_jsonl(spark, f"{path.rstrip('/')}/metrics*.jsonl", METRICS_SCHEMA))


def read_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Every ``*.jsonl`` log chunk, ``ts`` parsed from the ISO text."""
    good, bad = split_quarantine(read_jsonl(spark, f"{path.rstrip('/')}/*.jsonl", LOGS_SCHEMA))
    return good.withColumn("ts", F.try_to_timestamp("timestamp")), bad


def read_deployments(spark: SparkSession, path: str, limit: int | None = DEPLOYMENTS_LIMIT
                     ) -> tuple[DataFrame, DataFrame]:
    """S3: schema-validated deployments (required fields present, status in
    the allowed set), newest first, ``limit`` rows; invalid rows are
    quarantined instead of failing the read."""
    good, bad = split_quarantine(read_jsonl(spark, path, DEPLOYMENT_SCHEMA))
    valid = (F.col("id").isNotNull() & F.col("timestamp").isNotNull() & F.col("projectName").isNotNull()
             & F.col("gitSha").isNotNull() & F.col("status").isin(*DEPLOY_STATUSES)
             & F.col("regression").isNotNull())
    ok = good.filter(valid)
    if limit is not None:
        ok = ok.orderBy(F.col("timestamp").desc()).limit(limit)
    invalid = good.filter(~valid).select(F.to_json(F.struct(*good.columns)).alias(CORRUPT))
    return ok, bad.unionByName(invalid)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A whole-file JSON array (incidents / patterns / score history);
    a missing file gives an empty DataFrame."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except Exception as e:  # noqa: BLE001 - missing path -> empty table
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Stored patterns in stored order, or the 8 built-ins when none are
    stored; ``ord`` is the order that pattern matching needs."""
    from vigil.operators.incidents import PATTERN_SCHEMA, patterns_df
    stored = read_json_array(spark, path, T.StructType([f for f in PATTERN_SCHEMA.fields if f.name != "ord"]))
    builtin = patterns_df(spark)
    # configuration rows in stored order, numbered without gaps (an id of the second partition is over 2^31)
    stored = stored.withColumn("ord", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)
    has = stored.limit(1).select(F.lit(1).alias("_k"))
    fallback = builtin.withColumn("_k", F.lit(1)).join(has, "_k", "left_anti").drop("_k")
    return stored.unionByName(fallback, allowMissingColumns=True)


def read_run_results(spark: SparkSession, directory: str, schema: T.StructType) -> DataFrame:
    """One JSON document per run (perf / chaos / compare); the latest run
    is the greatest file name (timestamped names)."""
    d = (spark.read.schema(schema).option("multiLine", True).json(directory)
         .withColumn("file_name", F.col("_metadata.file_name")))
    mx = d.agg(F.max("file_name").alias("_mx")).withColumn("_k", F.lit(1))   # one-row table
    return (d.withColumn("_k", F.lit(1)).join(F.broadcast(mx), "_k")
            .withColumn("is_latest", F.col("file_name") == F.col("_mx")).drop("_k", "_mx"))


def latest_run(runs: DataFrame) -> DataFrame:
    """W5 for run files: the document of the greatest file name."""
    return runs.orderBy(F.col("file_name").desc()).limit(1)


def read_raw_container_logs(spark: SparkSession, path: str) -> DataFrame:
    """Raw container log text, one row per line (``value``)."""
    return spark.read.text(path)


def read_engagement(spark: SparkSession, path: str) -> DataFrame:
    """The four training columns of the engagement table (column
    pruning reaches the Parquet scan)."""
    return spark.read.parquet(path).select("user_id", "item_id", "event_type", "value")


def append_metrics(snapshots: DataFrame, path: str) -> None:
    """Append snapshots that carry at least one container (HTTP-only
    snapshots are not stored), partitioned by day."""
    d = snapshots.filter(F.size("containers") > 0).withColumn(
        "dt", F.to_date(F.timestamp_millis("timestamp")))
    d.sortWithinPartitions("projectName", "timestamp").write.mode("append").partitionBy("dt").json(path)


def append_logs(logs: DataFrame, path: str) -> None:
    """Append log rows partitioned by day."""
    d = logs.withColumn("dt", F.to_date(F.col("ts").cast("timestamp")))
    d.sortWithinPartitions("service", "ts").write.mode("append").partitionBy("dt").json(path)
