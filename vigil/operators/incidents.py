"""Incident intelligence: search, symptom-pattern matching, similar incidents,
error/commit correlation, issue detection, knowledge-base statistics, fix
suggestions, confidence and root cause (F4, J2-J6, A3-A6, U1, U3, C1-C5,
P5, P7, P13)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.functions.scalar import severity_rank
from vigil.functions.text import (is_connection_error_line, is_error_line, is_oom_line,
                                  truncate, word_set)
from vigil.operators.ordered import top_n
from vigil.operators.simjoin import classes_of, spread_over_members, top_jaccard

# --- fixed values (must equal the reference's rules) ---------------------
# built-in failure patterns:
# id, name, description, category, symptoms, root causes, fixes, success rate, confidence
BUILTIN_PATTERNS = [
    ("pat-oom-killed", "OOMKilled Container", "Container killed due to exceeding memory limits", "resource",
     ["OOMKilled", "memory limit", "container killed", "exit code 137"],
     ["Memory leak", "Insufficient memory limits", "Unbounded cache", "Large data processing"],
     ["Increase container memory limits", "Add JVM heap bounds (-Xmx)",
      "Implement bounded caches with eviction", "Profile memory usage to find leaks"], 0.85, 0.9),
    ("pat-connection-refused", "Connection Refused", "Service cannot connect to a dependency", "reliability",
     ["connection refused", "ECONNREFUSED", "Connection reset", "timeout"],
     ["Dependency not running", "Network misconfiguration", "Port conflict", "Firewall rules"],
     ["Check dependency health and restart if needed", "Verify network configuration and service discovery",
      "Add retry logic with exponential backoff", "Implement circuit breaker pattern"], 0.9, 0.85),
    ("pat-slow-queries", "Slow Database Queries", "Database queries causing high latency", "performance",
     ["slow query", "query timeout", "high latency", "database connection pool exhausted"],
     ["Missing indexes", "N+1 queries", "Large result sets", "Lock contention"],
     ["Add database indexes for frequently queried columns", "Optimize N+1 queries with eager loading",
      "Add pagination for large result sets", "Configure connection pool timeouts"], 0.8, 0.75),
    ("pat-deploy-failure", "Deployment Failure", "Application fails to start after deployment", "deployment",
     ["CrashLoopBackOff", "readiness probe failed", "startup probe failed", "ImagePullBackOff"],
     ["Configuration error", "Missing environment variable", "Incompatible dependency", "Bad image"],
     ["Check deployment logs for startup errors", "Verify environment variables and config maps",
      "Rollback to previous working version", "Run pre-deployment validation checks"], 0.85, 0.8),
    ("pat-high-error-rate", "High Error Rate", "Sudden increase in HTTP 5xx errors", "reliability",
     ["5xx errors", "error rate spike", "internal server error", "500 status"],
     ["Code bug in new deployment", "Downstream service failure", "Resource exhaustion", "Configuration change"],
     ["Check recent deployments and rollback if needed", "Investigate downstream service health",
      "Check resource utilization (CPU, memory, connections)", "Review error logs for root cause"], 0.75, 0.7),
    ("pat-kafka-lag", "Kafka Consumer Lag", "Consumer falling behind on message processing", "performance",
     ["consumer lag", "message backlog", "slow consumer", "kafka offset behind"],
     ["Slow message processing", "Insufficient consumers", "Large message payloads", "Rebalancing"],
     ["Scale up consumer instances", "Optimize message processing logic", "Increase consumer batch size",
      "Check for poison messages blocking processing"], 0.8, 0.75),
    ("pat-cert-expiry", "Certificate Expiry", "TLS certificate expired or about to expire", "security",
     ["certificate expired", "SSL error", "TLS handshake failed", "x509"],
     ["Certificate not renewed", "cert-manager misconfigured", "Manual certificate management"],
     ["Renew the certificate immediately", "Set up automated certificate renewal with cert-manager",
      "Add certificate expiry monitoring and alerting"], 0.95, 0.9),
    ("pat-disk-pressure", "Disk Pressure", "Node or container running low on disk space", "resource",
     ["disk pressure", "no space left", "disk full", "eviction"],
     ["Log files not rotated", "Temp files not cleaned", "Large data volumes", "Container image cache"],
     ["Clean up old log files and enable rotation", "Add persistent volume claims with appropriate sizes",
      "Implement data retention policies", "Clean Docker image cache on nodes"], 0.9, 0.85),
]
MIN_MATCH_STRENGTH = 0.25
SIMILARITY_MIN = 0.1          # strictly greater
SIMILAR_LIMIT = 5
CORRELATION_WINDOW_MS = 3600000
CORRELATION_FLOOR = 0.3
CORRELATION_ERRORS = 5
CORRELATION_LIMIT = 5
TIMELINE_ERRORS = 10
ERROR_SPIKE_MIN, ERROR_SPIKE_CRITICAL, CONNECTION_MIN = 10, 50, 5
CPU_ISSUE, MEM_ISSUE, CRITICAL_PCT = 90.0, 85.0, 95.0
FIX_PATTERNS, FIX_LIMIT = 3, 10
NO_ISSUE_FINDING, NO_ISSUE_CONFIDENCE = "No issues detected", 90
SEARCH_LIMIT = 50
# --------------------------------------------------------------------------

PATTERN_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("symptoms", T.ArrayType(T.StringType())),
    T.StructField("rootCauses", T.ArrayType(T.StringType())),
    T.StructField("fixes", T.ArrayType(T.StringType())),
    T.StructField("successRate", T.DoubleType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("ord", T.IntegerType()),
])
BLOCK_CHARS = 4_000_000         # characters of symptoms in one automaton
PREFIX_SHARED = 8               # tokens that candidates share in their prefixes


def patterns_df(spark: SparkSession, extra: list[tuple] | None = None) -> DataFrame:
    """Built-in patterns (in their fixed order) plus caller patterns."""
    rows = [(*p, i) for i, p in enumerate(BUILTIN_PATTERNS + list(extra or []))]
    return spark.createDataFrame(rows, PATTERN_SCHEMA)


def _pattern_blocks(patterns: DataFrame, chars: int) -> Iterator[list[tuple]]:
    """(id, name, ord, symptoms, lower-cased symptoms) in blocks of at most
    ``chars`` characters of symptoms; the driver holds one block at a time."""
    rows = patterns.select("id", "name", "ord", "symptoms", F.transform("symptoms", F.lower).alias("low"))
    block, held = [], 0
    for r in rows.toLocalIterator():
        size = sum(len(x or "") for x in r["low"] or [])
        if block and held + size > chars:
            yield block
            block, held = [], 0
        block.append(tuple(r))
        held += size
    if block:
        yield block


def match_patterns(docs: DataFrame, patterns: DataFrame, id_col: str, text: Column,
                   min_strength: float | None = MIN_MATCH_STRENGTH) -> DataFrame:
    """Symptom substring matches in the lower-cased text; strength =
    matched / all symptoms; kept when >= ``min_strength`` (J2, 0.25) or > 0
    (J3, ``min_strength=None``).  Matched symptoms keep the pattern order.

    One automaton of all symptoms of a block of patterns reads each text once,
    whatever their number; a pattern lies in one block, so nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, kind), T.StructField("pattern_id", T.StringType()), T.StructField("pattern_name", T.StringType()),
        T.StructField("pattern_ord", T.IntegerType()), T.StructField("n_symptoms", T.IntegerType()),
        T.StructField("matched", T.LongType()), T.StructField("strength", T.DoubleType()),
        T.StructField("matched_symptoms", T.StringType())])
    arrow, least = to_arrow_schema(schema), min_strength
    d = docs.select(F.col(id_col), F.lower(text).alias("_text")).where("_text IS NOT NULL")

    def search(block: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick
            numbers = {}
            for _, _, _, _, low in block:
                for x in low or []:
                    if x is not None:
                        numbers.setdefault(x, len(numbers))
            find = ahocorasick.Automaton()
            for x, i in numbers.items():
                if x:
                    find.add_word(x, i)
            always = {numbers[""]} if "" in numbers else set()
            if len(find):
                find.make_automaton()
            owners: dict[int, list] = {}
            for p, (_, _, _, symptoms, low) in enumerate(block):
                for pos, x in enumerate(low or []):
                    if x is not None:
                        owners.setdefault(numbers[x], []).append((p, pos))
            for b in batches:
                out = []
                for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    hit: dict[int, list] = {}
                    for i in always.union(i for _, i in find.iter(t)) if len(find) else always:
                        for p, pos in owners[i]:
                            hit.setdefault(p, []).append(pos)
                    for p, at in hit.items():
                        pid, name, ord_, symptoms, _ = block[p]
                        strength = len(at) / len(symptoms)
                        if least is None or strength >= least:
                            out.append((key, pid, name, ord_, len(symptoms), len(at), strength,
                                        "|".join(symptoms[x] for x in sorted(at))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        return run
    found = [d.mapInArrow(search(block), schema) for block in _pattern_blocks(patterns, BLOCK_CHARS)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def incident_text(df: DataFrame) -> Column:
    """title + description (+ source summaries when present)."""
    parts = [F.col("title"), F.col("description")]
    if "source_summaries" in df.columns:
        parts.append(F.array_join("source_summaries", " "))
    return F.concat_ws(" ", *parts)


def jaccard_pairs(sets: DataFrame, threshold: float = SIMILARITY_MIN, right: DataFrame | None = None) -> DataFrame:
    """Exact set-similarity self-join: every pair with Jaccard > ``threshold``.

    ``sets``: ``(id, ws)`` with ``ws`` a distinct token array.  With
    ``right`` it is an R-S join (``id_a`` from ``sets``, ``id_b`` from
    ``right``) sharing one global token order.

    Prefix filtering (Bayardo et al. 2007; Xiao et al. 2008), extended to
    several shared tokens: tokens are ranked by global document frequency,
    rarest first.  A pair with J >= t has sizes ``t*|x| <= |y| <= |x|/t`` and
    an overlap of at least ``o = ceil(t / (1 + t) * (|x| + |y|))``; its first
    ``l`` shared tokens are followed by ``o - l`` others, so they lie among
    the first ``|x| - o + l`` tokens of each set.  Candidates therefore share
    ``l`` tokens there, counted in an equi-join on tokens (the most frequent
    tokens of each set never generate pairs), and are verified exactly with
    ``size(array_intersect)``.  No cut-off on partners: every filter is a
    proven bound.
    """
    rs = sets if right is None else right
    both = sets.withColumn("_side", F.lit(0))
    if right is not None:
        both = both.unionByName(right.withColumn("_side", F.lit(1)))
    tok = ranked_tokens(both, ["_side"])
    a = tok.filter(F.col("_side") == 0).drop("_side")
    b = a if right is None else tok.filter(F.col("_side") == 1).drop("_side")
    order = (F.col("id_a") < F.col("id_b")) if right is None else F.lit(True)
    return verified_pairs(a, b, sets, rs, threshold, order)


def ranked_tokens(sets: DataFrame, side: list[str] = []) -> DataFrame:
    """``(*side, id, n, token, pos)``: the tokens of each set, the rarest over
    all ``sets`` first; ``n`` is the size of the set."""
    tok = sets.select(*side, "id", F.size("ws").alias("n"), F.explode("ws").alias("token"))
    df = tok.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    w = Window.partitionBy(*side, "id").orderBy("_df", "token")
    return tok.join(df, "token").withColumn("pos", F.row_number().over(w)).drop("_df")


def verified_pairs(tok_a: DataFrame, tok_b: DataFrame, sets_a: DataFrame, sets_b: DataFrame, t: float,
                   order: Column) -> DataFrame:
    """Pairs with Jaccard > ``t`` that satisfy ``order``, from tokens ranked
    together (see ``jaccard_pairs``)."""
    least = F.ceil(F.col("n") * F.lit(t))
    a, b = (d.filter(F.col("pos") <= F.col("n") - least + F.least(F.lit(PREFIX_SHARED), least)).select(
        F.col("id").alias("id_" + x), F.col("n").alias("n_" + x), "token", F.col("pos").alias("pos_" + x))
        for d, x in ((tok_a, "a"), (tok_b, "b")))
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("n_a") + F.col("n_b")))
    shared = F.least(F.lit(PREFIX_SHARED), need)
    cand = (a.join(b, "token")
            .filter(order
                    & (F.col("n_b") >= F.col("n_a") * t) & (F.col("n_b") * t <= F.col("n_a"))
                    & (F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need - shared))
            .groupBy("id_a", "id_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("_m"))
            .filter(F.col("_m") >= shared).drop("_m"))
    sa = sets_a.select(F.col("id").alias("id_a"), F.col("ws").alias("ws_a"))
    sb = sets_b.select(F.col("id").alias("id_b"), F.col("ws").alias("ws_b"))
    v = cand.join(sa, "id_a").join(sb, "id_b").withColumn("inter", F.size(F.array_intersect("ws_a", "ws_b")))
    sim = F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))
    return v.select("id_a", "id_b", "inter", sim.alias("similarity")).filter(F.col("similarity") > t)


def similar_incidents(incidents: DataFrame, k: int = SIMILAR_LIMIT, id_col: str = "incident_id",
                      threshold: float = SIMILARITY_MIN) -> DataFrame:
    """For every incident the ``k`` most similar other incidents by
    Jaccard of word sets (title, description, tags; words longer than 3
    characters), similarity strictly above 0.1, ties by the other id.

    Incidents of equal word sets are one class, so copies are never paired
    with each other; classes are joined by ``simjoin.top_jaccard``.
    """
    tags = F.col("tags") if "tags" in incidents.columns else F.array(F.col("tag"))
    ws = word_set(F.col("title"), F.col("description"), F.array_join(tags, " "))
    sets = incidents.select(F.col(id_col).alias("id"), F.sort_array(ws).alias("ws")).filter(F.size("ws") > 0)
    member, classes = classes_of(sets, "ws", "json")
    near = spread_over_members(top_jaccard(classes, k + 1, threshold), member, k, 1.0)
    return near.select(F.col("id").alias(id_col), F.col("other").alias("similar_id"),
                       F.col("score").alias("similarity"), "rank")


def search_incidents(incidents: DataFrame, type_: str | None = None, status: str | None = None,
                     severity: str | None = None, tags: list[str] | None = None, query: str | None = None,
                     limit: int = SEARCH_LIMIT, order: list[Column] | None = None) -> DataFrame:
    """exact type / status / severity, any-of tags, case-insensitive
    text in title, description or root cause; newest first, ``limit``."""
    d = incidents
    for col, v in (("type", type_), ("status", status), ("severity", severity)):
        if v is not None:
            d = d.filter(F.col(col) == v)
    if tags:
        tcol = F.col("tags") if "tags" in d.columns else F.array(F.col("tag"))
        d = d.filter(F.arrays_overlap(tcol, F.array(*[F.lit(t) for t in tags])))
    if query:
        q = query.lower()
        rc = F.coalesce(F.col("rootCause"), F.lit("")) if "rootCause" in d.columns else F.lit("")
        d = d.filter(F.lower(F.col("title")).contains(q) | F.lower(F.col("description")).contains(q)
                     | F.lower(rc).contains(q))
    return top_n(d, [], order or [F.col("incident_id").desc()], limit)


def kb_stats(incidents: DataFrame, patterns: DataFrame) -> DataFrame:
    """A3: long-form statistics: incidents total / open (open or
    investigating) / resolved, by type (tag here), patterns by category,
    fixes total / resolved / success rate (0 without fixes)."""
    has_fix = F.col("fix_outcome").isNotNull()
    tot = incidents.agg(
        F.count(F.lit(1)).alias("incidents_total"),
        F.count_if(F.col("status").isin("open", "investigating")).alias("incidents_open"),
        F.count_if(F.col("status") == "resolved").alias("incidents_resolved"),
        F.count_if(has_fix).alias("fixes_total"),
        F.count_if(F.col("fix_outcome") == "resolved").alias("fixes_resolved"))
    tot = tot.withColumn("fix_success_rate", F.when(F.col("fixes_total") > 0,
                                                    F.col("fixes_resolved") / F.col("fixes_total")).otherwise(0.0))
    metrics = ["incidents_total", "incidents_open", "incidents_resolved", "fixes_total",
               "fixes_resolved", "fix_success_rate"]
    long_tot = tot.select(F.inline(F.array(*[
        F.struct(F.lit("total").alias("section"), F.lit(m).alias("key"), F.col(m).cast("double").alias("value"))
        for m in metrics])))
    by_type = incidents.groupBy(F.col("tag").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")) \
        .select(F.lit("incidents_by_type").alias("section"), "key", "value")
    by_cat = patterns.groupBy(F.col("category").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")) \
        .select(F.lit("patterns_by_category").alias("section"), "key", "value")
    return long_tot.unionByName(by_type).unionByName(by_cat)


def pattern_success(incidents: DataFrame, patterns: DataFrame, id_col: str = "incident_id") -> DataFrame:
    """A4: per pattern, incidents matching any symptom in title +
    description, success rate = resolved fixes / incidents with a fix
    (unchanged when none)."""
    m = match_patterns(incidents, patterns, id_col, F.concat_ws(" ", "title", "description"), None)
    j = m.join(incidents.select(id_col, "fix_outcome"), id_col)
    s = j.groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.count_if(F.col("fix_outcome").isNotNull()).alias("with_fix"),
        F.count_if(F.col("fix_outcome") == "resolved").alias("resolved"))
    p = patterns.select(F.col("id").alias("pattern_id"), "name", "successRate")
    out = p.join(s, "pattern_id", "left").fillna(0, ["occurrences", "with_fix", "resolved"])
    return out.withColumn("success_rate", F.when(F.col("with_fix") > 0, F.col("resolved") / F.col("with_fix"))
                          .otherwise(F.col("successRate"))).drop("successRate")


def detect_issues(logs: DataFrame, samples: DataFrame, keys: list[str] = ["project"],
                  ts: str = "ts", tie: str = "log_id", sample_tie: str = "sample_id") -> DataFrame:
    """A5: per project the issue list of the analyzer rules (error spike,
    memory exhaustion, connection failures, container cpu / memory) with
    severity rank (critical first) and rule order."""
    order = F.struct(F.col(ts), F.col(tie))
    err, oom, conn = is_error_line("message"), is_oom_line("message"), is_connection_error_line("message")
    per_svc = logs.filter(err).groupBy(*keys, "service").agg(F.min(order).alias("_first"))
    svcs = per_svc.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_first", "service"))).alias("_s")) \
        .select(*keys, F.transform("_s", lambda x: x["service"]).alias("services"))
    agg = logs.groupBy(*keys).agg(
        F.count_if(err).alias("errors"), F.count_if(oom).alias("ooms"), F.count_if(conn).alias("conns"),
        F.min_by(F.col("message"), F.when(err, order)).alias("first_error"),
        F.min_by(F.col("message"), F.when(oom, order)).alias("first_oom"),
        F.min_by(F.col("message"), F.when(conn, order)).alias("first_conn"))
    a = agg.join(svcs, keys, "left")
    spike = a.filter(F.col("errors") > ERROR_SPIKE_MIN).select(
        *keys, F.lit("error-spike").alias("type"),
        F.when(F.col("errors") > ERROR_SPIKE_CRITICAL, "critical").otherwise("high").alias("severity"),
        F.concat(F.lit("High error rate detected in logs ("), F.col("errors").cast("string"),
                 F.lit(" errors)")).alias("finding"),
        F.concat(F.lit("Errors found in services: "), F.array_join("services", ", "), F.lit(". Sample: "),
                 truncate(F.col("first_error"), 200)).alias("details"),
        F.array_join(F.concat(F.array(F.lit("errors")), F.col("services")), ",").alias("tags"),
        F.lit(1).alias("rule_order"), F.lit(None).cast("string").alias("container"))
    mem = a.filter(F.col("ooms") > 0).select(
        *keys, F.lit("resource-exhaustion").alias("type"), F.lit("critical").alias("severity"),
        F.lit("Memory exhaustion detected").alias("finding"),
        F.concat(F.lit("OOM-related messages found: "), truncate(F.col("first_oom"), 200)).alias("details"),
        F.lit("oom,memory").alias("tags"), F.lit(2).alias("rule_order"),
        F.lit(None).cast("string").alias("container"))
    con = a.filter(F.col("conns") > CONNECTION_MIN).select(
        *keys, F.lit("dependency-failure").alias("type"), F.lit("high").alias("severity"),
        F.lit("Connection failures detected").alias("finding"),
        F.concat(F.col("conns").cast("string"), F.lit(" connection errors found. Sample: "),
                 truncate(F.col("first_conn"), 200)).alias("details"),
        F.lit("connection,dependency").alias("tags"), F.lit(3).alias("rule_order"),
        F.lit(None).cast("string").alias("container"))
    # latest sample per container (the analyzer reads current container stats)
    last = samples.groupBy(*keys, "container").agg(
        F.max_by(F.struct("cpu_pct", "mem_pct"), F.struct(F.col(ts), F.col(sample_tie))).alias("s"))
    cpu_s = F.concat(F.format_string("%.2f", F.col("s.cpu_pct")), F.lit("%"))
    mem_s = F.concat(F.format_string("%.2f", F.col("s.mem_pct")), F.lit("%"))
    cpu = last.filter(F.col("s.cpu_pct") > CPU_ISSUE).select(
        *keys, F.lit("resource-exhaustion").alias("type"),
        F.when(F.col("s.cpu_pct") > CRITICAL_PCT, "critical").otherwise("high").alias("severity"),
        F.concat(F.lit("High CPU usage on "), F.col("container"), F.lit(": "), cpu_s).alias("finding"),
        F.concat(F.lit("Container "), F.col("container"), F.lit(" is using "), cpu_s, F.lit(" CPU")).alias("details"),
        F.lit("cpu,resource").alias("tags"), F.lit(4).alias("rule_order"), "container")
    memi = last.filter(F.col("s.mem_pct") > MEM_ISSUE).select(
        *keys, F.lit("resource-exhaustion").alias("type"),
        F.when(F.col("s.mem_pct") > CRITICAL_PCT, "critical").otherwise("high").alias("severity"),
        F.concat(F.lit("High memory usage on "), F.col("container"), F.lit(": "), mem_s).alias("finding"),
        F.concat(F.lit("Container "), F.col("container"), F.lit(" is using "), mem_s,
                 F.lit(" memory")).alias("details"),
        F.lit("memory,resource").alias("tags"), F.lit(5).alias("rule_order"), "container")
    out = spike.unionByName(mem).unionByName(con).unionByName(cpu).unionByName(memi)
    return out.withColumn("severity_rank", severity_rank("severity"))


def build_timeline(commits: DataFrame, logs: DataFrame, keys: list[str] = ["project"],
                   ts: str = "ts", tie: str = "log_id") -> DataFrame:
    """Commits (info) plus the last 10 error lines (error) per project,
    on real timestamps (quirk Q10)."""
    c = commits.select(*keys, F.col(ts).alias("ts"), F.lit("git").alias("source"),
                       F.concat(F.lit("Commit: "), F.col("message")).alias("event"),
                       F.lit("info").alias("severity"),
                       F.concat(F.substring("sha", 1, 7), F.lit(" by "),
                                F.coalesce(F.col("author"), F.lit("unknown")) if "author" in commits.columns
                                else F.lit("unknown")).alias("details"),
                       F.col("commit_id").alias("event_id"))
    e = top_n(logs.filter(is_error_line("message")), keys, [F.col(ts).desc(), F.col(tie).desc()],
              TIMELINE_ERRORS, salt_col=tie)
    e = e.select(*keys, F.col(ts).alias("ts"), F.lit("logs").alias("source"),
                 F.concat(F.lit("["), F.col("service"), F.lit("] "), truncate(F.col("message"), 200)).alias("event"),
                 F.lit("error").alias("severity"), F.lit(None).cast("string").alias("details"),
                 F.col(tie).alias("event_id"))
    # T-K7: ascending by real timestamps (a distributed range sort)
    return c.unionByName(e).orderBy(*keys, "ts", "event_id")


def correlate_errors_commits(timeline: DataFrame, keys: list[str] = ["project"]) -> DataFrame:
    """The first five error events of each project's timeline x its
    commits with |dt| < 1 h (strict); confidence = max(0.3, 1 - dt / 1 h);
    top five by confidence.  Interval join on hour buckets (each error is
    expanded to its neighbour buckets), exact residual on |dt|."""
    t = timeline.withColumn("_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    errs = top_n(t.filter(F.col("severity") == "error"), keys, [F.col("_ms"), F.col("event_id")],
                 CORRELATION_ERRORS, salt_col="event_id")
    errs = errs.select(*keys, F.col("_ms").alias("_ems"), F.col("event").alias("error_event"),
                       F.col("event_id").alias("error_id"),
                       F.explode(F.sequence(F.floor(F.col("_ms") / CORRELATION_WINDOW_MS) - 1,
                                            F.floor(F.col("_ms") / CORRELATION_WINDOW_MS) + 1)).alias("_b"))
    com = t.filter(F.col("source") == "git").select(
        *keys, F.col("_ms").alias("_cms"), F.col("details").alias("commit_details"),
        F.col("event_id").alias("commit_id"), F.floor(F.col("_ms") / CORRELATION_WINDOW_MS).alias("_b"))
    j = errs.join(com, keys + ["_b"]).withColumn("_dt", F.abs(F.col("_ems") - F.col("_cms")))
    j = j.filter(F.col("_dt") < CORRELATION_WINDOW_MS)
    j = j.withColumn("confidence", F.greatest(F.lit(CORRELATION_FLOOR),
                                              1 - F.col("_dt") / F.lit(float(CORRELATION_WINDOW_MS))))
    j = j.withColumn("description", F.concat(
        F.lit('Error "'), truncate(F.col("error_event"), 100), F.lit('" occurred within 1h of commit "'),
        F.col("commit_details"), F.lit('"')))
    j = j.select(*keys, "error_id", "commit_id", "confidence", "description",
                 F.lit("logs").alias("source_a"), F.lit("git").alias("source_b"))
    return top_n(j, keys, [F.col("confidence").desc(), F.col("error_id"), F.col("commit_id")],
                 CORRELATION_LIMIT, salt_col="commit_id", rank_col="rank")


def confidence(top_strength: Column, top_corr: Column, top_sim: Column) -> Column:
    """20 + 30 x top pattern strength + min(25 x top correlation, 25) +
    20 x top similarity + 5 when patterns and correlations agree;
    min(round, 95)."""
    c = (F.lit(20.0) + F.coalesce(top_strength * 30, F.lit(0.0))
         + F.when(top_corr.isNotNull(), F.least(top_corr * 25, F.lit(25.0))).otherwise(F.lit(0.0))
         + F.coalesce(top_sim * 20, F.lit(0.0))
         + F.when(top_strength.isNotNull() & top_corr.isNotNull(), 5.0).otherwise(0.0))
    return F.least(F.round(c), F.lit(95.0)).cast("int")


def root_cause(top_root_causes: Column, corr_descriptions: Column, finding: Column) -> Column:
    """C4: first root cause of the top pattern, else the first code-change
    correlation, else the fallback text."""
    corr = F.concat(F.lit("Recent code change may be the trigger: "), corr_descriptions[0])
    return F.coalesce(F.try_element_at(top_root_causes, F.lit(1)), F.when(F.size(corr_descriptions) > 0, corr),
                      F.concat(F.lit("Detected: "), finding, F.lit(". Further investigation needed.")))


def suggest_fixes(pattern_matches: DataFrame, patterns: DataFrame, similar: DataFrame | None,
                  keys: list[str]) -> DataFrame:
    """C3 + U3: fixes of the top-3 matched patterns (confidence = strength x
    success rate x 100) and resolutions of similar incidents (similarity x
    100); de-duplicated case-insensitively keeping the first, top 10."""
    top3 = top_n(pattern_matches, keys, [F.col("strength").desc(), F.col("pattern_ord")], FIX_PATTERNS,
                 rank_col="_prank")
    fx = top3.join(patterns.select(F.col("id").alias("pattern_id"), "fixes", "successRate"), "pattern_id")
    a = fx.select(*keys, F.posexplode("fixes").alias("_fpos", "description"),
                  (F.col("strength") * F.col("successRate") * 100).alias("confidence"),
                  F.concat(F.lit("Pattern: "), F.col("pattern_name")).alias("source"),
                  F.col("_prank").alias("_o1"))
    a = a.withColumn("_o2", F.col("_fpos")).drop("_fpos")
    u = a
    if similar is not None:
        b = similar.select(*keys, F.col("resolution").alias("description"),
                           (F.col("similarity") * 100).alias("confidence"),
                           F.concat(F.lit("Similar incident: "), F.col("title")).alias("source"),
                           (F.lit(100) + F.col("rank")).alias("_o1"), F.lit(0).alias("_o2"))
        u = a.unionByName(b.filter(F.col("description").isNotNull()))
    first = top_n(u.withColumn("_k", F.lower("description")), keys + ["_k"], [F.col("_o1"), F.col("_o2")], 1)
    return top_n(first, keys, [F.col("confidence").desc(), F.col("_o1"), F.col("_o2")], FIX_LIMIT,
                 rank_col="rank").drop("_k", "_o1", "_o2")


def relevance_score(temporal: Column, semantic: Column, severity_weight: Column) -> Column:
    """P5: 0.3 temporal + 0.4 semantic + 0.3 severity."""
    return 0.3 * temporal + 0.4 * semantic + 0.3 * severity_weight


LEVEL_WEIGHT = {"error": 1.0, "warn": 0.5}


def context_relevance(logs: DataFrame, issues: DataFrame, keys: list[str] = ["project"],
                      window_s: int = 3600, tie: str = "log_id") -> DataFrame:
    """P5: score each project's log lines as analysis context for its issue:
    temporal = max(0, 1 - age / 1 h) before the project's newest line,
    semantic = Jaccard of the line's and the issue's word sets, severity =
    1 error / 0.5 warn / 0 otherwise.  All lines return."""
    from vigil.functions.text import detect_level
    iw = issues.select(*keys, word_set(F.concat_ws(" ", "finding", "details",
                                                   F.regexp_replace("tags", ",", " "))).alias("_iws"))
    now = logs.groupBy(*keys).agg(F.max("ts").alias("_now"))
    d = logs.join(iw, keys).join(now, keys).withColumn("_lws", word_set(F.col("message")))
    inter = F.size(F.array_intersect("_lws", "_iws"))
    union = F.size("_lws") + F.size("_iws") - inter
    age = (F.unix_micros(F.col("_now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    lw = F.create_map(*[x for kk, v in LEVEL_WEIGHT.items() for x in (F.lit(kk), F.lit(v))])
    d = (d.withColumn("temporal", F.greatest(F.lit(0.0), 1 - age / window_s))
         .withColumn("semantic", F.when(union > 0, inter / union).otherwise(0.0))
         .withColumn("severity", F.coalesce(lw[detect_level("message")], F.lit(0.0))))
    d = d.withColumn("relevance", relevance_score(F.col("temporal"), F.col("semantic"), F.col("severity")))
    return d.select(*keys, tie, "ts", "temporal", "semantic", "severity", "relevance")
