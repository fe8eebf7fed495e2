"""Registered incident-intelligence queries over ``incidents``, ``logs``,
``commits`` and ``metric_samples``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from vigil.operators import incidents as I
from vigil.plans.registry import query
from vigil.sources.tables import read_table, view

# Query-time symptom patterns made of frequent tokens of the invented prose
# (the bundled symptoms rarely occur in it); built-ins are always included.
PROSE_PATTERNS = [
    ("pat-prose-en", "English prose", "Frequent English function words", "custom",
     ["that", "with", "this", "from"], ["Prose"], ["Read it", "Summarise it"], 0.5, 0.5),
    ("pat-prose-de", "German prose", "Frequent German function words", "custom",
     ["sich", " der ", " die ", " und "], ["Prosa"], ["Lesen"], 0.6, 0.5),
    ("pat-prose-fr", "French prose", "Frequent French function words", "custom",
     [" les ", " des ", " le ", " la "], ["Prose"], ["Lire"], 0.7, 0.5),
]


def _patterns(spark):
    return I.patterns_df(spark, PROSE_PATTERNS)


def _sym_values() -> str:
    rows = []
    for ordi, p in enumerate(I.BUILTIN_PATTERNS + PROSE_PATTERNS):
        for pos, s in enumerate(p[4]):
            rows.append(f"('{p[0]}', '{p[1]}', {ordi}, {len(p[4])}, {pos}, '{s}')")
    return "(VALUES " + ", ".join(rows) + \
        ") AS s(pattern_id, pattern_name, pattern_ord, n_symptoms, symptom_pos, symptom)"


def _pat_values() -> str:
    rows = [f"('{p[0]}', '{p[1]}', '{p[3]}', {p[7]}::DOUBLE, {i})"
            for i, p in enumerate(I.BUILTIN_PATTERNS + PROSE_PATTERNS)]
    return "(VALUES " + ", ".join(rows) + ") AS p(id, name, category, successRate, ord)"


_MATCH_SQL = f"""
SELECT d.incident_id, s.pattern_id, s.pattern_name, s.pattern_ord, s.n_symptoms,
       COUNT(*) AS matched, COUNT(*) / s.n_symptoms AS strength,
       string_agg(s.symptom, '|' ORDER BY s.symptom_pos) AS matched_symptoms
FROM incidents d JOIN {_sym_values()} ON instr(lower(d.title || ' ' || d.description), lower(s.symptom)) > 0
GROUP BY d.incident_id, s.pattern_id, s.pattern_name, s.pattern_ord, s.n_symptoms"""


@query("match_patterns", f"SELECT * FROM ({_MATCH_SQL}) m WHERE strength >= 0.25", ("incidents",))
def match_patterns(spark, sf):
    """Symptom patterns matched by each incident (strength >= 0.25)."""
    inc = view(spark, sf, "incidents")
    return I.match_patterns(inc, _patterns(spark), "incident_id", F.concat_ws(" ", "title", "description"))


_WS = "list_distinct(list_filter(string_split_regex(lower(title || ' ' || description || ' ' || tag), '\\s+'), lambda w: length(w) > 3))"


@query("similar_incidents", f"""
WITH w AS (SELECT incident_id, {_WS} AS ws FROM incidents),
p AS (SELECT a.incident_id, b.incident_id AS similar_id,
             len(list_intersect(a.ws, b.ws)) AS inter, len(a.ws) AS na, len(b.ws) AS nb
      FROM w a JOIN w b ON a.incident_id <> b.incident_id),
s AS (SELECT incident_id, similar_id, inter / (na + nb - inter) AS similarity FROM p
      WHERE na + nb - inter > 0 AND inter / (na + nb - inter) > 0.1)
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY incident_id ORDER BY similarity DESC, similar_id) AS rank
               FROM s) x WHERE rank <= 5""", ("incidents",))
def similar_incidents(spark, sf):
    """Top-5 Jaccard-similar incidents (> 0.1) via exact prefix filtering."""
    return I.similar_incidents(view(spark, sf, "incidents"))


@query("search_incidents", """
SELECT * FROM incidents
WHERE status = 'open' AND tag IN ('en') AND (contains(lower(title), 'that') OR contains(lower(description), 'that'))
ORDER BY incident_id DESC LIMIT 50""", ("incidents",))
def search_incidents(spark, sf):
    """open English incidents mentioning 'that', newest 50."""
    return I.search_incidents(view(spark, sf, "incidents"), status="open", tags=["en"], query="THAT")


@query("kb_stats", f"""
WITH t AS (
  SELECT COUNT(*) AS incidents_total,
         COUNT(*) FILTER (WHERE status IN ('open', 'investigating')) AS incidents_open,
         COUNT(*) FILTER (WHERE status = 'resolved') AS incidents_resolved,
         COUNT(*) FILTER (WHERE fix_outcome IS NOT NULL) AS fixes_total,
         COUNT(*) FILTER (WHERE fix_outcome = 'resolved') AS fixes_resolved
  FROM incidents)
SELECT 'total' AS section, 'incidents_total' AS key, CAST(incidents_total AS DOUBLE) AS value FROM t
UNION ALL SELECT 'total', 'incidents_open', incidents_open FROM t
UNION ALL SELECT 'total', 'incidents_resolved', incidents_resolved FROM t
UNION ALL SELECT 'total', 'fixes_total', fixes_total FROM t
UNION ALL SELECT 'total', 'fixes_resolved', fixes_resolved FROM t
UNION ALL SELECT 'total', 'fix_success_rate', CASE WHEN fixes_total > 0 THEN fixes_resolved / fixes_total ELSE 0.0 END FROM t
UNION ALL SELECT 'incidents_by_type', tag, COUNT(*) FROM incidents GROUP BY tag
UNION ALL SELECT 'patterns_by_category', category, COUNT(*) FROM {_pat_values()} GROUP BY category""",
       ("incidents",))
def kb_stats(spark, sf):
    """A3: knowledge-base statistics (long form)."""
    return I.kb_stats(view(spark, sf, "incidents"), _patterns(spark))


@query("pattern_success", f"""
WITH m AS ({_MATCH_SQL}),
s AS (SELECT m.pattern_id, COUNT(*) AS occurrences, COUNT(*) FILTER (WHERE i.fix_outcome IS NOT NULL) AS with_fix,
             COUNT(*) FILTER (WHERE i.fix_outcome = 'resolved') AS resolved
      FROM m JOIN incidents i USING (incident_id) GROUP BY m.pattern_id)
SELECT p.id AS pattern_id, p.name, coalesce(s.occurrences, 0) AS occurrences, coalesce(s.with_fix, 0) AS with_fix,
       coalesce(s.resolved, 0) AS resolved,
       CASE WHEN coalesce(s.with_fix, 0) > 0 THEN s.resolved / s.with_fix ELSE p.successRate END AS success_rate
FROM {_pat_values()} LEFT JOIN s ON p.id = s.pattern_id""", ("incidents",))
def pattern_success(spark, sf):
    """A4: occurrences and fix success rate per pattern."""
    return I.pattern_success(view(spark, sf, "incidents"), _patterns(spark))


def project_logs(spark, sf):
    """Logs keyed by the project of the emitting user (the metric-sample key)."""
    ev = read_table(spark, sf, "events").select(
        F.col("event_id").alias("log_id"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project"))
    return view(spark, sf, "logs").join(ev, "log_id")


def project_commits(spark, sf):
    ev = read_table(spark, sf, "events").select(
        F.col("event_id").alias("commit_id"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project"))
    return view(spark, sf, "commits").join(ev, "commit_id")


_PLOGS = "plogs AS (SELECT l.*, 'p' || CAST(e.user_id % 3 AS STRING) AS project FROM logs l JOIN events e ON l.log_id = e.event_id)"
_PCOMMITS = "pcommits AS (SELECT c.*, 'p' || CAST(e.user_id % 3 AS STRING) AS project FROM commits c JOIN events e ON c.commit_id = e.event_id)"
_ERR = "regexp_matches(lower(message), 'error|exception|fatal|panic|fail')"
_OOM = "regexp_matches(lower(message), 'oomkilled|out of memory|heap space|memory limit')"
_CONN = "regexp_matches(lower(message), 'connection refused|econnrefused|connection reset|timeout')"

_ISSUES_SQL = f"""
WITH {_PLOGS},
svc AS (SELECT project, list(service ORDER BY ft, fl) AS services FROM (
          SELECT project, service, min(ts) AS ft, arg_min(log_id, (ts, log_id)) AS fl FROM plogs WHERE {_ERR}
          GROUP BY project, service) x GROUP BY project),
a AS (SELECT project, COUNT(*) FILTER (WHERE {_ERR}) AS errors, COUNT(*) FILTER (WHERE {_OOM}) AS ooms,
             COUNT(*) FILTER (WHERE {_CONN}) AS conns,
             arg_min(message, (ts, log_id)) FILTER (WHERE {_ERR}) AS first_error,
             arg_min(message, (ts, log_id)) FILTER (WHERE {_OOM}) AS first_oom,
             arg_min(message, (ts, log_id)) FILTER (WHERE {_CONN}) AS first_conn
      FROM plogs GROUP BY project),
last AS (SELECT project, container, arg_max(cpu_pct, (ts, sample_id)) AS cpu, arg_max(mem_pct, (ts, sample_id)) AS mem
         FROM metric_samples GROUP BY project, container),
u AS (
  SELECT a.project, 'error-spike' AS type, CASE WHEN errors > 50 THEN 'critical' ELSE 'high' END AS severity,
         'High error rate detected in logs (' || errors || ' errors)' AS finding,
         'Errors found in services: ' || array_to_string(services, ', ') || '. Sample: ' || substr(first_error, 1, 200) AS details,
         array_to_string(list_concat(['errors'], services), ',') AS tags, 1 AS rule_order, NULL::VARCHAR AS container
  FROM a LEFT JOIN svc USING (project) WHERE errors > 10
  UNION ALL
  SELECT project, 'resource-exhaustion', 'critical', 'Memory exhaustion detected',
         'OOM-related messages found: ' || substr(first_oom, 1, 200), 'oom,memory', 2, NULL FROM a WHERE ooms > 0
  UNION ALL
  SELECT project, 'dependency-failure', 'high', 'Connection failures detected',
         conns || ' connection errors found. Sample: ' || substr(first_conn, 1, 200), 'connection,dependency', 3, NULL
  FROM a WHERE conns > 5
  UNION ALL
  SELECT project, 'resource-exhaustion', CASE WHEN cpu > 95 THEN 'critical' ELSE 'high' END,
         'High CPU usage on ' || container || ': ' || printf('%.2f', cpu) || '%',
         'Container ' || container || ' is using ' || printf('%.2f', cpu) || '% CPU', 'cpu,resource', 4, container
  FROM last WHERE cpu > 90
  UNION ALL
  SELECT project, 'resource-exhaustion', CASE WHEN mem > 95 THEN 'critical' ELSE 'high' END,
         'High memory usage on ' || container || ': ' || printf('%.2f', mem) || '%',
         'Container ' || container || ' is using ' || printf('%.2f', mem) || '% memory', 'memory,resource', 5, container
  FROM last WHERE mem > 85)
SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS severity_rank FROM u"""


@query("detect_issues", _ISSUES_SQL, ("logs", "metric_samples"))
def detect_issues(spark, sf):
    """A5: analyzer issue rules per project (logs + latest container samples)."""
    return I.detect_issues(project_logs(spark, sf), view(spark, sf, "metric_samples"))


_TIMELINE_SQL = f"""
WITH {_PLOGS}, {_PCOMMITS}
SELECT project, ts, 'git' AS source, 'Commit: ' || message AS event, 'info' AS severity,
       substr(sha, 1, 7) || ' by unknown' AS details, commit_id AS event_id FROM pcommits
UNION ALL
SELECT project, ts, 'logs', '[' || service || '] ' || substr(message, 1, 200), 'error', NULL, log_id FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY project ORDER BY ts DESC, log_id DESC) AS rn FROM plogs WHERE {_ERR}) x
WHERE rn <= 10"""


def _timeline(spark, sf):
    return I.build_timeline(project_commits(spark, sf), project_logs(spark, sf))


@query("build_timeline", _TIMELINE_SQL, ("logs", "commits"))
def build_timeline(spark, sf):
    """Commits plus the last 10 error lines per project."""
    return _timeline(spark, sf)


@query("error_commit_correlations", f"""
WITH t AS ({_TIMELINE_SQL}),
e AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project ORDER BY epoch_us(ts) // 1000, event_id) AS rn
                     FROM t WHERE severity = 'error') x WHERE rn <= 5),
c AS (SELECT * FROM t WHERE source = 'git'),
j AS (SELECT e.project, e.event_id AS error_id, c.event_id AS commit_id,
             abs(epoch_us(e.ts) // 1000 - epoch_us(c.ts) // 1000) AS dt, e.event AS ev, c.details AS cd
      FROM e JOIN c ON e.project = c.project),
k AS (SELECT project, error_id, commit_id, greatest(0.3, 1 - dt / 3600000.0) AS confidence,
             'Error "' || substr(ev, 1, 100) || '" occurred within 1h of commit "' || cd || '"' AS description,
             'logs' AS source_a, 'git' AS source_b
      FROM j WHERE dt < 3600000)
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project ORDER BY confidence DESC, error_id, commit_id) AS rank
               FROM k) x WHERE rank <= 5""", ("logs", "commits"))
def error_commit_correlations(spark, sf):
    """First five timeline errors x commits within 1 h, top five."""
    return I.correlate_errors_commits(_timeline(spark, sf))


def _analysis(spark, sf):
    from vigil.plans import analysis as AN
    return AN.analyze(project_logs(spark, sf), view(spark, sf, "metric_samples"), project_commits(spark, sf),
                      view(spark, sf, "incidents"), _patterns(spark))


@query("analyze")
def analyze(spark, sf):
    """C1 (+ A5, T-K3, J3, J5, J4, C3, A6, C4): root-cause analysis of every
    project."""
    return _analysis(spark, sf)


def _fix_values() -> str:
    rows = [f"('{p[0]}', {ordi}, {p[7]}::DOUBLE, {i}, '{f}', '{p[5][0]}')"
            for ordi, p in enumerate(I.BUILTIN_PATTERNS + PROSE_PATTERNS) for i, f in enumerate(p[6])]
    return "(VALUES " + ", ".join(rows) + ") AS f(pattern_id, ord, rate, pos, fix, cause)"


# matches, similar incidents and fixes of every handled incident
_EVIDENCE_SQL = f"""
pm AS ({_MATCH_SQL}),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY incident_id ORDER BY strength DESC, pattern_ord) AS rn FROM pm),
words AS (SELECT incident_id, {_WS} AS ws FROM incidents),
sim AS (SELECT * FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY incident_id ORDER BY similarity DESC, similar_id) AS rank FROM (
    SELECT a.incident_id, b.incident_id AS similar_id, len(list_intersect(a.ws, b.ws))
             / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) AS similarity
    FROM words a JOIN words b ON a.incident_id <> b.incident_id WHERE len(a.ws) + len(b.ws) > 0) x
  WHERE similarity > 0.1) y WHERE rank <= 5),
cand AS (
  SELECT r.incident_id, f.fix AS description, r.strength * f.rate * 100 AS confidence,
         'Pattern: ' || r.pattern_name AS source, r.rn AS o1, f.pos AS o2
  FROM ranked r JOIN {_fix_values()} ON f.pattern_id = r.pattern_id WHERE r.rn <= 3
  UNION ALL
  SELECT sim.incident_id, h.resolution, similarity * 100, 'Similar incident: ' || h.title, 100 + rank, 0
  FROM sim JOIN handled_incidents h ON h.incident_id = sim.similar_id WHERE h.resolution IS NOT NULL),
one AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY incident_id, lower(description) ORDER BY o1, o2) AS k
                       FROM cand) z WHERE k = 1),
fixes AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY incident_id ORDER BY confidence DESC, o1, o2) AS rank
                         FROM one) z WHERE rank <= 10),
sagg AS (SELECT incident_id, max(similarity) AS top, COUNT(*) AS n FROM sim GROUP BY incident_id),
a AS (SELECT h.incident_id, r.pattern_id, r.pattern_name, coalesce(s.n, 0) AS similar_incidents, least(round(
             20.0 + coalesce(r.strength * 30, 0.0) + coalesce(s.top * 20, 0.0)), 95.0) AS confidence
      FROM handled_incidents h LEFT JOIN ranked r ON r.incident_id = h.incident_id AND r.rn = 1
      LEFT JOIN sagg s ON s.incident_id = h.incident_id)"""


def _handled(spark, sf):
    return view(spark, sf, "handled_incidents")


@query("incident_fixes", f"""
WITH {_EVIDENCE_SQL} SELECT incident_id, description, confidence, source, rank FROM fixes""", ("handled_incidents",))
def incident_fixes(spark, sf):
    """C3 + U3: the fixes suggested for every stored incident, from its
    patterns and from how similar incidents were resolved."""
    from vigil.plans import analysis as AN
    _, _, fixes = AN.incident_evidence(_handled(spark, sf), _patterns(spark))
    return fixes.select("incident_id", "description", "confidence", "source", "rank")


_ANALYSIS_SQL = f"""
WITH {_EVIDENCE_SQL}
SELECT h.incident_id, CAST(a.confidence AS INTEGER) AS confidence,
  coalesce(h.root_cause, c.cause, 'Detected: ' || h.title || '. Further investigation needed.') AS root_cause,
  a.pattern_name AS top_pattern, a.similar_incidents, f.description AS top_fix
FROM handled_incidents h JOIN a USING (incident_id)
LEFT JOIN (SELECT DISTINCT pattern_id, cause FROM {_fix_values()}) c ON c.pattern_id = a.pattern_id
LEFT JOIN fixes f ON f.incident_id = h.incident_id AND f.rank = 1"""


@query("analyze_incidents", _ANALYSIS_SQL, ("handled_incidents",))
def analyze_incidents(spark, sf):
    """C2 + A6 + C4: analysis of every stored incident (patterns, similar
    incidents, fixes, confidence, root cause)."""
    from vigil.plans import analysis as AN
    return AN.analyze_incidents(_handled(spark, sf), _patterns(spark))


@query("record_incidents")
def record_incidents(spark, sf):
    """Incidents recorded from the project analyses, with the matched
    patterns as sources."""
    from vigil.plans import analysis as AN
    args = (project_logs(spark, sf), view(spark, sf, "metric_samples"), project_commits(spark, sf),
            _handled(spark, sf), _patterns(spark))
    e = AN.project_evidence(*args)
    out = AN.record_incidents(AN.analyze(*args, evidence=e), e.patterns, now=F.lit("2024-02-01").cast("timestamp"))
    return out.withColumn("sources", F.array_join("sources", "|")).withColumn("tags", F.array_join("tags", "|"))


@query("analysis_evidence")
def analysis_evidence(spark, sf):
    """C1's rows in long form: each project's patterns, correlations, similar
    incidents and fixes, best first."""
    from vigil.plans import analysis as AN
    e = AN.project_evidence(project_logs(spark, sf), view(spark, sf, "metric_samples"), project_commits(spark, sf),
                            _handled(spark, sf), _patterns(spark))
    rows = [(e.patterns, "pattern", "pattern_name", "strength"), (e.correlations, "correlation", "description", "confidence"),
            (e.similar, "similar", "similar_id", "similarity"), (e.fixes, "fix", "description", "confidence")]
    parts = [d.select("project", F.lit(kind).alias("kind"), F.col(text).cast("string").alias("text"),
                      F.col(score).cast("double").alias("score")) for d, kind, text, score in rows]
    return reduce(lambda a, b: a.unionByName(b), parts)


_LVL = """CASE WHEN contains(lower(message), 'error') OR contains(lower(message), 'exception')
               OR contains(lower(message), 'fatal') THEN 1.0
               WHEN contains(lower(message), 'warn') THEN 0.5 ELSE 0.0 END"""
_IWS = "list_distinct(list_filter(string_split_regex(lower(finding || ' ' || details || ' ' || replace(tags, ',', ' ')), '\\s+'), lambda w: length(w) > 3))"
_LWS = "list_distinct(list_filter(string_split_regex(lower(message), '\\s+'), lambda w: length(w) > 3))"


@query("context_relevance", f"""
WITH iss AS ({_ISSUES_SQL}),
prim AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY project ORDER BY severity_rank, rule_order,
                                                     container NULLS FIRST) AS rn FROM iss) x WHERE rn = 1),
{_PLOGS},
nw AS (SELECT project, max(ts) AS now_ts FROM plogs GROUP BY project),
j AS (SELECT l.project, l.log_id, l.ts, l.message, {_IWS} AS iws, {_LWS} AS lws, nw.now_ts
      FROM plogs l JOIN prim USING (project) JOIN nw USING (project)),
s AS (SELECT project, log_id, ts,
             greatest(0.0, 1 - ((epoch_us(now_ts) - epoch_us(ts)) / 1e6) / 3600) AS temporal,
             CASE WHEN len(lws) + len(iws) - len(list_intersect(lws, iws)) > 0
                  THEN len(list_intersect(lws, iws)) / (len(lws) + len(iws) - len(list_intersect(lws, iws)))
                  ELSE 0.0 END AS semantic,
             {_LVL} AS severity FROM j),
r AS (SELECT *, 0.3 * temporal + 0.4 * semantic + 0.3 * severity AS relevance FROM s)
SELECT * FROM r""", ("logs", "metric_samples"))
def context_relevance(spark, sf):
    """P5: relevance of every log line of a project for its primary issue
    (0.3 temporal + 0.4 semantic + 0.3 severity)."""
    from vigil.plans import analysis as AN
    logs = project_logs(spark, sf)
    prim = AN.primary_issues(I.detect_issues(logs, view(spark, sf, "metric_samples")))
    return I.context_relevance(logs, prim)


@query("incident_fix_lookup", """
WITH fx AS (SELECT doc_id AS incident_id, CASE WHEN toxic = 1 THEN 'failed' ELSE 'resolved' END AS outcome,
                   doc_id AS applied_at FROM labels)
SELECT i.incident_id, i.title, i.status, fx.outcome AS fix_outcome, CAST(fx.applied_at AS VARCHAR) AS fix_applied_at
FROM incidents i LEFT JOIN fx USING (incident_id)""", ("incidents",))
def incident_fix_lookup(spark, sf):
    """Each incident with its latest fix record (fix records derived
    from the labels table)."""
    from vigil.operators.extensions import fix_lookup
    lab = read_table(spark, sf, "labels")
    fixes = lab.select(F.col("doc_id").alias("incident_id"),
                       F.when(F.col("toxic") == 1, "failed").otherwise("resolved").alias("outcome"),
                       F.col("doc_id").alias("applied_at"))
    inc = view(spark, sf, "incidents").select("incident_id", "title", "status")
    out = fix_lookup(inc, fixes)
    return out.select("incident_id", "title", "status", F.col("fix.outcome").alias("fix_outcome"),
                      F.col("fix.applied_at").cast("string").alias("fix_applied_at"))


@query("suggestion_ranking", f"""
WITH {_EVIDENCE_SQL},
g AS (SELECT f.description, COUNT(*) AS frequency,
             max(CASE h.status WHEN 'open' THEN 2 WHEN 'investigating' THEN 1 ELSE 0 END) AS sev,
             coalesce(max(v.rate), 0.0) AS ease, avg(a.confidence) / 100 AS confidence
      FROM fixes f JOIN handled_incidents h USING (incident_id) JOIN a USING (incident_id)
      LEFT JOIN (SELECT DISTINCT fix, max(rate) AS rate FROM {_fix_values()} GROUP BY fix) v ON v.fix = f.description
      GROUP BY f.description)
SELECT description, frequency, ease, confidence,
       CASE sev WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM g""", ("handled_incidents",))
def suggestion_ranking(spark, sf):
    """Every fix suggested for any incident aggregated into ranked
    suggestions — frequency (incidents), severity (worst status: open high,
    investigating medium, resolved low), ease (success rate of the fix's
    pattern) and confidence (mean analysis confidence / 100); best first."""
    from vigil.operators.extensions import rank_suggestions
    from vigil.plans import analysis as AN
    inc, pats = _handled(spark, sf), _patterns(spark)
    evidence = AN.incident_evidence(inc, pats)
    a = AN.analyze_incidents(inc, pats, evidence).select("incident_id", F.col("confidence").alias("_conf"))
    sev = F.when(F.col("status") == "open", 2).when(F.col("status") == "investigating", 1).otherwise(0)
    ease = pats.select(F.explode("fixes").alias("description"), "successRate").groupBy("description").agg(
        F.max("successRate").alias("ease"))
    s = (evidence[2].select("incident_id", "description").join(a, "incident_id")
         .join(inc.select("incident_id", "status"), "incident_id").join(ease, "description", "left")
         .groupBy("description").agg(F.count(F.lit(1)).alias("frequency"), F.max(sev).alias("_sev"),
                                     F.max("ease").alias("ease"), (F.avg("_conf") / 100).alias("confidence")))
    s = s.withColumn("severity", F.when(F.col("_sev") == 2, "high").when(F.col("_sev") == 1, "medium")
                     .otherwise("low")).drop("_sev").fillna(0.0, ["ease"])
    return rank_suggestions(s).drop("priority_score")
