"""Incident-analysis composites over all projects at once.

``analyze`` joins, per project: the primary issue (A5 + T-K3), the patterns
matching it (J3), error / commit correlations (J5), similar stored
incidents (J4 as an R-S set-similarity join), fix suggestions (C3),
confidence (A6) and the root cause (C4).  Every step is a DataFrame job;
the per-project results are small and are joined on ``project``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import word_set
from vigil.operators import incidents as I
from vigil.operators.ordered import top_n
from vigil.operators.simjoin import top_jaccard
from vigil.session import cut_lineage


def _issue_text() -> F.Column:
    return F.concat_ws(" ", "finding", "details", F.regexp_replace("tags", ",", " "))


def primary_issues(issues: DataFrame, keys: list[str] = ["project"]) -> DataFrame:
    """T-K3: the first issue per project: critical first, then rule order."""
    return top_n(issues, keys, [F.col("severity_rank"), F.col("rule_order"),
                                F.col("container").asc_nulls_first()], 1)


def similar_to_issues(issues: DataFrame, incidents: DataFrame, keys: list[str] = ["project"],
                      k: int = I.SIMILAR_LIMIT) -> DataFrame:
    """Stored incidents similar to each project's issue (Jaccard > 0.1, top 5)."""
    iw = issues.select(F.concat_ws("\u0001", *keys).alias("id"),
                       word_set(_issue_text()).alias("ws"))
    tags = F.col("tags") if "tags" in incidents.columns else F.array(F.col("tag"))
    kw = incidents.select(F.col("incident_id").cast("string").alias("id"),
                          word_set(F.col("title"), F.col("description"), F.array_join(tags, " ")).alias("ws"))
    p = top_jaccard(iw, k, I.SIMILARITY_MIN, others=kw).select(
        F.col("id").alias("_key"), F.col("other").alias("similar_id"), F.col("score").alias("similarity"))
    top = top_n(p, ["_key"], [F.col("similarity").desc(), F.col("similar_id")], k, rank_col="rank")
    info = incidents.select(F.col("incident_id").cast("string").alias("similar_id"), "title",
                            *(["resolution"] if "resolution" in incidents.columns else []))
    if "resolution" not in incidents.columns:
        info = info.withColumn("resolution", F.lit(None).cast("string"))
    out = top.join(info, "similar_id", "left")
    for i, kcol in enumerate(keys):
        out = out.withColumn(kcol, F.split("_key", "\u0001")[i])
    return out.drop("_key")


@dataclass
class Evidence:
    """What an analysis rests on, as rows: the primary issue of each project,
    matched patterns, error / commit correlations, similar incidents, fixes."""
    issues: DataFrame
    patterns: DataFrame
    correlations: DataFrame
    similar: DataFrame
    fixes: DataFrame


def project_evidence(logs: DataFrame, samples: DataFrame, commits: DataFrame, incidents: DataFrame,
                     patterns: DataFrame, keys: list[str] = ["project"]) -> Evidence:
    """C1's rows, written (a few for each project)."""
    prim = cut_lineage(primary_issues(I.detect_issues(logs, samples, keys), keys))
    pm = I.match_patterns(prim.withColumn("_id", F.concat_ws("\u0001", *keys)), patterns, "_id",
                          _issue_text(), min_strength=None)
    for i, kcol in enumerate(keys):
        pm = pm.withColumn(kcol, F.split("_id", "\u0001")[i])
    pm = cut_lineage(pm.drop("_id"))
    corr = cut_lineage(I.correlate_errors_commits(I.build_timeline(commits, logs, keys), keys))
    sim = cut_lineage(similar_to_issues(prim, incidents, keys))
    return Evidence(prim, pm, corr, sim, cut_lineage(I.suggest_fixes(pm, patterns, sim, keys)))


def analyze(logs: DataFrame, samples: DataFrame, commits: DataFrame, incidents: DataFrame,
            patterns: DataFrame, keys: list[str] = ["project"], evidence: Evidence | None = None) -> DataFrame:
    """Per project the finding, confidence, root cause and the evidence
    counts; a project without issues gets 'No issues detected' / 90.  The rows
    behind it: ``project_evidence``."""
    e = evidence or project_evidence(logs, samples, commits, incidents, patterns, keys)
    prim, pm, corr, sim, fixes = e.issues, e.patterns, e.correlations, e.similar, e.fixes
    top_p = (top_n(pm, keys, [F.col("strength").desc(), F.col("pattern_ord")], 1)
             .join(patterns.select(F.col("id").alias("pattern_id"), "rootCauses"), "pattern_id")
             .select(*keys, F.col("strength").alias("top_strength"), F.col("pattern_name").alias("top_pattern"),
                     "rootCauses"))
    n_p = pm.groupBy(*keys).agg(F.count(F.lit(1)).alias("patterns_matched"))
    cagg = corr.groupBy(*keys).agg(
        F.max("confidence").alias("top_correlation"), F.count(F.lit(1)).alias("correlations"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "description"))),
                    lambda x: x["description"]).alias("corr_desc"))
    sagg = sim.groupBy(*keys).agg(F.max("similarity").alias("top_similarity"),
                                  F.count(F.lit(1)).alias("similar_incidents"))
    fagg = fixes.filter(F.col("rank") == 1).select(*keys, F.col("description").alias("top_fix"))
    projects = samples.select(*keys).union(logs.select(*keys)).distinct()
    d = (projects.join(prim, keys, "left").join(top_p, keys, "left").join(n_p, keys, "left")
         .join(cagg, keys, "left").join(sagg, keys, "left").join(fagg, keys, "left"))
    has = F.col("finding").isNotNull()
    conf = I.confidence(F.col("top_strength"), F.col("top_correlation"), F.col("top_similarity"))
    rc = I.root_cause(F.coalesce("rootCauses", F.array().cast("array<string>")),
                      F.coalesce("corr_desc", F.array().cast("array<string>")), F.col("finding"))
    return d.select(
        *keys, F.coalesce("finding", F.lit(I.NO_ISSUE_FINDING)).alias("finding"),
        F.when(has, conf).otherwise(F.lit(I.NO_ISSUE_CONFIDENCE)).alias("confidence"),
        F.when(has, rc).alias("root_cause"), "severity", "type",
        F.coalesce("patterns_matched", F.lit(0)).alias("patterns_matched"), "top_pattern",
        F.coalesce("correlations", F.lit(0)).alias("correlations"),
        F.coalesce("similar_incidents", F.lit(0)).alias("similar_incidents"), "top_fix")


def incident_evidence(incidents: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pattern matches, similar incidents, fixes) of every stored incident, as
    rows, written: J3 over title, description and source summaries, J4, and C3
    with the resolutions of similar incidents."""
    pm = cut_lineage(I.match_patterns(incidents, patterns, "incident_id", I.incident_text(incidents), None))
    res = F.col("resolution") if "resolution" in incidents.columns else F.lit(None).cast("string")
    info = incidents.select(F.col("incident_id").alias("similar_id"), "title", res.alias("resolution"))
    sim = cut_lineage(I.similar_incidents(incidents).join(info, "similar_id", "left"))
    return pm, sim, cut_lineage(I.suggest_fixes(pm, patterns, sim, ["incident_id"]))


def analyze_incidents(incidents: DataFrame, patterns: DataFrame,
                      evidence: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """The same analysis for every stored incident (no correlations):
    patterns matched in title, description and source summaries, similar
    incidents, fixes, confidence and root cause per incident; a root cause
    stored with the incident holds."""
    pm, sim, fixes = evidence or incident_evidence(incidents, patterns)
    top_p = (top_n(pm, ["incident_id"], [F.col("strength").desc(), F.col("pattern_ord")], 1)
             .join(patterns.select(F.col("id").alias("pattern_id"), "rootCauses"), "pattern_id")
             .select("incident_id", F.col("strength").alias("top_strength"), "rootCauses",
                     F.col("pattern_name").alias("top_pattern")))
    sagg = sim.groupBy("incident_id").agg(F.max("similarity").alias("top_similarity"),
                                          F.count(F.lit(1)).alias("similar_incidents"))
    fagg = fixes.filter(F.col("rank") == 1).select("incident_id", F.col("description").alias("top_fix"))
    stored = F.col("root_cause") if "root_cause" in incidents.columns else F.lit(None).cast("string")
    d = incidents.select("incident_id", "title", F.nullif(stored, F.lit("")).alias("_stored")) \
        .join(top_p, "incident_id", "left").join(sagg, "incident_id", "left").join(fagg, "incident_id", "left")
    conf = I.confidence(F.col("top_strength"), F.lit(None).cast("double"), F.col("top_similarity"))
    rc = I.root_cause(F.coalesce("rootCauses", F.array().cast("array<string>")),
                      F.array().cast("array<string>"), F.col("title"))
    return d.select("incident_id", conf.alias("confidence"), F.coalesce("_stored", rc).alias("root_cause"), "top_pattern",
                    F.coalesce("similar_incidents", F.lit(0)).alias("similar_incidents"), "top_fix")


def record_incidents(analysis: DataFrame, matches: DataFrame | None = None,
                     keys: list[str] = ["project"], now: F.Column | None = None) -> DataFrame:
    """Analysis results with an issue -> new incident rows (type custom,
    severity high when confidence >= 70 else medium, status open, no tags,
    pattern summaries as sources; the id is a digest, so recording a result
    twice makes the same row)."""
    a = analysis.filter(F.col("finding") != I.NO_ISSUE_FINDING)
    out = a.select(F.sha2(F.concat_ws("\u0001", *keys, "finding", "root_cause"), 256).alias("incident_id"),
                   *keys, F.lit("custom").alias("type"), F.array().cast("array<string>").alias("tags"),
                   (F.current_timestamp() if now is None else now).alias("timestamp"),
                   F.when(F.col("confidence") >= 70, "high").otherwise("medium").alias("severity"),
                   F.col("finding").alias("title"), F.col("root_cause").alias("description"),
                   F.col("root_cause").alias("rootCause"), F.lit("open").alias("status"))
    if matches is not None:
        src = matches.groupBy(*keys).agg(F.collect_list(F.concat(
            F.lit("Pattern: "), F.col("pattern_name"), F.lit(" ("),
            F.round(F.col("strength") * 100).cast("int").cast("string"), F.lit("% match)"))).alias("sources"))
        out = out.join(src, keys, "left")
    return out
