"""Registered warehouse queries (replacing tables, reports, TTL, history)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import logs as L
from vigil.operators import warehouse as W
from vigil.plans.registry import query
from vigil.sources.tables import read_table, view


@query("latest_articles", """
SELECT id, arg_max(version, version) AS version, arg_max(url, version) AS url, arg_max(title, version) AS title,
       arg_max(score, version) AS score
FROM articles GROUP BY id""", ("articles",))
def latest_articles(spark, sf):
    """Articles replacing table read with FINAL (latest version per id)."""
    return W.latest_wins(view(spark, sf, "articles"), ["id"], "version")


@query("top_articles", """
SELECT * FROM (SELECT id, arg_max(version, version) AS version, arg_max(url, version) AS url,
                      arg_max(title, version) AS title, arg_max(score, version) AS score
               FROM articles GROUP BY id) a
ORDER BY score DESC, id LIMIT 500""", ("articles",))
def top_articles(spark, sf):
    """T-K5: top 500 latest articles by score."""
    lw = W.latest_wins(view(spark, sf, "articles"), ["id"], "version")
    return W.newest(lw, [F.col("score").desc(), F.col("id")], W.TOP_ARTICLES)


@query("latest_events", """
SELECT * FROM engagement ORDER BY ts DESC, event_id DESC LIMIT 20""", ("engagement",))
def latest_events(spark, sf):
    """T-K6: the 20 newest engagement events."""
    return W.newest(view(spark, sf, "engagement"), [F.col("ts").desc(), F.col("event_id").desc()],
                    W.LATEST_EVENTS)


@query("top_engaged", """
SELECT item_id, COUNT(*) AS completions, sum(value) AS total_value FROM engagement
WHERE event_type = 'view_complete' GROUP BY item_id
ORDER BY completions DESC, total_value DESC, item_id LIMIT 10""", ("engagement",))
def top_engaged(spark, sf):
    """Most completed items."""
    return W.top_engaged(view(spark, sf, "engagement"))


@query("table_counts", """
SELECT 'events' AS "table", COUNT(*) AS rows FROM engagement
UNION ALL SELECT 'articles', COUNT(*) FROM articles
UNION ALL SELECT 'chat', COUNT(*) FROM chat""", ("engagement", "articles", "chat"))
def table_counts(spark, sf):
    """Event / article / message counts."""
    return W.table_counts({"events": view(spark, sf, "engagement"), "articles": view(spark, sf, "articles"),
                           "chat": view(spark, sf, "chat")})


@query("recent_messages", """
SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM chat) x
WHERE rn <= 5""", ("chat",))
def recent_messages(spark, sf):
    """The five latest messages of every conversation, oldest first."""
    return W.recent_messages(view(spark, sf, "chat"), 5)


@query("event_ttl", """
SELECT * FROM engagement WHERE ts >= TIMESTAMP '2024-04-15 00:00:00' - INTERVAL 90 DAY""", ("engagement",))
def event_ttl(spark, sf):
    """90-day TTL on engagement events as of 2024-04-15."""
    return L.ttl(view(spark, sf, "engagement"), "2024-04-15 00:00:00", 90)


@query("storage_info")
def storage_info(spark, sf):
    """Bytes, files, oldest and newest event of the events table."""
    return W.storage_info(read_table(spark, sf, "events"))
