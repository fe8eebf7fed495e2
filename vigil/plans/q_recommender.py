"""Registered recommender queries over ``engagement`` and ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import recommender as RC
from vigil.operators import warehouse as W
from vigil.operators.extensions import batch_recommend_all
from vigil.plans.registry import query
from vigil.session import cut_lineage, scratch_path
from vigil.sources.tables import read_table, view

_W = """CASE event_type WHEN 'view_complete' THEN 4.0 WHEN 'rating' THEN 3.0 WHEN 'view_start' THEN 1.0
             WHEN 'search' THEN 0.5 ELSE 1.0 END"""
_MATRIX = f"""
SELECT user_id, item_id, sum({_W} * value) AS weight FROM engagement
WHERE item_id IN (SELECT id FROM catalog) GROUP BY user_id, item_id"""


@query("validate_engagement", """
SELECT * FROM engagement
WHERE item_id IN (SELECT id FROM catalog) AND event_type IN ('view_start', 'view_complete', 'rating', 'search')""",
       ("engagement", "catalog"))
def validate_engagement(spark, sf):
    """Accepted engagement events (known item, allowed type)."""
    ok, _ = RC.validate_engagement(view(spark, sf, "engagement"), view(spark, sf, "catalog"))
    return ok


@query("rejected_engagement", """
SELECT *, 'unknown item' AS reason FROM engagement WHERE item_id NOT IN (SELECT id FROM catalog)
UNION ALL
SELECT *, 'invalid event_type' FROM engagement
WHERE item_id IN (SELECT id FROM catalog) AND event_type NOT IN ('view_start', 'view_complete', 'rating', 'search')""",
       ("engagement", "catalog"))
def rejected_engagement(spark, sf):
    """I15 quarantine: rejected events with the reason."""
    _, bad = RC.validate_engagement(view(spark, sf, "engagement"), view(spark, sf, "catalog"))
    return bad


def _matrix(spark, sf):
    return RC.engagement_matrix(view(spark, sf, "engagement"), view(spark, sf, "catalog"))


@query("engagement_matrix", _MATRIX, ("engagement", "catalog"))
def engagement_matrix(spark, sf):
    """A12 + F7 + E9: weighted interaction per (user, item) over catalog items."""
    return _matrix(spark, sf)


@query("trending", f"""
WITH m AS ({_MATRIX}),
s AS (SELECT c.id AS item_id, c.title, c.rating, coalesce(x.s, 0.0) AS s
      FROM catalog c LEFT JOIN (SELECT item_id, sum(weight) AS s FROM m GROUP BY item_id) x ON c.id = x.item_id),
st AS (SELECT min(s) AS lo, max(s) AS hi FROM s),
n AS (SELECT COUNT(*) AS nnz FROM m)
SELECT item_id, title,
       round(CASE WHEN nnz > 0 THEN (s - lo) / (hi - lo + 1e-9) ELSE rating / 10.0 END, 4) AS score,
       'trending' AS source
FROM s, st, n ORDER BY s DESC, rating DESC, item_id LIMIT 10""", ("engagement", "catalog"))
def trending(spark, sf):
    """M8: top-10 trending catalog items."""
    return RC.trending(_matrix(spark, sf), view(spark, sf, "catalog"))


_TFIDF = """
WITH t AS (SELECT id AS item_id,
                  regexp_extract_all(lower(array_to_string(genres, ' ') || ' ' || array_to_string(tags, ' ')),
                                     '\\b\\w\\w+\\b') AS tok FROM catalog),
g AS (SELECT item_id, unnest(list_concat(tok, list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]))) AS term
      FROM t),
tf AS (SELECT item_id, term, CAST(COUNT(*) AS DOUBLE) AS tf FROM g GROUP BY item_id, term),
df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term),
n AS (SELECT COUNT(*) AS n FROM catalog),
w AS (SELECT tf.item_id, tf.term, tf.tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n)
SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM w"""


@query("item_tfidf", _TFIDF, ("catalog",))
def item_tfidf(spark, sf):
    """M4: unit TF-IDF vectors of uni/bi-grams over genres + tags."""
    return RC.item_vectors(view(spark, sf, "catalog"))


# content scores of all catalog items for every user with history, best first
_CONTENT = f"""
m AS ({_MATRIX}), v AS ({_TFIDF}),
nw AS (SELECT user_id, COUNT(*) AS n FROM m GROUP BY user_id),
prof AS (SELECT m.user_id, v.term, sum(v.w) / nw.n AS pw FROM m JOIN v USING (item_id) JOIN nw USING (user_id)
         GROUP BY m.user_id, v.term, nw.n),
cs AS (SELECT prof.user_id, v.item_id, sum(pw * w) AS s FROM prof JOIN v USING (term) GROUP BY prof.user_id, v.item_id),
rest AS (SELECT nw.user_id, c.id AS item_id, c.title, c.genres, c.tags, c.rating AS catalog_rating,
                CAST(coalesce(cs.s, 0.0) AS FLOAT) AS s
         FROM nw CROSS JOIN catalog c LEFT JOIN cs ON cs.user_id = nw.user_id AND cs.item_id = c.id
         WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = nw.user_id AND m.item_id = c.id)),
recs AS (SELECT user_id, rank, item_id, title, genres, tags, catalog_rating, round(CAST(s AS DOUBLE), 4) AS score,
                'content' AS source
         FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) AS rank FROM rest) x
         WHERE rank <= 10)"""


@query("content_recommendations", f"WITH {_CONTENT} SELECT * FROM recs", ("engagement", "catalog"))
def content_recommendations(spark, sf):
    """M5 + M7 (content branch) + J8 + J9: top-10 unwatched items per user by
    mean cosine similarity to the watched items, the whole catalog scored."""
    return RC.hybrid_recommend(_matrix(spark, sf), view(spark, sf, "catalog"), model=None)


def _registered(spark, sf):
    """Every customer and everyone who ever sent an event is a user."""
    ids = read_table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("user_id"))
    return ids.union(view(spark, sf, "engagement").select(F.col("user_id").cast("long"))).distinct()


@query("hybrid_recommendations")
def hybrid_recommendations(spark, sf):
    """M6 + M7 + M10: ALS (implicit, 50 factors, 20 iterations, reg 0.1) on
    string ids, blended 0.7 / 0.3 with content scores for users with >= 5
    watched items, trending for registered users without history; persisted and
    read back as a latest-wins table."""
    m = _matrix(spark, sf).withColumn("user_id", F.concat(F.lit("u-"), F.col("user_id").cast("string")))
    users = _registered(spark, sf).select(F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("user_id"))
    recs = RC.hybrid_recommend(m, view(spark, sf, "catalog"), model=RC.fit_als(m), users=users)
    path = scratch_path(spark, "recommendations")
    batch_recommend_all(recs, "als+content-1", path)      # M10: persisted replacing table
    return W.recs_for_user(spark.read.parquet(path), RC.TOP_K)


@query("stored_recommendations", f"""
WITH {_CONTENT}
SELECT user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank, item_id, score,
       'content-2' AS model_ver FROM recs WHERE rank <= 10""", ("engagement", "catalog"))
def stored_recommendations(spark, sf):
    """M10 + F8: an older model's rows and a newer model's for the same keys
    are persisted; each user gets the newest row of every key, best first."""
    recs = RC.hybrid_recommend(_matrix(spark, sf), view(spark, sf, "catalog"), model=None)
    path = scratch_path(spark, "recommendations")
    at = [F.lit(f"2024-02-0{d} 00:00:00").cast("timestamp") for d in (1, 2)]
    batch_recommend_all(recs, "content-2", path, now=at[1])     # the newer rows come first in the log
    batch_recommend_all(recs.withColumn("score", 1 - F.col("score")), "content-1", path, now=at[0])
    return W.recs_for_user(spark.read.parquet(path), RC.TOP_K).select("user_id", "rank", "item_id", "score", "model_ver")


@query("served_recommendations", f"""
WITH {_CONTENT},
s AS (SELECT c.id AS item_id, coalesce(x.s, 0.0) AS s, c.rating
      FROM catalog c LEFT JOIN (SELECT item_id, sum(weight) AS s FROM m GROUP BY item_id) x ON c.id = x.item_id),
st AS (SELECT min(s) AS lo, max(s) AS hi FROM s),
t AS (SELECT item_id, round((s - lo) / (hi - lo + 1e-9), 4) AS score, 'trending' AS source FROM s, st
      ORDER BY s DESC, rating DESC, item_id LIMIT 10),
users AS (SELECT CAST(c_custkey AS BIGINT) AS user_id FROM customer UNION SELECT CAST(user_id AS BIGINT) FROM engagement)
SELECT user_id, item_id, score, CASE WHEN user_id % 2 = 0 THEN 'stored' ELSE 'content' END AS source FROM recs
UNION ALL SELECT user_id, item_id, score, source FROM users, t
WHERE user_id NOT IN (SELECT user_id FROM nw)""", ("engagement", "catalog"))
def served_recommendations(spark, sf):
    """Stored rows for users that have any (even ids here), else the live
    model's, else the trending list for registered users without history."""
    cat, m = view(spark, sf, "catalog"), _matrix(spark, sf)
    live = cut_lineage(RC.hybrid_recommend(m, cat, model=None).select("user_id", "item_id", "score", "source"))
    stored = live.where(F.col("user_id") % 2 == 0).withColumn("source", F.lit("stored"))
    trend = RC.trending(m, cat).select("item_id", "score", "source")
    return RC.serve_recommendations(stored, live, trend, _registered(spark, sf))


@query("catalog_source", """
SELECT id, title, CASE WHEN len(tags) > 0 THEN tags[1:3] ELSE ['tech'] END AS genres, tags, 2024 AS year, rating
FROM (SELECT id, title, list_distinct([regexp_extract(url, '://([^/]*)', 1)]) AS tags,
             round(least(greatest(log10(score + 1) / log10(1001.0) * 9 + 1, 1.0), 10.0), 1) AS rating
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM articles) WHERE rn = 1) x""",
       ("articles", "catalog"))
def catalog_source(spark, sf):
    """J13 + I14: the catalog comes from the latest scraped articles when there
    are any, else from the fallback catalog."""
    latest = W.latest_wins(view(spark, sf, "articles"), ["id"], "version")
    tags = F.array(F.regexp_extract("url", "://([^/]*)", 1))
    scraped = RC.articles_to_catalog(latest.withColumn("tags", tags), 2024)
    fallback = view(spark, sf, "catalog").withColumn("year", F.lit(2024))
    return RC.catalog_source(scraped, fallback)


@query("precision_at_k")
def precision_at_k(spark, sf):
    """Content recommendations from the first half of the month scored
    against the items each user engaged with afterwards."""
    e = view(spark, sf, "engagement")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    train = e.filter(F.col("ts").cast("timestamp") < cut)
    test = RC.known_items(e.filter(F.col("ts").cast("timestamp") >= cut), view(spark, sf, "catalog"))
    recs = RC.hybrid_recommend(RC.engagement_matrix(train, view(spark, sf, "catalog")),
                               view(spark, sf, "catalog"), model=None)
    return RC.precision_at_k(recs, test)


@query("training_metadata", f"""
WITH m AS ({_MATRIX})
SELECT COUNT(DISTINCT user_id) AS n_users, COUNT(DISTINCT item_id) AS n_items, COUNT(*) AS n_interactions,
       'ContentBased' AS algorithm FROM m""", ("engagement", "catalog"))
def training_metadata(spark, sf):
    """Users, items and interactions of the training matrix."""
    return RC.training_metadata(_matrix(spark, sf), None)
