"""Hybrid recommender as Spark jobs: validation, engagement matrix, TF-IDF
content vectors, content scores, ALS, hybrid blend, trending, serving
fallbacks and evaluation (I14, I15, E9, F7, A12, A27, M4-M8, M10, J8, J9,
J13, J14, P12).

Content similarity is computed without an item x item matrix: the mean
cosine of a candidate to the watched items equals the dot product of the
candidate's unit TF-IDF vector with the user's *profile* (the mean of the
watched items' unit vectors), so scores come from one sparse term join
(profile terms x item terms).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.scalar import ALLOWED_ENGAGEMENT, event_weight, rating_from_score
from vigil.operators.ordered import top_n
from vigil.operators.scoring import dense_ids, factor_extremes, top_items
from vigil.session import cut_lineage

# --- fixed values (must equal the reference's rules) ---------------------
COLLAB_WEIGHT = 0.7
MIN_INTERACTIONS = 5          # per user for the hybrid branch, and total for fitting ALS
ALS_FACTORS, ALS_ITERATIONS, ALS_REG = 50, 20, 0.1
TOP_K = 10
RETRAIN_EVERY = 50
TREND_EPS = 1e-9
DEFAULT_GENRE = "tech"
# --------------------------------------------------------------------------

_TOKEN = r"\b\w\w+\b"


def validate_engagement(events: DataFrame, catalog: DataFrame, item: str = "item_id",
                        id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Accepted events (known item, allowed type) and rejects with a
    reason (left-semi / left-anti joins on the catalog ids)."""
    ids = catalog.select(F.col(id_col).alias(item)).distinct()
    allowed = F.col("event_type").isin(*ALLOWED_ENGAGEMENT)
    known = events.join(ids, item, "left_semi")
    accepted = known.filter(allowed)
    unknown = events.join(ids, item, "left_anti").withColumn("reason", F.lit("unknown item"))
    bad_type = known.filter(~allowed).withColumn("reason", F.lit("invalid event_type"))
    return accepted, unknown.unionByName(bad_type)


def known_items(events: DataFrame, catalog: DataFrame, item: str = "item_id", id_col: str = "id") -> DataFrame:
    """interactions whose item is in the catalog."""
    return events.join(catalog.select(F.col(id_col).alias(item)).distinct(), item, "left_semi")


def engagement_matrix(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Σ weight(type) x value per (user, item) over catalog items.  The
    sum is combined map-side, so a hot user is reduced inside every task
    before the shuffle."""
    e = known_items(events, catalog)
    return e.groupBy("user_id", "item_id").agg(F.sum(event_weight("event_type", "value")).alias("weight"))


def trending(matrix: DataFrame, catalog: DataFrame, k: int = TOP_K) -> DataFrame:
    """M8: item score = Σ weights, normalised (s - min) / (max - min + 1e-9)
    over the whole catalog (items without interactions score 0); no
    interactions at all -> rating / 10."""
    s = matrix.groupBy("item_id").agg(F.sum("weight").alias("s"))
    items = catalog.select(F.col("id").alias("item_id"), "title", "rating")
    j = items.join(s, "item_id", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    stats = j.agg(F.min("s").alias("lo"), F.max("s").alias("hi")).withColumn("_k", F.lit(1))
    has = matrix.agg(F.count(F.lit(1)).alias("nnz")).withColumn("_k", F.lit(1))
    # one-row global statistics attached on a constant key
    j = j.withColumn("_k", F.lit(1)).join(F.broadcast(stats), "_k").join(F.broadcast(has), "_k").drop("_k")
    score = F.when(F.col("nnz") > 0, (F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo") + TREND_EPS)) \
        .otherwise(F.col("rating") / 10.0)
    j = j.withColumn("score", F.round(score, 4)).withColumn("source", F.lit("trending"))
    return top_n(j.select("item_id", "title", "score", "source", "s", "rating"), [],
                 [F.col("s").desc(), F.col("rating").desc(), F.col("item_id")], k).drop("s", "rating")


def _text_key() -> Column:
    return F.concat_ws("\u0001", F.array_join("genres", " "), F.array_join("tags", " "))


def key_vectors(catalog: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """M4 on distinct catalog texts: items with the same genres + tags have
    the same TF-IDF vector, so vectors are computed once per text key (df
    still counts items).  Returns ``(item_id -> key, (key, term, w))``."""
    keyed = catalog.select(F.col(id_col).alias("item_id"), _text_key().alias("key"), "genres", "tags")
    keys = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("items"), F.first("genres").alias("genres"),
                                    F.first("tags").alias("tags"))
    text = F.lower(F.concat_ws(" ", F.array_join("genres", " "), F.array_join("tags", " ")))
    d = keys.select("key", "items", F.regexp_extract_all(text, F.lit(_TOKEN), 0).alias("tok"))
    n1 = F.greatest(F.size("tok") - 1, F.lit(0))
    grams = F.concat(d["tok"], F.transform(F.arrays_zip(F.slice("tok", 1, n1), F.slice("tok", 2, n1)),
                                           lambda z: F.concat_ws(" ", z["0"], z["1"])))
    t = d.select("key", "items", F.explode(grams).alias("term"))
    tf = t.groupBy("key", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"), F.first("items").alias("items"))
    n = catalog.agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(1))
    dfr = (tf.groupBy("term").agg(F.sum("items").alias("df")).withColumn("_k", F.lit(1))
           .join(F.broadcast(n), "_k").drop("_k"))   # one-row table on a constant key
    dfr = dfr.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(dfr, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    kv = w.join(norm, "key").select("key", "term", (F.col("w") / F.col("norm")).alias("w"))
    return keyed.select("item_id", "key"), kv


def item_vectors(catalog: DataFrame, id_col: str = "id") -> DataFrame:
    """M4: TF-IDF of uni- and bi-grams over ``genres + tags`` (lower-cased,
    tokens of two or more word characters), idf = ln((1 + n) / (1 + df)) + 1,
    raw term counts, L2-normalised: rows ``(item_id, term, w)``."""
    keyed, kv = key_vectors(catalog, id_col)
    return keyed.join(kv, "key").select("item_id", "term", "w")


def content_key_scores(matrix: DataFrame, keyed: DataFrame, kv: DataFrame) -> DataFrame:
    """M5 per (user, text key): profile . key vector, where the profile is the
    mean of the watched items' unit vectors."""
    watched = matrix.select("user_id", "item_id").distinct()
    nw = watched.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_watched"))
    prof = (watched.join(keyed, "item_id").join(kv, "key").groupBy("user_id", "term").agg(F.sum("w").alias("pw"))
            .join(nw, "user_id").select("user_id", "term", (F.col("pw") / F.col("n_watched")).alias("pw")))
    return (prof.join(kv, "term").groupBy("user_id", "key")
            .agg(F.sum(F.col("pw") * F.col("w")).alias("content_score")))


def content_scores(matrix: DataFrame, vectors: DataFrame) -> DataFrame:
    """M5: mean cosine similarity of every catalog item to the user's watched
    items = profile . item (profile = mean of watched unit vectors).  Items
    that share no term with the profile score 0 and are not emitted."""
    watched = matrix.select("user_id", "item_id").distinct()
    nw = watched.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_watched"))
    prof = (watched.join(vectors, "item_id").groupBy("user_id", "term").agg(F.sum("w").alias("pw"))
            .join(nw, "user_id").select("user_id", "term", (F.col("pw") / F.col("n_watched")).alias("pw")))
    return (prof.join(vectors, "term").groupBy("user_id", "item_id")
            .agg(F.sum(F.col("pw") * F.col("w")).alias("content_score")))


@dataclass
class Factors:
    """A fitted factor model under the ids of its matrix, whatever their type."""
    users: DataFrame     # user_id, features
    items: DataFrame     # item_id, features
    rank: int


def fit_als(matrix: DataFrame, seed: int = 42, rank: int = ALS_FACTORS, max_iter: int = ALS_ITERATIONS,
            reg: float = ALS_REG) -> Factors | None:
    """M6: implicit-feedback ALS on the engagement matrix (None when fewer
    than five interactions).  Users and items keep their own roles (quirk
    Q11).  Ids may be strings or longs of any size: the trainer gets dense
    numbers (``scoring.dense_ids``) and the factors get the ids back."""
    if matrix.limit(MIN_INTERACTIONS).count() < MIN_INTERACTIONS:
        return None
    users, items = (cut_lineage(dense_ids(matrix, c, "n_" + c)) for c in ("user_id", "item_id"))
    rows = matrix.join(users, "user_id").join(items, "item_id").select(
        F.col("n_user_id").cast("int"), F.col("n_item_id").cast("int"), F.col("weight").cast("float"))
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, implicitPrefs=True, userCol="n_user_id",
              itemCol="n_item_id", ratingCol="weight", seed=seed, coldStartStrategy="drop",
              nonnegative=False, checkpointInterval=5)
    model = als.fit(rows)
    named = [f.select(F.col("id").cast("long").alias("n_" + c), "features").join(
                 ids.withColumn("n_" + c, F.col("n_" + c).cast("long")), "n_" + c).select(c, "features")
             for f, ids, c in ((model.userFactors, users, "user_id"), (model.itemFactors, items, "item_id"))]
    return Factors(cut_lineage(named[0]), cut_lineage(named[1]), rank)


def als_scores(model: Factors, pairs: DataFrame) -> DataFrame:
    """ALS score of (user, item) candidate pairs: dot product of the factor
    vectors, joined per pair (no user x item product)."""
    uf = model.users.select("user_id", F.col("features").alias("uf"))
    itf = model.items.select("item_id", F.col("features").alias("itf"))
    pairs = pairs.select("user_id", "item_id").join(uf, "user_id").join(itf, "item_id")
    dot = F.aggregate(F.zip_with("uf", "itf", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return pairs.select("user_id", "item_id", dot.alias("als_score"))


def content_profiles(matrix: DataFrame, keyed: DataFrame, kv: DataFrame) -> DataFrame:
    """``(user_id, n_watched, terms, weights)``: the mean of the unit vectors of
    a user's watched items."""
    watched = matrix.select("user_id", "item_id").distinct()
    nw = watched.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_watched"))
    prof = watched.join(keyed, "item_id").join(kv, "key").groupBy("user_id", "term").agg(F.sum("w").alias("pw"))
    lists = prof.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("term", "pw"))).alias("_t"))
    return nw.join(lists, "user_id", "left").select(
        "user_id", "n_watched", F.col("_t.term").alias("terms"),
        F.transform("_t.pw", lambda x: x / F.col("n_watched")).alias("weights"))


def hybrid_recommend(matrix: DataFrame, catalog: DataFrame, model: Factors | None = None, k: int = TOP_K,
                     users: DataFrame | None = None) -> DataFrame:
    """M7 + J8 + J9: per user — five or more watched items and a model:
    0.7 x minmax(ALS) + 0.3 x content ('hybrid'); some watched: content
    ('content'); of ``users`` (user_id) those without history: rating / 10
    ('trending').  Watched items removed; score rounded to 4 decimals; catalog
    fields attached.  Ties go to the smaller item id.

    Every catalog item counts for every user, also in the smallest and largest
    ALS score (an item that the model does not know scores 0), see
    ``scoring.top_items``; items of equal genres and tags are scored as one.
    Users without history share one list.
    """
    keyed, kv = key_vectors(catalog)
    vec = kv.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("_t"))
    vec = cut_lineage(vec.select("key", F.col("_t.term").alias("terms"), F.col("_t.w").alias("weights")))
    items = keyed.select(F.col("item_id").alias("id"), "key")
    prof = content_profiles(matrix, keyed, kv)
    asked = prof.select(F.col("user_id").alias("id"), "n_watched", "terms", "weights")
    none = F.lit(None).cast("array<float>")
    if model is None:
        items = items.withColumn("factors", none)
        asked = asked.select("id", none.alias("factors"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"),
                             "terms", "weights")
    else:
        items = items.join(model.items.select(F.col("item_id").alias("id"), F.col("features").alias("factors")),
                           "id", "left")
        known = asked.where(F.col("n_watched") >= MIN_INTERACTIONS).select("id").join(
            model.users.select(F.col("user_id").alias("id"), F.col("features").alias("factors")), "id")
        items, known = cut_lineage(items), cut_lineage(known)
        asked = asked.join(known.join(factor_extremes(items, known, model.rank), "id"), "id", "left").select(
            "id", "factors", "lo", "hi", "terms", "weights")
    rank = model.rank if model is not None else 1
    barred = matrix.select(F.col("user_id").alias("user"), F.col("item_id").alias("id")).distinct()    # J9
    d = top_items(items, vec, asked, barred, k, COLLAB_WEIGHT, rank)
    top = top_n(d, ["user"], [F.col("score").desc(), F.col("item")], k, rank_col="rank")
    top = top.select(F.col("user").alias("user_id"), "rank", F.col("item").alias("item_id"),
                     F.col("score").cast("double").alias("score"), F.lit("content").alias("source"))
    if model is not None:
        top = top.join(known.select(F.col("id").alias("user_id"), F.lit("hybrid").alias("_s")), "user_id", "left") \
            .withColumn("source", F.coalesce("_s", "source")).drop("_s")
    if users is not None:
        new = users.select("user_id").distinct().join(matrix.select("user_id").distinct(), "user_id", "left_anti")
        best = top_n(catalog.select(F.col("id").alias("item_id"), (F.col("rating") / 10.0).alias("score")), [],
                     [F.col("score").desc(), F.col("item_id")], k, rank_col="rank")
        shared = best.agg(F.collect_list(F.struct("rank", "item_id", "score")).alias("_l"))    # k entries
        rows = new.withColumn("_k", F.lit(1)).join(F.broadcast(shared.withColumn("_k", F.lit(1))), "_k") \
            .select("user_id", F.inline("_l"))
        top = top.unionByName(rows.withColumn("source", F.lit("trending")))
    fields = [c for c in ("title", "genres", "tags", "year") if c in catalog.columns]
    cat = catalog.select(F.col("id").alias("item_id"), *fields, F.col("rating").alias("catalog_rating"))
    return (top.join(cat, "item_id", "left")                                                # J8
            .select("user_id", "rank", "item_id", *fields, "catalog_rating",
                    F.round("score", 4).alias("score"), "source"))


def serve_recommendations(cached: DataFrame, live: DataFrame, trending_df: DataFrame,
                          users: DataFrame) -> DataFrame:
    """Stored rows for users that have any; else live model rows; else
    trending (anti-join fallback chain, no per-user lookups)."""
    a = cached
    b = live.join(cached.select("user_id").distinct(), "user_id", "left_anti")
    served = a.unionByName(b, allowMissingColumns=True)
    rest = users.join(served.select("user_id").distinct(), "user_id", "left_anti")
    # every remaining user gets the k trending rows (a k-row broadcast)
    c = (rest.withColumn("_one", F.lit(1))
         .join(F.broadcast(trending_df.withColumn("_one", F.lit(1))), "_one").drop("_one"))
    return served.unionByName(c, allowMissingColumns=True)


def catalog_source(scraped: DataFrame, fallback: DataFrame) -> DataFrame:
    """Scraped articles when there are any, else the fallback catalog."""
    flag = scraped.limit(1).select(F.lit(1).alias("_k"))
    fb = fallback.withColumn("_k", F.lit(1)).join(flag, "_k", "left_anti").drop("_k")
    return scraped.unionByName(fb, allowMissingColumns=True)


def articles_to_catalog(articles: DataFrame, year: int) -> DataFrame:
    """genres = first three tags or ['tech']; rating from the score."""
    return articles.select(
        "id", "title",
        F.when(F.size("tags") > 0, F.slice("tags", 1, 3)).otherwise(F.array(F.lit(DEFAULT_GENRE))).alias("genres"),
        "tags", F.lit(year).alias("year"), rating_from_score(F.col("score")).alias("rating"))


def training_metadata(matrix: DataFrame, model) -> DataFrame:
    """Users, items, interactions and algorithm."""
    return matrix.agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"),
                      F.count(F.lit(1)).alias("n_interactions")) \
        .withColumn("algorithm", F.lit("ALS+ContentBased" if model is not None else "ContentBased"))


def precision_at_k(recs: DataFrame, relevant: DataFrame, k: int = TOP_K) -> DataFrame:
    """Per user |top-k ∩ relevant| / k, and the mean over users."""
    r = recs.filter(F.col("rank") <= k).select("user_id", "item_id")
    hits = r.join(relevant.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi")
    per = r.select("user_id").distinct().join(hits.groupBy("user_id").agg(F.count(F.lit(1)).alias("hits")),
                                              "user_id", "left").fillna(0, ["hits"])
    return per.withColumn("precision_at_k", F.col("hits") / F.lit(float(k)))


def retrain_due(new_events: Column) -> Column:
    """M9: retrain once 50 new events (or articles) have arrived."""
    return new_events >= RETRAIN_EVERY
