"""Content recommendations equal a brute-force scoring of every item."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.operators import recommender as RC
from vigil.sources.tables import view
from tests.conftest import SF_SMALL


def test_content_topk_equals_brute_force(spark):
    cat = view(spark, SF_SMALL, "catalog")
    m = RC.engagement_matrix(view(spark, SF_SMALL, "engagement"), cat)
    got = RC.hybrid_recommend(m, cat, model=None, k=10)
    cs = RC.content_scores(m, RC.item_vectors(cat))
    cs = cs.join(m.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    cs = cs.withColumn("score", F.round(F.col("content_score").cast("float").cast("double"), 4))
    w = Window.partitionBy("user_id").orderBy(F.col("content_score").cast("float").desc(), "item_id")
    exp = cs.withColumn("r", F.row_number().over(w)).filter("r <= 10")
    a = sorted((r.user_id, r.item_id, r.score) for r in got.collect())
    b = sorted((r.user_id, r.item_id, r.score) for r in exp.collect())
    assert a == b


def test_trending_and_precision(spark):
    cat = view(spark, SF_SMALL, "catalog")
    m = RC.engagement_matrix(view(spark, SF_SMALL, "engagement"), cat)
    t = RC.trending(m, cat).collect()
    assert len(t) == 10 and t[0].score == 1.0
