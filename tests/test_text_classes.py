"""Items of equal text are scored as one class (M5-M7): lists equal the plain
scoring of every item with copies, ties and watched items."""
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vigil.operators import recommender as RC
from vigil.operators import scoring


def test_a_part_scores_each_text_once():
    ids = [[5, 1, 9], [4, 2], [3, 8, 7, 6]]
    part = scoring._Part(pa.table({
        "terms": [["a"], ["a", "b"], None], "weights": [[1.0], [0.6, 0.8], None], "ids": ids,
        "vectors": pa.array([None] * 3, pa.list_(pa.list_(pa.float32())))}), 1)
    content = part.content(["a", "b"], [0.5, 0.5])
    assert content.tolist() == [0.5, 0.7, 0.0]                     # one score a text, by smallest id
    best = part.best(content.astype(np.float32), [2, 1, 8], 6)
    assert [part.ids[p].as_py() for p, _, _ in best] == [4, 5, 9, 3, 6, 7]


def test_lists_over_copied_texts_equal_scoring_every_item(spark, monkeypatch):
    rng = random.Random(7)
    texts = [(["web"], ["rust", "data"]), (["web"], ["data"]), (["ops"], []), ([], []), (["bio"], ["math"])]
    cat = [(i, f"t{i}", *texts[rng.randrange(5)], float(i % 10)) for i in range(400)]
    seen = {u: rng.sample(range(400), n) for u, n in enumerate([1, 4, 40, 200, 395])}
    catalog = spark.createDataFrame(cat, "id long, title string, genres array<string>, tags array<string>, rating double")
    matrix = spark.createDataFrame([(u, i, 1.0) for u, s in seen.items() for i in s], "user_id long, item_id long, weight double")
    vec = {}
    for r in RC.item_vectors(catalog).collect():
        vec.setdefault(r.item_id, {})[r.term] = r.w
    for part in (4_000_000, 150):
        monkeypatch.setattr(scoring, "PART_VALUES", part)
        got = {}
        for r in RC.hybrid_recommend(matrix, catalog, model=None, k=6).orderBy("rank").collect():
            got.setdefault(r.user_id, []).append((r.item_id, r.score))
        for u, s in seen.items():
            prof = {}
            for i in s:
                for t, w in vec.get(i, {}).items():
                    prof[t] = prof.get(t, 0.0) + w / len(s)
            score = {c[0]: round(sum(w * prof.get(t, 0.0) for t, w in vec.get(c[0], {}).items()), 5) for c in cat}
            want = sorted((-x, i) for i, x in score.items() if i not in s)[:6]
            assert [i for _, i in want] == [i for i, _ in got[u]]
            assert all(abs(-x - y) < 1e-4 for (x, _), (_, y) in zip(want, got[u]))


def test_a_model_that_knows_no_item_of_the_catalog(spark):
    catalog = spark.createDataFrame([(i, "t", ["a"], ["b"], 1.0) for i in range(4)],
                                    "id long, title string, genres array<string>, tags array<string>, rating double")
    matrix = spark.createDataFrame([(1, i, 1.0) for i in range(5)], "user_id long, item_id long, weight double")
    model = RC.Factors(spark.createDataFrame([(1, [1.0, 2.0])], "user_id long, features array<float>"),
                       spark.createDataFrame([(99, [1.0, 2.0])], "item_id long, features array<float>"), 2)
    more = catalog.unionByName(catalog.where("id = 0").withColumn("id", F.lit(7).cast("long")))
    got = RC.hybrid_recommend(matrix, more, model, k=3).collect()
    assert [(r.user_id, r.item_id, r.source) for r in got] == [(1, 7, "hybrid")]
