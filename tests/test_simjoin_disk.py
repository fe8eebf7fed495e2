"""What the similarity joins write is bounded by what they must hold."""
import os
import random

import pytest

from vigil.operators import simjoin
from vigil.session import checkpoint_dir


def _written(spark) -> int:
    root = checkpoint_dir(spark).replace("file:", "", 1)
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs)


@pytest.fixture
def sets(spark):
    rng = random.Random(3)
    rows = [(i, sorted({f"word{rng.randrange(3000):06d}" for _ in range(200)})) for i in range(400)]
    return spark.createDataFrame(rows, "id long, ws array<string>").coalesce(2), sum(11 * len(w) for _, w in rows)


def test_few_queries_read_the_index_where_it_lies(spark, sets):
    index, size = sets
    queries = index.where("id < 3")
    before = _written(spark)
    got = simjoin.top_jaccard(queries, 2, 0.0, others=index)
    assert _written(spark) - before < size / 4          # the queries' block and the pairs, not the index
    assert {(r.id, r.other, r.score) for r in got.collect() if r.score == 1.0} == {(i, i, 1.0) for i in range(3)}


def test_classes_hold_each_text_once(spark, sets):
    rows, size = sets
    before = _written(spark)
    member, classes = simjoin.classes_of(rows.unionByName(rows.withColumn("id", rows.id + 1000)), "ws", "json")
    assert _written(spark) - before < size
    assert classes.count() == 400 and member.where("id - 1000 = cls").count() == 400
    assert {r.id: r.ws for r in classes.collect()} == {r.id: r.ws for r in rows.collect()}
