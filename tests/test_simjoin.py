"""Top-k similarity joins (J4, P7) and whole-catalog scoring (M5-M7) against
plain loops over all pairs."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigil.operators import extensions as X
from vigil.operators import recommender as RC
from vigil.operators import scoring, simjoin


def _sets(seed, n=160):
    rng = random.Random(seed)
    common = [f"common{i}" for i in range(25)]
    rows = []
    for i in range(n):
        ws = set(rng.sample(common, rng.randrange(3, 20))) | {f"w{rng.randrange(900)}" for _ in range(rng.randrange(0, 40))}
        rows.append((i, sorted(ws)))
    rows += [(1000 + i, rows[i % 3][1]) for i in range(20)]                 # copies
    rows += [(2000, ["alone"]), (2001, rows[5][1][:-1])]
    return rows


def _best(rows, others, k, t, same):
    out = set()
    for i, a in rows:
        a = set(a)
        near = []
        for j, b in others:
            if same and i == j:
                continue
            s = len(a & set(b)) / len(a | set(b)) if a | set(b) else 0.0
            if s > t:
                near.append((-s, j))
        out |= {(i, j, round(-s, 12)) for s, j in sorted(near)[:k]}
    return out


@pytest.mark.parametrize("part,frequent,t", [(4_000_000, 256, 0.1), (900, 4, 0.1), (900, 40, 0.5)])
def test_top_jaccard_equals_all_pairs(spark, monkeypatch, part, frequent, t):
    monkeypatch.setattr(simjoin, "PART_VALUES", part)
    rows = _sets(3)
    df = spark.createDataFrame(rows, "id long, ws array<string>")
    simjoin.FREQUENT, kept = frequent, simjoin.FREQUENT
    try:
        got = {(r.id, r.other, round(r.score, 12)) for r in simjoin.top_jaccard(df, 5, t).collect()}
        other = spark.createDataFrame(rows[:50], "id long, ws array<string>")
        cross = {(r.id, r.other, round(r.score, 12)) for r in simjoin.top_jaccard(df, 3, t, others=other).collect()}
    finally:
        simjoin.FREQUENT = kept
    assert got == _best(rows, rows, 5, t, True)
    assert cross == _best(rows, rows[:50], 3, t, False)
    assert simjoin.top_jaccard(df.limit(0), 5, t).count() == 0


def test_set_index_scores_few(spark):
    rows = _sets(5, 400)
    numbers = {}
    tokens = [np.array([numbers.setdefault(w, len(numbers)) for w in ws]) for _, ws in rows]
    sizes = np.array([len(x) for x in tokens])
    index = simjoin.SetIndex([i for i, _ in rows], sizes, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(tokens))
    for (i, _), n, v in zip(rows, sizes, tokens):
        index.best(i, int(n), v, 5, 0.5)
    assert index.scored < len(rows) * len(rows) / 20


def test_rows_are_packed_once_however_many_blocks_they_meet(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "PART_VALUES", 300)
    rows = _sets(7)
    sets, _ = simjoin.numbered_words(spark.createDataFrame(rows, "id long, ws array<string>"))
    blocks = [pa.ipc.open_stream(r["block"]).read_all() for r in simjoin._blocks(sets, 4).collect()]
    assert len(blocks) > 8
    assert sorted(i for b in blocks for i in b.column("id").to_pylist()) == sorted(i for i, _ in rows)
    assert all(sum(b.column("n").to_pylist()) <= 300 for b in blocks)


def test_the_worst_of_the_best_bounds_later_blocks():
    index = simjoin.SetIndex([1, 2, 3], np.array([4, 4, 4]), np.array([0, 4, 8, 12]),
                             np.array([1, 2, 3, 4, 1, 2, 3, 9, 1, 7, 8, 9]))
    asked = [9], np.array([4]), np.array([0, 4]), np.array([1, 2, 3, 4])
    for least, want in ((-np.inf, [0, 1, 2]), (0.6, [0, 1]), (0.7, [0])):
        [(_, near, _)] = index.many(*asked, 5, 0.1, np.array([least]))
        assert near.tolist() == want


@pytest.mark.parametrize("part", [4_000_000, 300])
def test_top_cosine_equals_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(simjoin, "PART_VALUES", part)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 12))
    v[100:110] = v[0]                             # copies
    v[110:] = v[:10] + 0.1 * rng.normal(size=(10, 12))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, [0.0] * 12), (501, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for t in (0.75, 0.3):
        got = {(r.vec_id, r.similar_id) for r in X.vector_similar(df, min_cos=t).collect()}
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        c = np.round(u @ u.T, 12)
        want = set()
        for i in range(len(u)):
            near = sorted((-c[i, j], j) for j in range(len(u)) if j != i and c[i, j] >= t)[:5]
            want |= {(i, j) for _, j in near}
        assert got == want and want


def test_vector_index_scores_few():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = simjoin.VectorIndex(list(range(600)), v)
    assert not any(len(near) for _, near, _ in index.best(list(range(600)), v, 5, 0.75))
    assert index.scored < 600 * 600 / 100


def test_dense_ids_of_strings_and_large_longs(spark):
    df = spark.createDataFrame([("hn-%d" % (i % 70), (1 << 40) + i % 50) for i in range(300)], "a string, b long")
    for c in ("a", "b"):
        got = sorted((r[1], r[0]) for r in scoring.dense_ids(df, c, "n").collect())
        assert [n for n, _ in got] == list(range(len(got)))
        assert [x for _, x in got] == sorted({r[c] for r in df.collect()})


def _shop(spark, seed=1, users=14, items=60):
    rng = random.Random(seed)
    words = "rust data web cloud ai ops game math bio art".split()
    cat = [(f"hn-{i}", f"t{i}", rng.sample(words, 2), rng.sample(words, rng.randrange(0, 3)), float(rng.randrange(1, 10)))
           for i in range(items)]
    m = {}
    for u in range(users):
        for _ in range(rng.choice([1, 3, 6, 9])):
            m[(f"user-{u}", f"hn-{rng.randrange(items // 2)}")] = float(rng.randrange(1, 9))
    catalog = spark.createDataFrame(cat, "id string, title string, genres array<string>, tags array<string>, rating double")
    matrix = spark.createDataFrame([(u, i, w) for (u, i), w in m.items()], "user_id string, item_id string, weight double")
    return catalog, matrix, cat, m


@pytest.mark.parametrize("part,block", [(4_000_000, 1024), (60, 4)])
def test_hybrid_equals_scoring_every_item(spark, monkeypatch, part, block):
    monkeypatch.setattr(scoring, "PART_VALUES", part)
    monkeypatch.setattr(scoring, "BLOCK", block)
    catalog, matrix, cat, m = _shop(spark)
    model = RC.fit_als(matrix, rank=6, max_iter=4)
    new = spark.createDataFrame([("user-0",), ("nobody",)], "user_id string")
    got = {}
    for r in RC.hybrid_recommend(matrix, catalog, model, k=7, users=new).collect():
        got.setdefault(r.user_id, []).append((r.rank, r.item_id, r.score, r.source))
    uf = {r.user_id: np.array(r.features, float) for r in model.users.collect()}
    itf = {r.item_id: np.array(r.features, float) for r in model.items.collect()}
    assert set(uf) == {u for u, _ in m} and set(itf) == {i for _, i in m}
    vec = {}
    for r in RC.item_vectors(catalog).collect():
        vec.setdefault(r.item_id, {})[r.term] = r.w
    for u in uf:
        seen = [i for x, i in m if x == u]
        prof = {}
        for i in seen:
            for t, w in vec[i].items():
                prof[t] = prof.get(t, 0.0) + w / len(seen)
        content = {c[0]: sum(w * prof.get(t, 0.0) for t, w in vec[c[0]].items()) for c in cat}
        als = {c[0]: float(itf[c[0]] @ uf[u]) if c[0] in itf else 0.0 for c in cat}
        lo, hi = min(als.values()), max(als.values())
        if len(seen) >= 5:
            score = {i: 0.7 * (als[i] - lo) / (hi - lo) + 0.3 * content[i] for i in als}
        else:
            score = content
        # equal texts have equal scores up to the order of sums: compare the scores, then the sets
        best = sorted(((-round(s, 6), i) for i, s in score.items() if i not in seen))[:7]
        rows = sorted(got[u])
        assert [r[0] for r in rows] == list(range(1, 8))
        assert [round(-s, 4) for s, _ in best] == pytest.approx([r[2] for r in rows], abs=1.1e-4)
        assert {r[3] for r in rows} == {"hybrid" if len(seen) >= 5 else "content"}
        for _, i, s, _ in rows:
            assert i not in seen and score[i] == pytest.approx(s, abs=6e-5)
    want = sorted(cat, key=lambda c: (-c[4], c[0]))[:7]
    assert [(r[1], r[2], r[3]) for r in sorted(got["nobody"])] == [(c[0], round(c[4] / 10, 4), "trending") for c in want]


def test_als_needs_five_interactions_and_keeps_large_ids(spark):
    few = spark.createDataFrame([("a", "x", 1.0)] * 4, "user_id string, item_id string, weight double")
    assert RC.fit_als(few) is None
    big = spark.createDataFrame([((1 << 33) + i % 3, (1 << 35) + i % 4, 1.0) for i in range(12)],
                                "user_id long, item_id long, weight double")
    model = RC.fit_als(big, rank=2, max_iter=2)
    assert {r[0] for r in model.users.select("user_id").collect()} == {(1 << 33) + i for i in range(3)}
    assert {r[0] for r in model.items.select("item_id").collect()} == {(1 << 35) + i for i in range(4)}


def test_stored_rows_are_read_latest_first(spark, tmp_path):
    from vigil.operators import warehouse as W
    recs = spark.createDataFrame([(1, 5, 0.5, ["a", "b"]), (1, 6, 0.4, ["c"])],
                                 "user_id long, item_id long, score double, genres array<string>")
    path = str(tmp_path / "recs")
    for day, rows in ((2, recs), (1, recs.withColumn("score", F.lit(0.9)))):
        X.batch_recommend_all(rows, f"m{day}", path, now=F.lit(f"2024-01-0{day}").cast("timestamp"))
    got = [(r.item_id, r.score, r.genres, r.model_ver) for r in
           W.recs_for_user(spark.read.parquet(path), 10).orderBy("rank").collect()]
    assert got == [(5, 0.5, ["a", "b"], "m2"), (6, 0.4, ["c"], "m2")]
