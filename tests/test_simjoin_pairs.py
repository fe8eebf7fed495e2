"""Pairs of sets between two blocks, each pair of blocks met once."""
import pickle
import random

import numpy as np
import pytest

from vigil.operators import simjoin


def _index(ids, sets):
    sizes = np.array([len(x) for x in sets])
    tokens = np.array([w for x in sets for w in sorted(x)], np.int64)
    return simjoin.SetIndex(ids, sizes, np.append(0, np.cumsum(sizes)), tokens)


def _some(seed, n, frequent, rare):
    """Sets that hold most of ``frequent`` and a few of ``rare`` tokens."""
    rng = random.Random(seed)
    return [{w for w in range(frequent) if rng.random() < 0.8} | {1000 + rng.randrange(rare) for _ in range(rng.randrange(1, 40))}
            for _ in range(n)]


@pytest.mark.parametrize("frequent,dense,few", [(20, 0.0015, 16), (700, 0.0015, 1), (700, 2.0, 1)])
@pytest.mark.parametrize("t", [0.1, 0.6])
def test_pairs_of_two_blocks_equal_plain_counts(monkeypatch, frequent, dense, few, t):
    monkeypatch.setattr(simjoin, "DENSE", dense)
    monkeypatch.setattr(simjoin, "FEW", few)
    monkeypatch.setattr(simjoin, "TOGETHER", 16)
    a, b = _some(1, 70, frequent, 300), _some(2, 50, frequent, 300) + [{5}, set(range(4))]
    index, asks = _index(list(range(70)), a), pickle.loads(pickle.dumps(_index(list(range(500, 552)), b)))
    got = {(q, i): s for q, rows, scores in index.pairs(asks, t, None, True) for i, s in zip(rows.tolist(), scores.tolist())}
    want = {(q, i): len(x & y) / len(x | y) for q, x in enumerate(b) for i, y in enumerate(a)}
    assert got == {k: s for k, s in want.items() if s > t} and got


def test_sums_of_three_sets_are_taken_apart_again():
    rng = np.random.default_rng(3)
    dense = (rng.random((900, 40)) < 0.9).astype(np.float32)
    sets = [np.flatnonzero(rng.random(900) < p) for p in (0.99, 0.9, 0.0, 0.5, 1.0, 0.01, 0.7)]
    got = simjoin._products(np.concatenate(sets), np.array([len(x) for x in sets]), dense, np.int16)
    assert [got[i].tolist() for i in range(7)] == [dense[x].sum(axis=0).astype(int).tolist() for x in sets]


def test_a_block_is_sent_by_token_only():
    index = _index(list(range(300)), _some(4, 300, 200, 500))
    again = pickle.loads(pickle.dumps(index, 5))
    assert len(pickle.dumps(index, 5)) < 4 * len(index.owners)     # the rows of Arrow took 8 a token
    assert again.at.tolist() == index.at.tolist() and again.offsets.tolist() == index.offsets.tolist()


def test_the_best_of_rows_are_kept_while_pairs_come(monkeypatch):
    monkeypatch.setattr(simjoin, "PAIRS", 50)
    rng = np.random.default_rng(5)
    score = rng.integers(0, 6, (30, 20)) / 10
    best = simjoin._BestOfRows(np.arange(30)[::-1].copy(), 4)
    for q in range(30):
        rows = np.flatnonzero(score[q] > 0.1)
        best.add(rows, q, score[q, rows])
    rows, other, got = (x.tolist() for x in best.best())
    want = [(r, q, score[q, r]) for r in range(20) for q in sorted((q for q in range(30) if score[q, r] > 0.1),
                                                                    key=lambda q: (-score[q, r], -q))[:4]]
    assert list(zip(rows, other, got)) == want


def test_sets_are_dealt_by_their_commonest_word(spark):
    rows = [(1, ["the", "x1"]), (2, ["die", "x2"]), (3, ["the", "die"]), (4, ["the", "x3"]), (5, []), (6, ["x9"])]
    sets = spark.createDataFrame(rows, "id long, ws array<string>")
    seed, common = simjoin.word_numbers(sets)
    got = {r.id: r.label for r in simjoin.by_common_word(simjoin.numbered(sets, seed), common).collect()}
    assert got[1] == got[3] == got[4] == 0 and got[2] == 1 and got[5] == len(common) and 1 < got[6] < len(common)
