"""Set-similarity join equals brute force; pattern matching edge cases."""
import random

from pyspark.sql import functions as F

from vigil.operators import incidents as I


def test_jaccard_join_equals_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["hot"] * 30
    sets = {i: sorted(set(rnd.sample(vocab, rnd.randint(1, 12)))) for i in range(150)}
    df = spark.createDataFrame([(k, v) for k, v in sets.items()], "id long, ws array<string>")
    got = {(r.id_a, r.id_b): r.similarity for r in I.jaccard_pairs(df, 0.1).collect()}
    exp = {}
    for a in sets:
        for b in sets:
            if a < b:
                x, y = set(sets[a]), set(sets[b])
                j = len(x & y) / len(x | y)
                if j > 0.1:
                    exp[(a, b)] = j
    assert got.keys() == exp.keys()
    assert all(abs(got[k] - exp[k]) < 1e-12 for k in exp)


def test_match_patterns_strength(spark):
    inc = spark.createDataFrame([(1, "Pod OOMKilled", "memory limit hit, exit code 137"),
                                 (2, "nothing", "quiet")], "incident_id long, title string, description string")
    m = I.match_patterns(inc, I.patterns_df(spark), "incident_id", F.concat_ws(" ", "title", "description"))
    r = {(x.incident_id, x.pattern_id): x.strength for x in m.collect()}
    assert r == {(1, "pat-oom-killed"): 0.75}


def test_confidence_formula(spark):
    d = spark.createDataFrame([(1.0, 0.9, 0.5), (None, None, None)], "s double, c double, m double")
    got = [r[0] for r in d.select(I.confidence(F.col("s"), F.col("c"), F.col("m"))).collect()]
    assert got == [min(round(20 + 30 + 22.5 + 10 + 5), 95), 20]


def test_patterns_in_blocks_equal_plain_search(spark, monkeypatch):
    """Automata of any block size find what a search for each symptom finds."""
    import random
    rng = random.Random(2)
    syll = ["ab", "ba", "é", "x ", "Ab", "", "bab"]
    pats = [(f"p{i}", f"n{i}", "", "c", ["".join(rng.choice(syll) for _ in range(rng.randrange(1, 4)))
                                        for _ in range(rng.randrange(1, 5))], [], [], 0.5, 0.5) for i in range(25)]
    rows = [(i, "".join(rng.choice(syll + ["zz", "Q"]) for _ in range(rng.randrange(0, 14)))) for i in range(80)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, body string")
    want = {}
    for i, t in rows:
        for p in pats:
            hit = [x for x in p[4] if t is not None and x.lower() in t.lower()]
            if hit:
                want[(i, p[0])] = (len(hit), len(hit) / len(p[4]), "|".join(hit))
    patterns = spark.createDataFrame([(*p, i) for i, p in enumerate(pats)], I.PATTERN_SCHEMA)
    for size in (4_000_000, 9):
        monkeypatch.setattr(I, "BLOCK_CHARS", size)
        got = {(r.id, r.pattern_id): (r.matched, r.strength, r.matched_symptoms)
               for r in I.match_patterns(df, patterns, "id", F.col("body"), None).collect()}
        assert got == want
    assert I.match_patterns(df, patterns.limit(0), "id", F.col("body")).count() == 0
