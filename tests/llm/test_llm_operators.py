"""Small tests of the training-data operators: brute force, round trips, and
nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vigil.llm import (ann, backoff_lm, chat, decontam, langid, packing, secret_scan, sharding,
                       simhash, surrogate)
from vigil.llm.queries import word_tokenizer

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the and tion with that this from have they which would there their about".split(),
         "de": "und der die nicht eine wird auch über für werden haben zwischen durch".split()}


def prose(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s", "er", "n"]) for _ in range(n))


def docs(spark, texts, extra=False):
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    if extra:  # names that operators use themselves
        for c in ("score", "shard", "slot", "_hash", "fp", "root", "key", "n", "row_hash"):
            df = df.withColumn(c, F.lit("x"))
    return df


ODD = [None, "", "   ", "12 34 !!", "one", "one", "tail " * 3000]


# ------------------------------------------------------------------ chat

def test_chat_round_trip(spark):
    rng = random.Random(4)
    marks = ["<|", "<||", "<|turn|>", "<|/turn|>\n", "|", "\n", "<|n|>", "a", "\\", "é", "<"]
    rows, want = [], {}
    for c in range(40):
        turns = []
        for t in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", "od\nd<|r"])
            text = rng.choice([None, "", "".join(rng.choice(marks) for _ in range(30))])
            rows.append((c, t, role, text))
            turns.append((role, text or ""))
        want[c] = turns
    rng.shuffle(rows)
    ex = chat.prefix_target_examples(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)))
    got = {r["conv_id"]: r for r in chat.digest_examples(ex).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(
            "".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (
            len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in ex.where("target_turn IS NOT NULL").collect():
        span = r["formatted"][r["loss_start"]:r["loss_start"] + r["loss_chars"]]
        assert span.replace("<||", "<|") == want[r["conv_id"]][r["target_turn"]][1]
        assert r["formatted"].endswith(span + chat.END)


def test_chat_empty_and_ties(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.digest_examples(chat.prefix_target_examples(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, "x"), (None, 0, "assistant", "y")]
    got = {r["conv_id"]: r["n_turns"] for r in chat.digest_examples(
        chat.prefix_target_examples(spark.createDataFrame(rows, schema))).collect()}
    assert got == {1: 3, None: 1}


# ------------------------------------------------------------------ sharding

@pytest.mark.parametrize("hot", [False, True])
def test_sharding_is_whole_gapless_and_even(spark, hot):
    rng = random.Random(2)
    rows = [(i, 0 if hot and i % 3 == 0 else i, rng.randrange(1, 200)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k long, size long").withColumn("shard", F.lit("x"))
    got = sharding.shard_by_bytes(df, 7, "size", ["k"]).collect()
    assert sorted(r["id"] for r in got) == list(range(3000))
    total, by = sum(r[2] for r in rows), {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) == set(range(7))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 7) <= total / 7 / 32 + 200


def test_sharding_edges(spark):
    empty = spark.createDataFrame([], "id long, size long")
    assert sharding.shard_by_bytes(empty, 4, "size", ["id"]).count() == 0
    none = spark.createDataFrame([(1, None), (1, None), (None, None)], "id long, size long")
    got = sharding.shard_by_bytes(none, 2, "size", ["id"]).collect()
    assert len(got) == 3 and all(r["shard"] in (0, 1) for r in got)


# ------------------------------------------------------------------ neighbours

def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 24))
    x[100:160] = x[100]  # ties
    x = x.round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] + [1.0] * 23), (1003, [None] * 24),
           (1100, []), (1004, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, block=7).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 600, 20))
    hits = 0
    for q, rows in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-9 for _, v, s in rows)
        hits += len(set(want) & {v for _, v, _ in rows})
    assert hits / (10 * len(found)) >= 0.9
    assert {v for _, v, _ in found[100]} == set(range(101, 111))


def test_nearest_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.5]), (3, [0.0, 1.0])],
                               "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [3, 1]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


# ------------------------------------------------------------------ near-duplicates

def brute_fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    v = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return v - (1 << 64) if v >> 63 else v


def test_fingerprint_matches_definition():
    for t in [*ODD, "Über  A\tB\x0bc d\x1ce f", prose("de", 200, 1), "A b"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_near_links_miss_nothing(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << p for p in rng.sample(range(64), rng.randrange(0, 5))) for b in base for _ in range(12)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {tuple(r) for r in simhash.near_links(
        spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1:]
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert got == want and len(want) > 20


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["fp"]: r["root"] for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_keep_one_per_component(spark):
    a, b = prose("en", 300, 1), prose("de", 300, 2)
    df = docs(spark, [a, b, a, None, "", a + " x", b], extra=True)
    df = df.union(df.where("doc_id = 1")).union(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    found = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(df).collect()}
    assert {(0, 0), (2, 0), (1, 1), (6, 1), (3, 3), (4, 3), (None, 0)} <= found
    kept = simhash.keep_one_per_component(df)
    assert kept.columns == df.columns
    keys = Counter(r["doc_id"] for r in kept.collect())
    assert keys[0] == keys[1] == keys[3] == 1 and not {2, 4, 6, None} & set(keys)
    assert simhash.keep_one_per_component(df.limit(0)).count() == 0


# ------------------------------------------------------------------ language

def test_language_of_held_out_texts(spark):
    train = [(prose(g, 60, i), g) for g in WORDS for i in range(60)] + [(None, "en"), ("x", None), ("", "de")]
    learned = langid.learn_dictionaries(spark.createDataFrame(train, "text string, lang string"))
    assert {k for k, _ in learned} == {"en", "de"}
    texts = [(prose(g, n, 1000 + i), g) for g in WORDS for i, n in enumerate([3, 10, 40, 3000])] + [
        (t, "und") for t in (None, "", "12 34 !!")]
    df = spark.createDataFrame(texts, "text string, lang string").withColumn("score", F.lit("x"))
    for r in langid.identify(df, learned).collect():
        assert r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1
        assert r["accepted"] == (r["lang"] != "und")
    assert langid.keep_identified(df, learned).columns == df.columns
    assert langid.identify(df, []).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(df.limit(0), learned).count() == 0


# ------------------------------------------------------------------ packing

def test_bin_completion_is_valid_and_no_worse_than_best_fit():
    for seed in range(12):
        rng = random.Random(seed)
        counts = Counter(rng.randrange(1, 101) for _ in range(rng.randrange(1, 60)))
        plan = packing.bin_completion(counts, 100)
        assert all(sum(f) <= 100 for f, _ in plan)
        packed = Counter()
        for f, n in plan:
            for x in f:
                packed[x] += n
        assert packed == counts
        n = sum(n for _, n in plan)
        assert packing.lower_bound(counts, 100) <= n <= sum(n for _, n in packing.best_fit(counts, 100))
    assert packing.bin_completion({}, 100) == []


def test_bin_completion_beats_best_fit():
    counts = {49: 1, 41: 1, 34: 1, 33: 1, 29: 1, 26: 1, 26 + 62: 1}
    best = sum(n for _, n in packing.best_fit(counts, 100))
    assert sum(n for _, n in packing.bin_completion(counts, 100)) <= best


def test_pack_against_the_tokenizer(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(word_tokenizer())
    texts = [*ODD, "it's don't a.b.c ... x.. y,, z!!?", "Éá İstanbul ΣΑΣ. straße x\x1cz", "日本語 １２３",
             prose("de", 900, 3), "word%%% other!! (x) é. ß, <|endoftext|>"]
    df = docs(spark, texts, extra=True)
    got = packing.pack(df, word_tokenizer(), capacity=256, with_ids=True).collect()
    t.encode_special_tokens = True
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == list(range(0, len(ids), 256))
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in parts]).tolist() == ids
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in parts)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(df.limit(0), word_tokenizer()).count() == 0


# ------------------------------------------------------------------ decontamination

def test_lcs_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        a = [bytes([rng.randrange(97, 101)]) for _ in range(rng.randrange(1, 12))]
        b = [bytes([rng.randrange(97, 101)]) for _ in range(rng.randrange(0, 12))]
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        assert decontam.lcs_length(a, b) == m[-1][-1]


def test_leaks_found_and_clean_kept(spark):
    rng = random.Random(5)

    def word():
        return "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [" ".join(word() for _ in range(n)) + ". " + " ".join(word() for _ in range(5)) + "."
             for n in (10, 20, 30, 50)]
    noise = [" ".join(word() for _ in range(300)) for _ in range(8)]
    near = items[2].split()
    near[3] = "changed"
    near.insert(10, "inserted")
    texts = [noise[0], noise[1] + " " + items[0].upper() + " " + noise[2], items[3], None, "",
             noise[3] + "\n" + " ".join(near) + "\n" + noise[4], noise[5] * 40, items[1] + "!!"]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (8, "too short"), (7, items[0])],
                                  "item_id long, text string")
    df = docs(spark, texts, extra=True)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench, block=2).collect()}
    assert found == {(1, 0), (2, 3), (5, 2), (7, 1)}
    kept = decontam.drop_leaks(df, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 6] and kept.columns == df.columns
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0
    assert decontam.find_leaks(df.limit(0), bench).count() == 0


def test_cut_copies_are_found(spark):
    rng = random.Random(15)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    items = [(i, words(n), words(m)) for i, (n, m) in enumerate([(20, 5), (12, 4), (40, 1), (25, 12)])]
    bench = spark.createDataFrame([(i, f"{a}. {b}.") for i, a, b in items], "item_id long, text string")
    hosts = [f"{words(100)} {a}. {words(100)}" for _, a, _ in items] + [words(300)]
    for i, a, b in items:  # 30 % of the words changed, the whole last sentence among them
        w = f"{a} {b}".split()
        left = max(0, round(0.3 * len(w)) - len(b.split()))
        for at in rng.sample(range(len(a.split())), left):
            w[at] = words(1)
        hosts.append(" ".join([words(100), *w[:len(a.split())], words(len(b.split()) + 100)]))
    df = docs(spark, hosts)
    whole = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench).collect()}
    held = {(d, i) for d, t in enumerate(hosts) for i, a, b in items
            if decontam.lcs_length(decontam.words_of(f"{a} {b}"), decontam.words_of(t))
            >= 0.6 * len(decontam.words_of(f"{a} {b}"))}
    assert whole == held >= {(0, 0), (1, 1), (2, 2), (3, 3), (5, 0), (6, 1), (7, 2)}
    assert {r["doc_id"] for r in decontam.drop_leaks(df, bench).collect()} == {
        d for d in range(len(hosts)) if d not in {x for x, _ in held}}
    # an answer column still decides where it is given
    given = bench.withColumn("answer", F.when(F.col("item_id") != 2, F.regexp_extract("text", r"([^.]+)\.$", 1)))
    found = decontam.find_leaks(df, given, answer="answer").collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(2, 2), (7, 2)}
    assert all(r["answer_share"] is None for r in found)


def test_every_benchmark_row_is_searched(spark):
    rng = random.Random(18)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    items = [(1, words(20)), (1, words(20)), (1, words(20)), (None, words(20)), (None, words(15)),
             (2, words(20)), (3, words(3)), (None, words(1)), (4, words(5)), (5, " ?! "), (6, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hosts = [f"{words(100)}, {t.upper()}! {words(100)}" for _, t in items[:9]]
    w = items[8][1].split()
    hosts += [f"{words(50)} {' '.join(w[:4])} {words(1)} {w[4]} {words(50)}", words(200)]
    df = docs(spark, hosts)
    for block in (1, 2, 512):
        got = Counter((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench, block=block).collect())
        assert got == Counter((i, n) for i, (n, _) in enumerate(items[:9]))
        assert sorted(r["doc_id"] for r in decontam.drop_leaks(df, bench, block=block).collect()) == [9, 10]
    # an answer that is given must be near a short item, too
    given = bench.withColumn("answer", F.when(F.col("item_id") == 3, F.lit(words(2))))
    assert {r["doc_id"] for r in decontam.find_leaks(df, given, answer="answer").collect()} == {
        0, 1, 2, 3, 4, 5, 7, 8}


def test_latent_space_is_of_all_windows_of_distinct_texts(spark):
    rng = random.Random(19)
    vocab = [a + b for a in "bdfgk" for b in ("ala", "olo", "umu", "iri")]
    items = [" ".join(rng.choice(vocab) for _ in range(12)) for _ in range(6)]
    texts = [" ".join(rng.choice(vocab[:4 + 3 * (i % 6)] + ["other"]) for _ in range(n))
             for i, n in enumerate([200, 130, 64, 10, 300, 90])]
    texts += [texts[0]] * 9 + [None, "", "nothing here"]
    df = docs(spark, texts)
    index, = decontam.indexes(df, spark.createDataFrame([*enumerate(items)], "item_id long, text string"), rank=4)
    terms = sorted({w for t in items for w in t.split()})
    held = np.array([sum(w in (t or "").split() for t in texts) for w in terms])
    idf = np.log((len(texts) + 1) / (held + 1)) + 0.1

    def gram(windows):
        x = np.array([[w.count(t) for t in terms] * idf for w in windows])
        x = x[x.any(1)]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        return x.T @ x / len(x)
    whole = [t.split() for t in {t for t in texts if t}]
    both = gram([t.split() for t in items]) + gram([w[i:i + 64] for w in whole for i in range(0, len(w), 64)])
    basis = index.terms / idf[:, None]
    assert np.allclose(basis.T @ basis, np.eye(4), atol=1e-4)
    top = np.sort(np.linalg.eigvalsh(both))[::-1][:4]
    assert np.allclose(np.sort(np.diag(basis.T @ both @ basis))[::-1], top, rtol=1e-3)


def test_texts_are_read_once_and_searched_as_numbers(spark, tmp_path):
    rng = random.Random(20)

    def words(n):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    items = [words(20), words(40), words(3)]
    bench = spark.createDataFrame([(i, t, items[0].split()[2] + " unheard" if i == 2 else None)
                                   for i, t in enumerate(items)], "item_id long, text string, answer string")
    texts = [f"{words(90)} {items[0]}", f"{items[1]} {words(9)}", f"{words(30)}, {items[2]}!", None, words(50)]
    big = 1 << 60
    rows = [(big + i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (big, texts[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    found = decontam.find_leaks(df, bench)
    assert not any(str(tmp_path) in f for f in found.inputFiles())
    assert Counter((r["doc_id"], r["item_id"]) for r in found.collect()) == Counter(
        [(big, 0), (big, 0), (None, 0), (big + 1, 1), (big + 2, 2)])
    # words of an answer that no item holds are numbers, too
    assert {r["item_id"] for r in decontam.find_leaks(df, bench, answer="answer").collect()} == {0, 1}


def test_frequent_and_rare_terms_give_the_same_sums():
    rng = np.random.default_rng(21)
    terms, window = 300, 64
    weight = 1 / np.arange(1, terms + 2) ** 1.2
    texts = [rng.choice(terms + 1, n, p=weight / weight.sum()) for n in (5000, 1, 64, 200, 40000, 900)]
    idf, q = rng.random(terms) + 0.5, rng.standard_normal((terms, 8)).astype(np.float32)
    rows = [np.bincount(t[i:i + window], minlength=terms + 1)[:terms] * idf
            for t in texts for i in range(0, len(t), window)]
    x = np.array([r / np.linalg.norm(r) for r in rows if r.any()])
    raw = [t.astype("<u4").tobytes() for t in texts]
    for chunk in (1 << 12, 1 << 15):
        z, n = decontam._multiplied(iter(raw), q, idf, chunk=chunk)
        assert n == len(x) and np.allclose(z, x.T @ (x @ q), rtol=1e-4, atol=1e-3)
    row, term = np.repeat(np.arange(400), 3), np.r_[np.zeros(1180, int), np.arange(1, 21)]
    often, counts, rest = decontam._often(row, term, 400, terms)
    assert often.tolist() == [0] and counts[:, 0].sum() == 1180 and rest.sum() == 20
    # many texts at once, and each by itself
    vocabulary = {b"w%d" % i: i for i in range(terms)}
    items = [decontam.Item(i, [b"w%d" % w for w in t[:20 * i + 10]], []) for i, t in enumerate(texts[-1:] * 3)]
    index = decontam.Index(items, [], vocabulary, idf, q, 0.3, 0.6, 0.5)
    words = [" ".join(f"w{w}" for w in t) for t in texts] + [None, "", "other"]
    together, alone = index.find_all(words), [index.find(t) for t in words]
    assert any(alone) and [[(f["item_id"], f["lcs_share"]) for f in x] for x in together] == [
        [(f["item_id"], f["lcs_share"]) for f in x] for x in alone]


# ------------------------------------------------------------------ secrets

def test_secrets_found_and_redacted(spark):
    rng = random.Random(6)
    secret = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    texts = [f'{prose("en", 20, i)} token = "{s}" {prose("en", 20, i + 50)}' for i, s in enumerate(secret)]
    cards = ["".join(rng.choice("0123456789") for _ in range(16)) for _ in range(30)]
    texts += [f'{prose("en", 20, i)} {c} {prose("en", 20, i + 50)}' for i, c in enumerate(cards)]
    df = docs(spark, texts + ODD, extra=True)
    df = df.union(df.where("doc_id = 0")).withColumn("source", F.when(F.col("doc_id") != 1, F.col("source")))
    out = secret_scan.redact_secrets(df)
    assert out.columns == df.columns and out.count() == df.count()
    text = " ".join(r["text"] or "" for r in out.collect())
    assert not any(s in text for s in secret) and all(c in text for c in cards)
    assert text.count("[SECRET]") == 31
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0
    # the forest itself tells held-out findings apart
    lex = secret_scan.learn_lexicon(df)
    found = secret_scan.scan(df, lex)
    labelled = secret_scan.reviewed_findings(found)
    forest = secret_scan.train(labelled)
    assert secret_scan.judge(found, forest).where("is_secret").count() == 31


def test_long_secrets_leave_no_remainder(spark):
    rng = random.Random(16)
    values = ["".join(rng.choice("abcdefghijklmnopABCDEFGHIJ0123456789+/") for _ in range(2000)) for _ in range(12)]
    values += [".".join(v[i:i + 700] for i in (0, 700, 1400)) for v in values[:4]]
    df = docs(spark, [f'{prose("en", 20, i)} token={v} {prose("en", 20, i + 50)}' for i, v in enumerate(values)])
    labelled = secret_scan.scan(df, secret_scan.Lexicon({})).select("features", F.lit(1).alias("label"))
    for i, r in enumerate(secret_scan.redact_secrets(df, labelled).orderBy("doc_id").collect()):
        assert r["text"] == f'{prose("en", 20, i)} token=[SECRET] {prose("en", 20, i + 50)}'


def test_bare_keys_and_letters_only_passwords_are_redacted(spark):
    rng = random.Random(17)
    mixed = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def of(n, chars=mixed):
        return "".join(rng.choice(chars) for _ in range(n))
    secrets = ["AKIA" + of(16, mixed[26:52] + "234567"), "ghp_" + of(36), "sk_live_" + of(24) + "7",
               "eyJ" + of(30) + "1.eyJ" + of(90) + "2." + of(43) + "3", of(63) + "5\n" + of(63) + "6"]
    passwords = ["qzvkxwtrpl", "HjwqzKxvbnTr"]
    texts = [f'{prose("en", 20, i)} {s} {prose("en", 20, i + 50)}' for i, s in enumerate(secrets)]
    texts += [f'{prose("en", 20, i)} password = "{s}" {prose("en", 20, i + 70)}' for i, s in enumerate(passwords)]
    kept = ["password = example1234", "card 4111111111111111", "run 2024-01-12T10", "commit " + of(40, "0123456789abcdef")]
    texts += [f'{prose("en", 20, i)} {s} {prose("en", 20, i + 90)}' for i, s in enumerate(kept)]
    out = [r["text"] for r in secret_scan.redact_secrets(docs(spark, texts)).orderBy("doc_id").collect()]
    for i, s in enumerate(secrets + passwords):
        assert not [part for part in re.split(r"[.\s]", s) if part in out[i]] and "[SECRET]" in out[i]
    assert out[-len(kept):] == texts[-len(kept):]


def test_training_sample_is_drawn_per_label(spark):
    rare = [([1.0 + i / 100] * 16, 1) for i in range(20)]
    many = spark.range(20000).select(F.array(*[F.rand(i) / 2 for i in range(16)]).alias("features"), F.lit(0).alias("label"))
    labelled = many.union(spark.createDataFrame(rare, "features array<double>, label int"))
    forest = secret_scan.train(labelled, bound=100)
    found = spark.createDataFrame([(f,) for f, _ in rare], "features array<double>")
    assert secret_scan.judge(found, forest).where("is_secret").count() == 20
    # equal findings do not all stay or all go
    same = spark.range(20000).select(F.array(*[F.lit(0.0)] * 16).alias("features"), F.lit(0).alias("label"))
    assert secret_scan.train(same, bound=100) is not None


# ------------------------------------------------------------------ surrogates

def test_surrogates_keep_type_coreference_and_distinctness(spark):
    rng = random.Random(8)
    mails = [f"user{i}.name@mail{i % 3}.example.com" for i in range(20)]
    ips = [f"{rng.randrange(1, 255)}.{i}.7.{rng.randrange(1, 255)}" for i in range(20)]
    phones = [f"+1 ({200 + i}) 555-{1000 + i}" for i in range(20)]
    texts = [f"Write {m} or {m.upper()} at {ip}, call {p}. Mrs. Maria Lopez met г-н Иванов."
             for m, ip, p in zip(mails, ips, phones)] + ["4111 1111 1111 1111 or 4111111111111111"] + ODD
    df = docs(spark, texts, extra=True).withColumn("n_entities", F.lit(0))
    df = df.union(df.where("doc_id = 0"))
    out = {r["doc_id"]: r for r in surrogate.replace_entities(df, "k").collect()}
    again = {r["doc_id"]: r["text"] for r in surrogate.replace_entities(df, "k").collect()}
    assert all(out[i]["text"] == again[i] for i in out)
    new = [out[i]["text"] for i in range(20)]
    for olds in (mails, ips, phones, ["Maria", "Lopez", "Иванов"]):
        assert not any(o in t for o in olds for t in new)
    shape = re.compile(r"Write (\S+) or (\S+) at ([\d.]+), call (\+1 \(\d{3}\) \d{3}-\d{4})\. "
                       r"Mrs\. ([A-Z]\w+ [A-Z]\w+) met г-н ([А-Я]\w+)\.$")
    parts = [shape.match(t).groups() for t in new]
    assert all(a.upper() == b for a, b, *_ in parts)
    for k in (0, 2, 3):
        assert len({p[k] for p in parts}) == 20
    assert len({p[4:] for p in parts}) == 1
    a, b = out[20]["text"].split(" or ")
    assert a.replace(" ", "") == b and surrogate._luhn(b) == 0 and b != "4111111111111111"
    for i, t in enumerate(ODD[:-1]):
        assert out[21 + i]["text"] == (t if t != "12 34 !!" else "12 34 !!")
    assert surrogate.replace_entities(df.limit(0), "k").count() == 0


def test_names_are_replaced_whole_and_at_each_mention(spark):
    texts = ["Mr John Quincy Adams spoke. John Quincy Adams left; ADAMS stayed, Adams's dog and adams too.",
             "Ms Anna Smith-Jones met Herr Dr. Jan van der Berg. Then Smith-Jones and Jan van der Berg, Berg. Jones!",
             "Dr Smith wrote. Mr John Smith, Mr Smith and John Smith: Smith.", "Mrs. O'Brien, J. O'Brien.",
             "Adams and Smith have no title here.", None]
    out = [r["text"] for r in surrogate.replace_entities(docs(spark, texts), "k").orderBy("doc_id").collect()]
    for t in out[:4]:
        assert not re.search(r"John|Quincy|Adams\b|ADAMS|Anna|Smith|Jones|Jan\b|Berg|Brien", t)
    a = re.fullmatch(r"Mr (\w+) (\w+) (\w+) spoke\. (\w+) (\w+) (\w+) left; (\w+) stayed, (\w+)'s dog and adams too\.", out[0])
    x, y, z = a.groups()[:3]
    assert a.groups()[3:] == (x, y, z, z.upper(), z)
    b = re.fullmatch(r"Ms \w+ (\w+)-(\w+) met Herr Dr\. (\w+) van der (\w+)\. Then (\w+)-(\w+) and "
                     r"(\w+) van der (\w+), (\w+)\. (\w+)!", out[1]).groups()
    assert b[4:6] == b[:2] and b[6:8] == b[2:4] and b[8] == b[3] and b[9] == b[1]
    c = re.fullmatch(r"Dr (\w+) wrote\. Mr (\w+) (\w+), Mr (\w+) and (\w+) (\w+): (\w+)\.", out[2]).groups()
    assert len({c[0], c[2], c[3], c[5], c[6]}) == 1 and c[1] == c[4] == x and c[0] == b[0]
    assert out[4:] == texts[4:]


def test_surrogate_collisions_are_resolved(spark):
    rows = [("ip", f"{i}.{j}.1.1") for i in range(1, 10) for j in range(1, 10)]  # small formats
    got = surrogate.assign(spark.createDataFrame(rows, "kind string, norm string"), b"k").collect()
    new = [r["new"] for r in got]
    assert len(new) == len(set(new)) == 81 and not set(new) & {n for _, n in rows}


# ------------------------------------------------------------------ language model

def test_scores_against_a_plain_model(spark):
    texts = [prose(rng_lang, 5 + i, i % 7) for i, rng_lang in enumerate(["en", "de"] * 20)] + ODD
    df = docs(spark, texts, extra=True)
    train = F.col("doc_id") % 5 != 1
    got = {r["doc_id"]: r for r in backoff_lm.score_texts(df, train, block_bytes=700, bucket_bytes=300).collect()}
    tokens = [(t or "").lower().split() + [" end"] for t in texts]
    uni, bi = Counter(), Counter()
    for i, w in enumerate(tokens):
        if i % 5 != 1:
            uni.update(w)
            bi.update(zip([" begin"] + w, w))
    n, v = sum(uni.values()), len(uni)

    def discount(c):
        n1, n2 = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        return min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))
    d, e = discount(bi), discount(uni)
    ctx, types = Counter(), Counter()
    for (h, _), c in bi.items():
        ctx[h] += c
        types[h] += 1

    def p(w, h=None):
        low = (uni[w] - e) / n if uni[w] else e * v / n
        if h is None or not ctx[h]:
            return low
        return max(bi[h, w] - d, 0) * (bi[h, w] > 0) / ctx[h] + d * types[h] / ctx[h] * low
    for i, w in enumerate(tokens):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(uni[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[x] + .5) / (n + .5 * (v + 1))) for x in w))
        assert r["score"] == pytest.approx(sum(math.log10(p(x, h)) for h, x in zip([" begin"] + w, w)))
    # the arcs of a state and its failure arc sum to one
    for h in [" begin", *list(ctx)[:5]]:
        assert sum(p(w, h) for w in uni) + d * types[h] / ctx[h] * e * v / n == pytest.approx(1)


def test_scores_without_training(spark):
    got = backoff_lm.score_texts(docs(spark, ["a b", None]), F.lit(False)).collect()
    assert sorted((r["n_tokens"], r["train_tokens"], r["score"], r["base_score"]) for r in got) == [
        (1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]
    assert backoff_lm.score_texts(docs(spark, []), F.lit(True)).count() == 0


def test_lexicon_counts_every_text(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "Lexicon", dict)
    docs = spark.range(6000).select(F.concat(F.lit("zebra number "), F.col("id").cast("string")).alias("text"))
    assert secret_scan.learn_lexicon(docs) == {"zebra": 6000, "number": 6000}
