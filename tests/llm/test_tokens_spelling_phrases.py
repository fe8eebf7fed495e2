"""Token files, spelling variants and phrases against plain versions: nulls,
empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm import phrases, spelling, token_files, tokens
from vigil.llm.queries import word_tokenizer
from vigil.session import scratch_path

CLASHING = ("key", "tie", "place", "file", "segment", "first", "n_ids", "keys", "lengths", "words", "offsets", "word", "n",
            "frame", "m", "near", "gram", "f", "part", "counts", "a", "l", "r", "score", "rank", "start", "text_")


def table(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


# ------------------------------------------------------------------ tokens

def odd_texts():
    rng = random.Random(1)
    signs = "aé,. '-!ß́ ×÷İ0\n\t<|>ÀσΣ\x1c\x0b "
    out = ["a, b.", "., x", "É, È. Ça", "a×, b", "x ., y", "don't, it's.", "<|endoftext|> a<|startoftext|>", "5, 6.7, 8",
           "Σας, ΟΔΟΣ. x", "a\x1cb, c", "日本, 語. x", " , ", "", "a-, b", "''s 's, t'", "l'été, d'un. 3,4", "word " * 3000]
    return out + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(800)]


@pytest.mark.parametrize("cache", [64_000_000, 20_000])
def test_word_ids_equal_the_tokenizer(cache):
    whole = Tokenizer.from_file(word_tokenizer())
    whole.encode_special_tokens = True
    ours = tokens.WordIds(word_tokenizer(), cache)
    texts = odd_texts()
    for _ in range(3):      # unmet, met again, cached
        for i in range(0, len(texts), 100):
            for t, got in zip(texts[i:i + 100], ours.encode(texts[i:i + 100])):
                assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert ours.encode([None, ""]) == [b"", b""]
    assert ours.size <= cache + 200_000


def test_each_part_of_a_batch_is_looked_up_once(monkeypatch):
    asked: list[list[bytes]] = []
    look_up = tokens.WordIds._look_up
    monkeypatch.setattr(tokens.WordIds, "_look_up", lambda self, parts: asked.append(parts) or look_up(self, parts))
    ours = tokens.WordIds(word_tokenizer())
    texts = [" the cat, the\thound. ", None, "cat the the", "", "Été été the"]
    alone = [ours.encode([t])[0] for t in texts]
    asked.clear()
    assert ours.encode(texts) == alone and alone[1] == alone[3] == b""
    parts, = asked
    assert len(parts) == len(set(parts)) and {b"the", b"cat", b"hound"} <= set(parts)
    assert ours.encode([]) == []


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for trial in range(120):
        n = int(rng.integers(0, 9000))
        top = int(rng.choice([1, 2, 5, 300, 40000, 1 << 20, 1 << 31, 1 << 45, (1 << 60) - 1]))
        ids = rng.integers(0, top, n, dtype=np.uint64) if top > 1 else np.zeros(n, np.uint64)
        if n and trial % 2:
            at = int(rng.integers(0, n))
            ids[at:at + int(rng.integers(1, 6000))] = ids[at]
        words, offsets = token_files.encode_segment(ids)
        assert np.array_equal(token_files.read_ids(words, offsets), ids)
        # every block decodes from its own first word
        ends = np.frombuffer(offsets, "<u4")
        w = np.frombuffer(words, "<u8")
        for b in range(-(-n // token_files.BLOCK)):
            part = ids[b * token_files.BLOCK:(b + 1) * token_files.BLOCK]
            assert np.array_equal(token_files.decode_words(w[ends[b]:ends[b + 1]]), part)
        if n:
            at = int(rng.integers(0, n))
            size = int(rng.integers(0, n - at + 1))
            assert np.array_equal(token_files.read_ids(words, offsets, at, size), ids[at:at + size])
    with pytest.raises(ValueError):
        token_files.encode_segment(np.array([1 << 60], np.uint64))


def test_simple8b_packs_small_ids_and_runs():
    assert len(token_files.encode_words(np.ones(60, np.uint64))[0]) == 1
    assert len(token_files.encode_words(np.full(4096, 49000, np.uint64))[0]) == 1       # a run
    assert len(token_files.encode_words(np.arange(16384, 20480, dtype=np.uint64))[0]) == 1024      # four of 15 bits
    assert len(token_files.encode_words(np.array([1 << 59], np.uint64))[0]) == 1        # a wide id


@pytest.mark.parametrize("segment", [1 << 16, 50])
def test_token_files_hold_all_documents_in_order(spark, monkeypatch, segment):
    monkeypatch.setattr(token_files, "SEGMENT", segment)
    texts = [None, "", "  ", "one two", "one two", "Zwölf Boxkämpfer, jagen.", "tail " * 5000] + odd_texts()[:40]
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    rows += [(None, "no key"), (7, "same key"), (7, "another text"), (7, "same key")]
    df = table(spark, rows, "doc_id long, text string")
    files = token_files.write_token_files(df, scratch_path(spark, "tf"), word_tokenizer(), file_bytes=4000)
    got = token_files.read_documents(spark, files, with_ids=True).orderBy("start").collect()
    whole = Tokenizer.from_file(word_tokenizer())
    whole.encode_special_tokens = True
    want = Counter((k, tuple(whole.encode(t or "", add_special_tokens=False).ids + [1])) for k, t in rows)
    ids = [np.frombuffer(r.ids, "<u4") for r in got]
    assert Counter((r.key, tuple(x.tolist())) for r, x in zip(got, ids)) == want
    assert [r.key is None for r in got][0] and [r.key for r in got[1:]] == sorted(k for k, _ in rows if k is not None)
    at = 0
    for r, x in zip(got, ids):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    stored = spark.read.parquet(files.path).collect()       # a segment's documents by offset, without the rest
    for s in stored[:5]:
        first = 0
        for k, n in zip(s["keys"], s["lengths"]):
            one = token_files.read_ids(s["words"], s["offsets"], first, n).astype("<u4")
            assert (k, tuple(one.tolist())) in want
            first += n


def test_token_files_of_an_empty_table_and_string_keys(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_documents(spark, token_files.write_token_files(
        none, scratch_path(spark, "tf"), word_tokenizer())).count() == 0
    df = spark.createDataFrame([("b", "x"), ("a", "y z")], "doc_id string, text string")
    got = token_files.read_documents(spark, token_files.write_token_files(df, scratch_path(spark, "tf"), word_tokenizer()))
    assert [(r.key, r.start) for r in got.orderBy("start").collect()] == [("a", 0), ("b", 3)]


# ------------------------------------------------------------------ spelling

def plain_words(rows):
    n = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= 2}


def is_near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) > len(b) + 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def plain_groups(words):
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    out = {}
    for w, n in words.items():
        near = [x for d in (-1, 0, 1) for x in by_length[len(w) + d] if is_near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (n, len(near), best if best and words[best] >= 10 * n else None)

    def root(w):
        while out[w][2]:
            w = out[w][2]
        return w
    return {w: (n, k, f, words[f] if f else None, root(w)) for w, (n, k, f) in out.items()}


def spelled(seed, docs=60):
    rng = random.Random(seed)
    bases = ["abcdefgh", "aaaaaaaa", "électricité", "x" * 40, "ab" * 50, "q" * 300, "Zusammen", "zusammen"]
    rows = []
    for k in range(docs):
        ws = []
        for _ in range(60):
            w = rng.choice(bases)
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                i, op, ch = rng.randrange(len(w)), rng.randrange(3), rng.choice("abéxq")
                w = w[:i] + ("" if op == 0 else ch) + w[i + (op != 1):]
            ws.append(w)
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(ws)))
    # a chain of forms: 2, 20 and 200 occurrences
    rows += [(9000, "chainedab " * 2 + "chainedac " * 20 + "chainexac " * 200)]
    return rows + [(None, "abcdefgh abcdefgh"), (5, None), (6, ""), (7, "12 34 !!"), (8, "tailing " * 4000), (8, "tailing " * 4000)]


@pytest.mark.parametrize("hot,rows,pairs,block", [(4096, 50_000, 200_000, 512), (3, 400, 50, 4)])
def test_variants_equal_all_pairs(spark, monkeypatch, hot, rows, pairs, block):
    for name, value in (("HOT", hot), ("ROWS", rows), ("PAIRS", pairs), ("BLOCK", block)):
        monkeypatch.setattr(spelling, name, value)
    data = spelled(3)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in
           spelling.group_variants(table(spark, data, "doc_id long, text string")).collect()}
    want = plain_groups(plain_words(data))
    assert got == want
    assert any(v[4] != (v[2] or w) for w, v in want.items())        # a form of a form


def test_variants_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short words only")], "doc_id long, text string")
    assert spelling.group_variants(df).count() == 0 and spelling.group_variants(df.limit(0)).count() == 0


# ------------------------------------------------------------------ phrases

def plain_phrases(rows, least, top):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang][tuple(ws[i:i + k])] += 1
    out = set()
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            if any(100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in cand.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                        for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return out


def prose(seed, docs=120):
    rng = random.Random(seed)
    words = "the of and in New York été über a to is l'or x y d\x1ce".split(" ")
    rows = []
    for _ in range(docs):
        lang = rng.choice(["en", "en", "de", None, "und"])
        ws = []
        for _ in range(rng.randrange(0, 80)):
            ws.append(rng.choice(words) + rng.choice(["", "", "", ".", ", ", "\n", ";", "\t"]))
            if rng.random() < 0.05:
                ws.append("a passage that many documents share")
        rows.append((lang, rng.choice([" ", "  "]).join(ws)))
    return rows + [("en", None), ("en", ""), (None, " .,; "), ("fr", "solo"), ("en", "tail end " * 3000), ("en", "tail end " * 3000)]


@pytest.mark.parametrize("held,parts,least,top", [(400_000, 256, 30, 2000), (200, 5, 5, 7)])
def test_collocations_equal_plain_counts(spark, monkeypatch, held, parts, least, top):
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "PARTS", parts)
    data = prose(5)
    df = table(spark, data, "lang string, text string")
    got = {tuple(r) for r in phrases.collocations(df, least=least, top=top).collect()}
    assert got == plain_phrases(data, least, top)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_scores_pass_64_bits(spark):
    """Counts of which the products do not fit a long."""
    big = 10 ** 16
    grams = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big), ("en", "a b", 2, 2 * big - 1)],
                                  "lang string, gram string, words int, f long")
    cand = grams.where("words = 2").withColumnRenamed("f", "a")
    r = phrases.cut_scores(cand, grams, 2_000_000).collect()[0]
    assert r.score == 2_000_000 * (2 * big - 1) // (5 * big) and (r.l, r.r, r.k) == (3 * big, 2 * big, 1)


def test_unary_paths_are_compacted(spark):
    rows = [("en", "a b c d", 9), ("en", "b c d e", 7), ("en", "c d e f", 8),       # one path
            ("en", "c d e g", 3),                                                    # a second way out of "c d e"
            ("en", "r s t r", 5), ("en", "s t r s", 5), ("en", "t r s t", 5),        # a ring
            ("en", "z z z z", 6), ("de", "a b c d", 4), ("de", "b c d e", 4)]
    grams = spark.createDataFrame([(lg, g, 4, f) for lg, g, f in rows] + [("en", "a b", 2, 50)],
                                  "lang string, gram string, words int, f long")
    got = {(r.lang, r.path, r.edges, r.least, r.most) for r in phrases.compact_paths(grams).collect()}
    assert got == {("en", "a b c d e", 2, 7, 9), ("en", "c d e f", 1, 8, 8), ("en", "c d e g", 1, 3, 3),
                   ("en", "r s t r", 1, 5, 5), ("en", "s t r s", 1, 5, 5), ("en", "t r s t", 1, 5, 5),
                   ("en", "z z z z", 1, 6, 6), ("de", "a b c d e", 2, 4, 4)}
    long = [f"w{i}" for i in range(40)]
    chain = [("en", " ".join(long[i:i + 4]), 4, 30 + i) for i in range(37)]
    got = phrases.compact_paths(spark.createDataFrame(chain, "lang string, gram string, words int, f long")).collect()
    assert [(r.path, r.edges, r.least, r.most) for r in got] == [(" ".join(long), 37, 30, 66)]
    assert phrases.compact_paths(grams.limit(0)).count() == 0
