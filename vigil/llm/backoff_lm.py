"""Language-model scoring with a weighted backoff automaton.

The model is an interpolated bigram model with absolute discounting.  Each
context is a state; a counted bigram is an arc with its full log-probability;
everything else leaves by the state's failure arc, whose weight is the mass
the discount set free, to the root, where the discounted unigrams are.  Words
that training has not seen share the mass that the unigram discount set free.

    P(w | h) = (c(hw) - D) / c(h) + a(h) P(w),   a(h) = D types(h) / c(h)
    P(w) = (c(w) - E) / N,   P(unseen) = E V / N

D and E follow from how many n-grams occur once and twice, n1 / (n1 + 2 n2).

The model grows with the corpus and is never in one place.  Documents are dealt
into blocks; a block asks for the n-grams of its own texts, packed as arrays of
word hashes (48 bits) with its own training counts.  The arrays are merged by
buckets of contexts, and each block gets back, in the order it asked, the total
counts: the slice of the automaton that its texts can reach.  Contexts that are
frequent in a sample are spread over all buckets and their totals added up
afterwards; which ones are so spread changes nothing in the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import to_scratch, unit_hash

MASK = (1 << 48) - 1


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 11) & MASK


# no word holds white space
END, BEGIN = word_hash(b" end"), word_hash(b" begin")


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.astype("<i8").tobytes())


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "<i8")


def _six(a: np.ndarray) -> bytes:
    """48-bit numbers, six bytes each."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _of_six(b: bytes) -> np.ndarray:
    wide = np.zeros((len(b) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1).astype(np.int64)


def deal_texts(docs: DataFrame, key: str, text: str, train: Column, n_blocks: int) -> DataFrame:
    """(block, keys, train, sizes, texts): lower-cased texts, compressed, those
    of one block and batch together."""
    kind = dict(docs.dtypes)[key]

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = zstandard.ZstdCompressor(level=3)
        for p in parts:
            rows = []
            for block, g in p.groupby("block", sort=False):
                raw = [(t or "").encode("utf-8", "replace").lower() for t in g["text"]]
                rows.append((block, list(g["key"]), list(g["train"]), [len(r) for r in raw],
                             coder.compress(b"".join(raw))))
            yield pd.DataFrame(rows, columns=["block", "keys", "train", "sizes", "texts"])
    rows = docs.select(
        F.pmod(F.xxhash64(key, text), F.lit(n_blocks)).alias("block"), F.col(key).alias("key"),
        F.coalesce(train, F.lit(False)).alias("train"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(deal, f"block long, keys array<{kind}>, train array<boolean>, "
                            "sizes array<long>, texts binary")


class Block:
    """The tokens and bigrams of a block's documents, all in the order of word
    hashes, so that every run sees them alike."""

    def __init__(self, rows: pd.DataFrame, n_buckets: int, hot: np.ndarray):
        self.keys: list = []
        train: list[bool] = []
        ids: dict[bytes, int] = {}
        parts, lengths = [], []
        for keys, flags, sizes, packed in zip(rows["keys"], rows["train"], rows["sizes"], rows["texts"]):
            raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(sum(sizes)) + 1)
            at = 0
            self.keys += list(keys)
            train += [bool(f) for f in flags]
            for n in sizes:
                words = raw[at:at + int(n)].split()
                at += int(n)
                parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64,
                                         len(words)))
                lengths.append(len(words) + 1)
        self.train = np.array(train, bool)
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        hashes = np.fromiter((word_hash(w) for w in ids), np.int64, len(ids))
        # words that share a hash are one word; END and BEGIN come in by their hashes
        self.hashes = np.unique(np.r_[hashes, END, BEGIN])
        rank = np.searchsorted(self.hashes, hashes)
        end, begin = np.searchsorted(self.hashes, [END, BEGIN])
        token = np.full(int(self.lengths.sum()), end, np.int64)
        for start, p in zip(self.starts.tolist(), parts):
            token[start:start + len(p)] = rank[p]
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.starts] = begin
        self.token = token
        taught = np.repeat(self.train, self.lengths)
        size = len(self.hashes)
        self.word_counts = np.bincount(token[taught], minlength=size)
        grams, self.gram_of = np.unique(before * size + token, return_inverse=True)
        self.gram_counts = np.bincount(self.gram_of[taught], minlength=len(grams))
        self.context, self.word = grams // size, grams % size
        own = self.hashes % n_buckets
        bucket = own[self.context]
        spread = np.isin(self.hashes, hot)[self.context]
        bucket[spread] = (self.hashes[self.context[spread]] * 31
                          + self.hashes[self.word[spread]]) % n_buckets
        self.word_order, self.word_cuts = self._by_bucket(own, n_buckets)
        self.gram_order, self.gram_cuts = self._by_bucket(bucket, n_buckets)

    @staticmethod
    def _by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(n + 1))

    def of_bucket(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, bigrams, and places in them where another context begins."""
        words = self.word_order[self.word_cuts[b]:self.word_cuts[b + 1]]
        grams = self.gram_order[self.gram_cuts[b]:self.gram_cuts[b + 1]]
        context = self.context[grams]
        return words, grams, np.flatnonzero(np.r_[len(grams) > 0, context[1:] != context[:-1]][:len(grams)])


ASKED = ("bucket int, block long, words binary, word_counts binary, contexts binary, runs binary, "
         "grams binary, gram_counts binary")
TOLD = "block long, bucket int, words binary, grams binary, contexts binary, types binary, stats array<long>"


def ask(rows: pd.DataFrame, n_buckets: int, hot: np.ndarray) -> pd.DataFrame:
    """The n-grams of a block with its training counts, one row per bucket."""
    x, out = Block(rows, n_buckets, hot), []
    for b in range(n_buckets):
        words, grams, cuts = x.of_bucket(b)
        if len(words) or len(grams):
            out.append((b, int(rows["block"].iloc[0]), _six(x.hashes[words]), _pack(x.word_counts[words]),
                        _six(x.hashes[x.context[grams[cuts]]]), _pack(np.diff(np.r_[cuts, len(grams)])),
                        _six(x.hashes[x.word[grams]]), _pack(x.gram_counts[grams])))
    return pd.DataFrame(out, columns=[f.split()[0] for f in ASKED.split(", ")])


def merge(rows: pd.DataFrame, hot: np.ndarray) -> pd.DataFrame:
    """Totals over all blocks of the n-grams of a bucket, told to every block
    that asked; and a row with block -1 for the statistics of the bucket:
    tokens, types, unigrams seen once and twice, bigrams seen once and twice;
    its words, contexts and types columns hold the spread contexts."""
    bucket = int(rows["bucket"].iloc[0])

    def joined(name: str, read) -> tuple[np.ndarray, np.ndarray]:
        parts = [read(b) for b in rows[name]]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    words, word_at = joined("words", _of_six)
    counts, _ = joined("word_counts", _unpack)
    _, which = np.unique(words, return_inverse=True)
    total = np.bincount(which, weights=counts).astype(np.int64)
    contexts, context_at = joined("contexts", _of_six)
    runs, _ = joined("runs", _unpack)
    grams, gram_at = joined("grams", _of_six)
    counts, _ = joined("gram_counts", _unpack)
    names, context_of = np.unique(contexts, return_inverse=True)
    others, word_of = np.unique(grams, return_inverse=True)
    pairs, pair_of = np.unique(np.repeat(context_of, runs) * max(1, len(others)) + word_of,
                               return_inverse=True)
    gram_total = np.bincount(pair_of, weights=counts, minlength=len(pairs)).astype(np.int64)
    of = pairs // max(1, len(others))
    tokens = np.bincount(of, weights=gram_total, minlength=len(names)).astype(np.int64)
    types = np.bincount(of[gram_total > 0], minlength=len(names))
    out = []
    for i, block in enumerate(rows["block"]):
        c = context_of[context_at[i]:context_at[i + 1]]
        out.append((int(block), bucket, _pack(total[which[word_at[i]:word_at[i + 1]]]),
                    _pack(gram_total[pair_of[gram_at[i]:gram_at[i + 1]]]),
                    _pack(tokens[c]), _pack(types[c]), None))
    spread = np.isin(names, hot)
    stats = [total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum(),
             (gram_total == 1).sum(), (gram_total == 2).sum()]
    out.append((-1, bucket, _pack(names[spread]), b"", _pack(tokens[spread]), _pack(types[spread]),
                [int(s) for s in stats]))
    return pd.DataFrame(out, columns=[f.split()[0] for f in TOLD.split(", ")])


@dataclass
class Totals:
    """Corpus-wide numbers of the model."""
    tokens: int
    types: int
    word_discount: float
    gram_discount: float
    spread: dict[int, tuple[int, int]]


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / max(1, once + 2 * twice)))


class Automaton:
    """The states and arcs that a block's texts can reach."""

    def __init__(self, x: Block, told: pd.DataFrame, totals: Totals):
        size = len(x.hashes)
        words, grams = np.zeros(size, np.int64), np.zeros(len(x.context), np.int64)
        tokens, types = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for r in told.itertuples():
            w, g, cuts = x.of_bucket(r.bucket)
            words[w] = _unpack(r.words)
            grams[g] = _unpack(r.grams)
            tokens[x.context[g[cuts]]] = _unpack(r.contexts)
            types[x.context[g[cuts]]] = _unpack(r.types)
        for i, h in enumerate(x.hashes.tolist()):
            if h in totals.spread:
                tokens[i], types[i] = totals.spread[h]
        n, v = totals.tokens, totals.types
        self.words = words
        unseen = totals.word_discount * v / n if n else 1.0
        root = np.where(words > 0, (words - totals.word_discount) / max(1, n), unseen)
        self.base = np.log10((words + 0.5) / (n + 0.5 * (v + 1)))
        #: weight of each word's arc at the root
        self.root = np.log10(root)
        #: weight of each state's failure arc; 0 for words that are no state
        free = totals.gram_discount * types / np.maximum(tokens, 1)
        self.failure = np.where(tokens > 0, np.log10(np.where(tokens > 0, np.maximum(free, 1e-300), 1)), 0.0)
        #: weight of each bigram's arc; nan where there is none
        context = x.context
        with np.errstate(divide="ignore", invalid="ignore"):
            full = ((grams - totals.gram_discount) / tokens[context] + free[context] * root[x.word])
            self.arc = np.where(grams > 0, np.log10(full), np.nan)

    def traverse(self, x: Block) -> np.ndarray:
        """log10 probability of each document.  The state after a token depends
        on that token alone, so the left-to-right traversal of all documents is
        one pass over arrays: the state's arc for the token, or the failure arc
        and the root's."""
        arc = self.arc[x.gram_of]
        by_root = self.failure[x.context] + self.root[x.word]
        step = np.where(np.isnan(arc), by_root[x.gram_of], arc)
        return np.add.reduceat(step, x.starts)


def score_block(texts: pd.DataFrame, told: pd.DataFrame, n_buckets: int, hot: np.ndarray,
                totals: Totals) -> pd.DataFrame:
    if not len(texts):
        return pd.DataFrame({c: [] for c in ("key", "trained_on", "n_tokens", "n_known",
                                             "train_tokens", "base_score", "score")})
    x = Block(texts, n_buckets, hot)
    a = Automaton(x, told, totals)
    return pd.DataFrame({
        "key": x.keys, "trained_on": x.train, "n_tokens": x.lengths,
        "n_known": np.add.reduceat((a.words[x.token] > 0).astype(np.int64), x.starts),
        "train_tokens": totals.tokens, "base_score": np.add.reduceat(a.base[x.token], x.starts),
        "score": a.traverse(x)})


def frequent_words(docs: DataFrame, text: str, share: float, texts: int = 2000, most: int = 4096) -> np.ndarray:
    """Hashes of the words with about that share of the tokens, from a bounded
    sample; they only steer where work goes."""
    n = docs.count()
    rows = docs.where(unit_hash(text, seed=31) < min(1.0, texts / max(1, n))).select(F.explode(F.split(
        F.lower(F.col(text).cast("string")), r"[\x20\x09-\x0D]+")).alias("w"))
    counts = rows.groupBy("w").count()
    total = counts.agg(F.sum("count")).first()[0] or 1
    top = counts.where(F.col("count") >= max(5, share * total)).orderBy(F.desc("count")).limit(most)
    return np.unique(np.array([word_hash(r["w"].encode()) for r in top.collect()] + [BEGIN], np.int64))


def score_texts(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text",
                block_bytes: int = 12 << 20, bucket_bytes: int = 6 << 20) -> DataFrame:
    """One row per document: key, trained_on, n_tokens (words and one end),
    n_known (tokens that training holds), train_tokens, base_score (log10, each
    token by add-one-half over the training counts), score (log10 probability
    under the automaton).

    The model is learned from the rows where ``train`` holds (null: not).
    Null and empty texts are one end token.  Repeated rows count and return
    each.  With no training row every token has probability 1 in both scores.
    Extra columns are ignored; an empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    n_blocks, n_buckets = 1 + size // block_bytes, 1 + size // bucket_bytes
    hot = frequent_words(docs, text, 1 / (8 * n_buckets))
    texts = deal_texts(docs, key, text, train, n_blocks)

    def ask_block(rows: pd.DataFrame) -> pd.DataFrame:
        return ask(rows, n_buckets, hot)

    def merge_bucket(rows: pd.DataFrame) -> pd.DataFrame:
        return merge(rows, hot)
    told = to_scratch(texts.groupBy("block").applyInPandas(ask_block, ASKED)
                      .groupBy("bucket").applyInPandas(merge_bucket, TOLD), "lm-counts")
    sums, spread = np.zeros(6, np.int64), {}
    for r in told.where("block = -1").select("words", "contexts", "types", "stats").toLocalIterator():
        sums += np.array(r["stats"], np.int64)
        for h, c, t in zip(_unpack(r["words"]), _unpack(r["contexts"]), _unpack(r["types"])):
            c0, t0 = spread.get(int(h), (0, 0))
            spread[int(h)] = (c0 + int(c), t0 + int(t))
    totals = Totals(int(sums[0]), int(sums[1]), _discount(sums[2], sums[3]),
                    _discount(sums[4], sums[5]), spread)

    def score(texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return score_block(texts, told, n_buckets, hot, totals)
    kind = dict(docs.dtypes)[key]
    return (texts.groupBy("block").cogroup(told.where("block >= 0").drop("stats").groupBy("block"))
            .applyInPandas(score, f"key {kind}, trained_on boolean, n_tokens long, n_known long, "
                           "train_tokens long, base_score double, score double")
            .withColumnRenamed("key", key))
