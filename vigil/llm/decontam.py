"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the words of the benchmark.  A distributed
randomised SVD of the benchmark and all windows of the distinct texts of the
corpus gives a latent space; every window of every document is compared with
the benchmark items there, and candidates are checked by the longest common
subsequence of words with the item and, where the benchmark has an answer
column, with the answer.  So copies with changed, dropped or inserted words,
cut ones too, are found, and shared topics alone are not.

Benchmark items come in blocks of bounded size, each a pass over the
documents, so what tasks and driver hold does not grow with the benchmark.
Once a block the numbers of the benchmark's words in each text are written:
document frequencies, SVD and search read these.  They, document frequencies
and small matrices are shuffled; no text moves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, free_name, to_scratch

_SIGNS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII signs separate."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SIGNS).split()


@dataclass
class Item:
    item_id: int | None
    words: list[bytes]
    answer: list[bytes]


def read_items(rows: list) -> list[Item]:
    """Items with a word; without an answer column, or where it is null, the
    answer is empty and nothing is asked of it."""
    items = [Item(item_id, words_of(text), words_of(answer)) for item_id, text, answer in rows]
    return [x for x in items if x.words]


def lcs_length(item: list, other: list) -> int:
    """Longest common subsequence, bit-parallel over the item's words."""
    masks: dict = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in other:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def codes_of(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """The number of each word; len(vocabulary) for other words."""
    return np.fromiter(map(vocabulary.get, words, repeat(len(vocabulary))), np.int64, len(words))


def encode_texts(docs: DataFrame, text: str, vocabulary: dict[bytes, int], key: str | None = None) -> DataFrame:
    """Of each row: key, a hash h of the text and the numbers of its words,
    32 bits each (null if it holds none of the vocabulary), written once."""
    @F.pandas_udf("binary")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            codes = (codes_of(words_of(t), vocabulary) for t in s)
            yield pd.Series([c.astype("<u4").tobytes() if len(c) and c.min() < len(vocabulary) else None
                             for c in codes], dtype=object)
    body = F.col(text).cast("string")
    return to_scratch(docs.select((F.col(key) if key else F.lit(None).cast("int")).alias("key"),
                                  F.xxhash64(body).alias("h"), encode(body).alias("ids")), "passages")


def document_frequencies(texts: DataFrame, terms: int) -> np.ndarray:
    """Number of documents that hold each term, from the distinct texts (ids,
    and the number n of documents)."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(terms, np.int64)
        for p in parts:
            for raw, n in zip(p["ids"], p["n"]):
                ids = np.unique(np.frombuffer(raw, "<u4"))
                held[ids[:np.searchsorted(ids, terms)]] += n
        at = np.flatnonzero(held)
        yield pd.DataFrame({"term": at, "n": held[at]})
    rows = texts.select("ids", "n").mapInPandas(count, "term long, n long")
    got = dict(tuple(r) for r in rows.groupBy("term").agg(F.sum("n")).collect())
    return np.array([got.get(i, 0) for i in range(terms)], np.int64)


def _often(row: np.ndarray, term: np.ndarray, n: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a sparse matrix of n rows: the terms that are worth a dense column,
    the counts there (n x these), and which of the places are left."""
    often = np.flatnonzero(np.bincount(term, minlength=terms) * 64 >= n)
    column = np.full(terms, -1)
    column[often] = np.arange(len(often))
    at = column[term]
    counts = np.bincount((row * len(often) + at)[at >= 0], minlength=n * len(often))
    return often, counts.reshape(n, len(often)).astype(np.float32), at < 0


def _add_rows(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Adds each row of ``values`` to the row of ``out`` that ``at``, in
    ascending order, names: first the first of each, then the second."""
    first = np.flatnonzero(np.r_[True, np.diff(at) > 0])
    left = np.diff(np.r_[first, len(at)])
    while len(first):
        out[at[first]] += values[first]
        more = left > 1
        first, left = first[more] + 1, left[more] - 1


def _multiplied(texts: Iterator[bytes], q: np.ndarray, idf: np.ndarray, window: int = 64,
                chunk: int = 1 << 15) -> tuple[np.ndarray, int]:
    """X'Xq and the number of rows of X, the unit TF-IDF vectors of all windows
    of the texts (the term of each word, 32 bits; len(idf) or more for others).
    The terms that are frequent in a chunk are multiplied as a dense matrix."""
    terms, z, rows = len(idf), np.zeros(q.shape), 0
    held: list[np.ndarray] = []

    def flush() -> None:
        nonlocal rows
        ids = np.concatenate(held).astype(np.int64)
        held.clear()
        at = np.flatnonzero(ids < terms)
        if not len(at):
            return
        size, row, term = len(ids) // window, at // window, ids[at]
        often, x, rest = _often(row, term, size, terms)
        pairs, n = np.unique(row[rest] * terms + term[rest], return_counts=True)
        row, term = pairs // terms, pairs % terms
        x *= idf[often].astype(np.float32)
        v = n * idf[term]
        squares = np.einsum("ij,ij->i", x, x) + np.bincount(row, v * v, size)
        rows += np.count_nonzero(squares)
        scale = 1 / np.sqrt(np.where(squares > 0, squares, 1))
        x *= scale[:, None].astype(np.float32)
        v = (v * scale[row]).astype(np.float32)[:, None]
        there = x @ q[often]
        if len(pairs):
            _add_rows(there, row, q[term] * v)
            order = np.argsort(term, kind="stable")
            _add_rows(z, term[order], there[row[order]] * v[order])
        z[often] += x.T @ there
    room = chunk
    for raw in texts:
        ids = np.frombuffer(raw, "<u4")
        for start in range(0, len(ids), chunk):  # a multiple of the window
            part = ids[start:start + chunk]
            held.append(np.r_[part, np.full(-len(part) % window, terms, "<u4")])
            room -= len(held[-1])
            if room <= 0:
                flush()
                room = chunk
    if held:
        flush()
    return z, rows


def randomised_svd(items: list[bytes], texts: DataFrame, idf: np.ndarray, rank: int, power: int = 2,
                   seed: int = 1) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF matrix of the items
    and of all windows of the texts (column ids), both sides with the same
    weight, since the items are few.  Each round multiplies by the matrix and
    back: tasks sum over their windows, a shuffle by blocks of terms sums over
    the tasks, and the driver orthonormalises terms x (rank + 16) numbers."""
    terms, step = len(idf), 512
    width = min(rank + 16, terms)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]

    def sums(q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float32)

        def multiply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            z, rows = _multiplied((raw for p in parts for raw in p["ids"]), q, idf)
            yield pd.DataFrame([(-1, np.array([float(rows)]).tobytes())] + [
                (i, z[i:i + step].tobytes()) for i in range(0, terms, step) if z[i:i + step].any()],
                columns=["block", "z"])

        def add(p: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(z) for z in p["z"])
            return pd.DataFrame({"block": p["block"][:1], "z": [total.tobytes()]})
        out, rows = np.zeros((terms, width)), 0.0
        for r in texts.mapInPandas(multiply, "block int, z binary").groupBy("block").applyInPandas(
                add, "block int, z binary").collect():
            part = np.frombuffer(r["z"])
            if r["block"] < 0:
                rows = part[0]
            else:
                out[r["block"]:r["block"] + len(part) // width] = part.reshape(-1, width)
        own, n = _multiplied(iter(items), q, idf)
        return out / max(1.0, rows) + own / max(1, n)
    for _ in range(power):
        q = np.linalg.qr(sums(q))[0]
    values, turn = np.linalg.eigh(q.T @ sums(q))
    best = np.argsort(-values)[:rank]
    return (q @ turn[:, best[values[best] > 1e-9 * values[best[0]]]]).astype(np.float32)


class Index:
    """Latent vectors of the items of a block, and all that checking needs.
    Words are numbers: first those of the items, which are the terms, then
    those of ``short`` items and of answers.  Short items have no vector: their
    words are looked for as they are."""

    def __init__(self, items: list[Item], short: list[Item], vocabulary: dict[bytes, int], idf: np.ndarray,
                 basis: np.ndarray, min_cosine: float, min_lcs: float, min_answer: float):
        def numbers(words: list[bytes]) -> list[int]:
            return [vocabulary[w] for w in words]
        self.items = [Item(x.item_id, numbers(x.words), numbers(x.answer)) for x in items + short]
        self.vocabulary = vocabulary
        self.short: dict[int, list[int]] = {}
        for n, x in enumerate(self.items[len(items):], len(items)):
            self.short.setdefault(x.words[0], []).append(n)
        self.terms = basis * idf[:, None].astype(np.float32)
        self.limits = (min_cosine, min_lcs, min_answer)
        self.classes, self.vectors, self.longest = {}, {}, 0
        if not items:
            return
        sizes = [max(16, 1 << (len(x.words) - 1).bit_length()) for x in items]
        vectors = np.stack([self.terms[x.words].sum(0) for x in self.items[:len(items)]])
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        self.classes = {s: np.array([i for i, x in enumerate(sizes) if x == s]) for s in set(sizes)}
        self.vectors = {s: vectors[at] for s, at in self.classes.items()}
        self.longest = max(self.classes)

    def find(self, text: str | None) -> list[dict]:
        """The items found in a text."""
        return self.find_all([text])[0]

    def find_all(self, texts: Iterable[str | None]) -> list[list[dict]]:
        """The items found in each text."""
        return self.find_encoded(codes_of(words_of(t), self.vocabulary) for t in texts)

    def find_encoded(self, texts: Iterable[np.ndarray], chunk: int = 1 << 15) -> list[list[dict]]:
        """The items found in each text, given the numbers of its words; as many
        texts as make up a chunk of words are compared at once."""
        out: list[dict[int, dict]] = []
        held: list[tuple[np.ndarray, dict[int, dict]]] = []
        room = chunk
        for words in texts:
            out.append(self._find_short(words))
            if len(words) and self.classes:
                held.append((words, out[-1]))
                room -= len(words)
            if room <= 0:
                self._find_near(held)
                held, room = [], chunk
        if held:
            self._find_near(held)
        return [[best[n] for n in sorted(best)] for best in out]

    def _find_near(self, texts: list[tuple[np.ndarray, dict[int, dict]]]) -> None:
        """Adds to each text's finds the items near its windows, which are
        twice as long as the items' length class and half overlapping, so that
        a copy lies whole in one.  A candidate is read word by word only if
        enough of the item's words are there at all, which the subsequence
        cannot exceed."""
        min_cosine, min_lcs, min_answer = self.limits
        # empty blocks fill each text up and part it from the next, for every class
        lengths = np.array([len(words) for words, _ in texts])
        room = (-(-lengths // self.longest) + 1) * self.longest
        first = np.cumsum(room) - room
        ids = np.full(int(room.sum()), len(self.vocabulary))
        for (words, _), at in zip(texts, first.tolist()):
            ids[at:at + len(words)] = words
        size, blocks = 16, self._block_sums(ids)
        while size <= self.longest:
            if size in self.classes:
                sums = blocks.copy()
                sums[1:] += blocks[:-1]
                norms = np.maximum(np.sqrt(np.einsum("ij,ij->i", sums, sums)), 1e-12)
                near_by = sums @ self.vectors[size].T
                rows, cols = np.nonzero(near_by >= np.float32(min_cosine) * norms[:, None])
                cosines = (near_by[rows, cols] / norms[rows]).tolist()
                of = np.searchsorted(first // size, rows, "right") - 1
                at = -1
                for row, col, k, cosine in zip(rows.tolist(), cols.tolist(), of.tolist(), cosines):
                    words, best = texts[k]
                    if row != at:
                        at = row
                        r = row - int(first[k]) // size
                        near = words[max(0, (r - 1) * size - size // 2):(r + 1) * size + size // 2].tolist()
                        held = set(near).__contains__
                    n = int(self.classes[size][col])
                    item = self.items[n]
                    if sum(map(held, item.words)) < min_lcs * len(item.words):
                        continue
                    share = lcs_length(item.words, near) / len(item.words)
                    if share < min_lcs or share <= best.get(n, {}).get("lcs_share", 0.0):
                        continue
                    answer = lcs_length(item.answer, near) / len(item.answer) if item.answer else None
                    if answer is None or answer >= min_answer:
                        best[n] = {"item_id": item.item_id, "cosine": cosine,
                                   "lcs_share": share, "answer_share": answer}
            blocks = blocks[::2] + blocks[1::2] if size < self.longest else blocks
            size *= 2

    def _find_short(self, ids: np.ndarray) -> dict[int, dict]:
        """Short items whose words stand in the text in a row."""
        best: dict[int, dict] = {}
        if not self.short:
            return best
        words = ids.tolist()
        for at in [i for i, w in enumerate(words) if w in self.short]:
            for n in self.short[words[at]]:
                item = self.items[n]
                if n in best or words[at:at + len(item.words)] != item.words:
                    continue
                near = words[max(0, at - 16):at + 32]
                answer = lcs_length(item.answer, near) / len(item.answer) if item.answer else None
                if answer is None or answer >= self.limits[2]:
                    best[n] = {"item_id": item.item_id, "cosine": 1.0, "lcs_share": 1.0, "answer_share": answer}
        return best

    def _block_sums(self, ids: np.ndarray, size: int = 16, chunk: int = 1 << 15) -> np.ndarray:
        """Latent sums of the words of each block of 16; words that no item
        holds add nothing and are skipped."""
        parts = []
        for start in range(0, len(ids), chunk):  # a multiple of the block
            part = ids[start:start + chunk]
            at = np.flatnonzero(part < len(self.terms))
            n = len(part) // size
            row, term = at // size, part[at]
            often, counts, rest = _often(row, term, n, len(self.terms))
            out = counts @ self.terms[often]
            if rest.any():
                _add_rows(out, row[rest], self.terms[term[rest]])
            parts.append(out)
        return np.concatenate(parts)


def build_index(docs: DataFrame, rows: list, text: str, rank: int, min_words: int,
                limits: tuple[float, float, float], key: str | None = None) -> tuple[Index, DataFrame] | None:
    """The index of a block of (item_id, text, answer), and the encoded texts."""
    every = read_items(rows)
    if not every:
        return None
    items, short = [[x for x in every if (len(x.words) < min_words) == is_short] for is_short in (False, True)]
    first = {w for x in items for w in x.words}
    more = {w for x in every for w in x.words + x.answer} - first
    vocabulary = {w: i for i, w in enumerate([*sorted(first), *sorted(more)])}
    encoded = encode_texts(docs, text, vocabulary, key)
    if not items:
        return Index([], short, vocabulary, np.zeros(0), np.zeros((0, 1), np.float32), *limits), encoded
    # equal texts are one: numbers of words are shuffled for it, no text
    texts = to_scratch(encoded.where("ids is not null").groupBy("h").agg(
        F.first("ids").alias("ids"), F.count("*").alias("n")), "distinct")
    idf = np.log((encoded.count() + 1) / (document_frequencies(texts, len(first)) + 1)) + 0.1
    own = [codes_of(x.words, vocabulary).astype("<u4").tobytes() for x in items]
    return Index(items, short, vocabulary, idf, randomised_svd(own, texts.select("ids"), idf, rank), *limits), encoded


def indexes(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
            item_text: str = "text", answer: str | None = None, block: int = 512, rank: int = 128,
            min_words: int = 6, min_cosine: float = 0.38,
            min_lcs: float = 0.6, min_answer: float = 0.5) -> Iterator[Index]:
    """An index for each block of benchmark items: see ``encoded_blocks``."""
    return (index for index, _ in encoded_blocks(
        docs, benchmark, None, text, item, item_text, answer, block, rank, min_words, min_cosine, min_lcs, min_answer))


def encoded_blocks(docs: DataFrame, benchmark: DataFrame, key: str | None = None, text: str = "text",
                   item: str = "item_id", item_text: str = "text", answer: str | None = None, block: int = 512,
                   rank: int = 128, min_words: int = 6, min_cosine: float = 0.38,
                   min_lcs: float = 0.6, min_answer: float = 0.5) -> Iterator[tuple[Index, DataFrame]]:
    """For each block of benchmark items, in order of id and text, those
    without an id first, an index and the texts in its words' numbers.  Equal texts are one item (the smallest id);
    null texts and texts without a word are none.  Items under ``min_words``
    words are found only word by word, nothing changed."""
    rows = to_scratch(benchmark.where(F.col(item_text).isNotNull()).groupBy(
        F.col(item_text).alias("text")).agg(
            F.min(F.col(item)).alias("item"),
            (F.min(F.col(answer)) if answer else F.lit(None)).cast("string").alias("answer")), "items")
    bounded_batches(docs)
    last = None
    while True:
        # nulls are the smallest in the order and inside a struct
        left = rows if last is None else rows.where(F.struct("item", "text") > F.struct(
            F.lit(last[0]).cast(rows.schema["item"].dataType).alias("item"), F.lit(last[1]).alias("text")))
        got = left.orderBy("item", "text").limit(block).select("item", "text", "answer").collect()
        if not got:
            return
        made = build_index(docs, [tuple(r) for r in got], text, rank, min_words,
                           (min_cosine, min_lcs, min_answer), key)
        if made:
            yield made
        last = got[-1]


def matches_column(column: Column, index: Index, encoded: bool = False) -> Column:
    """array<struct(item_id, cosine, lcs_share, answer_share)> of a column of
    texts, or of the numbers of their words."""
    @F.pandas_udf("array<struct<item_id:long,cosine:double,lcs_share:double,answer_share:double>>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(index.find_encoded(np.frombuffer(x, "<u4") for x in s) if encoded
                            else index.find_all(s), dtype=object)
    # else Spark repeats the function in a filter that it infers from an explode
    return find.asNondeterministic()(column)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
               **options) -> DataFrame:
    """One row per document and benchmark item found in it: key, item_id,
    cosine, lcs_share, answer_share (null where no answer is given).

    Null and empty texts hold nothing; repeated rows return their findings
    again; extra columns are ignored; with no document or no item the result
    is empty.  Whole texts are searched.
    """
    out = docs.sparkSession.createDataFrame(
        [], f"{key} {dict(docs.dtypes)[key]}, item_id long, cosine double, lcs_share double, answer_share double")
    for index, encoded in encoded_blocks(docs, benchmark, key, text, **options):
        found = encoded.where("ids is not null").select(
            F.col("key").alias(key), F.explode(matches_column(F.col("ids"), index, True)).alias("m"))
        out = out.unionByName(found.select(key, "m.*"))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay."""
    out, m = docs, free_name(docs, "_found")
    for index in indexes(docs, benchmark, text, **options):
        out = out.withColumn(m, matches_column(F.col(text).cast("string"), index)).where(F.size(m) == 0).drop(m)
    return out
