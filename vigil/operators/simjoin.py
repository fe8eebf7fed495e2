"""Top-k similarity joins on an inverted or blocked index.

Index rows and queries are packed once into blocks of bounded size and written.
A task holds one block of queries and streams the index blocks past it, read from
where they lie (a Cartesian product of the blocks), so rows are not copied once a
partner block by a shuffle.  It keeps only the best ``k`` of each query; the worst
of these is the bound for the blocks that follow.  Neither pairs of a large group
of alike rows nor a whole index ever stand in one place.  Upper bounds decide what
is scored; the results are exact.  Blocks of sets of one table meet only once, for
both, and hold sets of like words and sizes.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.operators.ordered import top_n
from vigil.session import cut_lineage, scratch_path, stored

PART_VALUES = 4_000_000      # tokens or coordinates that a block holds
PART_ROWS = 16_000           # sets that a block holds
QUERY_ROWS = 64              # queries that make a block of their own worthwhile
PAIRS = 2_000_000            # products of two vectors made at once, pairs of sets held
FREQUENT = 2048              # tokens that are columns of a matrix at most, if they
DENSE = 0.0015               # occur in so large a share of the pairs of two blocks
FEW = 16                     # if there are so many of them,
DENSE_VALUES = 20_000_000    # and the matrix has no more values than these
LIST = 64                    # rows that make a list of its own worthwhile
TOGETHER = 288               # sets that are counted together
COMMON = 1024                # words that sets are dealt to blocks by
SLACK = 1e-9                 # on bounds; scores decide exactly


class SetIndex:
    """Sets of token numbers, by set and by token; finds the pairs of sets
    with Jaccard above ``t`` between two blocks.

    Tokens that many pairs share are columns of a matrix, whose product counts
    three sets at once (of 8 bits each, exact in single precision); the others
    have lists of rows.  A pair above ``t`` shares at least ``t / (1 + t) *
    (n + m)`` tokens: only such pairs are scored.
    """

    def __init__(self, ids: list, sizes: np.ndarray, offsets: np.ndarray, tokens: np.ndarray):
        self.ids, self.sizes, self.offsets = ids, sizes.astype(np.int64), offsets.astype(np.int64)
        self.words, at = np.unique(tokens, return_inverse=True)
        self.at = at.reshape(-1).astype(np.int32)    # the tokens of each set, as places in words
        owner = np.repeat(np.arange(len(ids), dtype=np.uint16 if len(ids) < 1 << 16 else np.int32), np.diff(self.offsets))
        self.owners = owner[np.argsort(self.at, kind="stable")]
        self.starts = np.append(0, np.cumsum(np.bincount(self.at, minlength=len(self.words))))
        self.scored = 0

    def __getstate__(self) -> tuple:           # by token only, the smaller half
        return self.ids, self.sizes, self.words, np.diff(self.starts).astype(np.int32), self.owners

    def __setstate__(self, state: tuple) -> None:
        self.ids, self.sizes, self.words, length, self.owners = state
        self.starts = np.append(0, np.cumsum(length, dtype=np.int64))
        self.scored = 0

    @cached_property
    def offsets(self) -> np.ndarray:
        return np.append(0, np.cumsum(np.bincount(self.owners, minlength=len(self.ids))))

    @cached_property
    def at(self) -> np.ndarray:
        words = np.repeat(np.arange(len(self.words), dtype=np.int32), np.diff(self.starts))
        return words[np.argsort(self.owners, kind="stable")]

    @cached_property
    def rank(self) -> np.ndarray:
        rank = np.empty(len(self.ids), np.int64)
        rank[sorted(range(len(self.ids)), key=lambda i: self.ids[i])] = np.arange(len(self.ids))
        return rank

    @cached_property
    def place(self) -> dict:
        return {x: i for i, x in enumerate(self.ids)}

    def rows_of(self, mask: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The tokens in ``mask`` (places in ``self.words``) of all sets, and where
        those of each begin."""
        chosen = np.flatnonzero(mask[self.at])
        return self.at[chosen], np.searchsorted(chosen, self.offsets).tolist()

    def best(self, own, n: int, tokens: np.ndarray, k: int, t: float) -> tuple[np.ndarray, np.ndarray]:
        for _, near, score in self.many([own], np.array([n]), np.array([0, len(tokens)]), tokens, k, t, np.array([-np.inf])):
            return near, score
        return np.empty(0, np.int64), np.empty(0)

    def many(self, owns: list, sizes: np.ndarray, offsets: np.ndarray, tokens: np.ndarray, k: int, t: float,
             least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Partners above ``t`` that score at least ``least`` of the query."""
        return self.nearest(SetIndex(owns, sizes, offsets, tokens), k, t, least, True)

    def nearest(self, asks: SetIndex, k: int, t: float, least: np.ndarray, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for q, near, score in self.pairs(asks, t, least, same):
            pick = _first(-score, self.rank[near], k)
            yield q, near[pick], score[pick]

    def pairs(self, asks: SetIndex, t: float, least: np.ndarray | None, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """All pairs above ``t`` that score at least ``least`` of the set asked
        for, by that set; with ``same`` none of equal ids."""
        if not len(self.words) or not len(asks.words):
            return
        to = np.minimum(np.searchsorted(self.words, asks.words), len(self.words) - 1)
        known = self.words[to] == asks.words
        length = np.diff(self.starts)
        met = np.where(known, length[to] * np.diff(asks.starts), 0)
        rows, n_asks = len(self.ids), len(asks.ids)
        often = np.argsort(-met, kind="stable")[:max(1, min(FREQUENT, DENSE_VALUES // rows))]
        often = often[met[often] >= max(1, DENSE * rows * n_asks)]
        if len(often) < FEW:
            often = often[:0]
        dense = np.zeros((len(often), rows), np.float32)
        for c, w in enumerate(to[often].tolist()):
            dense[c, self.owners[self.starts[w]:self.starts[w + 1]]] = 1
        column = np.full(len(to), -1)
        column[often] = np.arange(len(often))
        known &= column < 0
        lists = known & (length[to] >= LIST)
        columns, columns_at = asks.rows_of(column >= 0)
        columns = column[columns]
        owners = self.owners
        long, long_at = asks.rows_of(lists)
        long = (np.cumsum(lists) - 1)[long]
        views = [owners[a:b] for a, b in zip(self.starts[to[lists]].tolist(), self.starts[to[lists] + 1].tolist())]
        short, short_at = asks.rows_of(known & ~lists)
        short = to[short]
        smallest, largest = int(self.sizes.min()), int(self.sizes.max())
        kind = np.int16 if min(largest, int(asks.sizes.max())) < 2 ** 15 else np.int32
        part = np.floor(t / (1 + t) * self.sizes).astype(np.int64)
        least_part = int(part.min())
        for lo in range(0, n_asks, TOGETHER):
            hi = min(lo + TOGETHER, n_asks)
            counts = _products(columns[columns_at[lo]:columns_at[hi]], np.diff(columns_at[lo:hi + 1]), dense, kind) if len(often) else None
            some = short[short_at[lo]:short_at[hi]]
            n = length[some]
            ends = np.append(0, np.cumsum(n))
            flat = owners[np.arange(ends[-1]) + np.repeat(self.starts[some] - ends[:-1], n)]
            edge = ends[np.array(short_at[lo:hi + 1]) - short_at[lo]].tolist()
            for q in range(lo, hi):
                size = int(asks.sizes[q])
                above = t if least is None else max(t, least[q])
                if smallest * above * (1 - SLACK) > size or size * above * (1 - SLACK) > largest:
                    continue
                found = [views[x] for x in long[long_at[q]:long_at[q + 1]].tolist()]
                found.append(flat[edge[q - lo]:edge[q - lo + 1]])
                shared = np.bincount(np.concatenate(found), minlength=rows).astype(kind)
                if counts is not None:
                    shared += counts[q - lo]
                need = int(np.floor(above / (1 + above) * size))
                left = np.flatnonzero(shared >= kind(max(1, need + least_part)))
                left = left[shared[left] >= need + part[left]]
                if not len(left):
                    continue
                got, sizes = shared[left].astype(np.int64), self.sizes[left]
                enough = got >= above / (1 + above) * (size + sizes) - SLACK
                if same:
                    enough &= left != self.place.get(asks.ids[q], -1)
                left, got, sizes = left[enough], got[enough].astype(np.float64), sizes[enough]
                self.scored += len(left)
                score = got / (size + sizes - got)
                keep = (score > t) if least is None else (score > t) & (score >= least[q])
                if keep.any():
                    yield q, left[keep], score[keep]


def _products(columns: np.ndarray, n: np.ndarray, dense: np.ndarray, kind: type) -> np.ndarray:
    """What sets (the next ``n`` of ``columns`` each) share with all rows of
    ``dense`` (column, row).  A sum holds the counts of three sets; columns are
    dealt to several products if a set has more than 255 of them."""
    third = -(-len(n) // 3)
    out = np.empty((3, third, dense.shape[1]), kind)
    has = np.zeros((3 * third, len(dense)), np.float32)
    has[np.repeat(np.arange(len(n)), n), columns] = 1
    parts = 1
    while any(has[:, c::parts].sum(axis=1).max() > 255 for c in range(parts)):
        parts += 1
    three = has[:third] + 256 * has[third:2 * third] + 65536 * has[2 * third:]
    for c in range(parts):
        sums = (three[:, c::parts] @ dense[c::parts]).astype("<i4").view(np.uint8).reshape(third, -1, 4)
        for j in range(3):
            if c:
                out[j] += sums[:, :, j]
            else:
                out[j] = sums[:, :, j]
    return out.reshape(3 * third, -1)


def _first(score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest, ties by ``rank``."""
    if len(score) <= 4 * k:
        return np.lexsort((rank, score))[:k]
    near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
    return near[np.lexsort((rank[near], score[near]))[:k]]


class _BestOfRows:
    """The best ``k`` partners of each row of a block, from (row, partner, score)."""

    def __init__(self, rank: np.ndarray, k: int):
        self.rank, self.k, self.held, self.new = rank, k, [], 0

    def add(self, rows: np.ndarray, other: int, score: np.ndarray) -> None:
        self.held.append((rows, np.full(len(rows), other), score))
        self.new += len(rows)
        if self.new > PAIRS:
            self.held, self.new = [self.best()], 0

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        rows, other, score = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((self.rank[other], -score, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        order = order[place < self.k]
        return rows[place < self.k], other[order], score[order]


class VectorIndex:
    """Unit vectors; answers the best partners by cosine.

    Products in single precision, with the error they can have, decide which
    pairs are scored in double precision.
    """

    def __init__(self, ids: list, vectors: np.ndarray):
        self.ids = ids
        self.rank = np.empty(len(ids), np.int64)
        self.rank[sorted(range(len(ids)), key=lambda i: ids[i])] = np.arange(len(ids))
        self.place = {x: i for i, x in enumerate(ids)}
        self.whole = vectors
        self.rough = vectors.astype(np.float32)
        self.error = SLACK + (vectors.shape[1] + 8) * 2.0 ** -22     # of a rough product of unit vectors
        self.scored = 0

    def best(self, owns: list, queries: np.ndarray, k: int, t: float,
             least: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Partners of ``t`` or more that score at least ``least`` of the query."""
        least = np.full(len(owns), t) if least is None else np.maximum(least, t)
        some = max(1, PAIRS // max(1, len(self.ids)))
        for lo in range(0, len(owns), some):
            rough = queries[lo:lo + some].astype(np.float32) @ self.rough.T
            for q in range(lo, lo + len(rough)):
                row = rough[q - lo]
                if owns[q] in self.place:
                    row[self.place[owns[q]]] = -np.inf
                left = np.flatnonzero(row >= np.float32(least[q] - self.error))
                if len(left) > 4 * k:         # what is below the k best by more than the error is out
                    worst = np.partition(row[left], len(left) - k)[len(left) - k]
                    left = left[row[left] >= worst - np.float32(2 * self.error)]
                if not len(left):
                    continue
                self.scored += len(left)
                score = self.whole[left] @ queries[q]
                keep = score >= least[q]
                left, score = left[keep], score[keep]
                pick = np.lexsort((self.rank[left], -score))[:k]
                yield q, left[pick], score[pick]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


class _Sets:
    """A block of sets, as index or as queries."""

    def __init__(self, block: bytes):
        self.sets: SetIndex = pickle.loads(block)
        self.ids = self.sets.ids

    @staticmethod
    def packed(rows: pa.Table) -> bytes:
        offsets, tokens = _lists(rows.column("v").combine_chunks())
        return pickle.dumps(SetIndex(rows.column("id").to_pylist(), rows.column("n").to_numpy(), offsets, tokens), 5)

    def index(self) -> SetIndex:
        return self.sets

    def ask(self, index: SetIndex, least: np.ndarray, k: int, t: float, same: bool) -> Iterator[tuple]:
        return index.nearest(self.sets, k, t, least, same)


def _stream(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_table(rows)
    return sink.getvalue().to_pybytes()


class _Vectors:
    """A block of unit vectors, as index or as queries."""

    def __init__(self, block: bytes):
        rows = pa.ipc.open_stream(block).read_all()
        self.ids = rows.column("id").to_pylist()
        offsets, flat = _lists(rows.column("v").combine_chunks())
        self.vectors = flat.reshape(len(offsets) - 1, -1)

    @staticmethod
    def packed(rows: pa.Table) -> bytes:
        return _stream(rows)

    def index(self) -> VectorIndex:
        return VectorIndex(self.ids, self.vectors)

    def ask(self, index: VectorIndex, least: np.ndarray, k: int, t: float, same: bool) -> Iterator[tuple]:
        return index.best(self.ids, self.vectors, k, t, least)


def _blocks(rows: DataFrame, parts: int | None, kind: type = _Vectors, order: list[str] = []) -> DataFrame:
    """``rows`` (id, n, v) in about ``parts`` blocks of at most PART_VALUES
    values, and of at most PART_ROWS sets: name, block (from ``kind``), written.
    By ranges of ``order``, if there is one, the caller writes them.  Without
    ``parts`` they are packed where they lie, neither moved nor written."""
    most, most_rows, packed = PART_VALUES, PART_ROWS if kind is _Sets else 1 << 40, kind.packed

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, values, n = [], 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([packed(pa.Table.from_batches(held))], pa.binary())],
                                              ["name", "block"])
        for b in batches:
            at = b.column("v").offsets.to_numpy()
            lo = 0
            while lo < len(b):
                hi = min(int(np.searchsorted(at, at[lo] + most - values, "right")) - 1, lo + most_rows - n)
                if hi <= lo and n:
                    yield out()
                    held, values, n = [], 0, 0
                    continue
                hi = min(max(hi, lo + 1), len(b))
                held.append(b.slice(lo, hi - lo))
                values, n, lo = values + int(at[hi] - at[lo]), n + hi - lo, hi
        if held:
            yield out()
    if parts is None:
        return rows.select("id", "n", "v").mapInArrow(pack, "name string, block binary")
    if order:
        return rows.repartitionByRange(parts, *order).coalesce(parts).select("id", "n", "v").mapInArrow(pack, "name string, block binary")
    return cut_lineage(rows.repartition(parts).select("id", "n", "v").mapInArrow(pack, "name string, block binary"))


def _amount(rows: DataFrame, kind: type) -> tuple[int, int]:
    """Rows, and the blocks that they fill."""
    n, values = rows.agg(F.count(F.lit(1)), F.sum(F.size("v"))).first()
    return n, max(-(-(values or 0) // PART_VALUES), -(-n // PART_ROWS) if kind is _Sets else 0)


def _pair_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", id_type), T.StructField("other", id_type), T.StructField("score", T.DoubleType())])


def _top_of_pairs(sets: DataFrame, common: list[int], k: int, t: float) -> DataFrame:
    """``sets``: id, n, v.  Returns id, other, score: the best ``k`` of each set in
    each pair of blocks, more than ``k`` for some.  A pair of blocks meets once, for
    the sets of both.  Blocks hold sets of like words and sizes, so that most
    blocks share few words."""
    spark = sets.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rows, parts = _amount(sets, _Sets)
    parts = max(1, parts, min(2 * cores, rows // QUERY_ROWS))
    path = scratch_path(spark, "blocks")       # as Python's bytes: Spark's rows of bytes reach Python slowly
    _blocks(by_common_word(sets, common), parts, _Sets, ["label", "n"]).rdd.map(tuple).saveAsPickleFile(path, 1)
    blocks = spark.sparkContext.pickleFile(path, parts)
    number = {name: i for i, name in enumerate(sorted(blocks.keys().collect()))}

    def work(pairs: Iterator[tuple]) -> Iterator[tuple]:
        asked: dict[int, tuple] = {}
        last, index = None, None
        for (q, ask), (i, block) in pairs:
            a, b = number[q], number[i]
            if a != b and (a < b) != ((a + b) % 2 == 1):
                continue                       # these two meet the other way round
            if a not in asked:
                some = pickle.loads(ask)
                asked[a] = some, [[] for _ in some.ids], np.full(len(some.ids), -np.inf)
            some, best, least = asked[a]
            if last != b:
                last, index = b, pickle.loads(block)
            back = _BestOfRows(some.rank, k)
            for n, near, score in index.pairs(some, t, least if a == b else None, True):
                if a != b:
                    back.add(near, n, score)
                pick = _first(-score, index.rank[near], k)
                best[n] = sorted(best[n] + [(-s, index.ids[x]) for x, s in zip(near[pick].tolist(), score[pick].tolist())])[:k]
                if len(best[n]) == k:
                    least[n] = -best[n][-1][0]
            for row, other, score in zip(*(x.tolist() for x in back.best())):
                yield index.ids[row], some.ids[other], score
        for some, best, _ in asked.values():
            for own, found in zip(some.ids, best):
                for s, other in found:
                    yield own, other, -s
    held = blocks.coalesce(max(1, min(parts, -(-8 * cores // max(1, len(number))))))
    return cut_lineage(spark.createDataFrame(blocks.cartesian(held).mapPartitions(work), _pair_schema(sets.schema["id"].dataType),
                                             verifySchema=False))


def _top_of_parts(queries: DataFrame, index: DataFrame, kind: type, k: int, t: float, same: bool) -> DataFrame:
    """``queries`` and ``index``: id, n, v.  Returns id, other, score: the best
    ``k`` of each query over groups of the index's blocks."""
    spark = queries.sparkSession

    cores = spark.sparkContext.defaultParallelism
    rows, splits = _amount(queries, kind)
    parts = max(1, splits if queries is index else _amount(index, kind)[1])
    splits = max(1, splits, min(2 * cores, rows // QUERY_ROWS))
    groups = max(1, min(parts, 2 * cores // splits))

    def block(row) -> object:
        return kind(row["block"])

    def work(pairs: Iterator[tuple]) -> Iterator[tuple]:
        asked: dict[str, tuple] = {}           # by block of queries: it, the best of each query, the worst of these
        last, built = None, None
        for q, i in pairs:
            if q["name"] not in asked:
                some = block(q)
                asked[q["name"]] = some, [[] for _ in some.ids], np.full(len(some.ids), -np.inf)
            some, best, least = asked[q["name"]]
            if last != i["name"]:
                last, built = i["name"], block(i).index()
            for n, near, score in some.ask(built, least, k, t, same):
                best[n] = sorted(best[n] + [(-s, built.ids[x]) for x, s in zip(near.tolist(), score.tolist())])[:k]
                if len(best[n]) == k:
                    least[n] = -best[n][-1][0]
        for some, best, _ in asked.values():
            for own, found in zip(some.ids, best):
                for s, other in found:
                    yield own, other, -s
    asks = _blocks(queries, splits, kind)
    if splits == 1:                            # one block of queries reads the index once
        held = _blocks(index, None, kind).rdd
    elif queries is index and splits == parts:
        held = asks.rdd.coalesce(groups)
    else:
        held = _blocks(index, parts, kind).rdd.coalesce(groups)
    pairs = asks.rdd.cartesian(held)
    return cut_lineage(spark.createDataFrame(pairs.mapPartitions(work), _pair_schema(index.schema["id"].dataType), verifySchema=False))


def word_numbers(sets: DataFrame, others: DataFrame | None = None) -> tuple[int, list[int]]:
    """The first seed under which no two words of ``sets`` and ``others`` (id, ws)
    have the same hash, and the hashes of the words that most sets hold."""
    both = sets.select("ws") if others is None else sets.select("ws").unionByName(others.select("ws"))
    words = both.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    for seed in range(100):
        numbers = words.groupBy(F.xxhash64("w", F.lit(seed)).alias("h")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"))
        first = numbers.orderBy((F.col("words") > 1).desc(), F.col("n").desc(), "h").limit(COMMON).collect()
        if not first or first[0]["words"] == 1:
            break
    return seed, [r["h"] for r in first]


def numbered(sets: DataFrame, seed: int) -> DataFrame:
    return sets.select("id", F.size("ws").alias("n"), F.transform("ws", lambda w: F.xxhash64(w, F.lit(seed))).alias("v"))


def numbered_words(sets: DataFrame, others: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``sets`` and ``others`` (id, ws) with the words as numbers (id, n, v).
    Numbers are hashes under the first seed that gives no two words of the
    vocabulary the same."""
    seed, _ = word_numbers(sets, others)
    return numbered(sets, seed), None if others is None else numbered(others, seed)


def by_common_word(sets: DataFrame, common: list[int]) -> DataFrame:
    """``sets`` (id, n, v) with label: the place of the first of ``common`` that
    the set holds.  Sets of one label are likely to share words."""
    order = np.argsort(np.array(common, np.int64), kind="stable")
    hashes = np.array(common, np.int64)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, v = _lists(b.column("v"))
            at = np.minimum(np.searchsorted(hashes, v), len(hashes) - 1)
            first = np.where(hashes[at] == v, order[at], len(hashes))
            row = np.repeat(np.arange(len(b)), np.diff(offsets))
            label = np.full(len(b), len(hashes))
            np.minimum.at(label, row, first)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label, pa.int32())], [*b.schema.names, "label"])
    if not common:
        return sets.withColumn("label", F.lit(0))
    return sets.mapInArrow(run, T.StructType([*sets.schema.fields, T.StructField("label", T.IntegerType())]))


def top_jaccard(sets: DataFrame, k: int, t: float, others: DataFrame | None = None) -> DataFrame:
    """id, other, score: for each set of ``sets`` (id, ws: distinct words) its
    ``k`` best partners (in ``others``, else in ``sets`` but itself) with
    Jaccard above ``t``, ties to the smaller id.  Exact."""
    if others is None:
        seed, common = word_numbers(sets)
        found = _top_of_pairs(numbered(sets, seed), common, k, t)
    else:
        found = _top_of_parts(*numbered_words(sets, others), _Sets, k, t, False)
    return top_n(found, ["id"], [F.col("score").desc(), F.col("other")], k)


def classes_of(rows: DataFrame, value: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, ``value``) of equal value as one class: (members: id, cls) and
    (classes: id = cls, the smallest id of the class, value).  Rows are worked out
    and written once; only digests and ids are shuffled to find the classes."""
    text = F.to_json(value) if kind == "json" else F.col(value)
    rows = stored(rows.select("id", value, F.sha2(text, 256).alias("_key")), "keyed")
    heads = rows.groupBy("_key").agg(F.min("id").alias("cls"))
    member = cut_lineage(rows.select("id", "_key").join(heads, "_key").select("id", "cls"))
    classes = rows.select("id", value).join(member.where("id = cls").select("id").distinct(), "id", "left_semi")
    return member, stored(classes.dropDuplicates(["id"]), "classes")


def spread_over_members(near: DataFrame, member: DataFrame, k: int, own_score: float) -> DataFrame:
    """id, other, score, rank: partners of classes (id, other, score; the best
    ``k + 1`` of each) as those of their members.  Members of the own class
    score ``own_score``; only the ``k + 1`` smallest ids of a class can matter."""
    heads = cut_lineage(top_n(member, ["cls"], [F.col("id")], k + 1, salt_col="id"))
    other = heads.select(F.col("cls").alias("other"), F.col("id").alias("m"))
    all_ = near.join(other, "other").select(F.col("id").alias("cls"), "m", "score").unionByName(
        heads.select("cls", F.col("id").alias("m"), F.lit(own_score).alias("score")))
    best = top_n(all_, ["cls"], [F.col("score").desc(), F.col("m")], k + 1)
    lists = best.groupBy("cls").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("s"), F.col("m").alias("i")))).alias("_l"))
    rows = member.join(lists, "cls").select(
        "id", F.posexplode(F.slice(F.filter("_l", lambda x: x["i"] != F.col("id")), 1, k)).alias("_p", "_x"))
    return rows.select("id", F.col("_x.i").alias("other"), (-F.col("_x.s")).alias("score"),
                       (F.col("_p") + 1).alias("rank"))


def top_cosine(vectors: DataFrame, k: int, t: float) -> DataFrame:
    """id, other, score, rank: for each vector (id, v: array of doubles of one
    length, none zero) its ``k`` best partners with cosine of ``t`` or more,
    ties to the smaller id.  Equal vectors are one class.  Exact."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    unit = vectors.select("id", F.transform("v", lambda x: x / norm).alias("v"))
    member, classes = classes_of(unit, "v", "json")
    rows = classes.select("id", F.lit(0).alias("n"), "v")
    near = top_n(_top_of_parts(rows, rows, _Vectors, k + 1, t, True), ["id"],
                 [F.col("score").desc(), F.col("other")], k + 1)
    return spread_over_members(near, member, k, 1.0)
