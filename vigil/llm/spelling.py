"""Grouping of spelling variants by dense prefix-suffix tiling.

Two words are near if they differ by one inserted, deleted or replaced code
point.  Words lie in matrices of code points, padded from the left and, read
backwards, from the right; a tile compares each word of a block with each of
another at once, and a pair is near if its common prefix and common suffix
together reach the longer length less one.

Which blocks meet is decided by frames.  In the class of pairs whose longer
word has ``m`` code points, the place of the edit lies in one of the windows
of two code points; around that window both words read alike, counted from the
front before it and from the end behind it.  A word therefore enters, for
``m`` its length and its length plus one, one frame for each window, and only
words of one frame are tiled.  Distinct words of a frame differ within its window
alone, so a frame of the alphabet's 90 signs holds at most 90 * 90 + 90 words.
Words over 32 code points have 16 wider windows; of these a frame of over
``HOT`` words is taken apart into windows of two as well.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, to_scratch

_RUN = re.compile("[a-zÀ-ÿ]+")
DROP_ONE_IN = 31            # of the runs' hashes: these lose a code point
KEPT = 200_000              # words that a task counts before it hands them on
LONG, WINDOW, WINDOWS, HOT = 32, 2, 16, 4096
BLOCK = 512                 # words on a side of a tile
PAIRS = 200_000             # pairs compared in one array operation
ROWS = 50_000               # rows of frames taken together


# ---------------------------------------------------------------- words

def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 7,
                least_count: int = 2) -> DataFrame:
    """Written table word, n: the runs of Latin letters of all whole texts,
    A-Z lower-cased, one in 31 (by the crc32 of ``<key>:<run>``) with a code
    point deleted.  Null texts have none; a null key is the empty string."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                runs = [r for r in _RUN.findall(t.encode("utf-8", "replace").lower().decode("utf-8"))
                        if len(r) >= least_length]
                before = zlib.crc32(f"{'' if k is None else k}:".encode())
                marks = [zlib.crc32(r.encode(), before) for r in runs]
                for i, h in enumerate(marks):
                    if h % DROP_ONE_IN == 0:
                        r = runs[i]
                        at = h % len(r)
                        runs[i] = r[:at] + r[at + 1:]
                held.update(runs)
                if len(held) > KEPT:
                    yield hand_on()
        yield hand_on()
    rows = bounded_batches(docs, 1024).select(F.col(key).cast("string"), F.col(text).cast("string").alias("text"))
    found = rows.where("text IS NOT NULL").mapInArrow(count, "word string, n long")
    n = (found.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))
         .where(F.col("n") >= least_count))
    return to_scratch(n, "spelling-words")


# ---------------------------------------------------------------- frames

def _windows(m: int) -> list[tuple[int, int]]:
    width = WINDOW if m <= LONG else -(-m // WINDOWS)
    return [(a, min(a + width, m)) for a in range(0, m, width)]


def _points(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(words, f"<U{length}").view("<u4").reshape(len(words), length)


def _hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first k and of the last k code points of each word, k from 0."""
    n, length = points.shape
    out = []
    for p, factor in ((points, 0x9E3779B97F4A7C15), (points[:, ::-1], 0xC2B2AE3D27D4EB4F)):
        h = np.empty((length + 1, n), np.uint64)
        h[0] = factor
        for k in range(length):
            h[k + 1] = (h[k] ^ (h[k] >> np.uint64(29))) * np.uint64(factor) + p[:, k] + np.uint64(1)
        out.append(h)
    return out[0], out[1]


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    h = np.uint64(0)
    for p in parts:
        h = (h ^ (p if isinstance(p, np.ndarray) else np.uint64(p))) * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


_FRAME = "frame long, m int, first int, behind int, word string, n long"


def _frame_rows(words: pa.Array, n: pa.Array, windows) -> Iterator[pa.RecordBatch]:
    """Rows of the frames of ``words``; ``windows(length)``: lists of
    (row numbers or None for all, m, first, behind) for words of one length."""
    names = ["frame", "m", "first", "behind", "word", "n"]
    text = words.to_pylist()
    lengths = np.array([len(w) for w in text], np.int64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        step = max(1, 4_000_000 // (int(length) + 1))
        for lo in range(0, len(at), step):
            some = at[lo:lo + step]
            front, back = _hashes(_points([text[i] for i in some], int(length)))
            for pick, m, first, behind in windows(int(length), some):
                rows = np.arange(len(some)) if pick is None else pick
                key = _mix(front[first][rows], back[m - behind][rows], m, first, behind)
                idx = pa.array(some[rows])
                k = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), *(pa.array(np.full(k, x, np.int32)) for x in (m, first, behind)),
                     words.take(idx), n.take(idx)], names=names)


def _merged(parts: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows``."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += p.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _frames(words: DataFrame) -> DataFrame:
    def all_windows(length: int, some: np.ndarray):
        return [(None, m, a, b) for m in (length, length + 1) for a, b in _windows(m)]

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merged(x for b in batches for x in _frame_rows(b.column(0), b.column(1), all_windows))
    return words.select("word", "n").mapInArrow(frame, _FRAME)


def _taken_apart(rows: DataFrame) -> DataFrame:
    """Rows of wide frames, framed anew by windows of two inside theirs."""
    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for b in batches:
                m, first, behind = (b.column(i).to_numpy() for i in (1, 2, 3))

                def inner(length: int, some: np.ndarray):
                    for x in {(int(m[i]), int(first[i]), int(behind[i])) for i in some}:
                        pick = np.flatnonzero((m[some] == x[0]) & (first[some] == x[1]))
                        for a in range(x[1], x[2], WINDOW):
                            yield pick, x[0], a, min(a + WINDOW, x[2])
                yield from _frame_rows(b.column(4), b.column(5), inner)
        yield from _merged(parts())
    return rows.select("frame", "m", "first", "behind", "word", "n").mapInArrow(frame, _FRAME)


# ---------------------------------------------------------------- tiles

def _sides(size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of a frame of ``size`` words, a tile of blocks at a time."""
    blocks = [np.arange(a, min(a + BLOCK, size)) for a in range(0, size, BLOCK)]
    for x, a in enumerate(blocks):
        i, j = np.triu_indices(len(a), 1)
        if len(i):
            yield a[i], a[j]
        for b in blocks[x + 1:]:
            yield np.repeat(a, len(b)), np.tile(b, len(a))


def _differ(points: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows i and j (which are never equal)."""
    return (points[i] != points[j]).argmax(axis=1)


def near_in_frames(words: list[str], frame: np.ndarray, m: np.ndarray, first: np.ndarray,
                   behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the near pairs inside each frame; rows of a frame
    lie in a row.  A pair is told in the one frame whose window holds the end
    of its common prefix."""
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.flatnonzero(np.concatenate([[True], frame[1:] != frame[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(frame)]]))
    out_i, out_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    # frames of one size are compared together; those of long words by themselves
    tall = lengths[starts] > 2 * LONG
    for size in np.unique(sizes[sizes > 1]):
        m0 = starts[(sizes == size) & ~tall]
        jobs = [m0] if len(m0) else []
        jobs += [np.array([s]) for s in starts[(sizes == size) & tall]]
        for heads in jobs:
            width = int(max(lengths[h:h + size].max() for h in heads)) if len(heads) == 1 else 2 * LONG + 1
            for a, b in _sides(int(size)):
                per = max(1, PAIRS * 16 // (len(a) * width))
                for lo in range(0, len(heads), per):
                    some = heads[lo:lo + per]
                    span = max(1, PAIRS * 16 // width)
                    for c in range(0, len(a), span) if per == 1 else (0,):
                        pa_, pb_ = (a[c:c + span], b[c:c + span]) if per == 1 else (a, b)
                        i, j = (some[:, None] + pa_).ravel(), (some[:, None] + pb_).ravel()
                        fit = np.maximum(lengths[i], lengths[j]) == m[i]
                        i, j = i[fit], j[fit]
                        if not len(i):
                            continue
                        rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                        x, y = at[:len(i)], at[len(i):]
                        wide = int(lengths[rows].max())
                        text = [words[r] for r in rows]
                        p = _differ(_points(text, wide), x, y)
                        s = _differ(_points([w[::-1] for w in text], wide), x, y)
                        near = (p + s >= m[i] - 1) & (p >= first[i]) & (p < behind[i]) & (frame[i] == frame[j])
                        out_i.append(i[near])
                        out_j.append(j[near])
    return np.concatenate(out_i), np.concatenate(out_j)


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of frames -> word, n_near and its best near word, a row for
    each frame in which the word has any."""
    names = ["word", "n_near", "near_n", "near"]

    def solve(t: pa.Table) -> pa.RecordBatch:
        words = t.column("word").to_pylist()
        n = t.column("n").to_numpy()
        cols = [t.column(c).to_numpy() for c in ("frame", "m", "first", "behind")]
        i, j = near_in_frames(words, *cols)
        src, dst = np.concatenate([i, j]), np.concatenate([j, i])
        order = sorted(set(dst.tolist()), key=lambda r: (-n[r], words[r]))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(order))
        best = np.full(len(words), len(words), np.int64)
        np.minimum.at(best, src, rank[dst])
        count = np.bincount(src, minlength=len(words))
        has = np.flatnonzero(count)
        near = [order[b] for b in best[has]]
        return pa.RecordBatch.from_arrays(
            [pa.array([words[r] for r in has], pa.string()), pa.array(count[has].astype(np.int64)),
             pa.array(n[near].astype(np.int64)), pa.array([words[r] for r in near], pa.string())], names=names)
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < ROWS:
            continue
        t = pa.Table.from_batches(held)
        frame = t.column("frame").to_numpy()
        cut = int(np.searchsorted(frame, frame[-1]))    # the last frame may go on
        if cut:
            yield solve(t.slice(0, cut))
        held = t.slice(cut).combine_chunks().to_batches()
        rows = len(frame) - cut
    if held:
        yield solve(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near (the near word of largest n, ties: smallest in
    code-point order), near_n, for the words of ``words`` (word, n; distinct
    words) that have any.  All near pairs count; none is emitted."""
    size = F.length("word")
    short = _frames(words.where(size < LONG))
    wide = to_scratch(_frames(words.where(size >= LONG)), "spelling-long")
    hot = wide.where(F.col("m") > LONG).groupBy("frame").agg(F.count("*").alias("_c")).where(F.col("_c") > HOT)
    hot = to_scratch(hot.select("frame"), "spelling-hot")
    if not hot.isEmpty():
        wide = wide.join(hot, "frame", "left_anti").unionByName(
            _taken_apart(wide.join(hot, "frame", "left_semi")))
    frames = short.unionByName(wide).repartition("frame").sortWithinPartitions("frame")
    found = frames.mapInArrow(_tile, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    g = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b"))
    return g.select("word", "n_near", F.col("_b.word").alias("near"), (-F.col("_b.n")).alias("near_n"))


# ---------------------------------------------------------------- groups

def roots(forms: DataFrame, max_n: int, ratio: int = 10) -> DataFrame:
    """word, root for rows word, form: forms followed to the last one.  Each
    step multiplies n by ``ratio`` at least, so a chain has at most the digits
    of the largest n as steps, and each round doubles what is behind a word."""
    steps, reach = 0, 2
    while reach * ratio <= max_n:
        steps, reach = steps + 1, reach * ratio
    edges = to_scratch(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    done = 1
    while done < steps:
        nxt = edges.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        edges = to_scratch(edges.join(nxt, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root")), "spelling-roots")
        done *= 2
    return edges


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 7,
                   least_count: int = 2, ratio: int = 10) -> DataFrame:
    """One row for each word of all texts: word, n, n_near, form (its best near
    word if that occurs ``ratio`` times as often, else null), form_n, root.

    Null and empty texts hold no word; repeated rows count each; an empty table
    gives no rows; other columns are ignored whatever their names.  Words of
    any length take part whole.  Ties of n go to the smaller word.
    """
    words = word_counts(docs, key, text, least_length, least_count)
    max_n = words.agg(F.max("n")).first()[0] or 0
    has = F.col("near_n") >= F.col("n") * F.lit(ratio)
    out = to_scratch(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "spelling-forms")
    ends = roots(out.where("form IS NOT NULL"), max_n, ratio)
    return out.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
