"""Best-fit packing of documents into sequences by bin completion.

Tokenising and numbering run on Spark.  The search itself needs only how many
pieces there are of each length: at most ``capacity`` counts, whatever the
size of the corpus.  Its answer is a list of fillings with the number of
sequences that get each; pieces find their sequence and offset from their rank
among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, to_scratch
from vigil.llm.tokens import word_ids

# ---------------------------------------------------------------- search

Filling = tuple[int, ...]
Plan = list[tuple[Filling, int]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, bins of the same filling taken together."""
    open_bins: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: Filling, n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_bins[room].append((filling, n))
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_right(rooms, size - 1)
            if at < len(rooms):
                room = rooms[at]
                filling, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, filling, n = capacity, (), left
            each = min(room // size, left)
            used = min(n, left // each)
            if n > used and filling:
                put(room, filling, n - used)
            put(room - each * size, filling + (size,) * each, used)
            left -= each * used
    return [x for per in open_bins.values() for x in per]


def fillings(lengths: list[int], counts: dict[int, int], room: int, width: int) -> list[Filling]:
    """Up to ``width`` undominated ways to fill ``room``, fullest first, large
    pieces before small ones.  A filling is left out when another one has, in
    place of some of its pieces, a piece at least as long as those together:
    so a single piece that fits exactly stands alone, and the last piece of a
    filling is always the longest that fits."""
    found: list[Filling] = []

    def grow(room: int, top: int, chosen: Filling) -> bool:
        at = bisect_right(lengths, min(room, top))
        tried = 0
        any_fits = False
        while at and tried < width and len(found) < 4 * width:
            at -= 1
            size = lengths[at]
            if counts[size] <= chosen.count(size):
                continue
            any_fits = True
            tried += 1
            if size == room:
                found.append(chosen + (size,))
                return True
            grow(room - size, size, chosen + (size,))
        if not any_fits:
            found.append(chosen)
        return any_fits
    grow(room, room, ())
    out: list[Filling] = []
    for f in sorted(set(found), key=lambda f: (-sum(f), [-x for x in f])):
        if not any(_dominates(g, f) for g in out):
            out.append(f)
    return out[:width]


def _dominates(a: Filling, b: Filling) -> bool:
    """Can the pieces of b be laid into the pieces of a?"""
    rooms = sorted(a)
    for x in b:
        fit = next((i for i, r in enumerate(rooms) if r >= x), None)
        if fit is None:
            return False
        rooms[fit] -= x
        rooms.sort()
    return True


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: by total length, and, for every t up to half
    the capacity, by pieces over capacity - t (alone), over half (one each),
    and the length between t and half that these leave no room for."""
    sizes = np.arange(capacity + 1)
    n = np.zeros(capacity + 1, dtype=object)
    for k, v in counts.items():
        n[k] += v
    total = sizes * n
    best = -(-int(total.sum()) // capacity)
    half = capacity // 2
    for t in [x for x in counts if x <= half] + [0]:
        big = int(n[capacity - t + 1:].sum())
        mid = int(n[half + 1:capacity - t + 1].sum())
        room = mid * capacity - int(total[half + 1:capacity - t + 1].sum())
        rest = int(total[t:half + 1].sum()) - room
        best = max(best, big + mid + max(0, -(-rest // capacity)))
    return best


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 5000,
                   width: int = 4) -> Plan:
    """Fillings and how many sequences get each, as few sequences as found.

    Depth-first: the longest piece left gets each undominated filling in turn,
    fullest first, for as many sequences at a time as the pieces allow.  A
    branch is cut when its waste exceeds what a solution better than the
    incumbent may waste.  The first incumbent is best-fit decreasing; the
    search ends when the lower bound is met or after ``nodes`` nodes, and
    returns the incumbent.  ``width`` bounds the fillings tried for a piece.
    """
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return []
    total = sum(k * v for k, v in counts.items())
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    left, plan, waste = dict(counts), [], 0

    def move(whole: Filling, n: int) -> None:
        """Take n fillings from what is left (put them back if negative)."""
        nonlocal waste
        for size, each in Counter(whole).items():
            now = left.get(size, 0) - n * each
            if now:
                left[size] = now
            else:
                del left[size]
        waste += n * (capacity - sum(whole))

    def options() -> Iterator[Filling]:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        lengths = sorted(k for k, v in rest.items() if v)
        return iter([(longest, *f) for f in fillings(lengths, rest, capacity - longest, width)])
    # the path from the root: its options still open at each depth, its moves in plan
    path = [options()]
    while path and nodes and best_n > least:
        whole = next(path[-1], None)
        if whole is None:
            path.pop()
            if plan:
                done, n = plan.pop()
                move(done, -n)
            continue
        nodes -= 1
        n = min(left[k] // v for k, v in Counter(whole).items())
        move(whole, n)
        plan.append((whole, n))
        if not left and sum(n for _, n in plan) < best_n:
            best, best_n = list(plan), sum(n for _, n in plan)
        if not left or waste > (best_n - 1) * capacity - total:
            done, n = plan.pop()
            move(done, -n)
        else:
            path.append(options())
    return best


# ---------------------------------------------------------------- tokens

def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                 capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Written table of pieces: key, piece (from 0), start, length, ids_crc32,
    and ids (binary, little-endian 32-bit) if asked for.  A document is its
    ids and then ``end_id``; only documents longer than ``capacity`` are cut.
    Null text: empty."""
    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, encoder = np.array([end_id], "<u4").tobytes(), word_ids(tokenizer)
        for p in parts:
            rows = []
            for k, ids in zip(p["key"], encoder.encode(p["text"].tolist())):
                ids += tail
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((k, n, at // 4, len(part) // 4, zlib.crc32(part),
                                 part if with_ids else None))
            yield pd.DataFrame(rows, columns=["key", "piece", "start", "length", "ids_crc32", "ids"])
    kind = dict(docs.dtypes)[key]
    out = bounded_batches(docs).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInPandas(
        cut, f"key {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return to_scratch(out if with_ids else out.drop("ids"), "pieces")


# ---------------------------------------------------------------- assignment

def _slots(plan: Plan) -> dict[str, np.ndarray]:
    """For each filling and length in it: the ranks it takes among the pieces
    of that length, its first sequence, copies in a sequence, first offset."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for filling, n in plan:
        offset = 0
        for size, copies in sorted(Counter(filling).items(), reverse=True):
            rows.append((size, taken[size], sequence, copies, offset))
            taken[size] += n * copies
            offset += size * copies
        sequence += n
    rows.sort()
    names = ("length", "first", "sequence", "copies", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
         capacity: int = 4096, end_id: int = 1, with_ids: bool = False,
         nodes: int = 5000) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, (ids,)
    sequence_id, offset (gapless from 0 in each sequence).

    Empty and null texts are documents of the end id alone.  Repeated rows are
    packed each.  Keys may be null.  Extra columns are ignored; an empty table
    gives no rows.  Numbering among pieces of one length is done in hashed
    parts, so a length that a third of the documents share is no single task.
    """
    pieces = token_pieces(docs, tokenizer, key, text, capacity, end_id, with_ids)
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    slots = _slots(bin_completion(counts, capacity, nodes))
    n_parts = 64 + sum(counts.values()) // 1_000_000
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(n_parts)))
    tally = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tally.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    order = Window.partitionBy("length", "_part").orderBy("key", "piece", "ids_crc32")
    ranked = (dealt.withColumn("_i", F.row_number().over(order))
              .join(starts, ["length", "_part"])
              .withColumn("_rank", F.col("_n0") + F.col("_i") - 1))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths, firsts = slots["length"], slots["first"]
        for p in parts:
            size, rank = p["length"].to_numpy(), p["_rank"].to_numpy()
            at = np.empty(len(p), np.int64)
            for s in np.unique(size):
                lo, hi = np.searchsorted(lengths, [s, s + 1])
                m = size == s
                at[m] = lo + np.searchsorted(firsts[lo:hi], rank[m], "right") - 1
            gone = rank - firsts[at]
            p["sequence_id"] = slots["sequence"][at] + gone // slots["copies"][at]
            p["offset"] = slots["offset"][at] + gone % slots["copies"][at] * size
            yield p.drop(columns="_rank")
    fields = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return (ranked.select(*pieces.columns, "_rank")
            .mapInPandas(place, f"{fields}, sequence_id long, offset long")
            .withColumnRenamed("key", key))
