"""Approximate nearest neighbours by cross-polytope hashing.

Fast Hadamard pseudo-rotations (random signs, Hadamard transform, three times)
turn each unit vector; its hash in a table is the signed axis nearest to the
turned vector.  A query probes several nearest axes in every table, all
vectors found are candidates, and candidates are ranked exactly on the
original vectors.

The index (vector, one hash per table) is a written table.  Queries come in
bounded blocks, each a pass over the index in which every task keeps the best
k of its own rows, so a crowded axis only makes a task's batch dense: no group
is gathered anywhere and no pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import to_scratch

#: candidate pairs ranked at a time
PAIRS = 1 << 18


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (a power of two long), orthonormal."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(-1, n)
        step *= 2
    return x / np.sqrt(n)


def rotations(units: np.ndarray, tables: int, seed: int) -> Iterator[np.ndarray]:
    """The pseudo-rotated unit vectors, table by table."""
    width = 1 << max(0, units.shape[1] - 1).bit_length()
    wide = np.zeros((len(units), width))
    wide[:, :units.shape[1]] = units
    rng = np.random.default_rng(seed)
    for _ in range(tables):
        y = wide
        for _ in range(3):
            y = hadamard(y * rng.choice([-1.0, 1.0], width))
        yield y


def axis_hashes(vectors: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """The nearest signed axis (2 * axis + (1 if negative)) in every table."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.empty((len(units), tables), np.int16 if units.shape[1] < 8192 else np.int32)
    for t, y in enumerate(rotations(units, tables, seed)):
        axis = np.abs(y).argmax(1)
        out[:, t] = 2 * axis + (y[np.arange(len(y)), axis] < 0)
    return out


def probe_tables(queries: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """(tables, axes, queries) booleans: does the query probe that signed axis?"""
    units = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    out = []
    for y in rotations(units, tables, seed):
        both = np.stack([y, -y], 2).reshape(len(y), -1)  # order of axis_hashes
        top = np.argpartition(-both, min(probes, both.shape[1]) - 1, axis=1)[:, :probes]
        hit = np.zeros((both.shape[1], len(y)), bool)
        hit[top, np.arange(len(y))[:, None]] = True
        out.append(hit)
    return np.stack(out)


def usable(vec: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x)
                   | (F.abs(x) == F.lit(float("inf"))))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def build_index(df: DataFrame, key: str, vec: str, tables: int, seed: int) -> DataFrame:
    """Written table (vec_id, v, hashes) of all usable vectors."""
    rows = df.where(usable(F.col(vec)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v"))

    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            sizes = p["v"].map(len)
            for _, q in p.groupby(sizes, sort=False):
                h = axis_hashes(np.stack(q["v"].to_list()), tables, seed)
                yield q.assign(hashes=list(h.astype(np.int32)))
    return to_scratch(rows.mapInPandas(
        hashed, "vec_id long, v array<double>, hashes array<int>"), "ann-index")


def _best(query: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest rows of each query, ties to smaller ids."""
    order = np.lexsort((ids, dist, query))
    q = query[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.array([], int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[rank < k]


def _search_block(index: DataFrame, block: list, k: int, tables: int, probes: int,
                  seed: int) -> DataFrame:
    """The best k candidates of each task for each query of the block."""
    q_ids = np.array([r[0] for r in block], np.int64)
    q_vec = np.array([r[1] for r in block], np.float64)
    width = q_vec.shape[1]

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hit = probe_tables(q_vec, tables, probes, seed)
        best = [np.array([], np.int64), np.array([], np.int64), np.array([])]
        for p in parts:
            p = p[p["v"].map(len) == width]
            for at in range(0, len(p), step := max(1, PAIRS // len(q_ids))):
                s = p.iloc[at:at + step]
                ids, vec = s["vec_id"].to_numpy(), np.stack(s["v"].to_list())
                codes = np.stack(s["hashes"].to_list())
                found = np.zeros((len(s), len(q_ids)), bool)
                for t in range(tables):
                    found |= hit[t][codes[:, t]]
                row, query = np.nonzero(found & (ids[:, None] != q_ids[None, :]))
                gap = vec[row] - q_vec[query]
                got = [np.concatenate(x) for x in zip(
                    best, (query, ids[row], np.sqrt((gap * gap).sum(1))))]
                keep = _best(*got, k)
                best = [x[keep] for x in got]
        yield pd.DataFrame({"query_id": q_ids[best[0]], "vec_id": best[1], "score": best[2]})
    return index.mapInPandas(search, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, queries: Column, key: str = "vec_id", vec: str = "embedding",
            k: int = 10, tables: int = 16, probes: int = 6, seed: int = 5,
            block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance, double) of
    the k nearest found for every row of ``df`` where ``queries`` holds.

    A row is not its own candidate; ties go to the smaller vec_id.  A query
    whose probes find fewer than k is searched again with every axis probed,
    so it gets k if there are k.  Rows without a key and vectors that are null,
    empty, zero or hold null or non-finite components take no part; vectors of
    another length than the query's are no candidates.  A key given to several
    rows is one vector: the first in order of components.  Extra columns are
    ignored; an empty table gives no rows.

    ``block`` bounds what the driver holds and sends: so many queries at once.
    """
    spark = df.sparkSession
    # a vector that takes no part must not hide another one of its key
    flag = df.select(F.col(key).alias("_key"), F.col(vec).alias("_vec"), queries.alias("_asked"))
    flag = flag.where(usable(F.col("_vec"))).toDF(key, vec, "_asked")
    one = flag.groupBy(key).agg(F.min(F.struct(F.col(vec).alias("v"), "_asked")).alias("r"))
    index = build_index(one.select(key, F.col("r.v").alias("v")), key, "v", tables, seed)
    asked = to_scratch(one.where("r._asked").select(F.col(key).cast("long").alias("vec_id"))
                       .join(index.select("vec_id", "v"), "vec_id")
                       .withColumn("width", F.size("v")), "ann-queries")
    per = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def blocks(rows: DataFrame) -> Iterator[list]:
        """Bounded blocks of queries of one width, in order of id."""
        for w in sorted(r[0] for r in rows.select("width").distinct().collect()):
            last = None
            while True:
                left = rows.where(F.col("width") == w)
                if last is not None:
                    left = left.where(F.col("vec_id") > last)
                got = left.orderBy("vec_id").limit(block).select("vec_id", "v").collect()
                if not got:
                    break
                yield got
                if len(got) < block:
                    break
                last = got[-1][0]

    def search(rows: DataFrame, n_probes: int) -> DataFrame:
        out = None
        for b in blocks(rows):
            found = to_scratch(_search_block(index, b, k, tables, n_probes, seed).withColumn(
                "rank", F.row_number().over(per)).where(F.col("rank") <= k), "ann-found")
            out = found if out is None else out.unionByName(found)
        return out if out is not None else spark.createDataFrame(
            [], "query_id long, vec_id long, score double, rank int")
    first = search(asked, probes)
    full = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") == k)
    short = to_scratch(asked.join(full, asked.vec_id == full.query_id, "left_anti"), "ann-short")
    rest = search(short, 1 << 30)
    return (first.join(full.select("query_id"), "query_id", "left_semi").unionByName(rest)
            .select("query_id", "rank", "vec_id", "score"))
