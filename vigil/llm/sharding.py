"""Sharding by sampled splitters, in DataFrame operations only.

Size-weighted samples of the record keys give quantile boundaries; records are
range-partitioned by them, and overfull ranges are subdivided.  Inside the
ranges running sums place each record exactly, so the shards are equal in
bytes up to one record (or one small group), whatever the sample was like.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import free_name, to_scratch, unit_hash


def splitters_of(sample: list[tuple[int, int]], n_ranges: int) -> list[int]:
    """Quantile boundaries of a weighted sample of (key, weight): a key belongs
    to the range of the last boundary that is not above it.  A key that fills
    a whole quantile by itself gets a range of its own."""
    total = sum(w for _, w in sample)
    bounds, seen, goal = [], 0, 1
    for key, w in sorted(sample):
        seen += w
        hits = 0
        while goal < n_ranges and seen * n_ranges >= goal * total:
            goal, hits = goal + 1, hits + 1
        if hits:
            bounds.append(key)
        if hits > 1:
            bounds.append(key + 1)
    top = (1 << 63) - 1
    return sorted({b for b in bounds if b <= top})


def _last_not_above(bounds: list[int], key: Column) -> Column:
    """How many of the sorted ``bounds`` are <= key, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b) for b in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    at = F.lit(0)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), at,
        lambda lo, s: F.when((lo + s <= len(bounds))
                             & (F.get(table, lo + s - 1) <= key), lo + s).otherwise(lo))


def shard_by_bytes(df: DataFrame, n_shards: int, size: str, keys: list[str],
                   ranges_per_shard: int = 16, oversample: int = 16,
                   range_bytes: int = 256 << 20) -> DataFrame:
    """``df`` with shard (0 to n_shards-1) and slot (gapless from 0 in it).

    ``size``: a column of non-negative longs (null: 0).  ``keys``: rows equal
    in these columns form a group and lie next to each other; groups below
    1/64 of a shard are never cut.  Order: hash of the keys, then hash of the
    whole row.  Rows repeated whole take neighbouring slots in any order.
    An empty table gives an empty result; existing columns named shard or slot
    are replaced.

    The sample is bounded: about n_shards * ranges_per_shard * oversample hits,
    each row hit in proportion to its size.  A range above twice the mean, or
    above ``range_bytes``, is subdivided along the keys, a range of a single
    key along the row hashes; so no task sorts more than that, whatever share
    of the rows has one key.  Only (key, size) rows are read for the plan;
    whole records move once, to their range.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    k, tie, w, fine, i, c, g, g0, n0, b0, at = (free_name(df, x) for x in (
        "_key", "_tie", "_size", "_range", "_i", "_c", "_g", "_g0", "_n0", "_b0", "_at"))
    rows = (df.withColumn(w, F.coalesce(F.col(size).cast("long"), F.lit(0)))
            .withColumn(k, F.xxhash64(*keys)).withColumn(tie, F.xxhash64(*df.columns)))
    slim = to_scratch(rows.select(k, tie, w), "shard-keys")
    n, total = slim.agg(F.count("*"), F.sum(w)).first()
    total = total or 0
    n_ranges = n_shards * ranges_per_shard
    hits = F.floor(F.col(w) * F.lit(n_ranges * oversample / max(total, 1))
                   + unit_hash(k, tie, seed=17)).cast("long")
    sample = [tuple(r) for r in slim.select(k, hits.alias("h")).where("h > 0")
              .groupBy(k).agg(F.sum("h")).collect()]
    bounds = splitters_of(sample, n_ranges)
    rng = _last_not_above(bounds, F.col(k))
    held = {r[0]: r[1] for r in slim.groupBy(rng.alias("r")).agg(F.sum(w)).collect()}
    mean = max(1, min(total // n_ranges + 1, range_bytes))
    edges = [-(1 << 63), *bounds, 1 << 63]
    parts = [max(1, math.ceil((held.get(i) or 0) / mean)) if (held.get(i) or 0) > 2 * mean else 1
             for i in range(len(edges) - 1)]
    first = [sum(parts[:i]) for i in range(len(parts))]

    def of(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), rng)
    single = of([hi - lo == 1 for lo, hi in zip(edges, edges[1:])])
    along = ((F.col(k).cast("double") - of([float(x) for x in edges[:-1]]))
             / of([float(hi - lo) for lo, hi in zip(edges, edges[1:])]))
    within = F.when(single, unit_hash(tie, seed=29)).otherwise(along)
    sub = F.least(F.floor(F.greatest(within, F.lit(0.0)) * of(parts)).cast("int"),
                  of(parts) - 1)
    placed_range = (of(first) + sub).cast("long")

    slim_totals = (slim.groupBy(placed_range.alias(fine))
                   .agg(F.count("*").alias("n"), F.sum(w).alias("b")))
    before = Window.orderBy(fine).rowsBetween(Window.unboundedPreceding, -1)
    starts = slim_totals.select(
        fine, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(n0),
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias(b0))
    dealt = rows.withColumn(fine, placed_range)
    order = Window.partitionBy(fine).orderBy(k, tie)
    group = Window.partitionBy(fine, k)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = (dealt.withColumn(i, F.row_number().over(order))
             .withColumn(c, F.sum(w).over(upto))
             .withColumn(g, F.sum(w).over(group))
             .withColumn(g0, F.min(F.col(c) - F.col(w)).over(group)))
    dealt = dealt.join(starts, fine)
    small = F.col(g) * (64 * n_shards) <= F.lit(total)
    middle = F.col(b0) + F.when(small, F.col(g0) + F.col(g) / 2).otherwise(
        F.col(c) - F.col(w) / 2)
    if total:
        shard = F.least(F.floor(middle * n_shards / total), F.lit(n_shards - 1)).cast("int")
    else:  # nothing has a size: spread the rows
        shard = F.floor((F.col(n0) + F.col(i) - 1) * n_shards / max(n, 1)).cast("int")
    dealt = to_scratch(dealt.select(
        *df.columns, shard.alias("shard"), (F.col(n0) + F.col(i) - 1).alias(at)),
        "shard-rows")
    firsts = {r[0]: r[1] for r in dealt.groupBy("shard").agg(F.min(at)).collect()}
    start = F.get(F.array(*[F.lit(int(firsts.get(i, 0))) for i in range(n_shards)]),
                  F.col("shard"))
    return dealt.select(*df.columns, "shard", (F.col(at) - start).cast("long").alias("slot"))
