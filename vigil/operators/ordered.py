"""Skew-safe ordered computations: lag, running count/sum, top-N per group.

A plain ``Window.partitionBy(project)`` sends every row of a project to one
task; with three projects and one holding a third of all rows that task owns
a third of the data set.  These helpers split each key's timeline into
*slices* (global quantiles of the ordering column, so every slice of every
key is a bounded piece of the data), run the window inside
``(key, slice)`` and stitch the slice borders through a small
``(key, slice)`` summary table (at most keys x slices rows).  Results are
identical to the unsliced window because slices are monotone in the order.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"


def default_slices(df: DataFrame) -> int:
    """Slices per timeline: a few per shuffle partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return max(8, 4 * n)


def _order_number(df: DataFrame, col: str) -> Column:
    c = F.col(col)
    t = df.schema[col].dataType.typeName()
    if t.startswith("timestamp") or t == "date":
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def add_slices(df: DataFrame, order_col: str, n_slices: int | None = None) -> DataFrame:
    """Add ``_slice`` = quantile bucket of ``order_col`` (timestamp or number).

    The boundaries come from ``approxQuantile`` (one pruned pass over a single
    column, ``n_slices`` numbers to the driver); ``Bucketizer`` assigns slices
    on the JVM with a binary search.
    """
    n = n_slices or default_slices(df)
    tmp = "_slice_key"
    keyed = df.withColumn(tmp, _order_number(df, order_col))
    probs = [i / n for i in range(1, n)]
    # the allowed rank error shrinks with the slices, so that more slices stay distinct
    qs = keyed.approxQuantile(tmp, probs, min(0.001, 0.25 / n)) if n > 1 else []
    splits = sorted({float(q) for q in qs if q is not None})
    splits = [float("-inf")] + splits + [float("inf")]
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=SLICE, handleInvalid="keep")
    # null ordering values sort first in Spark: give them slice -1 (NaN keeps the last bucket)
    return b.transform(keyed).drop(tmp).withColumn(SLICE, F.coalesce(F.col(SLICE).cast("int"), F.lit(-1)))


def _sliced(df: DataFrame, order_col: str, n_slices: int | None) -> tuple[DataFrame, bool]:
    """Reuse an existing ``_slice`` column (several passes over one ordering
    share one quantile job) or add one."""
    if SLICE in df.columns:
        return df, False
    return add_slices(df, order_col, n_slices), True


def sliced_lag(df: DataFrame, keys: list[str], order: list[str], cols: list[str],
               prefix: str = "prev_", n_slices: int | None = None) -> DataFrame:
    """``lag(c, 1) over (partition by keys order by order)`` for each c in cols.

    ``order[0]`` must be the time column used for slicing.
    """
    d, added = _sliced(df, order[0], n_slices)
    part = keys + [SLICE]
    w = Window.partitionBy(*part).orderBy(*order)
    d = d.withColumn("_rn", F.row_number().over(w))
    for c in cols:
        d = d.withColumn(prefix + c, F.lag(c).over(w))
    # last row of each (key, slice), then the previous non-empty slice's last row
    tails = (d.groupBy(*part)
             .agg(F.max_by(F.struct(*[F.col(c).alias(c) for c in cols]),
                           F.struct(*order)).alias("_tail")))
    tails = tails.withColumn(
        "_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy(SLICE))
    ).select(*part, "_carry")
    d = d.join(tails, on=part, how="left")
    for c in cols:
        d = d.withColumn(prefix + c, F.when(F.col("_rn") == 1, F.col("_carry")[c])
                         .otherwise(F.col(prefix + c)))
    d = d.drop("_rn", "_carry")
    return d.drop(SLICE) if added else d


def sliced_running_sum(df: DataFrame, keys: list[str], order: list[str], out: str,
                       value: Column | None = None, n_slices: int | None = None) -> DataFrame:
    """Running ``sum(value)`` (``count(*)`` when value is None) ordered by
    ``order`` within ``keys``, rows unbounded preceding."""
    d, added = _sliced(df, order[0], n_slices)
    part = keys + [SLICE]
    v = F.lit(1).cast("long") if value is None else value
    d = d.withColumn("_v", v)
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_local", F.sum("_v").over(w))
    totals = d.groupBy(*part).agg(F.sum("_v").alias("_tot"))
    totals = totals.withColumn(
        "_offset",
        F.coalesce(F.sum("_tot").over(Window.partitionBy(*keys).orderBy(SLICE)
                                      .rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0).cast(totals.schema["_tot"].dataType)),
    ).select(*part, "_offset")
    d = d.join(totals, on=part, how="left")
    d = d.withColumn(out, F.col("_local") + F.col("_offset")).drop("_v", "_local", "_offset")
    return d.drop(SLICE) if added else d


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int,
          salt_col: str | None = None, salts: int = 16, rank_col: str | None = None) -> DataFrame:
    """Exact top-``n`` rows per key by ``order`` (ties broken by the order list).

    Two phases so a hot key never lands in one task: top-n inside
    ``(key, hash(salt_col) % salts)``, then top-n of the at most
    ``n * salts`` survivors per key.
    """
    if not keys:
        # global top-n: Spark plans TakeOrderedAndProject (partial top-n per task)
        r = df.orderBy(*order).limit(n)
        if rank_col:
            r = r.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
        return r
    d = df
    if salt_col is not None:
        d = d.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salts)))
        w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
        d = d.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n).drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    rc = rank_col or "_r2"
    d = d.withColumn(rc, F.row_number().over(w2)).filter(F.col(rc) <= n)
    return d if rank_col else d.drop(rc)


def sliced_last_value(df: DataFrame, keys: list[str], order: list[str], cols: list[str],
                      prefix: str = "last_", n_slices: int | None = None) -> DataFrame:
    """``last(c, ignorenulls) over (partition by keys order by order rows
    unbounded preceding .. current row)`` for each c (the as-of carry)."""
    d, added = _sliced(df, order[0], n_slices)
    part = keys + [SLICE]
    w = (Window.partitionBy(*part).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0))
    for c in cols:
        d = d.withColumn(prefix + c, F.last(c, ignorenulls=True).over(w))
    # last non-null value of each column per (key, slice), carried to later slices
    agg = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias("_t_" + c)
           for c in cols]
    tails = d.groupBy(*part).agg(*agg)
    ws = (Window.partitionBy(*keys).orderBy(SLICE)
          .rowsBetween(Window.unboundedPreceding, -1))
    for c in cols:
        tails = tails.withColumn("_carry_" + c, F.last("_t_" + c, ignorenulls=True).over(ws))
    tails = tails.select(*part, *["_carry_" + c for c in cols])
    d = d.join(tails, on=part, how="left")
    for c in cols:
        d = d.withColumn(prefix + c, F.coalesce(F.col(prefix + c), F.col("_carry_" + c)))
    d = d.drop(*["_carry_" + c for c in cols])
    return d.drop(SLICE) if added else d


def exact_rank_values(df: DataFrame, keys: list[str], value: str,
                      quantiles: dict[str, float]) -> DataFrame:
    """Per key: ``n`` and, for each name -> q, the value at 1-based rank
    ``min(floor(n*q) + 1, n)`` of the ascending values (``sorted[floor(n*q)]``).

    Distributed: values are first collapsed to ``(key, value, count)`` with a
    map-side combine, then a sliced running count locates each rank, so no
    group is ever sorted in one task.
    """
    cnt = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    tot = cnt.groupBy(*keys).agg(F.sum("_c").alias("n"))
    cum = sliced_running_sum(cnt, keys, [value], "_cum", value=F.col("_c"))
    if keys:
        cum = cum.join(tot, on=keys, how="inner")
    else:   # one-row total on a constant key
        cum = cum.withColumn("_k", F.lit(1)).join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k").drop("_k")
    aggs = [F.first(F.col("n")).alias("n")]
    for name, q in quantiles.items():
        r = F.least(F.floor(F.col("n") * F.lit(q)) + 1, F.col("n"))
        hit = (F.col("_cum") >= r) & (F.col("_cum") - F.col("_c") < r)
        aggs.append(F.max(F.when(hit, F.col(value))).alias(name))
    return cum.groupBy(*keys).agg(*aggs)


def sliced_rolling_mean(df: DataFrame, keys: list[str], order: list[str], col: str, n: int, out: str,
                        n_slices: int | None = None) -> DataFrame:
    """``avg(col) over (partition by keys order by order rows between n
    preceding and 1 preceding)`` without a key in one task: the local frame
    is completed with the last ``n`` values of the preceding slices, carried
    through a small (key, slice) table of at most ``n`` values per slice."""
    d, added = _sliced(df, order[0], n_slices)
    part = keys + [SLICE]
    w = Window.partitionBy(*part).orderBy(*order)
    d = (d.withColumn("_p", F.row_number().over(w))
         .withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy(*part)))
         .withColumn("_ls", F.sum(col).over(w.rowsBetween(-n, -1)))
         .withColumn("_lc", F.count(col).over(w.rowsBetween(-n, -1))))
    tails = (d.filter(F.col("_p") > F.col("_cnt") - n)
             .groupBy(*part).agg(F.array_sort(F.collect_list(F.struct(F.col("_p"), F.col(col).alias("v"))))
                                 .alias("_t")))
    tails = tails.withColumn("_t", F.transform("_t", lambda x: x["v"]))
    ws = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(SLICE), F.col("_t"))).over(ws)),
                                 lambda x: x["_t"]))
    tails = tails.withColumn("_carry", F.slice(prev, F.greatest(F.size(prev) - n + 1, F.lit(1)), n)) \
        .select(*part, "_carry")
    d = d.join(tails, part, "left")
    m = F.greatest(F.lit(n) - (F.col("_p") - 1), F.lit(0))
    cpart = F.when(m > 0, F.slice(F.coalesce("_carry", F.array().cast("array<double>")),
                                  F.greatest(F.size(F.coalesce("_carry", F.array())) - m + 1, F.lit(1)),
                                  F.greatest(m, F.lit(1)))).otherwise(F.array().cast("array<double>"))
    csum = F.aggregate(cpart, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    ccnt = F.aggregate(cpart, F.lit(0), lambda a, x: a + F.when(x.isNull(), 0).otherwise(1))
    total = F.coalesce(F.col("_ls").cast("double"), F.lit(0.0)) + csum
    count = F.col("_lc") + ccnt
    d = d.withColumn(out, F.when(count > 0, total / count))
    d = d.drop("_p", "_cnt", "_ls", "_lc", "_carry")
    return d.drop(SLICE) if added else d


def sliced_prev(df: DataFrame, keys: list[str], order: list[str], lag_cols: list[str],
                last_cols: list[str], prefix: str = "_p", n_slices: int | None = None) -> DataFrame:
    """One sliced pass giving, per row, the previous row's ``lag_cols`` and
    the last non-null value of each of ``last_cols`` strictly before the
    row (``lag`` and ``last(ignorenulls) rows unbounded preceding .. 1
    preceding``), with one summary table for the slice borders."""
    d, added = _sliced(df, order[0], n_slices)
    part = keys + [SLICE]
    w = Window.partitionBy(*part).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_rn", F.row_number().over(w))
    for c in lag_cols:
        d = d.withColumn(prefix + c, F.lag(c).over(w))
    for c in last_cols:
        d = d.withColumn(prefix + c, F.last(c, ignorenulls=True).over(before))
    aggs = [F.max_by(F.struct(*[F.col(c).alias(c) for c in lag_cols]), F.struct(*order)).alias("_tail")]
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias("_tl_" + c)
             for c in last_cols]
    tails = d.groupBy(*part).agg(*aggs)
    ws = Window.partitionBy(*keys).orderBy(SLICE)
    tails = tails.withColumn("_carry", F.lag("_tail").over(ws))
    for c in last_cols:
        tails = tails.withColumn("_cl_" + c, F.last("_tl_" + c, ignorenulls=True).over(
            ws.rowsBetween(Window.unboundedPreceding, -1)))
    tails = tails.select(*part, "_carry", *["_cl_" + c for c in last_cols])
    d = d.join(tails, part, "left")
    for c in lag_cols:
        d = d.withColumn(prefix + c, F.when(F.col("_rn") == 1, F.col("_carry")[c]).otherwise(F.col(prefix + c)))
    for c in last_cols:
        d = d.withColumn(prefix + c, F.coalesce(F.col(prefix + c), F.col("_cl_" + c)))
    d = d.drop("_rn", "_carry", *["_cl_" + c for c in last_cols])
    return d.drop(SLICE) if added else d


def exact_percentiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Per key the linearly interpolated percentile (``percentile`` /
    ``quantile_cont``): h = (n - 1) q, v[floor h] + (h - floor h) x
    (v[floor h + 1] - v[floor h]) over the ascending values, computed from
    exact order statistics (``(key, value, count)`` with a map-side combine
    and a sliced running count) instead of one in-memory value map per key."""
    cnt = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    tot = cnt.groupBy(*keys).agg(F.sum("_c").alias("n"))
    cum = sliced_running_sum(cnt, keys, [value], "_cum", value=F.col("_c"))
    if keys:
        cum = cum.join(tot, on=keys, how="inner")
    else:
        cum = cum.withColumn("_k", F.lit(1)).join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k").drop("_k")
    aggs = []
    for name, q in quantiles.items():
        h = (F.col("n") - 1) * F.lit(float(q))
        lo_rank = F.floor(h) + 1                        # 1-based ranks
        hi_rank = F.least(lo_rank + 1, F.col("n"))
        at = lambda r: (F.col("_cum") >= r) & (F.col("_cum") - F.col("_c") < r)
        aggs += [F.max(F.when(at(lo_rank), F.col(value))).alias(f"_{name}_lo"),
                 F.max(F.when(at(hi_rank), F.col(value))).alias(f"_{name}_hi"),
                 F.first(h - F.floor(h)).alias(f"_{name}_f")]
    g = cum.groupBy(*keys).agg(*aggs)
    for name in quantiles:
        lo, hi, fr = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_f")
        g = g.withColumn(name, lo + fr * (hi - lo)).drop(f"_{name}_lo", f"_{name}_hi", f"_{name}_f")
    return g
