"""Warehouse tables: append / partitioned writes, latest-wins (replacing)
reads, upserts, counts, top-k reports and history windows (S12-S14, S19,
A13, A14, A15, U6, F8, T-K1, T-K5, T-K6, W6-W8, W11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.scalar import genres_split
from vigil.operators.ordered import top_n

# --- fixed values (must equal the reference's rules) ---------------------
TOP_ARTICLES = 500
LATEST_EVENTS = 20
TOP_ENGAGED = 10
RECENT_GREETINGS = 10
CHAT_HISTORY = 50
MESSAGES_MAX = 200
ALERT_HISTORY_LIMIT, ALERT_HISTORY_CAP, SCORE_HISTORY_CAP = 50, 100, 50
DEPLOYMENTS_LIMIT = 50
# --------------------------------------------------------------------------


def latest_wins(df: DataFrame, keys: list[str], version: str | list[str]) -> DataFrame:
    """The row with the highest version per key (a replacing table read
    with FINAL semantics).  ``max_by`` over a struct is a partial aggregate:
    each task keeps one row per key before the shuffle, so a hot key costs
    one row per task, not its whole history."""
    vers = [version] if isinstance(version, str) else list(version)
    other = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(v) for v in vers])
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in other]), order).alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in other])


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str,
           stamp_resolved: str | None = None) -> DataFrame:
    """Partial update by key: for every field the value of the newest
    row (current state first, then the change log by ``version``) that sets
    it wins, i.e. ``coalesce(new, old)`` per field.  With ``stamp_resolved``
    the resolved time is set once, from the first change that resolves.

    One partial/final aggregate over the union (no join): each field is a
    ``max_by(field, version)`` restricted to rows where the field is set.
    """
    cols = [c for c in current.columns if c not in keys and c != version]
    cur = current if version in current.columns else current.withColumn(version, F.lit(None))
    u = cur.withColumn("_src", F.lit(0)).unionByName(changes.withColumn("_src", F.lit(1)),
                                                     allowMissingColumns=True)
    order = F.struct(F.col("_src"), F.col(version))
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols]
    aggs.append(F.max(version).alias(version))
    if stamp_resolved:
        aggs.append(F.min(F.when((F.col("_src") == 1) & (F.col("status") == "resolved"),
                                 F.col(version))).alias("_first_resolved"))
    d = u.groupBy(*keys).agg(*aggs)
    if stamp_resolved:
        d = d.withColumn(stamp_resolved, F.coalesce(F.col(stamp_resolved), F.when(
            F.col("status") == "resolved", F.col("_first_resolved")))).drop("_first_resolved")
    return d


def write_append(df: DataFrame, path: str, sort: list[str], partition_by: list[str] | None = None,
                 fmt: str = "parquet") -> None:
    """Append, optionally partitioned, rows sorted within
    files by the table's order key (min/max statistics prune later scans)."""
    w = df.sortWithinPartitions(*sort).write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def with_month(df: DataFrame, ts: str = "ts", out: str = "yyyymm") -> DataFrame:
    """S13 partition key: month of the event."""
    return df.withColumn(out, F.date_format(F.col(ts).cast("timestamp"), "yyyyMM").cast("int"))


def write_latest_wins_log(df: DataFrame, path: str, keys: list[str], version: str) -> None:
    """A replacing table is an append-only change log; readers apply
    ``latest_wins``."""
    write_append(df, path, keys + [version])


def recs_for_user(recs: DataFrame, k: int, keys: list[str] = ["user_id", "item_id"],
                  version: str = "timestamp", score: str = "score") -> DataFrame:
    """F8: latest-wins recommendation rows, top ``k`` per user by score,
    genres string -> array."""
    lw = latest_wins(recs, keys, version)
    top = top_n(lw, ["user_id"], [F.col(score).desc(), F.col("item_id")], k, salt_col="item_id", rank_col="rank")
    return top.withColumn("genres", genres_split(F.col("genres"))) if "genres" in recs.columns else top


def newest(df: DataFrame, order: list[Column], n: int, keys: list[str] | None = None,
           tie: str | None = None) -> DataFrame:
    """T-K1 / T-K6 / W6 / W8: newest ``n`` rows (per key)."""
    return top_n(df, keys or [], order, n, salt_col=tie)


def top_engaged(events: DataFrame, k: int = TOP_ENGAGED) -> DataFrame:
    """view_complete events per item: count and summed value, top k."""
    g = (events.filter(F.col("event_type") == "view_complete")
         .groupBy("item_id").agg(F.count(F.lit(1)).alias("completions"), F.sum("value").alias("total_value")))
    return top_n(g, [], [F.col("completions").desc(), F.col("total_value").desc(), F.col("item_id")], k)


def recent_messages(chat: DataFrame, n: int, keys: list[str] = ["conv_id"], order: str = "turn") -> DataFrame:
    """Latest ``n`` (1..200) messages per conversation, returned
    oldest -> newest."""
    n = max(1, min(int(n), MESSAGES_MAX))
    return top_n(chat, keys, [F.col(order).desc()], n, salt_col=order).orderBy(*keys, order)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables in one job (union of partial
    counts)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def storage_info(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Bytes, file count and oldest / newest timestamp of a file table
    (file metadata from the hidden ``_metadata`` column)."""
    m = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"), F.col(ts))
    files = m.groupBy("f").agg(F.first("s").alias("s"), F.min(ts).alias("o"), F.max(ts).alias("n"))
    return files.agg(F.sum("s").alias("bytes"), F.count(F.lit(1)).alias("files"),
                     F.min("o").alias("oldest"), F.max("n").alias("newest"))


def greetings_by_name(greetings: DataFrame, name: str, col: str = "name") -> DataFrame:
    """case-insensitive name equality (pushed to the scan as a filter on
    ``lower(name)``)."""
    return greetings.filter(F.lower(F.col(col)) == name.lower())
