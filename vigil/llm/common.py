"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.session import scratch_path


def to_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared scratch folder and return the written table.

    Cuts the lineage: later jobs read files, so they neither repeat the work
    nor depend on shuffle files of an executor that may be lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame, rows: int = 256) -> DataFrame:
    """``df``; sets the rows that Spark hands to Python at once to at most
    ``rows``, since texts are long and workers of several tasks share an
    executor's memory."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name, "10000")) > rows:
        conf.set(name, str(rows))
    return df


def text_or_empty(text: str) -> Column:
    """The text column, null as the empty string."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def id_crc32(key: str) -> Column:
    """crc32 of an id written as text (null: of the empty string)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))


def unit_hash(*cols: Column | str, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on the values alone."""
    h = F.xxhash64(*cols, F.lit(seed))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
