"""Tables that readers use while a job rewrites parts of them.

A table is cut into parts (a hash bucket or a day).  A version writes the parts
that change into a folder of its own and then a manifest: one row a part with
the version that holds it.  The newest manifest is the table, so readers see
whole versions only, untouched parts stay in place, and a version written twice
(a replayed batch) is the same version again.  Manifests are written by Spark's
own commit, so any store that Spark writes to will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "part long, held_by long"


class VersionedTable:
    """``schema``: of the rows; ``part``: the column expression of their part,
    a long (for example ``hash_part`` or ``day_part``)."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, part: Callable[[DataFrame], Column]):
        self.spark, self.root, self.schema, self.part = spark, root.rstrip("/"), schema, part
        # version -1 holds no part, so there always is a manifest; a row without a
        # part marks that the manifest is there
        self._write_manifest(-1, {}, "ignore")

    def _write_manifest(self, version: int, held: dict[int, int], mode: str) -> None:
        rows = [(None, None), *sorted(held.items())]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode(mode).parquet(f"{self.root}/manifest/v={version}")

    def manifest(self, below: int | None = None) -> dict[int, int]:
        """part -> version that holds it, of the newest version (below ``below``)."""
        m = self.spark.read.schema(_MANIFEST + ", v long").parquet(f"{self.root}/manifest")
        if below is not None:
            m = m.where(F.col("v") < below)
        v = m.agg(F.max("v")).first()[0]
        return {r[0]: r[1] for r in m.where((F.col("v") == v) & F.col("part").isNotNull()).collect()}   # a row a part

    def _read(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/data/v={v}/_part={p}" for p, v in sorted(held.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        return self._read(self.manifest())

    def _commit(self, version: int, rows: DataFrame, touched: list[int], held: dict[int, int]) -> None:
        rows.select(*self.schema.names, "_part").repartition("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(8))) \
            .write.mode("overwrite").partitionBy("_part").parquet(f"{self.root}/data/v={version}")
        stored = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_part", T.LongType())])) \
            .parquet(f"{self.root}/data/v={version}")
        kept = {r[0] for r in stored.select("_part").distinct().collect()}
        now = {p: v for p, v in held.items() if p not in touched} | {p: version for p in touched if p in kept}
        self._write_manifest(version, now, "overwrite")

    def upsert(self, changes: DataFrame, keys: list[str], version: int, newest: list[Column] | None = None) -> list[int]:
        """Replaces the rows whose ``keys`` are in ``changes``; returns the parts
        that were rewritten.  Of several changes of a key the last by ``newest``
        holds.  Only parts with a changed key are read and written."""
        rows = changes.select(*self.schema.names)
        order = F.struct(*(newest or [F.lit(0)]), F.xxhash64(*self.schema.names))
        other = [c for c in self.schema.names if c not in keys]
        rows = changes.groupBy(*keys).agg(F.max_by(F.struct(*other), order).alias("_r")) \
            .select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in self.schema.names])
        rows = rows.withColumn("_part", self.part(rows).cast("long"))
        touched = sorted(r[0] for r in rows.select("_part").distinct().collect())      # numbers of parts
        held = self.manifest(below=version)
        old = self._read({p: held[p] for p in touched if p in held})
        kept = old.join(rows.select(*keys), keys, "left_anti")
        self._commit(version, rows.unionByName(kept.withColumn("_part", self.part(kept).cast("long"))), touched, held)
        return touched

    def delete(self, gone: Column, version: int, parts: Callable[[int], bool] = lambda p: True) -> list[int]:
        """Removes the rows for which ``gone`` holds; only parts that have such
        a row (of those that ``parts`` admits) are rewritten; returns them."""
        held = self.manifest(below=version)
        rows = self._read({p: v for p, v in held.items() if parts(p)})
        rows = rows.withColumn("_part", self.part(rows).cast("long"))
        touched = sorted(r[0] for r in rows.where(gone).select("_part").distinct().collect())
        left = self._read({p: held[p] for p in touched}).where(~F.coalesce(gone, F.lit(False)))
        self._commit(version, left.withColumn("_part", self.part(left).cast("long")), touched, held)
        return touched


def hash_part(keys: list[str], parts: int = 64) -> Callable[[DataFrame], Column]:
    """Rows of equal keys in one of ``parts`` parts."""
    return lambda df: F.pmod(F.xxhash64(*keys), F.lit(parts))


def day_part(ts: str) -> Callable[[DataFrame], Column]:
    """A part a day, numbered from 1970-01-01."""
    return lambda df: F.unix_date(F.to_date(F.col(ts).cast("timestamp")))
