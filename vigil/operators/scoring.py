"""Exact top-k scoring of a whole catalog for every user (M5-M7).

Items are dealt to parts of bounded size and users to splits.  A task holds one
part's items and streams users past them.  Items of equal text are one class
with one content score, from an inverted index of the classes' terms; the ids of
a class, in order, are read only where they can reach a list.  Items with factors
are scored one by one, by matrix products over blocks in falling order of their
norms.  The product of the norms bounds what a block can score, so blocks that
can change neither a user's extremes nor its list are not multiplied.  Only k
rows of each user and part leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.session import cut_lineage

PART_VALUES = 4_000_000      # factors and term weights of the items of one part
BLOCK = 1024                 # items multiplied at once
USERS = 64
SLACK = 1e-6                 # on bounds, relative to single-precision factors


def dense_ids(df: DataFrame, col: str, out: str) -> DataFrame:
    """``(col, out)``: the distinct values of ``col`` (of any type) numbered from
    0 in their order, written.  Values are range-partitioned and numbered inside
    each partition; the partitions' counts give the offsets."""
    spark = df.sparkSession
    ranged = (df.select(col).where(F.col(col).isNotNull()).distinct()
              .repartitionByRange(col).sortWithinPartitions(col)
              .withColumn("_p", F.spark_partition_id())
              # the lower 33 bits of this number count the rows of a partition
              .withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    ranged = cut_lineage(ranged)
    at, offsets = 0, []
    for p, n in sorted(tuple(r) for r in ranged.groupBy("_p").count().collect()):   # a row a partition
        offsets.append((p, at))
        at += n
    start = spark.createDataFrame(offsets or [(0, 0)], "_p int, _o long")
    return ranged.join(F.broadcast(start), "_p").select(col, (F.col("_o") + F.col("_i")).alias(out))


class _Part:
    """Items of a part: classes of equal text (rows of terms, weights, ids and, if
    they have factors, vectors), numbered in the order of their smallest ids."""

    def __init__(self, rows: pa.Table, rank: int):
        ids, n = _lists(rows.column("ids"))
        order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
        self.ids = ids.take(pa.array(order))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        owner = np.repeat(np.arange(len(n)), n)
        members = order[np.argsort(owner[order], kind="stable")]       # by class, then by id
        starts = np.append(0, np.cumsum(n))
        first = place[members[starts[:-1]]]
        by_first = np.argsort(first)
        self.members = [place[members[starts[c]:starts[c + 1]]] for c in by_first.tolist()]
        number = np.empty(len(n), np.int64)
        number[by_first] = np.arange(len(n))
        has = rows.column("vectors").is_valid().to_numpy()
        self.plain = ~has[by_first]
        known = np.flatnonzero(has[owner])
        vectors = _lists(rows.column("vectors"))[0]
        flat = _lists(vectors)[0].to_numpy(zero_copy_only=False).astype(np.float64)
        norm = np.sqrt((flat.reshape(-1, rank) ** 2).sum(axis=1))
        by_norm = np.argsort(-norm, kind="stable")
        self.norm = norm[by_norm]
        self.sorted = np.ascontiguousarray(flat.reshape(-1, rank)[by_norm])
        self.place, self.number = place[known][by_norm], number[owner[known]][by_norm]
        self.at = {x: i for i, x in enumerate(self.ids.take(pa.array(self.place)).to_pylist())}
        terms: dict[str, tuple[list, list]] = {}
        for i, (ts, ws) in enumerate(zip(rows.column("terms").to_pylist(), rows.column("weights").to_pylist())):
            for t, w in zip(ts or (), ws or ()):
                at = terms.setdefault(t, ([], []))
                at[0].append(number[i])
                at[1].append(w)
        self.terms = {t: (np.array(a), np.array(w)) for t, (a, w) in terms.items()}

    def content(self, terms: list | None, weights: list | None) -> np.ndarray:
        """Content score of each class."""
        out = np.zeros(len(self.members))
        for t, w in zip(terms or (), weights or ()):
            if t in self.terms:
                at, x = self.terms[t]
                out[at] += w * x
        return out

    def extremes(self, users: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest factor score of each user over the part."""
        lo, hi = np.full(len(users), np.inf), np.full(len(users), -np.inf)
        size = np.sqrt((users ** 2).sum(axis=1))
        open_ = np.arange(len(users))
        for a in range(0, len(self.norm), BLOCK):
            reach = size[open_] * self.norm[a] * (1 + SLACK)
            open_ = open_[(reach > hi[open_]) | (-reach < lo[open_])]
            if not len(open_):
                break
            s = users[open_] @ self.sorted[a:a + BLOCK].T
            lo[open_], hi[open_] = np.minimum(lo[open_], s.min(axis=1)), np.maximum(hi[open_], s.max(axis=1))
        return lo, hi

    def best(self, score: np.ndarray, gone: list, k: int) -> list[tuple[int, float, int]]:
        """Place, score and class of the k best items that are not ``gone``, by the
        scores of the classes (-inf: left out), ties to the smaller id.  Each better
        class holds a better item, so k + len(gone) classes hold them all."""
        pick = _top(score, k + len(gone))
        out, left = [], set(gone)
        for run in np.split(pick, np.flatnonzero(np.diff(score[pick])) + 1):
            if len(out) >= k or not len(run):
                break
            most = k - len(out) + len(left)
            some = sorted((p, c) for c in run.tolist() for p in self.members[c][:most].tolist())[:most]
            for p, c in some:
                x = self.ids[p].as_py() if left else None
                if left and x in left:
                    left.remove(x)             # of rows with one id, one
                elif len(out) < k:
                    out.append((p, score[c], c))
        return out


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists in a row, and their number in each list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties to the first; missing ones are -inf."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        above = np.flatnonzero(score > least)
        pick = np.concatenate([above, np.flatnonzero(score == least)[:k - len(above)]])
    else:
        pick = np.arange(len(score))
    pick = pick[np.isfinite(score[pick])]
    return pick[np.lexsort((pick, -score[pick]))]


def _blended(part: _Part, user: np.ndarray, content: np.ndarray, lo: float, hi: float, weight: float,
             gone: list, k: int) -> list[tuple[int, float, int]]:
    """Best k of weight * minmax(factor score) + (1 - weight) * content, as 32-bit
    floats.  Items without factors have the factor score 0, so their classes have
    one score; the others' blocks follow in falling norm until none left can reach
    the list."""
    span = (hi - lo) if hi > lo else 1.0
    base = lo if hi > lo else 0.0
    rest = (weight * (0.0 - base) / span + (1 - weight) * content).astype(np.float32)
    rest[~part.plain] = -np.inf
    found = part.best(rest, gone, k)
    best, place = np.array([s for _, s, _ in found], np.float32), np.array([p for p, _, _ in found], np.int64)
    cls = np.array([c for _, _, c in found], np.int64)
    barred = np.zeros(len(part.norm), bool)
    barred[[part.at[x] for x in gone if x in part.at]] = True
    most = content[part.number].max(initial=0.0)
    size = np.sqrt((user ** 2).sum())
    for a in range(0, len(part.norm), BLOCK):
        worst = best[-1] if len(best) >= k else -np.inf
        reach = weight * (size * part.norm[a] - base) / span + (1 - weight) * most
        if reach * (1 + SLACK) + SLACK < worst:
            break
        c = part.number[a:a + BLOCK]
        s = (weight * (part.sorted[a:a + BLOCK] @ user - base) / span + (1 - weight) * content[c]).astype(np.float32)
        keep = np.flatnonzero((s >= worst) & ~barred[a:a + BLOCK])
        best, place = np.append(best, s[keep]), np.append(place, part.place[a:a + BLOCK][keep])
        cls = np.append(cls, c[keep])
        first = np.lexsort((place, -best))[:k]
        best, place, cls = best[first], place[first], cls[first]
    return list(zip(place.tolist(), best.tolist(), cls.tolist()))


def _groups(items: DataFrame, vectors: DataFrame | None, users: DataFrame, barred: DataFrame | None, work,
            out: T.StructType, rank: int) -> DataFrame:
    """Runs ``work(part, barred by user, batch of users)`` over all groups.
    items: id, key, factors; vectors: key, terms, weights (none: no content);
    users: id (any other columns); barred: user, id."""
    known = F.col("factors").isNotNull()
    size = items.agg(F.sum(F.when(known, rank + 1).otherwise(1))).first()[0] or 0
    if vectors is not None:
        size += vectors.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = max(1, -(-size // PART_VALUES))
    splits = max(1, parts, 2 * users.sparkSession.sparkContext.defaultParallelism // parts)

    def deal(col: str, n: int):
        return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    classes = items.groupBy(deal("id", parts).alias("part"), "key", known.alias("_known")).agg(
        F.collect_list(F.struct("id", "factors")).alias("_m"))
    lists = [F.col("_m.id").alias("ids"), F.when(F.col("_known"), F.col("_m.factors")).alias("vectors")]
    if vectors is not None:
        classes = classes.join(vectors, "key", "left")
    else:
        classes = classes.withColumn("terms", F.lit(None).cast("array<string>")) \
            .withColumn("weights", F.lit(None).cast("array<double>"))
    rows = classes.select("part", each(splits).alias("split"), F.lit(0).alias("kind"),
                          F.struct("terms", "weights", *lists).alias("item"))
    rows = rows.unionByName(users.select(each(parts).alias("part"), deal("id", splits).alias("split"), F.lit(2).alias("kind"),
                                         F.struct(*users.columns).alias("user")), allowMissingColumns=True)
    if barred is not None:
        rows = rows.unionByName(barred.select(deal("id", parts).alias("part"), deal("user", splits).alias("split"),
                                              F.lit(1).alias("kind"), F.struct("user", "id").alias("bar")),
                                allowMissingColumns=True)
    arrow = to_arrow_schema(out)

    def table(rows: list[pa.RecordBatch], col: str) -> pa.Table:
        return pa.Table.from_batches(rows).select([col]).flatten().rename_columns(
            [f.name for f in rows[0].schema.field(col).type])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, part, bars = None, [], None, {}
        for b in batches:
            key = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(key)]):
                if lo == hi:
                    continue
                some = b.slice(lo, hi - lo)
                if group != tuple(key[lo, :2]):
                    group, held, part, bars = tuple(key[lo, :2]), [], None, {}
                if key[lo, 2] == 0:
                    held.append(some)
                    continue
                if part is None:
                    if not held:
                        continue
                    part, held = _Part(table(held, "item"), rank), []
                if key[lo, 2] == 1:
                    t = table([some], "bar")
                    for u, i in zip(t.column("user").to_pylist(), t.column("id").to_pylist()):
                        bars.setdefault(u, []).append(i)
                    continue
                t = table([some], "user").to_pylist()
                for a in range(0, len(t), USERS):
                    found = work(part, bars, t[a:a + USERS])
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)
    dealt = rows.repartitionById(parts * splits, F.col("part") * splits + F.col("split"))      # a task a group
    return dealt.sortWithinPartitions("part", "split", "kind").mapInArrow(run, out)


def factor_extremes(items: DataFrame, users: DataFrame, rank: int) -> DataFrame:
    """id, lo, hi: the smallest and largest factor score of each user (id,
    factors) over all ``items`` (those without factors score 0)."""
    kind = users.schema["id"].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])

    def work(part: _Part, bars: dict, users: list[dict]) -> list[tuple]:
        lo, hi = part.extremes(np.array([u["factors"] for u in users], np.float64))
        return [(u["id"], float(a), float(b)) for u, a, b in zip(users, lo, hi)]
    slim = items.where("factors IS NOT NULL").select("id", F.lit("").alias("key"), "factors")
    g = _groups(slim, None, users.select("id", "factors"), None, work, out, rank)
    if not items.where("factors IS NULL").isEmpty():
        g = g.unionByName(users.select("id", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")))
    return g.groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def top_items(items: DataFrame, vectors: DataFrame, users: DataFrame, barred: DataFrame, k: int, weight: float,
              rank: int) -> DataFrame:
    """user, item, score, content: the k best of each part for every user.

    items: id, key (of its text), factors; vectors: key, terms, weights; users: id,
    factors (null: content alone), lo, hi, terms, weights; barred: user, id (never
    returned; distinct)."""
    kind = [df.schema[c].dataType for df, c in ((users, "id"), (items, "id"))]
    out = T.StructType([T.StructField("user", kind[0]), T.StructField("item", kind[1]),
                        T.StructField("score", T.FloatType()), T.StructField("content", T.DoubleType())])

    def work(part: _Part, bars: dict, users: list[dict]) -> list[tuple]:
        found = []
        for u in users:
            content, gone = part.content(u["terms"], u["weights"]), bars.get(u["id"], [])
            if u["factors"] is None:
                best = part.best(content.astype(np.float32), gone, k)
            else:
                best = _blended(part, np.array(u["factors"], np.float64), content, u["lo"], u["hi"], weight, gone, k)
            found += [(u["id"], part.ids[p].as_py(), float(s), float(content[c])) for p, s, c in best]
        return found
    return _groups(items, vectors, users, barred, work, out, rank)
