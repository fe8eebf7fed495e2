"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits.  Two of their 23-bit segments are covered by the
perfect binary Golay code: every 23-bit word lies within 3 bits of exactly one
of 4096 codewords, so a fingerprint has one home anchor, a pair of codewords
(24 bits).  A fingerprint within ``max_bits`` of another differs from it by d1
and d2 bits in the segments, d1 + d2 <= max_bits, and so lies within 3 + d1 and
3 + d2 bits of that one's home anchor.  Each distinct fingerprint is therefore
replicated to every anchor that near (covering radius plus threshold), and an
anchor compares its residents with the replicas.  No link can be missed.

For two bits a fingerprint has about 70 replicas over 16.8 million anchors;
and no fingerprint has more than 2,080 others within two bits, so links grow
with the number of distinct fingerprints, not with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, free_name, to_scratch

# fixed values: generator polynomial of the (23, 12) Golay code, its covering radius
GOLAY, GOLAY_BITS, RADIUS = 0xC75, 23, 3


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text as a signed integer: words between ASCII white
    space, A-Z lower-cased, shingles with repeats; null or blank: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[:n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        h = np.array([digest(joined[a:b], seed) for a, b in
                      zip(starts[at:at + 65536], stops[at:at + 65536])], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: str, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def prints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([fingerprint(t, shingle) for t in s], dtype="int64")
    return prints.asNondeterministic()(F.col(text).cast("string"))


@lru_cache(maxsize=4)
def _errors(max_bits: int) -> list[list[np.ndarray]]:
    """For each syndrome and each excess 0..max_bits: the error words with that
    syndrome whose weight is RADIUS + excess (excess 0: RADIUS or less)."""
    remainder = []
    for i in range(GOLAY_BITS):
        v = 1 << i
        for top in range(GOLAY_BITS - 1, 10, -1):
            if v >> top & 1:
                v ^= GOLAY << (top - 11)
        remainder.append(v)
    out = [[[] for _ in range(max_bits + 1)] for _ in range(2048)]
    for weight in range(RADIUS + max_bits + 1):
        for places in combinations(range(GOLAY_BITS), weight):
            syndrome = 0
            for p in places:
                syndrome ^= remainder[p]
            out[syndrome][max(0, weight - RADIUS)].append(sum(1 << p for p in places))
    return [[np.array(x, np.int64) for x in per] for per in out]


@lru_cache(maxsize=1)
def _syndromes() -> tuple[list[int], list[int]]:
    """Remainders of the words that have only the low 12 or the high 11 bits."""
    half = []
    for shift, bits in ((0, 12), (12, 11)):
        v = np.arange(1 << bits, dtype=np.int64) << shift
        for top in range(GOLAY_BITS - 1, 10, -1):
            v = np.where(v >> top & 1, v ^ (GOLAY << (top - 11)), v)
        half.append(v.tolist())
    return half[0], half[1]


def anchors(fp: int, max_bits: int) -> tuple[int, np.ndarray]:
    """Home anchor of a fingerprint, and all anchors that residents within
    ``max_bits`` of it can have as their home."""
    err, (low, high) = _errors(max_bits), _syndromes()
    mask = (1 << GOLAY_BITS) - 1
    v1, v2 = fp & mask, fp >> GOLAY_BITS & mask
    e1, e2 = (err[low[v & 4095] ^ high[v >> 12]] for v in (v1, v2))
    near = [(((v1 ^ e1[a]) >> 11) << 12)[:, None] | ((v2 ^ e2[b]) >> 11)[None, :]
            for a in range(max_bits + 1) for b in range(max_bits + 1 - a)]
    return int(near[0][0, 0]), np.concatenate([x.reshape(-1) for x in near])


def anchor_columns(fp: str, max_bits: int) -> Column:
    """struct(home, near) of a fingerprint column."""
    @F.pandas_udf("struct<home:int,near:array<int>>")
    def cover(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            got = [anchors(int(v), max_bits) for v in s]
            yield pd.DataFrame({"home": pd.Series([h for h, _ in got], dtype="int32"),
                                "near": [x.astype(np.int32) for _, x in got]})
    # else Spark repeats the function in a filter that it infers from the join
    return cover.asNondeterministic()(F.col(fp))


def near_links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct values of column fp that differ
    in ``max_bits`` bits or fewer."""
    covered = prints.select("fp", anchor_columns("fp", max_bits).alias("c"))
    home = covered.select(F.col("c.home").alias("anchor"), F.col("fp").alias("a"))
    near = covered.select(F.explode("c.near").alias("anchor"), F.col("fp").alias("b"))
    # Spark's size estimate does not see what the explode multiplies: never broadcast it
    return home.hint("merge").join(near, "anchor").where(
        (F.col("a") < F.col("b"))
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(fp, root) for every fingerprint in ``links``: root is the smallest one
    that it reaches.  Each round takes the smallest label among a node and its
    neighbours and then that label's own label, so long chains shorten fast;
    every round is written to the scratch folder.  A node has few neighbours
    (see above), and lookups of one frequent label are joins that Spark splits.
    """
    both = to_scratch(links.union(links.select("b", "a")).toDF("fp", "other"), "links")
    label = to_scratch(both.groupBy("fp").agg(F.min("other").alias("m")).select(
        "fp", F.least("fp", "m").alias("root")), "labels")
    while True:
        seen = both.join(label.toDF("other", "root"), "other").groupBy("fp").agg(
            F.min("root").alias("heard"))
        step = to_scratch(label.join(seen, "fp").select(
            "fp", "root", F.least("root", "heard").alias("next")), "labels")
        jump = step.select(F.col("fp").alias("next"), F.col("next").alias("far"))
        after = to_scratch(step.join(jump, "next").select(
            "fp", F.least("next", "far").alias("new"), "root"), "labels")
        changed = after.where("new <> root").limit(1).count()
        label = after.select("fp", F.col("new").alias("root"))
        if not changed:
            return label


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text",
                       shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per input row: key, fp (long), root (smallest fingerprint of the
    component, as a number), component_id (smallest key of the component, nulls
    aside; null if it has no other).

    Null and blank texts have fingerprint 0 and link like any other.  Repeated
    rows each return a row.  An empty table returns an empty result.  Extra
    columns are ignored.
    """
    prints = to_scratch(bounded_batches(docs).select(
        F.col(key).alias("key"), fingerprint_column(text, shingle).alias("fp")), "prints")
    distinct = to_scratch(prints.groupBy("fp").agg(F.min("key").alias("first")), "distinct")
    label = components(near_links(distinct.select("fp"), max_bits))
    rooted = distinct.join(label, "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = to_scratch(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    table = to_scratch(rooted.select("fp", "root").join(least, "root"), "members")
    return prints.join(table, "fp").select(F.col("key").alias(key), "fp", "root", "component_id")


def keep_one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text",
                           shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that with the
    smallest key (null only if the component has no other); of rows repeated
    under that key the one with the smallest text hash, once.  All columns stay.
    """
    found = simhash_components(docs, key, text, shingle, max_bits)
    k, n, f, r, h = (free_name(docs, x) for x in ("_keep", "_rows", "_fp", "_root", "_hash"))
    # the rows of the smallest keys; keys that have several are settled apart
    first = found.where(F.col(key).eqNullSafe(F.col("component_id"))).select(
        F.col(key).alias(k), F.col("fp").alias(f), F.col("root").alias(r))
    heads = to_scratch(first.groupBy(k).agg(F.count("*").alias(n)), "heads")
    once = heads.where(F.col(n) == 1)
    # the same join at every size: kept keys grow with the documents
    kept = docs.join(once.hint("merge"), docs[key].eqNullSafe(once[k]), "left_semi")
    repeated = heads.where(F.col(n) > 1)
    if repeated.isEmpty():
        return kept
    again = docs.join(repeated, docs[key].eqNullSafe(repeated[k]), "left_semi").withColumn(
        h, fingerprint_column(text, shingle))
    again = again.join(first.distinct(), (again[h] == first[f]) & again[key].eqNullSafe(first[k]))
    best = again.groupBy(r).agg(F.min_by(
        F.struct(*[again[c] for c in docs.columns]),
        F.struct(F.xxhash64(text), F.xxhash64(*docs.columns))).alias("row"))
    return kept.unionByName(best.select("row.*"))
