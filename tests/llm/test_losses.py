"""Cases that once crashed or lost rows: repeated keys, full formats, helper
names."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import ann, sharding, surrogate


def test_unusable_vectors_hide_none_of_their_key(spark):
    rows = [(1, [0.9, 0.1]), (1, None), (2, [0.0, 1.0]), (2, [0.0, 0.0]), (3, [1.0, float("nan")]), (3, [1.0, 0.0]),
            (4, [None, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("_asked", F.lit("x"))
    got = {(r.query_id, r.rank, r.vec_id, round(r.score, 9))
           for r in ann.nearest(df, F.col("vec_id") < 10, k=5).collect()}
    v = {1: [0.9, 0.1], 2: [0.0, 1.0], 3: [1.0, 0.0]}
    want = set()
    for q in v:
        near = sorted((round(float(np.linalg.norm(np.subtract(v[q], v[o]))), 9), o) for o in v if o != q)
        want |= {(q, n, o, d) for n, (d, o) in enumerate(near, 1)}
    assert got == want


def test_full_formats_get_longer(spark):
    """400 addresses with two letters before the domain's end, and every
    address of four one-digit octets: more than half of their formats."""
    letters = "abcdefghijklmnopqrst"
    mails = [f"{a}@{b}.de" for a in letters for b in letters]
    ips = [f"{a}.{b}.{c}.{d}" for a in range(1, 9) for b in range(1, 9) for c in range(1, 9) for d in range(1, 9)]
    rows = [(i, "write " + " or ".join(mails[i::4])) for i in range(4)] + [(9, " to ".join(ips))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in surrogate.replace_entities(df, key="k").collect()}
    new = re.findall(r"\S+@\S+\.de", " ".join(out[i].text for i in range(4)))
    assert len(new) == len(set(new)) == 400 and not set(new) & set(mails)
    new = re.findall(r"\d+\.\d+\.\d+\.\d+", out[9].text)
    assert len(new) == len(set(new)) == len(ips) and not set(new) & set(ips)
    assert all(0 <= int(o) <= 255 for x in new for o in x.split("."))
    again = {r.doc_id: r.text for r in surrogate.replace_entities(df, key="k").collect()}
    assert again == {i: r.text for i, r in out.items()}


@pytest.mark.parametrize("sizes", [[5, 1, 9, 9, 40, 2], [0, 0, 0, 0, 0, 0]])
def test_shards_keep_columns_of_any_name(spark, sizes):
    names = ("_i", "_c", "_g", "_g0", "_at", "_n0", "_b0", "_n", "_b", "_key", "_tie", "_size", "_range")
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, size long")
    for c in names:
        df = df.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    got = sharding.shard_by_bytes(df, 3, "size", ["doc_id"]).collect()
    assert sorted(r.doc_id for r in got) == list(range(6))
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
