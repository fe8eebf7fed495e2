"""Token ids in word-aligned binary blocks (Simple-8b).

A file holds documents in ascending key order as segments.  A segment is one
row of the written table: whole documents, one after the other, until
``SEGMENT`` ids are reached.  Its ids are cut into blocks of ``BLOCK`` ids and
each block is a run of 64-bit little-endian words: a selector in the upper
four bits and, below, as many ids as its width allows.  Two selectors are
escapes: a run of one repeated id, and a single id of any width up to 60 bits.
``offsets`` holds each block's first word, so a block, or a document by its
first id, is decoded without reading what comes before; decoding takes all
words of one selector in one array operation.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from vigil.llm.common import bounded_batches
from vigil.llm.tokens import word_ids

# ---------------------------------------------------------------- coding

#: ids a word and bits an id, by selector; 0 is a run, 15 a single wide id
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 32, 60])
RUN, WIDE = 0, 15
_RUN_ID_BITS = 32                 # below a run's length of up to 28 bits
_LEAST_RUN = 61                   # a run shorter than that fits other words as well
BLOCK, SEGMENT = 4096, 1 << 16


def _selectors(v: np.ndarray) -> np.ndarray:
    """The selector with the most ids at each place of a row of ids, none of
    which reaches over the end of its block."""
    n = len(v)
    bits = np.maximum((v.astype(np.float64).view(np.int64) >> 52) - 1022, 0)
    bits = np.append(bits, np.full(-n % BLOCK, 255)).astype(np.uint8).reshape(-1, BLOCK)
    best = np.full(bits.shape, WIDE, np.int8)
    widest, c = bits, 1           # the widest of the c ids from each place on
    for s in range(WIDE - 1, RUN, -1):
        while c < COUNTS[s]:
            widest = np.maximum(widest[:, :-1], bits[:, c:])
            c += 1
        fits = widest <= WIDTHS[s]
        if not fits.any():
            break                 # more ids are wider still, and get fewer bits each
        best[:, :BLOCK - c + 1][fits] = s
    return best.ravel()[:n].astype(np.int64)


def _long_runs(v: np.ndarray) -> list[tuple[int, int]]:
    """First and end of the runs of one id that are worth an escape."""
    same = v[1:] == v[:-1]
    if np.count_nonzero(same) < _LEAST_RUN - 1:
        return []
    edge = np.flatnonzero(~same) + 1
    firsts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(v)]])
    long = (ends - firsts >= _LEAST_RUN) & (v[firsts] >> np.uint64(_RUN_ID_BITS) == 0)
    return list(zip(firsts[long].tolist(), ends[long].tolist()))


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, place of each word's first id): greedy, as many ids a word as fit."""
    n = len(ids)
    v = ids.astype(np.uint64)
    if not n:
        return np.empty(0, "<u8"), np.empty(0, np.int64)
    if int(v.max()) >> 60:
        raise ValueError("ids of more than 60 bits have no code")
    best = _selectors(v)
    step = COUNTS[best]
    for a, b in _long_runs(v):
        for lo in range(a // BLOCK * BLOCK, b, BLOCK):   # from anywhere to the run's or the block's end
            hi = min(b, lo + BLOCK)
            at = np.arange(max(a, lo), hi - _LEAST_RUN + 1)
            best[at], step[at] = RUN, hi - at
    starts, i, after = [], 0, (np.arange(n) + step).tolist()
    while i < n:
        starts.append(i)
        i = after[i]
    at = np.array(starts)
    kind = best[at]
    words = kind.astype(np.uint64) << np.uint64(60)
    for s in np.unique(kind):
        m = kind == s
        first = at[m]
        if s == RUN:
            words[m] |= (step[first].astype(np.uint64) << np.uint64(_RUN_ID_BITS)) | v[first]
            continue
        shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
        words[m] |= np.bitwise_or.reduce(v[first[:, None] + np.arange(COUNTS[s])] << shifts, axis=1)
    return words.astype("<u8"), at


def decode_words(words: np.ndarray) -> np.ndarray:
    """The ids of any row of words (of one block or of many in a row)."""
    w = words.astype(np.uint64)
    kind = (w >> np.uint64(60)).astype(np.int64)
    n = COUNTS[kind]
    run = kind == RUN
    n[run] = (w[run] >> np.uint64(_RUN_ID_BITS)) & np.uint64((1 << 28) - 1)
    first = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint64)
    for s in np.unique(kind):
        m = kind == s
        if s == RUN:
            for a, c, x in zip(first[m], n[m], w[m]):
                out[a:a + c] = x & np.uint64((1 << _RUN_ID_BITS) - 1)
            continue
        shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        out[first[m][:, None] + np.arange(COUNTS[s])] = (w[m][:, None] >> shifts) & mask
    return out


def encode_segment(ids: np.ndarray) -> tuple[bytes, bytes]:
    """(words, offsets): all blocks' words in a row, and the first word of each
    block and of the end, as little-endian 32-bit numbers."""
    words, at = encode_words(ids)
    offsets = np.searchsorted(at, np.arange(0, len(ids) + BLOCK, BLOCK))
    return words.tobytes(), offsets.astype("<u4").tobytes()


def read_ids(words: bytes, offsets: bytes, start: int = 0, length: int | None = None) -> np.ndarray:
    """``length`` ids of a segment from ``start`` on (all: None); only the
    blocks that hold them are decoded."""
    w, ends = np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<u4")
    if length is None:
        return decode_words(w)[start:]
    if not length:
        return np.empty(0, np.uint64)
    b0, b1 = start // BLOCK, (start + length - 1) // BLOCK
    got = decode_words(w[int(ends[b0]):int(ends[b1 + 1])])
    return got[start - b0 * BLOCK:start - b0 * BLOCK + length]


# ---------------------------------------------------------------- files

@dataclass
class TokenFiles:
    """A written set: the folder, and the ids before each file (by file number)."""
    path: str
    starts: dict[int, int]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text",
                      end_id: int = 1, file_bytes: int = 128 << 20) -> TokenFiles:
    """Writes the ids of all documents, each followed by ``end_id``, in
    ascending order of ``key`` (nulls first) below ``path``.

    Null and empty texts are the end id alone.  Rows with the same key are
    written each, in the order of their texts' hashes; rows repeated whole
    have equal ids, so their order does not matter.  A row's text is held
    whole by the task that encodes it.  An empty table writes no segment.
    Other columns are ignored.

    Documents are range-partitioned by key, text hash and place in the input
    (a key that a third of the rows share is cut like any other range), into
    files of about ``file_bytes`` of text, and encoded in order by the task
    that writes the file.
    """
    spark = docs.sparkSession
    body = F.col(text).cast("string")
    rows = docs.select(F.col(key).alias("key"), body.alias("text"), F.xxhash64(body).alias("tie"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(2 * spark.sparkContext.defaultParallelism, -(-total // file_bytes))
    order = [F.col("key").asc_nulls_first(), F.col("tie").asc_nulls_first()]
    ranged = (rows.withColumn("place", F.monotonically_increasing_id())
              .repartitionByRange(int(files), *order, F.col("place"))
              .sortWithinPartitions(*order)
              .select(F.spark_partition_id().alias("file"), "key", "text"))
    kind = ranged.schema["key"].dataType
    schema = T.StructType([
        T.StructField("file", T.IntegerType()), T.StructField("segment", T.IntegerType()),
        T.StructField("first", T.LongType()),       # ids of this file before the segment
        T.StructField("n_ids", T.LongType()),
        T.StructField("keys", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("offsets", T.BinaryType()), T.StructField("words", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        file = segment = first = 0
        keys: list = []
        ids: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal keys, ids, held, segment, first
            words, offsets = encode_segment(np.frombuffer(b"".join(ids), "<u4"))
            out = pa.RecordBatch.from_pylist([{
                "file": file, "segment": segment, "first": first, "n_ids": held, "keys": keys,
                "lengths": [len(x) // 4 for x in ids], "offsets": offsets, "words": words}], arrow)
            segment, first = segment + 1, first + held
            keys, ids, held = [], [], 0
            return out
        for b in batches:
            if b.num_rows:
                file = b.column(0)[0].as_py()
            for k, x in zip(b.column(1).to_pylist(), encoder.encode(b.column(2).to_pylist())):
                keys.append(k)
                ids.append(x + tail)
                held += len(x) // 4 + 1
                if held >= SEGMENT:
                    yield close()
        if keys:
            yield close()
    bounded_batches(ranged).mapInArrow(encode, schema).write.parquet(path)
    sizes = (spark.read.schema(schema).parquet(path).groupBy("file").agg(F.sum("n_ids")).collect())
    starts, at = {}, 0
    for file, n in sorted(tuple(r) for r in sizes):   # one row a file
        starts[file], at = at, at + n
    return TokenFiles(path, starts)


def read_documents(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """One row per document, decoded from the files: key, start (ids of all
    documents before it), n_tokens, ids_crc32 and, if asked for, the ids as
    little-endian unsigned 32-bit numbers."""
    stored = spark.read.parquet(files.path)
    kind = stored.schema["keys"].dataType.elementType
    schema = T.StructType([
        T.StructField("key", kind), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    arrow, starts = to_arrow_schema(schema), files.starts

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(i)[r] for i, n in enumerate(b.schema.names)}
                flat = decode_words(np.frombuffer(row["words"].as_py(), "<u8")).astype("<u4").tobytes()
                lengths = np.array(row["lengths"].values)
                ends = np.cumsum(lengths)
                at = starts[row["file"].as_py()] + row["first"].as_py() + ends - lengths
                texts = [flat[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                cols = [row["keys"].values, pa.array(at), pa.array(lengths),
                        pa.array([zlib.crc32(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(texts, pa.binary())] if with_ids else [])],
                                                 schema=arrow)
    slim = stored.select("file", "first", "keys", "lengths", "words")
    return slim.mapInArrow(decode, schema)
