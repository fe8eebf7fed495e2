"""Language identification by compression.

Each language has a zstandard raw-content dictionary cut from labelled texts.
A text is encoded with every dictionary, in blocks, so that the dictionary
counts for all of a long text and not only for its start; the language whose
dictionary gives the fewest bytes is predicted, and a text is rejected when
the runner-up is too close.  Letters are lower-cased first.  Each block ends in
the same run of line breaks: an encoder stores a very short block as it is when
matches save it only a byte or two, and the run, which always compresses, lets
such savings show.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, free_name, unit_hash

UNKNOWN = "und"
TAIL = b"\n" * 48


def learn_dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang",
                       size: int = 65536, samples: int = 256,
                       seed: int = 3) -> list[tuple[str, bytes]]:
    """(language, raw content), the most frequent language first.

    Bounded sample: about ``samples`` texts of each language, drawn by a hash
    of the text, and of each one slice of 2 * size / samples characters from a
    hashed place; the dictionary is their first ``size`` bytes.  Rows without
    a language or with a blank text teach nothing.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\S")).select(
        F.col(lang).cast("string").alias("lang"),
        F.lower(F.col(text).cast("string")).alias("text"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, samples / n))).otherwise(share)
    span = 2 * size // samples
    place = F.floor(unit_hash("text", seed=seed + 1)
                    * F.greatest(F.length("text") - span, F.lit(1))).cast("int") + 1
    drawn = rows.where(unit_hash("text", seed=seed) < share).select(
        "lang", F.xxhash64("text").alias("h"), F.substring("text", place, F.lit(span)).alias("s"))
    drawn = drawn.dropDuplicates(["lang", "h"])
    out: dict[str, bytes] = {name: b"" for name in counts}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["h"])):
        if len(out[r["lang"]]) < size:
            out[r["lang"]] += r["s"].encode() + b"\n"
    order = sorted(out, key=lambda k: (-counts[k], k))
    return [(k, out[k][:size]) for k in order]


@lru_cache(maxsize=2)
def _coders(dictionaries: tuple, level: int) -> list:
    import zstandard
    out = []
    for _, raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw or b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(
            level, dict_size=len(raw), source_size=1024, min_match=3,
            write_content_size=False, write_dict_id=False, write_checksum=False)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
    return out


def encoded_sizes(text: str, dictionaries: tuple, level: int = 5, block: int = 1024) -> list[int]:
    """Bytes of the whole text encoded with each dictionary."""
    raw = text.lower().encode("utf-8", "replace")
    parts = [raw[i:i + block] + TAIL for i in range(0, len(raw), block)]
    return [sum(len(c.compress(p)) for p in parts) for c in _coders(dictionaries, level)]


def judged(dictionaries: list[tuple[str, bytes]], text: str = "text",
           min_margin: float = 0.008) -> Column:
    """struct(lang_pred, score, accepted) of a text column.

    score: by how much the best encoding is smaller than the runner-up, as a
    share of the runner-up (0 to 1; 1 if only one language was learned).
    lang_pred is `und`, and the score 0, for texts that are null or have no
    letter, and where no language was learned.  Ties go to the most frequent
    language.  accepted: not `und`, and a score of ``min_margin`` or more.
    """
    learned = tuple(dictionaries)

    @F.pandas_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            langs, scores = [], []
            for t in s:
                if not learned or t is None or not any(map(str.isalpha, t)):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                sizes = encoded_sizes(t, learned)
                best = int(np.argmin(sizes))
                rest = min(sizes[:best] + sizes[best + 1:], default=None)
                langs.append(learned[best][0])
                scores.append(1.0 if rest is None else 1.0 - sizes[best] / rest)
            out = pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object),
                                "score": pd.Series(scores, dtype=float)})
            out["accepted"] = (out["lang_pred"] != UNKNOWN) & (out["score"] >= min_margin)
            yield out
    return judge.asNondeterministic()(F.col(text).cast("string"))


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text",
             min_margin: float = 0.008) -> DataFrame:
    """``docs`` with lang_pred, score and accepted (see judged; columns of these
    names are replaced).  Every row returns, repeated rows and empty texts too;
    an empty table gives no rows."""
    docs = bounded_batches(docs).drop("lang_pred", "score", "accepted")
    j = free_name(docs, "_judged")
    return docs.withColumn(j, judged(dictionaries, text, min_margin)).select(*docs.columns, f"{j}.*")


def keep_identified(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text",
                    min_margin: float = 0.008) -> DataFrame:
    """``docs``, all columns, without the rows whose language is rejected."""
    j = free_name(bounded_batches(docs), "_judged")
    return docs.withColumn(j, judged(dictionaries, text, min_margin)).where(
        F.col(j)["accepted"]).drop(j)
