"""Collocations from a weighted de Bruijn graph of word 4-grams.

Nodes are 3-grams, edges the 4-grams between overlapping nodes, weighted by
how often they occur inside a piece of text.  Only edges, and the up to three
words at the end of each piece where no further edge starts, are counted in the
texts.  What flows out of a node, with the pieces that end there, is how often
its 3-gram occurs; in the same way 2-grams follow from 3-grams and words from
2-grams.  Unary paths of frequent edges, where each node has one frequent way
in and one out, are compacted to longer phrases.

Counts travel as packs: the sorted grams of one language and one hashed part
with their counts, compressed.  Grams are dealt by a hash of the whole gram, so
a frequent word or pair does not gather in one task, and a task holds one
part's counts at a time.  Counts are exact; nothing is dropped before the sums
are whole.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import bounded_batches, to_scratch
from vigil.operators.ordered import top_n

ORDER = 4                   # words of an edge
HELD = 400_000              # grams that a task holds before it packs them
PARTS = 256                 # hashed parts of a language at least
PART_BYTES = 4 << 20        # of text for each part
SALTS = 8
_END = b"\xff"              # between pieces; no byte of a text
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _END * 10 + b" ")
_CUT = b"\xfe"              # between the lists of a pack; no byte of a text either
_PACK = "lang string, part int, words int, body binary"
_UNZIP = zstandard.ZstdDecompressor().decompress


# ---------------------------------------------------------------- counting

def edges_and_ends(text: str, at_once: int = HELD // 4) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """For each word of a text the gram that starts there: (those of ``ORDER``
    words, those of the words left in a piece), at most ``at_once`` at a time."""
    words = text.encode("utf-8", "replace").lower().translate(_TABLE).replace(_END, b" \xff ").split()
    words += [_END] * ORDER
    for lo in range(0, len(words) - ORDER, at_once):
        some = words[lo:lo + at_once + ORDER - 1]
        grams = list(map(b" ".join, zip(*[some[i:len(some) - ORDER + 1 + i] for i in range(ORDER)])))
        yield ([g for g in grams if _END not in g],
               [g.partition(b" \xff")[0] for g in grams if _END in g and g[0] != 255])


class _Packer:
    """Counts by language and words of a gram, handed on as packs."""

    def __init__(self, parts: int):
        self.parts, self.held, self.n = parts, defaultdict(Counter), 0
        self.press = zstandard.ZstdCompressor(level=1).compress

    def rows(self) -> Iterator[pa.RecordBatch]:
        for (lang, words), counts in self.held.items():
            grams = list(counts)
            part = np.fromiter(map(zlib.crc32, grams), np.int64, len(grams)) % self.parts
            yield from self.pack(lang, words, grams, list(counts.values()), part)
        self.held.clear()
        self.n = 0

    def pack(self, lang: str, words: int, grams: list[bytes], counts: list[int], part: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Grams that occur once stand apart from those with a count."""
        if not grams:
            return
        numbers = np.array(counts, "<i8")
        order = np.lexsort((numbers > 1, part))
        sorted_part, numbers = part[order], numbers[order]
        cuts = np.flatnonzero(np.concatenate([[True], sorted_part[1:] != sorted_part[:-1], [True]]))
        names = [grams[i] for i in order.tolist()]
        singles = np.add.reduceat(numbers == 1, cuts[:-1], dtype=np.int64).tolist()
        body = []
        for a, b, one in zip(cuts.tolist(), cuts[1:].tolist(), singles):     # sorted, they compress better
            more = sorted(zip(names[a + one:b], numbers[a + one:b].tolist()))
            body.append(self.press(_CUT.join([
                b"\n".join(sorted(names[a:a + one])), b"\n".join([g for g, _ in more]),
                np.array([n for _, n in more], "<i8").tobytes()])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(body), pa.string()), pa.array(sorted_part[cuts[:-1]], pa.int32()),
             pa.array([words] * len(body), pa.int32()), pa.array(body, pa.binary())],
            names=["lang", "part", "words", "body"])


def _unpack(body: bytes) -> tuple[list[bytes], list[bytes], list[int]]:
    """(grams that occur once, other grams, their counts)."""
    a, b, n = _UNZIP(body).split(_CUT, 2)
    return a.split(b"\n") if a else [], b.split(b"\n") if n else [], np.frombuffer(n, "<i8").tolist()


def _count_texts(parts: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Packer(parts)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for edges, ends in edges_and_ends(text):
                    out.held[lang, ORDER].update(edges)
                    out.n += len(edges) + len(ends)
                    out.held[lang, ORDER - 1].update(ends)
                    if out.n >= HELD:
                        yield from out.rows()
        yield from out.rows()
    return count


def _sum_level(words: int, parts: int, least: int):
    """Packs sorted by (lang, part) -> grams of ``words`` words are whole now:
    the frequent ones are results (packs with a negative part), and all flow to
    the gram before their last word; shorter ends go on as they are, and packs
    that are opened later go on unopened."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Packer(parts)
        here, sums = None, Counter()

        def close() -> Iterator[pa.RecordBatch]:
            lang, whole = here[0], sums
            nxt = out.held[lang, words - 1]
            if words < ORDER:
                whole = {g: n for g, n in sums.items() if g.count(b" ") == words - 1}
                for g in sums.keys() - whole.keys():
                    nxt[g] += sums[g]
            keep = [g for g, n in whole.items() if n >= least]
            if words > 1:
                nxt.update([g[:g.rindex(b" ")] for g, n in whole.items() if n == 1])
                for g, n in whole.items():
                    if n > 1:
                        nxt[g[:g.rindex(b" ")]] += n
                out.n = sum(map(len, out.held.values()))
            else:
                yield from out.pack(lang, 0, [b""], [sum(whole.values())], np.array([-1]))
            if keep:
                yield from out.pack(lang, words, keep, [sums[g] for g in keep],
                                    np.full(len(keep), -1 - zlib.crc32(keep[0]) % 64))
            if out.n >= HELD:
                yield from out.rows()
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            on = np.array([p < 0 or w < words for p, w in zip(cols[1], cols[2])], bool)
            if on.any():
                yield b.filter(pa.array(on))
            for lang, part, _, body in (r for r, skip in zip(zip(*cols), on.tolist()) if not skip):
                if here != (lang, part):
                    if here:
                        yield from close()
                    here, sums = (lang, part), Counter()
                ones, grams, counts = _unpack(body)
                sums.update(ones)
                for g, n in zip(grams, counts):
                    sums[g] += n
        if here:
            yield from close()
        yield from out.rows()
    return work


def gram_counts(docs: DataFrame, least: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """Table lang, gram, words, f, read from a written one: all grams of 1 to ``ORDER`` words
    that occur at least ``least`` times in a language, and for each language a
    row of no words with the number of all its words.  Null languages: und."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    parts = max(PARTS, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)
    packs = bounded_batches(rows, 1024).mapInArrow(_count_texts(parts), _PACK)
    for words in range(ORDER, 0, -1):
        packs = (packs.repartition("lang", "part").sortWithinPartitions("lang", "part")
                 .mapInArrow(_sum_level(words, parts, least), _PACK))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, _, words, body in zip(*(c.to_pylist() for c in b.columns)):
                ones, grams, counts = _unpack(body)
                g, n = ones + grams, [1] * len(ones) + counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(g), pa.string()), pa.array([x.decode() for x in g], pa.string()),
                     pa.array([words] * len(g), pa.int32()), pa.array(n, pa.int64())],
                    names=["lang", "gram", "words", "f"])
    found = packs.mapInArrow(read, "lang string, gram string, words int, f long")
    found = to_scratch(found, "phrase-grams")
    totals = found.where("words = 0").groupBy("lang", "gram", "words").agg(F.sum("f").alias("f"))
    return found.where("words > 0").unionByName(totals)


# ---------------------------------------------------------------- phrases

def inside_longer(grams: DataFrame) -> DataFrame:
    """lang, gram, top: for each phrase of two words or more that lies in longer
    ones of ``grams``, the largest count of these."""
    ws = F.split("gram", " ")
    pieces = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1),
                              lambda i: F.array_join(F.slice(ws, i, k), " "))))
    return (grams.where("words > 2").select("lang", "f", F.explode(pieces).alias("gram"))
            .groupBy("lang", "gram").agg(F.max("f").alias("top")))


def cut_scores(cand: DataFrame, grams: DataFrame, factor: int) -> DataFrame:
    """lang, gram, a, k, l, r, score: the lowest-scoring cut of each phrase
    after its first k words, ties to the smallest k; score is
    floor(factor * a / (l + r)) in exact decimals.

    A word is part of many phrases: its count is copied to ``SALTS`` keys and
    the phrases are dealt over them."""
    ws = F.split("gram", " ")
    salt = F.pmod(F.xxhash64("gram"), F.lit(SALTS)).cast("int")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    first, rest = (F.array_join(F.slice(ws, *at), " ") for at in ((F.lit(1), F.col("k")), (F.col("k") + 1, F.col("words") - F.col("k"))))
    cuts = (cuts.withColumn("first", first).withColumn("rest", rest)
            .withColumn("s1", F.when(F.col("k") == 1, salt).otherwise(0))
            .withColumn("s2", F.when(F.col("k") == F.col("words") - 1, salt).otherwise(0)))
    salts = F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    counts = grams.where(F.col("words").between(1, ORDER - 1)).select("lang", "gram", "f", F.explode(salts).alias("s"))
    for part, s, name in (("first", "s1", "l"), ("rest", "s2", "r")):
        cuts = cuts.join(counts.select("lang", F.col("gram").alias(part), F.col("s").alias(s),
                                       F.col("f").alias(name)), ["lang", part, s])
    score = F.expr(f"CAST({factor} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + r)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "gram", "a").agg(best.alias("_b")).select("lang", "gram", "a", "_b.*")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, top: int = 2000,
                 factor: int = 2_000_000, cover: tuple[int, int] = (80, 100)) -> DataFrame:
    """The ``top`` phrases of two to four words of each language: lang, rank,
    phrase, a, l, r, n, score.

    Text is lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line breaks,
    and these into words at spaces and tabs.  A phrase needs ``least``
    occurrences; it is left out if a longer one of at least 80/100 of its count
    holds it.  Ties of score go to the larger count, then to the smaller phrase.

    Null and empty texts have no words, a null language counts as ``und``;
    repeated rows count each; an empty table gives no rows; other columns are
    ignored whatever their names.  Texts and words of any length take part
    whole.
    """
    grams = gram_counts(docs, least, lang, text)
    cand = grams.where("words > 1")
    share, whole = (F.lit(x).cast("decimal(18,0)") for x in cover)
    held = F.col("top").cast("decimal(19,0)") * whole >= F.col("f").cast("decimal(19,0)") * share
    kept = (cand.join(inside_longer(grams), ["lang", "gram"], "left")
            .where(~F.coalesce(held, F.lit(False))).select("lang", "gram", "words", F.col("f").alias("a")))
    scored = cut_scores(kept, grams, factor)
    best = top_n(scored, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("gram")], top,
                 salt_col="gram", rank_col="rank")
    n = grams.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"),
                                       "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def compact_paths(grams: DataFrame) -> DataFrame:
    """lang, path, edges, least, most: the frequent edges of ``grams`` (rows of
    ``ORDER`` words) with unary paths compacted to one phrase, and the smallest
    and largest count on it.

    Edge e is followed by edge x in a path if x is the only edge out of the node
    that e enters and e the only one into it.  Pointers to the first edge of
    each path are doubled until they stand; edges of a ring, which has no first
    one, stay single.  Nothing is collected: one row an edge in each round.
    """
    edges = grams.where(F.col("words") == ORDER).select(
        "lang", "gram", "f", F.substring_index("gram", " ", ORDER - 1).alias("tail"),
        F.substring_index("gram", " ", 1 - ORDER).alias("head"))

    def only(node: str, name: str) -> DataFrame:
        return (edges.groupBy("lang", node).agg(F.count("*").alias("_n"), F.min("gram").alias(name))
                .where("_n = 1").select("lang", F.col(node).alias("node"), name))
    links = only("head", "before").join(only("tail", "gram"), ["lang", "node"]).where("before <> gram")
    at = to_scratch(edges.select("lang", "gram", "f").join(links.drop("node"), ["lang", "gram"], "left")
                    .withColumn("far", F.when(F.col("before").isNull(), 0).otherwise(1).cast("long"))
                    .withColumn("first", F.coalesce("before", "gram")).drop("before"), "phrase-paths")
    open_, reach = at.where("far > 0").count(), 1
    while open_ and reach <= open_:
        ahead = at.where("far > 0").select("lang", F.col("gram").alias("first"), F.col("first").alias("_first"),
                                           F.col("far").alias("_far"))
        at = to_scratch(at.join(ahead, ["lang", "first"], "left").select(
            "lang", "gram", "f", (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"),
            F.coalesce("_first", "first").alias("first")), "phrase-paths")
        reach *= 2
        loose = at.where("far > 0").select("lang", "first").distinct().join(
            at.where("far > 0").select("lang", F.col("gram").alias("first")), ["lang", "first"], "left_semi")
        if loose.isEmpty():
            break
    starts = at.where("far = 0").select("lang", F.col("gram").alias("first"))
    ringed = at.join(starts, ["lang", "first"], "left_anti")
    at = at.join(starts, ["lang", "first"], "left_semi").unionByName(
        ringed.withColumn("first", F.col("gram")).withColumn("far", F.lit(0).cast("long")))
    last = F.struct("far", F.substring_index("gram", " ", -1).alias("w"))
    words = F.transform(F.array_sort(F.collect_list(last)), lambda x: x["w"])
    g = at.groupBy("lang", "first").agg(words.alias("_w"), F.min("f").alias("least"), F.max("f").alias("most"))
    path = F.concat_ws(" ", F.substring_index("first", " ", ORDER - 1), F.array_join("_w", " "))
    return g.select("lang", path.alias("path"), F.size("_w").alias("edges"), "least", "most")
