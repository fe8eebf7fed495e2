"""Registered queries of the subpackage: each applies one operator, with its
production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import (ann, backoff_lm, chat, decontam, langid, packing, phrases, secret_scan, sharding,
                       simhash, spelling, surrogate, token_files)
from vigil.llm.common import id_crc32, text_or_empty
from vigil.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MARKED = "\\### Assistant: </turn> ok"


@register
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -7 of the contract, formatted by
    prefix-target expansion; digests read back from the formatted examples.
    formatted_chars: length of all examples of the conversation together."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)],
                                  turns.schema)
    return chat.digest_examples(chat.prefix_target_examples(turns.unionByName(extra)))


ORACLE["op9_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                   (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
o AS (SELECT *, row_number() OVER w AS pos, sum(8
        + length(replace(replace(role, '<|', '<||'), chr(10), '<|n|>')) + 1
        + length(replace(text, '<|', '<||')) + 10) OVER w AS until,
        count(*) OVER (PARTITION BY conv_id) AS n
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                          ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(until) FILTER (role = 'assistant' OR pos = n)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR pos = n) AS n_examples
FROM o GROUP BY conv_id"""


@register
def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes; equal texts are
    neighbours and stay in one shard unless they are more than 1/64 of it."""
    text = F.col("text").cast("string")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(text_or_empty("text")).alias("text_crc32"), F.xxhash64(text).alias("_group"))
    out = sharding.shard_by_bytes(docs, 40, "size", ["_group"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      "slot", F.lit(None).cast("int").alias("grown_shard"))


@register
def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(df, F.col("vec_id") % 100 == 0)


@register
def op8_anchor_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links at two bits or fewer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.simhash_components(docs, shingle=3, max_bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


@register
def op2_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; dictionaries learned from the documents that
    are not held out."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", (id_crc32("doc_id") % 4 == 2).alias("held_out"))
    learned = langid.learn_dictionaries(docs.where(~F.col("held_out")))
    return langid.identify(docs.drop("lang"), learned).drop("text")


def word_tokenizer() -> str:
    """Path of the public word tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@register
def op5_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised, in sequences of at most 4096 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, word_tokenizer(), capacity=4096, end_id=1)


@register
def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret candidate of all documents with the forest's score.  The
    labelled findings are a stand-in, see reviewed_findings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secret_scan.scan_secrets(docs)
    return found.select(F.col("key").alias("doc_id"), "start", "length",
                        F.sha2("value", 256).alias("value_sha256"), "assigned", "score", "is_secret")


@register
def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogate.replace_entities(docs, key="surrogate key of the query")


@register
def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, all documents searched."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))


@register
def op4_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under the model of those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = backoff_lm.score_texts(docs, id_crc32("doc_id") % 5 != 1)
    return out.select("doc_id", (~F.col("trained_on")).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score")


@register
def op11_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest, read back from the token files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = token_files.write_token_files(docs, scratch_path(spark, "token-files"), word_tokenizer())
    return token_files.read_documents(spark, files).withColumnRenamed("key", "doc_id")


@register
def op12_prefix_suffix_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its near words, form and root."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.group_variants(docs)


@register
def op13_de_bruijn_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best-scoring phrases of each language of all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE["op13_de_bruijn_phrases"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM piece),
pos AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM ws),
gram AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
         FROM pos, (VALUES (1), (2), (3), (4)) AS k(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
sub AS (SELECT c.lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS top
        FROM c, (VALUES (2), (3)) AS j(j), (VALUES (1), (2), (3)) AS i(i)
        WHERE j < words AND i + j - 1 <= words GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN sub USING (lang, phrase)
         WHERE top IS NULL OR 100 * top::HUGEINT < 80 * a::HUGEINT),
cut AS (SELECT kept.lang, kept.phrase, a, x.k AS cut_k, l.f AS l, r.f AS r,
               2000000 * a::HUGEINT // (l.f + r.f) AS score
        FROM kept JOIN (VALUES (1), (2), (3)) AS x(k) ON x.k < words
        JOIN f l ON l.lang = kept.lang AND l.phrase = array_to_string(w[1:x.k], ' ')
        JOIN f r ON r.lang = kept.lang AND r.phrase = array_to_string(w[x.k + 1:words], ' ')),
best AS (SELECT lang, phrase, a, arg_min({'l': l, 'r': r, 's': score}, score::HUGEINT * 4 + cut_k) AS b
         FROM cut GROUP BY lang, phrase, a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.s DESC, a DESC, phrase) AS rank,
                  phrase, a, b.l AS l, b.r AS r, b.s::BIGINT AS score FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
