"""Event text classifier and the event-ML batch job (M1-M3, E10, E11, I6,
I7, A27).

The model is TF-IDF (lower-case tokens of two or more word characters,
English stop words removed, idf = ln((1 + n) / (1 + df)) + 1, L2 norm) with a
multinomial naive Bayes (Laplace smoothing 1, empirical class priors),
written as plain DataFrame aggregates; the learned terms are a table that
scoring joins, all on the JVM.  The stop words are a parameter; the default is
Spark's built-in English list.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.scalar import sentiment_of
from vigil.session import stored

# --- fixed values (must equal the reference's rules) ---------------------
# labelled training phrases: (text, category)
TRAINING_DATA = [
    ("hello", "greeting"), ("hi there", "greeting"), ("hey", "greeting"),
    ("good morning", "greeting"), ("good afternoon", "greeting"), ("welcome", "greeting"),
    ("howdy", "greeting"), ("greetings", "greeting"),
    ("goodbye", "farewell"), ("bye", "farewell"), ("see you later", "farewell"),
    ("farewell", "farewell"), ("take care", "farewell"), ("good night", "farewell"),
    ("catch you later", "farewell"),
    ("what is this", "question"), ("how does it work", "question"), ("why is that", "question"),
    ("where are you", "question"), ("when did it happen", "question"), ("who are you", "question"),
    ("can you help", "question"),
    ("wow", "exclamation"), ("amazing", "exclamation"), ("incredible", "exclamation"),
    ("awesome", "exclamation"), ("great job", "exclamation"), ("fantastic", "exclamation"),
    ("unbelievable", "exclamation"),
    ("the weather is nice", "neutral"), ("processing data", "neutral"), ("system update", "neutral"),
    ("running task", "neutral"), ("status report", "neutral"), ("log entry", "neutral"),
    ("event recorded", "neutral"),
]
ALPHA = 1.0
EVENT_SCHEMA = T.StructType([
    T.StructField("eventId", T.StringType()), T.StructField("eventType", T.StringType()),
    T.StructField("occurredAt", T.StringType()), T.StructField("name", T.StringType()),
])
# --------------------------------------------------------------------------

COMMON_NUMBERS = 1_000_000        # broadcast of the common terms: terms x (classes + 6) at most
BATCH = 256                       # texts handed to Python at once
_NOT_LATIN = r"[^\x00-\u024F\u2000-\u206F]"
_LATIN_TOKEN = re.compile(r"\w{2,}")
_TOKEN = r"[\p{L}\p{N}_]{2,}"      # two or more word characters of any script


def english_stop_words() -> list[str]:
    """Spark's built-in English list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def tokens(text: Column, stop_words: list[str]) -> Column:
    toks = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), 0)
    if not stop_words:
        return toks
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(toks, lambda t: ~F.array_contains(stop, t))


def training_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRAINING_DATA, "text string, label string") \
        .withColumn("doc_id", F.monotonically_increasing_id())


@dataclass
class EventModel:
    """``terms``: a table (term, idf, lp: log probability of the term in each
    class) of any size; ``classes``: (label, log prior) in order of the labels;
    terms of an idf up to ``common`` are few enough to be broadcast."""
    terms: DataFrame
    classes: list[tuple[str, float]]
    common: float = math.inf


def with_counts(rows: DataFrame, text: Column, stop_words: list[str]) -> DataFrame:
    """``rows`` with ``counts``, the distinct terms of the text and how often
    each stands there, so no token is shuffled to be counted.  Python cuts
    texts of Latin letters and general punctuation, on which ``\\w`` and
    ``_TOKEN`` agree in any Unicode version; other texts come cut at blanks."""
    stop = frozenset(stop_words)

    @F.arrow_udf("array<struct<term:string,tf:double>>")
    def count(texts: pa.Array, cut: pa.Array) -> pa.Array:
        offsets, terms, tf = [0], [], []
        for t, c in zip(texts, cut):
            t = t.as_py()
            n = Counter([w for w in t.split(" ") if len(w) > 1] if c.as_py() else _LATIN_TOKEN.findall(t))
            for w in stop & n.keys():
                del n[w]
            terms.extend(n)
            tf.extend(n.values())
            offsets.append(offsets[-1] + len(n))
        both = [pa.array(terms, pa.string()), pa.array(tf, pa.float64())]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(both, ["term", "tf"]))
    conf, batch = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(batch, "10000")) > BATCH:
        conf.set(batch, str(BATCH))
    low = F.lower(F.coalesce(text, F.lit("")))
    cut = low.rlike(_NOT_LATIN)
    low = F.when(cut, F.regexp_replace(low, r"[^\p{L}\p{N}_]+", " ")).otherwise(low)
    return rows.withColumn("counts", count(low, cut))


def counted_documents(train: DataFrame, stop_words: list[str]) -> DataFrame:
    """(doc_id, label, counts) written once.  Rows of the same id and label are
    one document: their terms are added up and stay rows of one term each, so
    that no document is gathered."""
    d = train.select("doc_id", "label", "text")
    again = stored(d.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    if again.isEmpty():
        return stored(with_counts(d, F.col("text"), stop_words).drop("text"), "counts")
    a = again.select(F.col("doc_id").alias("_d"), F.col("label").alias("_l"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("label").eqNullSafe(F.col("_l"))
    once = with_counts(d.join(a, same, "left_anti"), F.col("text"), stop_words).drop("text")
    t = d.join(a, same, "left_semi").select("doc_id", "label", F.explode(tokens(F.col("text"), stop_words)).alias("term"))
    t = t.groupBy("doc_id", "label", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    return stored(once.unionByName(t.select("doc_id", "label", F.array(F.struct("term", "tf")).alias("counts"))), "counts")


def join_terms(rows: DataFrame, terms: DataFrame, common: float) -> DataFrame:
    """``rows`` (of a term each) with the columns of ``terms``.  The common
    terms, most of all rows, meet in a broadcast; only rows of other terms are
    shuffled."""
    if common == math.inf:
        return rows.join(F.broadcast(terms), "term")
    few = terms.where(F.col("idf") <= common)
    rest = rows.join(F.broadcast(few.select("term")), "term", "left_anti")
    return rows.join(F.broadcast(few), "term").unionByName(rest.join(terms.where(F.col("idf") > common), "term"))


def common_idf(idf: DataFrame, most: int) -> float:
    """The idf up to which there are at most ``most`` terms (infinite: all).
    Document frequencies are counted by their number of bits."""
    left, cut = most, math.inf
    sizes = idf.groupBy(F.length(F.bin("df")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"), F.max("idf").alias("idf")).orderBy(F.col("bits").desc()).collect()
    for i, r in enumerate(sizes):
        left -= r["n"]
        if left < 0:
            return sizes[i - 1]["idf"] if i else -math.inf
    return cut


def fit_event_classifier(train: DataFrame, stop_words: list[str] | None = None) -> EventModel:
    """M1: TF-IDF naive Bayes from ``(doc_id, text, label)``.  Terms are counted
    inside each text; documents' norms and the rare terms are shuffled.  The
    terms stay a written table; only the classes (label, count, feature sum)
    and the terms' number reach the driver.  ``stop_words``: Spark's English
    list if not given."""
    stop = english_stop_words() if stop_words is None else stop_words
    counted = counted_documents(train, stop)
    labels = [(r[0], r[1]) for r in train.groupBy("label").agg(F.count(F.lit(1))).orderBy("label").collect()]
    n = sum(c for _, c in labels)
    tf = counted.select("doc_id", F.inline("counts"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = stored(df.withColumn("idf", F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1), "idf")
    common = common_idf(idf, COMMON_NUMBERS // (len(labels) + 6))
    w = join_terms(tf, idf.drop("df"), common).withColumn("x", F.col("tf") * F.col("idf"))
    norm = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n"))
    x = counted.join(norm, "doc_id").select("label", "_n", F.inline("counts"))
    fc = x.groupBy("term", "label").agg(F.sum(F.col("tf") / F.col("_n")).alias("fc"))
    fc = fc.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("label", "fc"))).alias("m"))
    fc = stored(fc.join(idf, "term").select("term", "idf", F.transform_values(
        "m", lambda _, v: v * F.col("idf")).alias("m")), "features")
    sums = {r[0]: r[1] for r in fc.select(F.explode("m").alias("label", "fc")).groupBy("label").agg(F.sum("fc")).collect()}
    n_terms = idf.count()
    lp = F.array(*[F.log((F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)) + ALPHA)
                         / F.lit(sums.get(c, 0.0) + ALPHA * n_terms)) for c, _ in labels])
    return EventModel(stored(fc.select("term", "idf", lp.alias("lp")), "terms"),
                      [(c, math.log(k / n)) for c, k in labels], common)


def event_text(parsed: DataFrame) -> Column:
    """Name, else eventType, else ''."""
    return F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("eventType"), F.lit("")), F.lit(""))


def classify_events(events: DataFrame, model: EventModel, id_col: str = "eventId") -> DataFrame:
    """M2: eventId (default 'unknown'), category, confidence = max posterior
    rounded to 4 digits, sentiment; empty text -> neutral / 0.0.

    A sparse product at any size of events and vocabulary: the events' terms,
    counted in each event and written with it, join the model's on the term,
    and one aggregate per event sums the squared weights and, for each class,
    weight x log p(t|c); joint log-likelihood = log prior + sum / norm,
    softmax, arg-max with ties to the first class.  Stop words are not in the
    vocabulary, so they drop out of the join.
    """
    d = events.withColumn("_text", event_text(events)).withColumn("_row", F.monotonically_increasing_id())
    d = stored(with_counts(d, F.col("_text"), []), "events")
    w = join_terms(d.select("_row", F.inline("counts")), model.terms, model.common).withColumn("w", F.col("tf") * F.col("idf"))
    d, sums = d.drop("counts"), w.groupBy("_row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"), *[
        F.sum(F.col("w") * F.col("lp")[i]).alias(f"_s{i}") for i in range(len(model.classes))])
    d = d.join(sums, "_row", "left")
    jll = [F.lit(p) + F.coalesce(F.col(f"_s{i}") / F.col("_norm"), F.lit(0.0)) for i, (_, p) in enumerate(model.classes)]
    d = d.withColumn("_jll", F.array(*jll))
    mx = F.array_max("_jll")
    d = d.withColumn("_x", F.transform("_jll", lambda v: F.exp(v - mx)))
    d = d.withColumn("_p", F.transform("_x", lambda v: v / F.aggregate("_x", F.lit(0.0), lambda a, x: a + x)))
    best = F.array_position(F.col("_p"), F.array_max("_p"))
    classes = F.array(*[F.lit(c) for c, _ in model.classes])
    empty = F.col("_text") == ""
    cat = F.when(empty, "neutral").otherwise(F.element_at(classes, best.cast("int")))
    conf = F.when(empty, 0.0).otherwise(F.round(F.array_max("_p"), 4)).cast("float")
    return d.select(F.coalesce(F.col(id_col), F.lit("unknown")).alias("eventId"), cat.alias("category"),
                    conf.alias("confidence"), sentiment_of(cat).alias("sentiment"),
                    *[c for c in events.columns if c != id_col], F.col("_text"))


def parse_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """bytes/string payload -> event struct; null payloads dropped.
    Malformed JSON keeps the payload as the event name (E11) and sets
    ``is_malformed`` (quirk Q15)."""
    s = raw.select(F.col(value).cast("string").alias("_raw")).filter(F.col("_raw").isNotNull())
    p = s.withColumn("_e", F.from_json("_raw", EVENT_SCHEMA, {"mode": "PERMISSIVE"}))
    bad = F.col("_e").isNull() | (F.col("_e.eventId").isNull() & F.col("_e.eventType").isNull()
                                  & F.col("_e.name").isNull() & ~F.trim(F.col("_raw")).startswith("{"))
    return p.select(F.col("_e.eventId").alias("eventId"), F.col("_e.eventType").alias("eventType"),
                    F.col("_e.occurredAt").alias("occurredAt"),
                    F.when(bad, F.col("_raw")).otherwise(F.col("_e.name")).alias("name"),
                    bad.alias("is_malformed"))


def serialize_predictions(pred: DataFrame) -> DataFrame:
    """key = eventId, value = JSON of the prediction."""
    return pred.select(F.col("eventId").alias("key"),
                       F.to_json(F.struct("eventId", "category", "confidence", "sentiment")).alias("value"))


def predictions_table(pred: DataFrame, at: Column) -> DataFrame:
    """Rows of the predictions table, ordered by (timestamp, event_id)."""
    return pred.select(at.cast("timestamp").alias("timestamp"), F.col("eventId").alias("event_id"), "category",
                       "confidence", "sentiment")


def batch_predict(raw: DataFrame, model: EventModel, sink_path: str | None = None,
                  fmt: str = "json", sink_options: dict[str, str] | None = None) -> DataFrame:
    """M3 + S9: parse -> classify -> serialize -> sink (a path, or a topic by
    ``sink_options`` with ``fmt="kafka"``).  The row count is taken with
    ``observe`` during the single write (no second scan); nothing is written
    when there are no events."""
    out = serialize_predictions(classify_events(parse_events(raw), model))
    if sink_path is None and not sink_options:
        return out
    from pyspark.sql import Observation
    obs = Observation("predictions")
    observed = out.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = observed.write.mode("append").format(fmt).options(**(sink_options or {}))
    w.save(sink_path) if sink_path else w.save()
    return out.sparkSession.createDataFrame([(int(obs.get.get("rows", 0)),)], "rows long")


def classifier_metadata(train: DataFrame) -> DataFrame:
    """Samples, classes and the sorted class list."""
    return train.agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct("label").alias("n_classes"),
                     F.array_join(F.array_sort(F.collect_set("label")), ",").alias("classes"))
