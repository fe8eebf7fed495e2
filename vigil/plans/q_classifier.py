"""Registered event-classification queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import classifier as C
from vigil.operators import warehouse as W
from vigil.plans.registry import query
from vigil.session import scratch_path
from vigil.sources.tables import read_table


def event_messages(spark, sf):
    """Kafka-style JSON payloads built from the events table."""
    ev = read_table(spark, sf, "events")
    return ev.select(F.to_json(F.struct(
        F.col("event_id").cast("string").alias("eventId"), F.col("event_type").alias("eventType"),
        F.col("ts").cast("string").alias("occurredAt"))).alias("value"))


@query("classify_events")
def classify_events(spark, sf):
    """I6 + E11 + M1 + M2 + E10: parse every event payload and classify its
    text with the TF-IDF naive Bayes model."""
    model = C.fit_event_classifier(C.training_frame(spark))
    return C.classify_events(C.parse_events(event_messages(spark, sf)), model) \
        .select("eventId", "category", "confidence", "sentiment")


@query("batch_predict")
def batch_predict(spark, sf):
    """M3 + I7: the serialized (key, value) prediction records of the batch job."""
    model = C.fit_event_classifier(C.training_frame(spark))
    return C.batch_predict(event_messages(spark, sf), model)


def conversation_model(spark, sf):
    """A classifier trained on the documents, labelled by their language."""
    d = read_table(spark, sf, "documents").where("lang IS NOT NULL").select("doc_id", "text", F.col("lang").alias("label"))
    return C.fit_event_classifier(d, stop_words=[])


def conversation_messages(spark, sf):
    """Every turn of the conversations as an event payload with its text."""
    t = read_table(spark, sf, "conversations")
    return t.select(F.to_json(F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("eventId"), F.col("role").alias("eventType"),
        F.col("text").alias("name"))).alias("value"))


# the model and the predictions of conversation_messages; {out}: the last SELECT
CLASSIFIED = r"""
WITH tok AS (SELECT doc_id, lang AS label, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term
             FROM documents WHERE lang IS NOT NULL),
tf AS (SELECT doc_id, label, term, COUNT(*)::DOUBLE AS tf FROM tok GROUP BY ALL),
lab AS (SELECT lang AS label, COUNT(*) AS cnt FROM documents WHERE lang IS NOT NULL GROUP BY lang),
n AS (SELECT sum(cnt)::DOUBLE AS n FROM lab),
idf AS (SELECT term, ln((1 + n) / (1 + COUNT(*))) + 1 AS idf FROM tf, n GROUP BY term, n),
x AS (SELECT doc_id, label, term, tf * idf AS x FROM tf JOIN idf USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(x * x)) AS nrm FROM x GROUP BY doc_id),
fc AS (SELECT label, term, sum(x / nrm) AS fc FROM x JOIN nrm USING (doc_id) GROUP BY label, term),
tot AS (SELECT label, sum(fc) AS tot FROM fc GROUP BY label),
nt AS (SELECT COUNT(*) AS nt FROM idf),
ev AS (SELECT conv_id || '-' || turn AS "eventId", coalesce(nullif(text, ''), nullif(role, ''), '') AS body,
              row_number() OVER () AS row FROM conversations),
et AS (SELECT row, unnest(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM ev),
w AS (SELECT row, term, COUNT(*) * idf AS w FROM et JOIN idf USING (term) GROUP BY row, term, idf),
en AS (SELECT row, sqrt(sum(w * w)) AS nrm FROM w GROUP BY row),
s AS (SELECT row, lab.label, sum(w * ln((coalesce(fc, 0) + 1) / (coalesce(tot, 0) + nt))) / any_value(en.nrm) AS s
      FROM w JOIN en USING (row) CROSS JOIN lab CROSS JOIN nt LEFT JOIN tot ON tot.label = lab.label
      LEFT JOIN fc ON fc.label = lab.label AND fc.term = w.term GROUP BY row, lab.label),
j AS (SELECT ev.row, lab.label, ln(cnt / n) + coalesce(s, 0) AS jll
      FROM ev CROSS JOIN lab CROSS JOIN n LEFT JOIN s ON s.row = ev.row AND s.label = lab.label),
b AS (SELECT row, max(jll) AS mx, arg_max(label, (jll, -unicode(label))) AS best FROM j GROUP BY row),
c AS (SELECT row, 1 / sum(exp(jll - mx)) AS conf FROM j JOIN b USING (row) GROUP BY row),
p AS (SELECT "eventId", CASE WHEN body = '' THEN 'neutral' ELSE best END AS category,
             CASE WHEN body = '' THEN 0.0 ELSE round(conf, 4) END AS confidence
      FROM ev JOIN b USING (row) JOIN c USING (row))
{out}"""


@query("classify_conversations", CLASSIFIED.format(out="""
SELECT "eventId", category, CAST(confidence AS FLOAT) AS confidence, 'neutral' AS sentiment FROM p"""))
def classify_conversations(spark, sf):
    """M1 + M2 + I6 + E11: a model of the documents' languages, kept as a table
    of all their terms, classifies the text of every conversation turn."""
    got = C.classify_events(C.parse_events(conversation_messages(spark, sf)), conversation_model(spark, sf))
    return got.select("eventId", "category", "confidence", "sentiment")


@query("stored_predictions", CLASSIFIED.format(out="""
SELECT "eventId" AS event_id, category, 'neutral' AS sentiment, '2024-03-01' AS day FROM p"""))
def stored_predictions(spark, sf):
    """S12 + M3: the predictions of the conversations appended to the
    predictions table (timestamp, event_id) and read back."""
    got = C.classify_events(C.parse_events(conversation_messages(spark, sf)), conversation_model(spark, sf))
    path = scratch_path(spark, "predictions-table")
    W.write_append(C.predictions_table(got, F.lit("2024-03-01 00:00:00")), path, ["timestamp", "event_id"])
    return spark.read.parquet(path).select("event_id", "category", "sentiment", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))
