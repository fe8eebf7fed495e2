"""The classifier's terms are counted inside each text; common terms meet in a
broadcast, the others in a shuffle (F19-F21)."""

import math
from collections import Counter, defaultdict

import pytest

from vigil.operators import classifier as C

DOCS = [(1, "the cat sat on the mat the end", "en"), (2, "le chat et le chien", "fr"), (2, "le chien dort", "fr"),
        (3, "the the dog — ÄRGER naïve x2", "en"), (3, "le dog", "fr"), (4, "猫 猫犬 the a_b", "en"),
        (None, "the lost", "en"), (5, None, "fr"), (6, "", "en")]


def plain_model(docs, cut):
    tf = defaultdict(Counter)
    for i, text, label in docs:
        tf[i, label].update(cut(text))
    n, df = len(docs), Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    norm, fc = Counter(), defaultdict(Counter)
    for (i, _), c in tf.items():
        norm[i] += sum((f * idf[t]) ** 2 for t, f in c.items())
    for (i, label), c in tf.items():
        for t, f in c.items():
            if i is not None:
                fc[label][t] += f * idf[t] / math.sqrt(norm[i])
    labels = sorted({x[2] for x in docs})
    held = {t for label in labels for t in fc[label]}
    return {t: [math.log((fc[c][t] + 1) / (sum(fc[c].values()) + len(idf))) for c in labels] for t in held}


@pytest.mark.parametrize("numbers", [0, 24, 1_000_000])
def test_fit_equals_a_plain_model(spark, monkeypatch, numbers):
    import re
    monkeypatch.setattr(C, "COMMON_NUMBERS", numbers)
    model = C.fit_event_classifier(spark.createDataFrame(DOCS, "doc_id long, text string, label string"), stop_words=[])
    got = {r.term: list(r.lp) for r in model.terms.collect()}
    want = plain_model(DOCS, lambda t: re.findall(r"\w{2,}", (t or "").lower()))
    assert got.keys() == want.keys()
    for t in want:
        assert got[t] == pytest.approx(want[t])
    held = model.terms.where(model.terms.idf <= model.common).count()
    assert held * 8 <= max(numbers, 0) or model.common == math.inf and len(want) * 8 <= numbers
    events = spark.createDataFrame([("a", None, None, "the the cat"), ("b", None, None, "le chien"), ("c", None, None, "")],
                                   "eventId string, eventType string, occurredAt string, name string")
    found = {r.eventId: r.category for r in C.classify_events(events, model).collect()}
    assert found == {"a": "en", "b": "fr", "c": "neutral"}


def test_counts_of_a_text(spark):
    rows = spark.createDataFrame([(1, "The the_x the ⅠⅠ a"), (2, "猫猫, 猫猫! Ab"), (3, None)],
                                 "i long, text string")
    got = {r.i: {c.term: c.tf for c in r.counts} for r in C.with_counts(rows, rows.text, ["ab"]).collect()}
    assert got == {1: {"the": 2.0, "the_x": 1.0, "ⅰⅰ": 1.0}, 2: {"猫猫": 2.0}, 3: {}}
