import zlib

import numpy as np
from pyspark.sql import functions as F

from plotmark.llm import language_id as lid
from tests.llm.conftest import prose


def test_held_out_accuracy_and_remainders(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = lid.op5_language_id(spark, d).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in unseen) >= 0.98 * len(unseen)
    assert all(0 <= r.score <= 1 for r in rows)


def test_counts_of_long_texts_do_not_depend_on_chunks(monkeypatch):
    text = "Ünïcode words, 12 and more; " * 50
    whole = lid.ngram_counts(text)
    monkeypatch.setattr(lid, "CHUNK", 17)
    assert (lid.ngram_counts(text) == whole).all()
    assert lid.ngram_counts("12 !?") is None and lid.ngram_counts("") is None and lid.ngram_counts(None) is None


def test_penalties_leave_unused_weights_at_zero():
    rows = [(np.array([i]), np.array([1.0]), i % 2) for i in range(4)] * 20
    w = lid.train_ftrl(rows, 2)
    assert (w[4:] == 0).all() and all(w[i].argmax() == i % 2 for i in range(4))


def test_temperature_tempers_wrong_certainty():
    logits = np.array([[9.0, 0.0]] * 10)
    assert lid.fit_temperature(logits, np.array([0] * 6 + [1] * 4)) > 5


def test_odd_documents(odd_docs, no_docs):
    model = lid.fit_language_model(odd_docs)
    got = lid.predict_language(odd_docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == odd_docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2, 11)} == {"und"} and {r.lang_pred for r in got if r.doc_id in (3, 5, 10)} == {"en"}
    nothing = lid.fit_language_model(no_docs)
    assert {r.lang_pred for r in lid.predict_language(odd_docs, nothing).collect()} == {"und"}
    assert lid.predict_language(no_docs, model).count() == 0


def test_many_labels_are_bounded(spark):
    rows = [(i, prose(40, i), "en" if i % 2 else "fr") for i in range(60)] + [(100 + i, prose(40, 100 + i), f"odd{i}") for i in range(300)]
    model = lid.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=3)
    assert model.languages == ["en", "fr", "odd0"] and model.weights.shape[1] == 3
