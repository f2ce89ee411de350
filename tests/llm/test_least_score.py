"""The least score rests on every held-out document, and long pieces are read in bounded steps."""

import numpy as np

from loomwork.llm import language_id


def test_every_held_out_document_counts(spark, monkeypatch):
    words = {"en": "the house and the garden", "de": "das haus und der garten"}
    df = spark.createDataFrame([(k, words[lang], lang) for k in range(400) for lang in words], "doc_id long, text string, lang string")
    net = language_id.Network.fresh(["de", "en"], 4)
    seen, plain = [], language_id.predict
    monkeypatch.setattr(language_id, "predict", lambda rows, *a, **k: seen.append(rows.count()) or plain(rows, *a, **k))
    monkeypatch.setattr(language_id, "_sample", None)
    assert 0.5 <= language_id.least_score(df, net) <= 1
    assert seen == [df.filter(language_id.held_out(5)).count()]


def test_steps_do_not_change_what_is_read(monkeypatch):
    reader = language_id.Reader(language_id.Network.fresh(["de", "en"], 4))
    runs = ["a" * n for n in range(1, 200)]
    whole = reader.read(runs)
    monkeypatch.setattr(language_id, "POSITIONS", 130)
    assert np.allclose(whole, reader.read(runs), atol=1e-4)
