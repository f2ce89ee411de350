"""The language sample is bounded by rows, and the pipeline stage keeps any column names."""

from loomwork.llm import language_id


def test_sample_is_bounded_whatever_the_ids(spark):
    rows = [(None, f"text {k}", "en") for k in range(300)] + [(7, f"other {k}", "de") for k in range(300)] + [(7, "same", "fr"), (7, "same", "de")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id._sample(df, 100).collect()
    assert len(got) == 100 and len({(r["doc_id"], r["text"]) for r in got}) == 100
    assert len(language_id._sample(df, 10_000).collect()) == 601
    assert {r["lang"] for r in language_id._sample(df.filter("text = 'same'"), 10).collect()} == {"de"}


def test_identified_rows_keep_odd_columns(spark):
    words = {"en": "the house and the garden", "de": "das haus und der garten"}
    rows = [(k, words[lang], lang, k * 1.5) for k in range(40) for lang in words]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` double")
    net = language_id.fit(df.select("doc_id", "text", "lang"))
    kept = language_id.keep_identified(df, net, least=0.0)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == sorted(rows)
