import zlib

import pytest
from pyspark.sql import functions as F

from kinweave.llm import langid
from kinweave.llm.queries import op5_language_id

from .helpers import documents, no_documents, odd_documents


def test_backoff_by_hand():
    words = {"label": ["a", "b"], "gram": ["sun", "sol"], "n": [10, 10]}
    grams = {"label": ["a", "b", "b"], "gram": ["un ", "ol ", "x"], "n": [4, 4, 1]}
    model = langid.build(words, grams, {0: {"a": 10, "b": 10}, 1: {"a": 9, "b": 9}, 3: {"a": 8, "b": 8}})
    scorer = langid.Scorer(model)
    assert scorer.predict("SUN")[0] == "a" and scorer.predict("sol sol sun")[0] == "b"
    assert list(scorer.unseen("fun")) == pytest.approx([-0.30103, -7.0], abs=1e-4)  # "un " alone is known
    assert list(scorer.unseen("x")) == pytest.approx([-7.0, -0.95424], abs=1e-4)
    assert list(scorer.unseen("qq")) == [-7.0, -7.0]
    assert scorer.predict("qq")[0] == "a"  # a tie
    for text in (None, "", "123 _ !?"):
        assert scorer.predict(text) == ("und", 0.0)


def test_cache_resets_change_nothing():
    words = {"label": ["a", "b"], "gram": ["sun", "sol"], "n": [10, 10]}
    model = langid.build(words, words, {0: {"a": 10, "b": 10}, 3: {"a": 10, "b": 10}})
    texts = [f"word{chr(97 + i % 26)} sun thing{chr(97 + i % 7)}" for i in range(60)]
    small, large = langid.Scorer(model, cache=3), langid.Scorer(model)
    assert [small.predict(t) for t in texts] == [large.predict(t) for t in texts]


def test_odd_rows(spark):
    df, rows = odd_documents(spark)
    found = langid.identify(df, langid.train(df)).collect()
    assert len(found) == len(rows)
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {1, 2, 3, 4}
    with pytest.raises(ValueError, match="already"):
        langid.identify_rows(df, langid.train(df), pred_col="score")
    kept = langid.identify_rows(df, langid.train(df), score_col="s2")
    assert kept.columns == [*df.columns, "lang_pred", "s2"] and kept.count() == len(rows)


def test_nothing_to_learn_from(spark):
    model = langid.train(no_documents(spark))
    assert {tuple(r) for r in langid.identify(documents(spark, ["abc", None]), model).collect()} == {(0, "und", 0.0), (1, "und", 0.0)}


def test_sample_is_bounded(spark):
    df = documents(spark, [f"text {i}" for i in range(50)])
    assert langid.sample_rows(df, "doc_id", "text", "lang", 10).count() == 10
    assert langid.sample_rows(df, "doc_id", "text", "lang", 100).count() == 50


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.filter("held_out AND lang IS NOT NULL").select((F.col("lang") == F.col("lang_pred")).alias("ok"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.ok for r in rows) / len(rows) >= 0.97


def test_numerals_are_no_letters(spark):
    found = langid.identify(documents(spark, ["² ½ Ⅷ ①", "Ⅷ", "x²", "12 _ !"]), langid.train(documents(spark, ["one two x"] * 3)))
    assert [r.lang_pred for r in found.orderBy("doc_id").collect()] == ["und", "und", "en", "und"]
