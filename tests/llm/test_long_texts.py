"""Very long texts in training samples and near copies, and mixing bounds that widen."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import language, mixing, simhash
from tests.llm.test_text_operators import prose


def test_language_of_long_texts(spark):
    rows = [(k, prose(lang, 60), lang) for k, lang in enumerate(["en", "de"] * 40)] + [(100, prose("en", 900_000), "en"), (101, prose("de", 500_000), "de"), (102, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    found = {r["doc_id"]: r for r in language.predict(docs, language.train(docs)).collect()}
    assert all(found[k]["lang_pred"] == lang for k, _, lang in rows[:-1]) and found[102]["lang_pred"] == "und"


def test_near_copies_of_long_texts(spark):
    long = prose("en", 700_000)
    rows = [(1, long), (2, long + " and some more"), (3, "x " + long), (4, prose("de", 400_000)), (5, prose("en", 300)), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, share=1.0, least=1).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}


def test_common_shingles_count_texts(spark, monkeypatch):
    texts = ["a b c d e f g h", "a b c d e x y z", None, "a b c d e", ""] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    keys, rank = simhash.common_shingles(docs, 5, 1.0, 4)
    whole = simhash.shingle_hashes(simhash.words("a b c d e"), 5)
    assert keys.tolist() == whole.tolist() and rank.tolist() == [0]


def test_bounds_widen_until_the_target_is_met(spark):
    rows = [(k, " ".join(f"g{k % 7}{j % 9}" for j in range(60)) if k < 30 else " ".join(f"p{k % 5}{j % 8}" for j in range(60))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, "good" if k < 30 else "poor") for k in range(300)], "doc_id long, domain string")
    model = mixing.fit(docs, labels)
    target = {"good": 0.6, "poor": 0.4}
    with pytest.raises(ValueError, match="missed"):
        mixing.mixed(docs, model, target, allowed=0.01, low=1.0, high=2.0)
    found = mixing.mixed(docs, model, target, allowed=0.01, widen=6, low=1.0, high=2.0)
    share = found.agg(F.sum(F.col("rate") * F.col("n_words") * F.col("posterior")[0]) / F.sum(F.col("rate") * F.col("n_words"))).first()[0]
    assert abs(share - 0.6) < 0.02
