"""A corpus pipeline: toxicity, language, near copies, mixture, tokens. Each stage works on what the one before it kept.

Every stage takes documents with any columns besides doc_id, text and lang; all but the last return the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, language, mixing, queries, simhash, toxicity
from tessera.llm.common import stored, table

#: Share of the words by domain in the mixture.
MIX = {"good": 0.8, "poor": 0.2}
#: The most that mixing repeats a document, to begin with; where the target is out of reach, it is doubled so often at most.
HIGH, WIDEN = 16.0, 6


def apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns in one, so that an operator's columns can't clash with theirs."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(0)).alias("_kept"))


def together(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"_kept.`{c}`") for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity under 0.7; the model learns from the labelled ones.

    Null and empty texts have the score of a text without words, which is low, and stay. Rows are judged one by one: repeated
    and null ids make no difference, except that labels of null ids count nowhere. Without labels all stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return together(toxicity.score(apart(docs), model).filter(F.col("score") < queries.TOXIC_AT), docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the centroids know; the model learns from text and lang of the documents.

    Null texts and texts without a letter go: they have no language. Rows are judged one by one, whatever their ids.
    """
    return together(language.predict(apart(docs), language.train(docs)).filter("not rejected"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of copies and near copies: those that the fingerprints of op8_simhash link,
    and texts of a similarity of 0.8 (five words), which two bits can't find all of.

    Empty texts are copies of one another. Of rows that repeat an id one stays; rows with a null id can't be told apart and
    stay.
    """
    linked = stored(simhash.groups(simhash.fingerprints(docs)))
    return simhash.first_of_each(docs, linked=linked)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say. Rates are 1 at least: none goes, some are repeated, as whole
    rows with their ids, as often as the target needs; a reader that needs each once takes distinct ones.

    Null and empty texts have no words and a rate of 1. A warning tells when the bounds put the target out of reach. Without
    labels of both domains the other's share is left out.
    """
    labels = queries.domain_labels(spark, sf_dir).filter(F.col("domain").isin(*MIX)).join(docs.select("doc_id"), "doc_id", "left_semi")
    model = mixing.fit(docs, stored(labels))
    rated = mixing.mixed(apart(docs), model, {d: MIX[d] for d in model.domains}, low=1.0, high=HIGH, widen=WIDEN)
    return together(mixing.repeated(rated), docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids by the byte-level vocabulary of 50k entries; null and empty texts have none."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    return found.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_copies", drop_near_copies),
    ("mixture", mix),
    ("tokens", tokenize),
]

#: The trained stages can't be written in SQL; tests/llm/test_query_contracts.py compares each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
