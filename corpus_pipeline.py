"""Corpus pipeline: quality, near-duplicates, personal data, source mixing, packing.

Every stage takes the documents that its predecessor kept and, but for the last, returns rows
with the columns of ``documents``, extra ones and those with names of the operators included.  Null
ids, null texts (empty ones), repeated rows and empty tables pass through all stages; what each
makes of them is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passgrid.llm.common import documents, staged
from passgrid.llm.jaccard_join import keep_representatives
from passgrid.llm.mixing import sample_mixture
from passgrid.llm.packing import pack
from passgrid.llm.pii import redact
from passgrid.llm.quality import keep_good, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject.

    Texts are scored one by one, so null ids and repeated rows stay or go by their text; a null text
    counts as an empty one.  Without labels the score is 0.5 and all stay.  No rows give none.
    """
    return keep_good(docs, train(docs, documents(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (that of the least id) of each group linked at five words and 0.8.

    Of repeated rows one stays; a row without id stays only if its group has none with an id; null and
    empty texts are one group.  No rows give none.
    """
    return keep_representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by marks.

    All rows stay, repeated ones and those without id too; a null text stays null.  No rows give none.
    """
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that source, language and topic meet their target shares, as far as none is repeated.

    Targets are observed token shares to the power 0.7, drawn to 0.6 of all tokens.  Null sources and
    languages are a value of their own; rows of equal id (null ids too) are drawn alike.  No rows give none.
    """
    return sample_mixture(docs, whole_rows=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 4096 tokens.

    Rows are packed one by one, repeated ones and those without id too; a null text is one token (its
    end).  No rows give none.
    """
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: Trained models, hashed paths and tokenizers are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
