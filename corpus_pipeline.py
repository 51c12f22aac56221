"""The training-data pipeline: from documents to token ids, each stage an operator of weftline.llm.

A stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the columns
of ``docs``, whatever else it has; none of them clashes with a stage's own. An empty table gives an empty table in every stage.
Null text counts as empty text, a null source as a source; the docstrings say what becomes of ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import exact, mix, pieces, queries, shingles, toxicity
from weftline.llm.common import Scratch, scope


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more go; it learns from labels outside the held-out third.

    Null and empty texts score 0 and stay; equal texts score alike, so repeated rows stay or go together. A null doc_id has no label.
    """
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels").where(queries.fold(3) != 1))
    return toxicity.keep_clean(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one row stays: the longest, then the smallest doc_id, a null one last.

    Null, empty and blank texts are one group. Of rows with the same text and doc_id exactly one stays.
    """
    return exact.keep_one(docs, Scratch(spark, "pipe-exact"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by near-duplicates the document with the smallest doc_id stays; rows that share it stay together.

    A document without a word is linked with nothing and stays; so does a null doc_id only where all of its group are null.
    """
    return shingles.keep_one(docs, Scratch(spark, "pipe-near"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, 0 to 2 times; rows alike in doc_id and size are taken together.

    A document without a word counts no words: it comes as often as its source's certain copies.
    """
    return mix.repeated(docs, Scratch(spark, "pipe-mix"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids of each row, their digest and that of the decoded text; a null or empty text has the begin and end ids."""
    return pieces.encode(docs, queries.model_path(), ("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("minhash near-dedup", near_stage), ("mixing", mix_stage), ("sentencepiece", pieces_stage)]

#: Trained scores, 64-bit set hashes and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others kept; a stage's own tables go once its output is written, and that output with the next one's."""
    scratch, docs, before = Scratch(spark, "pipeline"), queries.table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES[:-1]:
        with scope():
            docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            scratch.drop(before)
        before = name.replace(" ", "-")
    return STAGES[-1][1](spark, docs, sf_dir)
