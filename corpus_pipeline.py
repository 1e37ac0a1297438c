"""From raw documents to token ids: language, near-duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, the stage before's result;
`run` writes every result to the checkpoint folder before the next stage reads it.

All stages but the last return the columns of docs, whatever their names, with their values (texts
without personal data; n_chars follows its text). The last returns doc_id, n_tokens, ids, ids_sha256 and
decoded_sha256 only. Null, empty and letterless texts have no known language and go at the first
stage; a null doc_id, lang or source is a value like any other, and a document without a source is
mixed as a source of its own; rows equal in every column count as one near copy; texts of any length
are read whole; of near copies the smallest doc_id stays (a null one last); a document whose copies
come to none is not emitted; an empty table passes every stage and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import bpe, language_id, mixing, pii, simhash
from gristmill.llm.queries import TOKENIZER
from gristmill.runtime import cut, table

#: Documents go whose language is unknown or holds less of the pooled probability than this. A short
#: clean text can fall a little under one half, so the bar lies below it.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language."""
    return language_id.keep_known(docs, language_id.train(language_id.sample(docs)), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's target asks for."""
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each emitted document, with digests of ids and decoded text."""
    return bpe.encode_documents(docs, TOKENIZER)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Trained models and fingerprints are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
