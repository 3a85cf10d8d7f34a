"""The corpus pipeline: five stages over `documents`, each on what the one before it kept.

1. language: rejects documents without a language (no letters, or no known n-gram).
2. near_dup: one document of each group of near copies stays (Jaccard 0.8 on 5-word shingles).
3. secrets: live-looking secrets are cut out of the texts; widely copied examples stay.
4. mix: each document comes as often (0, 1 or 2 times) as its source's target asks.
5. tokens: BPE ids and their decoded text, as counts and digests, a row for each document.

Stages 1 to 4 return the columns of documents. run() writes each stage's result to the
shared folder and rereads it.

Defined results. Null and empty texts: the first stage rejects them; later stages, given
some, keep them (near_dup as rows without words, mix with size 0 once where the source has
no words at all and otherwise not above its rate, tokens with 0 ids). Null ids: rows without
an id are documents like others. Repeated rows: near_dup leaves one of them. Ties: the
smallest id of a group stays, a null id last. Very long texts are read whole by every stage.
Empty tables give empty results. Further columns, whatever their names, are carried along
unread up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linecensus.llm import bpe, langid, minhash, mixing, secrets
from linecensus.llm.common import save, table

#: Similarity from which the stage takes two documents for near copies; op10's own contract says 0.85.
NEAR = 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known_documents(docs)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.kept_documents(docs, threshold=NEAR)


def secret_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [("language", language), ("near_dup", near_dup), ("secrets", secret_cut), ("mix", mix), ("tokens", tokens)]

#: Hashing, Newton iterations and tokenizer merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
