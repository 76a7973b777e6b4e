"""From raw documents to token digests: five stages, each over all rows that the stage before kept.

Defined cases of all stages: an empty table gives an empty one; texts of any length are taken whole; columns beside
those of documents stay, whatever their names, up to the last stage, which returns digests only. A row stays as it
is but for what a stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import bpe, mixing, pii, queries, simhash, toxicity
from lexispark.session import remove, scratch

#: Chunks that a worker of the last stage keeps; its workers also hold what earlier stages left.
REMEMBERED = 120_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above their language's toxicity threshold go.

    A null or empty text is scored as one without words, a null language has the threshold of all languages, a null
    id is scored but not learnt from; equal rows go or stay together; without labels of both kinds the share of
    label 1 is every score, so all stay unless nearly all labelled documents are toxic.
    """
    return toxicity.reject(docs, queries.table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: of texts whose sets of five-word shingles are similar.

    That with the smallest id stays, a null id last, of equal ids the row with the smallest hash; null and empty texts
    and texts without words are one group; equal rows are one.
    """
    return simhash.deduplicate(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay.

    A null text stays null, and other nulls stay; n_chars is set anew where there is a text; equal rows stay equal.
    """
    return pii.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order.

    Null, empty and blank texts have no words and are not taken; null is a source of its own; equal rows are offered
    each by itself, and ties of the shuffle go by size.
    """
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of ids and decoded texts: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty, a null id stays, and each row gives one.
    """
    return bpe.digest(docs, queries.tokenizer_path(), remembered=REMEMBERED)


STAGES = [("toxicity", toxicity_stage), ("simhash", simhash_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: No SQL expresses the trained stages; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written to the shared folder and read again, and deleted
    when the next one is written; all are deleted where a stage fails. The last one's rows stay there, as the result reads them."""
    docs, folder, before = queries.table(spark, sf_dir, "documents"), scratch(spark, "pipeline"), None
    try:
        for n, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{n}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    except BaseException:
        remove(spark, folder)
        raise
    return docs
