"""The corpus pipeline: language, copies, near copies, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to the shared folder
and reads it again as the next stage's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernlight.llm import exact_dedup, jaccard, langid, packing, secrets
from fernlight.llm.base import documents, staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the models learn from what `docs` holds outside the held-out fold.

    Null, empty and letterless texts go. Without any labelled language every text with a letter stays. Null ids and
    repeated rows stay, each judged by its text; other columns pass through; an empty table gives no rows.
    """
    return langid.keep_identified(docs, langid.train_fold(docs))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space apart: the one with the smallest id.

    Null counts as empty, and one such document stays. A null id stays only where no copy has an id; of rows with one text
    and one id one stays; columns of any name pass through; an empty table gives no rows.
    """
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word shingles: the smallest id.

    Null and empty texts are alike to nothing and stay, as do rows with null ids; an id of several rows goes only if all of
    them are linked to smaller ids; columns of any name pass through; an empty table gives no rows.
    """
    return jaccard.drop_similar(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every finding in their texts replaced.

    Null texts stay null; null ids and repeated rows pass through; n_chars follows a changed text; an empty table gives no
    rows.
    """
    return secrets.redact(docs, secrets.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into training sequences.

    A null or empty text is the end id alone; null ids and repeated rows are packed each by itself; other columns are left
    out; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [("language ID", language), ("exact dedup", copies), ("n-gram Jaccard join", near_copies), ("secret scans", secret_scan), ("packing", pack)]

#: SQL can't express the first stage's models nor the last's tokens; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
