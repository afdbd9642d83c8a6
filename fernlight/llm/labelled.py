"""A bounded sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_fold

#: Labelled documents that a classifier is fitted on, at most.
SAMPLE = 8_000


def sample(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str = "doc_id", text_col: str = "text", folds: int, held_out: int, most: int = SAMPLE) -> DataFrame:
    """id, text, label of at most `most` labelled documents outside the held-out fold, spread evenly by a hash of the id.

    Rows without id or label are left out; of several labels of one id the largest holds, of several texts the greatest.
    The ids are at most `most`, so they are broadcast, and only the sampled texts are shuffled.
    """
    own = labels.where(F.col(label).isNotNull() & (id_fold(id_col, folds) != held_out))
    ids = own.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.max("text").alias("text"))
