"""Exact deduplication with a heavy-hitter split, in DataFrame operations alone.

A Misra-Gries sketch (Spark's frequent-items aggregate) in each of `BUCKETS` hash buckets names at most `BUCKETS * TOP`
digests that may be frequent; an exact count verifies them, and the winners, whose number that product bounds, are
broadcast so that rows of frequent digests are decided where they are read. The remaining digests, none of which is
frequent, are shuffled in the ordinary way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import SPACE, free_name, staged

BUCKETS, TOP, TRACKED = 64, 16, 1024


def digest(text: Column) -> Column:
    """sha256 (lowercase hex) of the text with every run of ASCII white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256)


def heavy_winners(keyed: DataFrame) -> DataFrame:
    """digest, first, size of verified frequent digests; at most BUCKETS * TOP rows. keyed: digest, key."""
    named = (
        keyed.groupBy(F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).alias("bucket"))
        .agg(F.expr(f"approx_top_k(digest, {TOP}, {TRACKED})").alias("top"))
        .select(F.explode("top").alias("top"))
        .where("top.count > 1")
        .select(F.col("top.item").alias("digest"))
    )
    return keyed.join(F.broadcast(named), "digest", "left_semi").groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")


def _key(id_col: str) -> Column:
    """Orders rows of one text: smallest id first, null ids last."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"))


def exact_dedup(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other. Of rows that share both text and id exactly one stays; a row with a
    null id stays only where its group has no id, and its keep_id is then null. Other columns are ignored; an empty
    table gives no rows. Texts are hashed whole.
    """
    rows = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row")).alias("key"), digest(F.col(text_col)).alias("digest"))
    keyed = staged(rows, "digests")
    winners = staged(heavy_winners(keyed), "winners")
    heavy = keyed.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    light = keyed.join(F.broadcast(winners), "digest", "left_anti").select("*", F.min("key").over(group).alias("first"), F.count(F.lit(1)).over(group).alias("size"))
    return heavy.unionByName(light).select(
        F.col("key.id").alias("doc_id"), F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("key.row") == F.col("first.row")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns; cases as in exact_dedup.

    Copies of frequent texts go where they are read; the text itself is shuffled once, for the rest.
    """
    mark, key = free_name(docs, "digest"), free_name(docs, "key")
    keyed = staged(docs.select(_key(id_col).alias("key"), digest(F.col(text_col)).alias("digest")), "digests")
    winners = staged(heavy_winners(keyed), "winners").select(F.col("digest").alias(mark), F.col("first").alias(f"{key}_first"))
    rows = docs.withColumns({mark: digest(F.col(text_col)), key: _key(id_col)}).join(F.broadcast(winners), mark, "left")
    rows = rows.where(F.col(f"{key}_first").isNull() | (F.col(key) == F.col(f"{key}_first")))
    order = Window.partitionBy(mark).orderBy(key)
    return rows.withColumn(f"{key}_n", F.row_number().over(order)).where(F.col(f"{key}_n") == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
WITH keyed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM keyed WINDOW g AS (PARTITION BY text_sha256)
"""
