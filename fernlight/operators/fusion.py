"""Vector scans, reciprocal-rank fusion, pooling, evidence and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import global_rank
from ..functions.vectors import cosine, cosine_to

#: Candidates of an approximate vector index; the exact scan keeps the same number where it stands in for one.
CANDIDATES = 50
HIGH_VECTOR, EXACT_KEYWORD = 0.78, 3.0
#: Dimensions from which Arrow batches beat interpreted lambdas.
ARROW_FROM = 256


def vector_scan(rows: DataFrame, vector: list[float], column: str = "embedding") -> DataFrame:
    """All rows with a vector of positive cosine, as vector_score."""
    own = cosine_to(vector)(F.col(column)) if len(vector) >= ARROW_FROM else cosine(F.col(column), F.array(*map(F.lit, map(float, vector))))
    return rows.where(F.col(column).isNotNull()).withColumn("vector_score", own).where("vector_score > 0")


def vector_top(rows: DataFrame, vector: list[float], key: str, n: int = CANDIDATES, column: str = "embedding") -> DataFrame:
    """The n nearest rows whatever their score, before any filter."""
    own = cosine(F.col(column), F.array(*map(F.lit, map(float, vector))))
    return rows.where(F.col(column).isNotNull()).withColumn("vector_score", own).orderBy(F.round("vector_score", 9).desc(), key).limit(n)


def fuse(keyword: DataFrame, vector: DataFrame | None, key: str, *, k: int = 60, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """key, keyword_score, vector_score, their ranks and rrf: sums of weight / (k + rank) over the channels that have a row.

    keyword and vector: key and score; vector is None where there is no such channel. Ties rank by key.
    """
    kw = global_rank(keyword.select(key, "keyword_score"), "keyword_rank", F.round("keyword_score", 9).desc(), F.col(key))
    if vector is None:
        missing = {"vector_score": F.lit(None).cast("double"), "vector_rank": F.lit(None).cast("long")}
        return kw.withColumns(missing).withColumn("rrf", F.lit(float(weights[0])) / (F.lit(float(k)) + F.col("keyword_rank")))
    vec = global_rank(vector.select(key, "vector_score"), "vector_rank", F.round("vector_score", 9).desc(), F.col(key))
    part = lambda rank, w: F.coalesce(F.lit(float(w)) / (F.lit(float(k)) + F.col(rank)), F.lit(0.0))
    return kw.join(vec, key, "full_outer").withColumn("rrf", part("keyword_rank", weights[0]) + part("vector_rank", weights[1]))


def evidence(keyword: Column, vector: Column, seq: Column) -> Column:
    kw, vec = F.coalesce(keyword, F.lit(0.0)), F.coalesce(vector, F.lit(0.0))
    return (
        F.when((seq == 0) & (kw > 0), "title_match").when(kw >= EXACT_KEYWORD, "keyword_exact").when(vec > HIGH_VECTOR, "high_vector_match").when(vec > 0, "vector_match").otherwise("keyword_match")
    )


def pool(rows: DataFrame, by: str, k: int, score: str = "score", *ties: str) -> DataFrame:
    """The best row of each group, then the k best: a limit in each group before the shuffle, a top-k after it."""
    order = [F.round(score, 9).desc(), *map(F.col, ties)]
    best = rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("__n = 1").drop("__n")
    return best.orderBy(*order).limit(k)


def normalise(rows: DataFrame, score: str = "score", out: str = "normalized_score") -> DataFrame:
    """Scores by the largest, between 0 and 1; 0 where the largest is 0."""
    top = rows.agg(F.max(score).alias("__top")).withColumn("__one", F.lit(1))
    joined = rows.withColumn("__one", F.lit(1)).join(F.broadcast(top), "__one")
    own = F.when(F.col("__top") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(score) / F.col("__top")))).otherwise(0.0)
    return joined.withColumn(out, own).drop("__one", "__top")


def threshold(rows: DataFrame, k: int, least: float, *order: Column) -> DataFrame:
    """The best max(4k, 20) rows, normalised among themselves, those that reach the threshold, and of them the first k.

    The top slice is taken once; its largest score is found in the one task that holds it.
    """
    top = rows.orderBy(*order).limit(max(4 * k, 20)).withColumn("__top", F.max("score").over(Window.partitionBy(F.lit(1))))
    own = F.when(F.col("__top") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / F.col("__top")))).otherwise(0.0)
    return top.withColumn("normalized_score", own).drop("__top").where(F.col("normalized_score") >= least).orderBy(*order).limit(k)
