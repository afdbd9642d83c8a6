"""BM25 over weighted title, slug and body, from an inverted index.

Texts are split once, when a row is indexed: `index` gives a row's terms by field and its weighted length, `postings` the
inverted index, which is written sorted by term. A query then reads its terms' postings and the rows' lengths, titles and
slugs, never a body. Statistics follow the filters on rows: they are aggregated after the postings met the rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75
TITLE_BOOST, SLUG_BOOST = 2.0, 2.5


def index(chunks: DataFrame, terms: Callable[[Column], Column] = T.terms, fold: Callable[[Column], Column] = F.lower) -> DataFrame:
    """chunks with their terms by field, their weighted length, and title and slug as they are searched for whole queries."""
    out = chunks.withColumns({"title_terms": terms(F.coalesce("title", F.lit(""))), "slug_terms": terms(T.slug_words(F.col("slug"))), "body_terms": terms(F.col("body"))})
    length = (T.TITLE_WEIGHT * F.size("title_terms") + T.SLUG_WEIGHT * F.size("slug_terms") + F.size("body_terms")).cast("long")
    return out.withColumns({"length": length, "title_folded": fold(F.coalesce("title", F.lit(""))), "slug_folded": fold(F.col("slug"))})


FIELD_TERMS = ("title_terms", "slug_terms", "body_terms")


def postings(indexed: DataFrame, key: str = "chunk_uid") -> DataFrame:
    """term, key, tf (weighted)."""
    each = [indexed.select(F.col(key), F.explode(c).alias("term"), F.lit(w).cast("long").alias("w")) for c, w in zip(FIELD_TERMS, (T.TITLE_WEIGHT, T.SLUG_WEIGHT, 1), strict=True)]
    return reduce(DataFrame.unionByName, each).groupBy("term", key).agg(F.sum("w").alias("tf"))


def by_term(rows: DataFrame) -> DataFrame:
    """Postings as they are written: in ranges of terms and sorted by term, so that a query prunes files and row groups.

    rows should be a written table: ranges are sampled from it.
    """
    return rows.repartitionByRange("term").sortWithinPartitions("term")


def counted(indexed: DataFrame, wanted: list[str]) -> DataFrame:
    return indexed.withColumn("tf", T.weighted_counts(F.col("title_terms"), F.col("slug_terms"), F.col("body_terms"), wanted))


def statistics(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """One row: rows, mean length, and for each term the rows that have it."""
    has = [F.count_if(F.col("tf")[i] > 0) for i in range(len(wanted))]
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.greatest("length", F.lit(1))).alias("mean_length"), F.array(*has).alias("df"))


def boost(folded: str, title: Column, slug: Column) -> Column:
    """For a query that stands whole in the title or the slug; plain containment, no wildcards. All in their folded forms."""
    if not folded:
        return F.lit(0.0)
    hyphened = re.sub(f"[{T.BLANK}]+", "-", folded)
    in_slug = F.contains(slug, F.lit(hyphened)) | F.contains(T.slug_words(slug), F.lit(folded))
    return F.when(F.contains(title, F.lit(folded)), TITLE_BOOST).otherwise(0.0) + F.when(in_slug, SLUG_BOOST).otherwise(0.0)


def score(rows: DataFrame, inverted: DataFrame, wanted: list[str], folded: str = "", key: str = "chunk_uid") -> DataFrame:
    """rows of positive score with column keyword_score. Filters on rows belong before this: statistics follow them.

    rows: key, length, title_folded, slug_folded and what else is to be carried; inverted: term, key, tf. folded: the
    query that titles and slugs are searched for, empty for no boost. A query without terms scores nothing, whatever
    titles say.
    """
    if not wanted:
        return rows.withColumn("keyword_score", F.lit(0.0)).where("false")
    hits = inverted.where(F.col("term").isin(wanted)).groupBy(key).agg(*(F.sum(F.when(F.col("term") == t, F.col("tf"))).alias(f"__tf{i}") for i, t in enumerate(wanted)))
    found = rows.join(hits, key, "left").withColumn("__one", F.lit(1))
    stats = found.agg(F.count(F.lit(1)).alias("__n"), F.avg(F.greatest("length", F.lit(1))).alias("__mean"), *(F.count(f"__tf{i}").alias(f"__df{i}") for i in range(len(wanted)))).withColumn("__one", F.lit(1))

    def part(i: int) -> Column:
        df, tf = F.col(f"__df{i}"), F.col(f"__tf{i}")
        idf = F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
        norm = tf + K1 * (1 - B + B * F.greatest("length", F.lit(1)) / F.col("__mean"))
        return F.coalesce(idf * tf * (K1 + 1) / norm, F.lit(0.0))

    total = reduce(lambda a, b: a + b, (part(i) for i in range(len(wanted)))) + boost(folded, F.col("title_folded"), F.col("slug_folded"))
    scored = found.join(F.broadcast(stats), "__one").withColumn("keyword_score", total).where("keyword_score > 0")
    return scored.select(*rows.columns, "keyword_score")
