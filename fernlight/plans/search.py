"""Ranked search over the catalogue.

A query reads the postings of its terms and, of chunks and documents, what filters, boosts and the order need: no text is
split again, and bodies are read for the k results alone.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import segment
from ..functions import text as T
from ..functions.shared import staged
from ..operators import filters, fusion, keyword
from ..sources import embeddings
from .config import Config
from .store import Store

ALGORITHM = "bm25"
ORDER = ("path", "seq", "chunk_uid")
DOCUMENT_FIELDS = ("path", "slug", "title", "heading_path", "anchor", "snippet", "score", "tier", "evidence", "facets", "tags")


def corpus(store: Store, facets: dict[str, str] | None = None, condition: dict | None = None, row_filter: Column | None = None) -> DataFrame:
    """Chunks of active documents that pass the filters; statistics are over these."""
    d = store.table("documents").where("status = 'active'").select("doc_id", "path", "slug", "title", "tags", "facets", "tier")
    rows = store.table("chunks").join(d, "doc_id")
    if facets:
        rows = rows.where(filters.exact(facets))
    if condition is not None:
        rows = rows.where(filters.conditions(condition, rows.columns))
    return rows if row_filter is None else rows.where(row_filter)


def rank(rows: DataFrame, keywords: DataFrame, vectors: DataFrame | None, config: Config, explain: bool = False) -> DataFrame:
    """rows of a positive score in either channel with score and evidence. keywords, vectors: chunk_uid and score."""
    weights = (config["search.rrf_weights.keyword"], config["search.rrf_weights.vector"]) if config["search.rank_fusion"] == "weighted_rrf" else (1.0, 1.0)
    fused = fusion.fuse(keywords, vectors, "chunk_uid", k=config["search.rrf_k"], weights=weights)
    out = rows.drop("embedding", "body").join(fused, "chunk_uid")
    out = out.withColumns({"score": F.col("rrf") * F.col("tier"), "evidence": fusion.evidence(F.col("keyword_score"), F.col("vector_score"), F.col("seq"))})
    if explain:
        parts = {
            "keyword_algorithm": F.lit(ALGORITHM), "keyword_score": F.coalesce("keyword_score", F.lit(0.0)), "vector_score": F.coalesce("vector_score", F.lit(0.0)), "keyword_rank": F.col("keyword_rank"), "vector_rank": F.col("vector_rank"),
            "rank_fusion": F.lit(config["search.rank_fusion"]), "rrf_k": F.lit(config["search.rrf_k"]), "keyword_weight": F.lit(float(weights[0])), "vector_weight": F.lit(float(weights[1])), "rrf_score": F.col("rrf"), "tier": F.col("tier"), "score": F.col("score"),
        }
        out = out.withColumn("explain", F.struct(*(c.alias(n) for n, c in parts.items())))
    return out


def _vectors(store: Store, rows: DataFrame, vector: list[float], config: Config) -> DataFrame:
    """chunk_uid and vector_score of rows: of all, or, with search.vector_candidates, of those among the index's nearest."""
    n = config["search.vector_candidates"]
    if n:
        near = fusion.vector_top(store.table("chunks").select("chunk_uid", "embedding"), vector, "chunk_uid", n)
        return near.join(rows.select("chunk_uid"), "chunk_uid", "left_semi").select("chunk_uid", "vector_score")
    return fusion.vector_scan(rows, vector).select("chunk_uid", "vector_score")


def _vector(store: Store, config: Config, query: str, provider) -> tuple[list[float] | None, str | None]:
    """The query's vector where the index has vectors and the settings ask for them; a failure leaves keywords alone."""
    if config["search.mode"] == "keyword" or config["embedding.provider"] == "none" or store.table("chunks").where("embedding IS NOT NULL").isEmpty():
        return None, None
    settings = dict(config["embedding"])
    try:
        return [float(x) for x in (provider or embeddings.PROVIDERS[settings["provider"]])([query], settings)[0]], None
    except embeddings.EmbeddingError as e:
        return None, str(e)


def search(store: Store, config: Config, query: str, *, k: int = 10, facets: dict[str, str] | None = None, condition: dict | None = None, explain: bool = False, pooled: bool = True, least: float | None = None, provider=None) -> dict[str, Any]:
    """The k best documents, or chunks where not pooled. least: a normalised score that results must reach."""
    spark = store.spark
    segment.register(spark)
    vector, error = _vector(store, config, query, provider)
    wanted = segment.query_terms(spark, query)
    folded = spark.range(1).select(T.trim(F.lower(F.lit(query)))).first()[0]
    rows = corpus(store, facets, condition)
    light = rows.select("chunk_uid", "length", "title_folded", "slug_folded")
    keywords = keyword.score(light, store.table("postings"), wanted, folded).select("chunk_uid", "keyword_score")
    vectors = None if vector is None else staged(_vectors(store, rows, vector, config), "vectors")
    ranked = rank(rows, keywords, vectors, config, explain)
    order = [F.round("score", 12).desc(), *map(F.col, ORDER)]
    if least is not None:
        best = fusion.threshold(ranked, k, least, *order)
    elif pooled:
        best = fusion.pool(ranked, "path", k, "score", *ORDER)
    else:
        best = ranked.orderBy(*order).limit(k)
    results = [r.asDict(True) for r in best.drop("flags", "length", "title_folded", "slug_folded").collect()]  # at most k rows
    texts = store.table("chunks").where(F.col("chunk_uid").isin([r["chunk_uid"] for r in results])).select("chunk_uid", "body", T.snippet(F.col("body")).alias("snippet"))
    held = {r.chunk_uid: r.asDict() for r in texts.collect()} if results else {}
    results = [r | held[r["chunk_uid"]] for r in results]
    last = store.state("last_sync")
    diagnostics = {
        "index_age": (last or {}).get("finished_at"), "docs_pending_sync": 0, "query_terms": wanted, "keyword_algorithm": ALGORITHM, "corpus_chunks": rows.count(),
        "rank_fusion": config["search.rank_fusion"], "rrf_k": config["search.rrf_k"],
    }
    if error:
        diagnostics["vector_error"] = error
    # Any vector score makes the search hybrid, whether or not it is among the results.
    hybrid = vectors is not None and not vectors.isEmpty()
    return {"query": query, "count": len(results), "retrieval_mode": "hybrid" if hybrid else "keyword_only", "results": results, "diagnostics": diagnostics}


def document_result(result: dict) -> dict:
    """The fields of a document's result, without those of its chunk."""
    return {k: result.get(k) for k in DOCUMENT_FIELDS}
