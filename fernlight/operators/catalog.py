"""Relational operators of the catalogue: change detection, upserts, tombstones, links, the embedding queue, statistics.

All take and give DataFrames; keys are hashes, so each is an equi-join that Spark plans by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_LENGTH = 2000
TOO_LONG = "%maximum context length%"


def chunk_uid(doc_id: Column, anchor: Column, seq: Column, content_hash: Column) -> Column:
    return F.sha2(F.concat_ws(":", doc_id, anchor, seq.cast("string"), content_hash), 256)


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """path and action of every path: new, changed, unchanged or missing. before: active documents; both by path and hashes."""
    old = before.select("path", F.col("content_hash").alias("old_content"), F.col("frontmatter_hash").alias("old_frontmatter"))
    new = now.select("path", "content_hash", "frontmatter_hash")
    same = F.col("content_hash").eqNullSafe(F.col("old_content")) & F.col("frontmatter_hash").eqNullSafe(F.col("old_frontmatter"))
    marked = new.withColumn("here", F.lit(1)).join(old.withColumn("there", F.lit(1)), "path", "full_outer")
    action = F.when(F.col("here").isNull(), "missing").when(F.col("there").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return marked.select("path", action.alias("action"))


def upsert(table: DataFrame, rows: DataFrame, key: str = "path", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rows over the table's rows of the same key; columns to keep stay the table's."""
    kept = table.select(key, *(F.col(c).alias(f"__{c}") for c in keep))
    new = rows.join(kept, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in keep}).drop(*(f"__{c}" for c in keep))
    return table.join(rows.select(key), key, "left_anti").unionByName(new.select(*table.columns))


def replace_children(table: DataFrame, rows: DataFrame, parent: str = "doc_id", parents: DataFrame | None = None) -> DataFrame:
    """All rows of the changed parents replaced."""
    changed = (parents if parents is not None else rows).select(parent).distinct()
    return table.join(changed, parent, "left_anti").unionByName(rows.select(*table.columns))


def tombstone(table: DataFrame, paths: DataFrame, at: str) -> DataFrame:
    """Active documents of these paths become deleted; their chunks and links stay."""
    gone = paths.select("path", F.lit(True).alias("__gone")).distinct()
    hit = F.coalesce(F.col("__gone"), F.lit(False)) & (F.col("status") == "active")
    changed = {"status": F.when(hit, "deleted").otherwise(F.col("status")), "last_synced_at": F.when(hit, F.lit(at)).otherwise(F.col("last_synced_at"))}
    return table.join(gone, "path", "left").withColumns(changed).drop("__gone").select(*table.columns)


def resolve_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """links with resolved_doc_id and ambiguous.

    External links resolve to nothing; links to files by path; wiki links by path, by path with .md, then by a slug that
    one active document alone has. Of several, the link is ambiguous and unresolved. Links with no target and external
    ones don't join: their null keys would all meet in one task.
    """
    named = (F.col("kind") != "external") & (F.col("normalized_target") != "")
    apart = links.where(~F.coalesce(named, F.lit(False))).withColumns({"resolved_doc_id": F.lit(None).cast("string"), "ambiguous": F.lit(False)})
    links, columns = links.where(named), [*links.drop("resolved_doc_id", "ambiguous").columns, "resolved_doc_id", "ambiguous"]
    active = documents.where("status = 'active'")
    paths = active.select(F.col("path").alias("__path"), F.col("doc_id").alias("__by_path"))
    with_md = active.select(F.col("path").alias("__path_md"), F.col("doc_id").alias("__by_md"))
    slugs = active.groupBy(F.col("slug").alias("__slug")).agg(F.count(F.lit(1)).alias("__same"), F.min("doc_id").alias("__by_slug"))
    target = F.col("normalized_target")
    last = F.regexp_extract(target, "([^/]*)\\z", 1)
    wiki = F.col("kind") == "wikilink"
    plain = links.drop("resolved_doc_id", "ambiguous")
    files = plain.where(~wiki).join(paths, target == F.col("__path"), "left").withColumns({"resolved_doc_id": F.col("__by_path"), "ambiguous": F.lit(False)})
    wikis = plain.where(wiki).join(paths, target == F.col("__path"), "left").join(with_md, F.concat(target, F.lit(".md")) == F.col("__path_md"), "left")
    wikis = wikis.withColumn("__slug_of", F.regexp_replace(last, "(?i)\\.md\\z", "")).join(slugs, F.col("__slug_of") == F.col("__slug"), "left")
    direct = F.coalesce("__by_path", "__by_md")
    wikis = wikis.withColumns({"resolved_doc_id": F.coalesce(direct, F.when(F.col("__same") == 1, F.col("__by_slug"))), "ambiguous": direct.isNull() & F.coalesce(F.col("__same") > 1, F.lit(False))})
    return apart.select(*columns).unionByName(files.select(*columns)).unionByName(wikis.select(*columns))


def link_rows(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Links with the paths of both ends; the far end is null where unresolved. Sources may be deleted."""
    source = documents.select(F.col("doc_id").alias("src_doc_id"), F.col("path").alias("src_path"))
    target = documents.select(F.col("doc_id").alias("resolved_doc_id"), F.col("path").alias("resolved_path"))
    return links.join(source, "src_doc_id").join(target, "resolved_doc_id", "left")


def outgoing(links: DataFrame, documents: DataFrame, doc_id: str) -> DataFrame:
    return link_rows(links.where(F.col("src_doc_id") == doc_id), documents).orderBy("kind", "normalized_target")


def incoming(links: DataFrame, documents: DataFrame, doc_id: str) -> DataFrame:
    return link_rows(links.where(F.col("resolved_doc_id") == doc_id), documents).orderBy("src_path")


def is_broken() -> Column:
    return (F.col("kind") != "external") & F.col("resolved_doc_id").isNull()


def broken(links: DataFrame, documents: DataFrame, doc_id: str | None = None) -> DataFrame:
    own = links if doc_id is None else links.where(F.col("src_doc_id") == doc_id)
    return link_rows(own.where(is_broken()), documents).orderBy("src_path", "kind", "normalized_target")


def resolve(documents: DataFrame, wanted: str) -> DataFrame:
    """Active documents of this slug or path, with or without .md."""
    return documents.where((F.col("status") == "active") & ((F.col("slug") == wanted) | F.col("path").isin(wanted, f"{wanted}.md"))).orderBy("path")


def statistics(documents: DataFrame, chunks: DataFrame, links: DataFrame, queue: DataFrame) -> DataFrame:
    """One row of counts: one pass over each table."""
    one = F.lit(1).alias("__one")
    parts = [
        documents.agg(F.count_if(F.col("status") == "active").alias("documents_active"), F.count_if(F.col("status") == "deleted").alias("documents_deleted")),
        chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("embedded_chunks")),
        links.agg(F.count(F.lit(1)).alias("links"), F.count_if(is_broken()).alias("broken_links"), F.count_if(F.col("ambiguous")).alias("ambiguous_links")),
        queue.agg(F.count_if(F.col("last_error").isNull()).alias("queued_embeddings"), F.count_if(F.col("last_error").isNotNull()).alias("failed_embeddings")),
    ]
    out = parts[0].select("*", one)
    for p in parts[1:]:
        out = out.join(p.select("*", one), "__one")
    return out.withColumn("retrieval_mode", F.when(F.col("embedded_chunks") > 0, "hybrid").otherwise("keyword_only")).drop("__one")


# The embedding queue: chunk_uid, enqueued_at, attempts, last_error, retryable.


def poll(queue: DataFrame, chunks: DataFrame, n: int | None = None) -> DataFrame:
    """The n oldest entries that may be tried, in order; all of them, in none, without n. Null counts as may."""
    ready = queue.where(~F.col("retryable").eqNullSafe(F.lit(False)))
    if n is not None:  # only the entries are ordered, not the bodies
        ready = ready.join(chunks.select("chunk_uid"), "chunk_uid", "left_semi").orderBy("enqueued_at", "attempts", "chunk_uid").limit(n)
    rows = ready.join(chunks.select("chunk_uid", "content_hash", "body", "token_est"), "chunk_uid")
    return rows if n is None else rows.orderBy("enqueued_at", "attempts", "chunk_uid")


def failed(queue: DataFrame, chunks: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    rows = queue.where(F.col("last_error").isNotNull()).join(chunks.select("chunk_uid", "doc_id"), "chunk_uid").join(documents.select("doc_id", "path"), "doc_id")
    return rows.orderBy(F.col("retryable").desc_nulls_last(), F.desc("attempts"), "path", "chunk_uid").limit(n)


def missing(chunks: DataFrame, documents: DataFrame, queue: DataFrame) -> DataFrame:
    """chunk_uid of active documents' chunks without a vector that aren't queued."""
    active = documents.where("status = 'active'").select("doc_id")
    return chunks.where("embedding IS NULL").join(active, "doc_id", "left_semi").join(queue, "chunk_uid", "left_anti").select("chunk_uid")


def enqueue(queue: DataFrame, uids: DataFrame, at: str) -> DataFrame:
    new = uids.select("chunk_uid").distinct().join(queue, "chunk_uid", "left_anti")
    return queue.unionByName(new.select("chunk_uid", F.lit(at).alias("enqueued_at"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("boolean").alias("retryable")))


def from_cache(chunks: DataFrame, cache: DataFrame, provider: str, model: str, dimensions: int) -> DataFrame:
    """chunks with vectors of the cache where content, provider, model and dimensions agree."""
    own = cache.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dimensions") == dimensions)).select("content_hash", F.col("vector").alias("__vector"))
    return chunks.join(own, "content_hash", "left").withColumn("embedding", F.coalesce("embedding", "__vector")).select(*chunks.columns)


def fulfil(chunks: DataFrame, queue: DataFrame, cache: DataFrame, done: DataFrame, provider: str, model: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables after vectors came. done: chunk_uid, content_hash, vector; the cache goes by each vector's own length."""
    with_vector = chunks.join(done.select("chunk_uid", F.col("vector").alias("__vector")), "chunk_uid", "left").withColumn("embedding", F.coalesce("__vector", "embedding")).select(*chunks.columns)
    new = done.select(F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.size("vector").alias("dimensions"), "content_hash", "vector").dropDuplicates(["dimensions", "content_hash"])
    keys = ["provider", "model", "dimensions", "content_hash"]
    return with_vector, queue.join(done, "chunk_uid", "left_anti"), cache.join(new, keys, "left_anti").unionByName(new)


def fail(queue: DataFrame, errors: DataFrame) -> DataFrame:
    """Attempts counted and errors kept. errors: chunk_uid, error, may_retry."""
    hit = F.col("error").isNotNull()
    out = queue.join(errors, "chunk_uid", "left")
    changed = {"attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")), "last_error": F.when(hit, F.substring("error", 1, ERROR_LENGTH)).otherwise(F.col("last_error")), "retryable": F.when(hit, F.col("may_retry")).otherwise(F.col("retryable"))}
    return out.withColumns(changed).select(*queue.columns)


def retry(queue: DataFrame) -> DataFrame:
    """Failed entries that may be tried again, and those whose text was too long, start afresh."""
    again = F.coalesce("retryable", F.lit(False)) | F.coalesce(F.col("last_error").like(TOO_LONG), F.lit(False))
    return queue.withColumns({"attempts": F.when(again, 0).otherwise(F.col("attempts")), "retryable": F.when(again, F.lit(None).cast("boolean")).otherwise(F.col("retryable")), "last_error": F.when(again, F.lit(None).cast("string")).otherwise(F.col("last_error"))})
