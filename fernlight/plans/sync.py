"""Bringing the catalogue up to date with a tree of files: discover, parse, compare hashes, write one revision."""

from __future__ import annotations

import contextlib
import json
import os
import stat
import time
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segment
from ..functions.shared import staged
from ..operators import catalog, keyword
from ..sources import embeddings, markdown
from ..sources.discover import discover
from .config import HOME, Config, ConfigError
from .store import SCHEMA_VERSION, Store, open_store


@dataclass
class Summary:
    run_id: str = ""
    status: str = "success"
    dry_run: bool = False
    discovered: int = 0
    indexed: int = 0
    skipped: int = 0
    tombstoned: int = 0
    excluded: int = 0
    diagnostics: int = 0
    revision: int = 0
    embedding: dict = field(default_factory=dict)


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


@contextlib.contextmanager
def lock(root: str, break_lock: bool = False):
    """One sync at a time: a file that only one process can create."""
    path = os.path.join(root, HOME, "sync.lock")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if break_lock and os.path.exists(path):
        os.remove(path)
    try:
        os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
    except FileExistsError:
        raise ConfigError("another sync is running", f"If none is, remove {path} or break the lock.") from None
    try:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"pid": os.getpid(), "started_at": now()}, f)
        yield
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(path)


def touch_gitignore(root: str) -> None:
    path = os.path.join(root, ".gitignore")
    text = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
    if f"{HOME}/" not in text.splitlines():
        with open(path, "a", encoding="utf-8") as f:
            f.write(("" if not text or text.endswith("\n") else "\n") + f"{HOME}/\n")


def write_json(path: str, value: object) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
    os.replace(beside, path)


def check_drift(store: Store, config: Config) -> None:
    """The index's vectors come from one provider, model and number of dimensions."""
    old = store.state("embedding_fingerprint")
    if not old or config["embedding.provider"] == "none":
        return
    ours = {k: config[f"embedding.{k}"] for k in ("provider", "model", "dimensions")}
    if any(old.get(k) != v for k, v in ours.items() if not (k == "dimensions" and not v)):
        raise ConfigError(f"the index was embedded by {old}, the settings say {ours}", "Sync in full to embed anew.")


def parser_settings(config: Config) -> dict:
    return {k: config[f"chunking.{k}"] for k in ("target_tokens", "max_tokens", "cjk_char_per_token")} | {"tier_boost": config["search.tier_boost"], "exclude_flags": config["discovery.exclude_frontmatter_flags"]}


def sync(spark: SparkSession, config: Config, *, full: bool = False, embed: bool = True, retry_failed: bool = False, dry_run: bool = False, break_lock: bool = False, embed_limit: int | None = None, max_files: int | None = None, prune_excluded: bool = False, provider=None) -> Summary:
    """One run. Files that are hidden by a rule but still there stay in the index unless prune_excluded or full."""
    with lock(config.root, break_lock):
        store = open_store(spark, config)
        out, started = Summary(uuid.uuid4().hex, dry_run=dry_run), now()
        if not full:
            check_drift(store, config)
            if not dry_run and "chunks" in store.pointer()["tables"] and "postings" not in store.pointer()["tables"]:
                reindex(store)
        elif not dry_run:
            store.reset()
        if retry_failed and not dry_run:
            store.commit({"embed_queue": catalog.retry(store.table("embed_queue"))})
        d = {k: config[f"discovery.{k}"] for k in ("include", "exclude", "respect_gitignore", "follow_symlinks")}
        paths = discover(config.root, **d)
        out.discovered = len(paths)
        journal = os.path.join(config.root, HOME, "journal", f"{out.run_id}.json")

        def log() -> None:
            run = (out.run_id, started, now(), out.status, json.dumps(asdict(out)))
            store.append("sync_runs", spark.createDataFrame([run], store.table("sync_runs").schema))

        try:
            _apply(spark, store, config, out, paths, paths if max_files is None else paths[:max_files], prune_excluded)
            if embed and not dry_run and config["embedding.provider"] != "none":
                out.embedding = embed_pending(store, config, embed_limit, provider)
        except Exception as e:
            out.status = "failed"
            write_json(journal, asdict(out) | {"error": str(e), "started_at": started, "finished_at": now()})
            if not dry_run:
                log()
            raise
        if not dry_run:
            if out.indexed or out.tombstoned or store.state("last_sync") is None:
                store.set_state(last_sync={"run_id": out.run_id, "finished_at": now()})
            out.revision = store.pointer()["revision"]
            log()
        out.revision = store.pointer()["revision"]
        write_json(journal, asdict(out) | {"started_at": started, "finished_at": now()})
        return out


def gone(root: str, path: str) -> bool:
    """Whether there is no such file any more; that it can't be told is an error, and deletes nothing."""
    try:
        return not stat.S_ISREG(os.stat(os.path.join(root, path)).st_mode)
    except (FileNotFoundError, NotADirectoryError):
        return True
    except OSError as e:
        raise ConfigError(f"whether {path} is still there can't be told: {e}", "Mend the file system's error and sync again.") from e


def _apply(spark: SparkSession, store: Store, config: Config, out: Summary, all_paths: list[str], paths: list[str], prune: bool) -> None:
    at, documents = now(), store.table("documents")
    active = documents.where("status = 'active'")
    parsed = staged(markdown.read(spark, config.root, paths, parser_settings(config), config["discovery.max_file_bytes"]), "parsed")
    shown = parsed.where("NOT excluded")
    actions = catalog.changes(active.join(parsed.select("path"), "path", "left_semi"), shown)
    changed = shown.join(actions.where("action IN ('new', 'changed')"), "path", "left_semi")
    # Of the paths that discovery no longer names, only those whose file is gone leave the index.
    here = spark.createDataFrame([(p,) for p in all_paths], "path string")
    lost = [r[0] for r in active.join(here, "path", "left_anti").select("path").toLocalIterator()]
    deleted = [p for p in lost if prune or gone(config.root, p)]
    hidden = parsed.where("excluded").join(active, "path", "left_semi").select("path")
    tombs = spark.createDataFrame([(p,) for p in deleted], "path string").unionByName(hidden)
    counts = parsed.agg(F.count_if("excluded"), F.sum(F.size("diagnostics"))).first()
    out.excluded, out.diagnostics = counts[0] or 0, counts[1] or 0
    out.indexed, out.tombstoned = changed.count(), tombs.count()
    out.skipped = len(paths) - out.excluded - out.indexed
    if out.dry_run or not (out.indexed or out.tombstoned):
        return
    new = changed.withColumns({"status": F.lit("active"), "diag_flags": F.transform("diagnostics", lambda d: d["kind"]), "last_synced_at": F.lit(at)})
    docs = staged(catalog.tombstone(catalog.upsert(documents, new.select(*documents.columns)), tombs, at), "documents")
    indexed = staged(analysed(new.select("doc_id", "title", "slug", F.explode("chunks").alias("c")).select("doc_id", "title", "slug", "c.*")), "indexed")
    chunk = indexed.drop("title", "slug", *keyword.FIELD_TERMS).withColumn("embedding", F.lit(None).cast("array<double>"))
    if config["embedding.provider"] != "none":
        chunk = catalog.from_cache(chunk, store.table("embedding_cache"), config["embedding.provider"], config["embedding.model"], config["embedding.dimensions"])
    chunks = staged(catalog.replace_children(store.table("chunks"), chunk, parents=new.select("doc_id")), "chunks")
    replaced = store.table("chunks").join(new.select("doc_id"), "doc_id", "left_semi").select("chunk_uid")
    postings = keyword.by_term(staged(store.table("postings").join(replaced, "chunk_uid", "left_anti").unionByName(keyword.postings(indexed)), "postings"))
    link = new.select(F.col("doc_id").alias("src_doc_id"), F.explode("links").alias("l")).select("src_doc_id", "l.*", F.lit(None).cast("string").alias("resolved_doc_id"), F.lit(False).alias("ambiguous"))
    links = catalog.replace_children(store.table("links"), link, "src_doc_id", new.select(F.col("doc_id").alias("src_doc_id")))
    queue = store.table("embed_queue").join(chunks.select("chunk_uid"), "chunk_uid", "left_semi")
    if config["embedding.provider"] != "none":
        queue = catalog.enqueue(queue, catalog.missing(chunks, docs, queue), at)
    store.commit({"documents": docs, "chunks": chunks, "postings": postings, "links": catalog.resolve_links(links, docs), "embed_queue": queue})


def analysed(chunks: DataFrame) -> DataFrame:
    """Chunks with title and slug, segmented for the index."""
    segment.register(chunks.sparkSession)
    return keyword.index(chunks, segment.terms, segment.fold)


def reindex(store: Store) -> None:
    """Makes the inverted index anew from the stored chunks: for a store that was written before it had one."""
    documents = store.table("documents").select("doc_id", "title", "slug")
    chunks = store.table("chunks")
    own = chunks.drop("length", "title_folded", "slug_folded").join(documents, "doc_id")
    indexed = staged(analysed(own), "indexed")
    store.commit({"chunks": indexed.select(*chunks.columns), "postings": keyword.by_term(staged(keyword.postings(indexed), "postings"))}, {"schema_version": SCHEMA_VERSION})


def embed_pending(store: Store, config: Config, limit: int | None = None, provider=None) -> dict:
    """Embeds what is queued, and active chunks without a vector that no one queued. Counts of what happened."""
    documents, chunks, queue, cache = (store.table(t) for t in ("documents", "chunks", "embed_queue", "embedding_cache"))
    queue = catalog.enqueue(queue, catalog.missing(chunks, documents, queue), now())
    settings = dict(config["embedding"])
    pending = catalog.poll(queue, chunks, limit)
    begun = time.time()
    done = staged(embeddings.embed(pending, settings, provider), "embedded")
    good = done.where("error IS NULL").select("chunk_uid", "content_hash", "vector")
    chunks, queue, cache = catalog.fulfil(chunks, queue, cache, good, settings["provider"], settings["model"])
    queue = catalog.fail(queue, done.where("error IS NOT NULL").select("chunk_uid", "error", "may_retry"))
    n = done.agg(F.count(F.lit(1)), F.count("error"), F.max(F.size("vector"))).first()
    state = {}
    if n[0] - n[1] > 0:
        state["embedding_fingerprint"] = {"provider": settings["provider"], "model": settings["model"], "dimensions": n[2]}
    if n[0]:
        store.commit({"chunks": chunks, "embed_queue": queue, "embedding_cache": cache}, state)
    return {"attempted": n[0], "succeeded": n[0] - n[1], "failed": n[1], "remaining": store.table("embed_queue").count(), "seconds": round(time.time() - begun, 3)}


def check_provider(config: Config, provider=None) -> dict:
    """One text through the provider."""
    settings = dict(config["embedding"])
    if settings["provider"] == "none":
        return {"ok": True, "provider": "none", "dimensions": 0}
    try:
        vector = (provider or embeddings.PROVIDERS[settings["provider"]])(["check"], settings)[0]
    except embeddings.EmbeddingError as e:
        return {"ok": False, "provider": settings["provider"], "error": str(e), "retryable": e.retryable}
    return {"ok": not settings["dimensions"] or len(vector) == settings["dimensions"], "provider": settings["provider"], "dimensions": len(vector)}


def tables_of(store: Store) -> dict[str, DataFrame]:
    return {t: store.table(t) for t in ("documents", "chunks", "links", "embed_queue")}
