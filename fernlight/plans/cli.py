"""The command line. Results are JSON on standard output; errors go to standard error with status 2 for settings, else 3."""

from __future__ import annotations

import argparse
import json
import os
import sys
import traceback
from dataclasses import asdict

from pyspark.sql import SparkSession

from ..operators import catalog, filters
from . import config as settings
from .search import search
from .serve import Service, start, url_of
from .store import open_store
from .sync import check_drift, check_provider, sync, tables_of, touch_gitignore

OVERRIDES = {"repo_root": "repo.root", "data_dir": "storage.data_dir", "storage_backend": "storage.backend", "storage_url": "storage.url", "embedding_provider": "embedding.provider", "embedding_base_url": "embedding.base_url", "embedding_model": "embedding.model", "embedding_dimensions": "embedding.dimensions", "search_mode": "search.mode"}
SKILL = "skills/fernlight/SKILL.md"


def positive(text: str) -> int:
    if not text.isascii() or not text.isdigit() or int(text) < 1:
        raise ValueError(f"{text!r} is no positive whole number")
    return int(text)


def session() -> SparkSession:
    builder = SparkSession.builder.appName("fernlight").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    return (builder if os.environ.get("SPARK_MASTER") or os.environ.get("MASTER") else builder.master("local[*]")).getOrCreate()


def emit(value: object) -> None:
    print(json.dumps(value, indent=2, ensure_ascii=False, default=str))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fernlight", description="Indexes Markdown files and searches them.")
    top.add_argument("--config")
    top.add_argument("--json", action="store_true", help="results are JSON in any case")
    top.add_argument("--verbose", action="store_true", help="tracebacks with errors")
    for name in OVERRIDES:
        top.add_argument(f"--{name.replace('_', '-')}")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    p = sub.add_parser("sync")
    for flag in ("full", "no-embed", "retry-failed", "dry-run", "break-lock", "prune-excluded"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--embed-limit")
    p.add_argument("--max-files")
    p = sub.add_parser("status")
    p.add_argument("--failed", action="store_true")
    p.add_argument("--limit", default="20")
    sub.add_parser("config").add_argument("action", choices=["show"])
    p = sub.add_parser("search")
    p.add_argument("query")
    p.add_argument("-k", default="10")
    p.add_argument("--filter", action="append", default=[])
    p.add_argument("--explain", action="store_true")
    p = sub.add_parser("serve")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", default="8765")
    p.add_argument("--knowledge-id", default="default")
    sub.add_parser("resolve").add_argument("slug")
    sub.add_parser("links").add_argument("slug")
    sub.add_parser("doctor").add_argument("--check-embedding", action="store_true")
    sub.add_parser("skill").add_argument("action", choices=["install"])
    return top


def install_skill(config: settings.Config) -> str:
    """A page that tells an agent how to search this index."""
    path = os.path.join(config.root, SKILL)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tiers = "\n".join(f"- `{k}`: {v}" for k, v in config["search.tier_boost"].items())
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# Searching this repository\n\nRun `fernlight search \"<words>\" -k 10`, narrow with `--filter key=value`, then read the files it names.\n`fernlight links <slug>` shows what a page links to and what links to it.\n\nPaths weigh:\n\n{tiers}\n")
    return path


def run(args: argparse.Namespace) -> object:
    flags = {dotted: getattr(args, name) for name, dotted in OVERRIDES.items() if getattr(args, name)}
    if "embedding.dimensions" in flags:
        flags["embedding.dimensions"] = positive(flags["embedding.dimensions"])
    if args.command == "init":
        path = settings.write_initial(".", args.config, flags)
        touch_gitignore(".")
        return {"config_path": path}
    # Numbers are read before Spark starts, so that mistakes show at once.
    numbers = {n: positive(v) for n in ("k", "limit", "port", "embed_limit", "max_files") if (v := getattr(args, n, None)) is not None}
    config = settings.load(".", args.config, flags)
    if args.command == "config":
        return settings.display(config)
    if args.command == "skill":
        return {"path": install_skill(config)}
    facets = filters.parse_cli(getattr(args, "filter", []))
    spark = session()
    store = open_store(spark, config)
    if args.command == "sync":
        return asdict(sync(spark, config, full=args.full, embed=not args.no_embed, retry_failed=args.retry_failed, dry_run=args.dry_run, break_lock=args.break_lock, embed_limit=numbers.get("embed_limit"), max_files=numbers.get("max_files"), prune_excluded=args.prune_excluded))
    t = tables_of(store)
    if args.command == "status":
        out = catalog.statistics(*t.values()).first().asDict() | {"last_sync": store.state("last_sync"), "embedding_fingerprint": store.state("embedding_fingerprint")}
        if args.failed:
            out["failed"] = [r.asDict() for r in catalog.failed(t["embed_queue"], t["chunks"], t["documents"], numbers["limit"]).collect()]
        return out
    if args.command == "search":
        return search(store, config, args.query, k=numbers["k"], facets=facets, explain=args.explain)
    if args.command == "resolve":
        return [r.asDict(True) for r in catalog.resolve(t["documents"], args.slug).limit(1000).collect()]
    if args.command == "links":
        found = catalog.resolve(t["documents"], args.slug).first()
        if found is None:
            raise settings.ConfigError(f"there is no document {args.slug!r}")
        lists = {n: f(t["links"], t["documents"], found["doc_id"]) for n, f in (("outgoing", catalog.outgoing), ("incoming", catalog.incoming), ("broken", catalog.broken))}
        return {"document": found["path"]} | {n: [r.asDict() for r in df.collect()] for n, df in lists.items()}
    if args.command == "doctor":
        out = {"config": settings.display(config), "revision": store.pointer()["revision"], "drift": None}
        try:
            check_drift(store, config)
        except settings.ConfigError as e:
            out["drift"] = str(e)
        return out | ({"embedding": check_provider(config)} if args.check_embedding else {})
    service = Service(store, config, args.knowledge_id, os.environ.get("FERNLIGHT_API_KEY"))
    server = start(service, args.host, numbers["port"])
    print(json.dumps({"url": url_of(args.host, server.server_port)}), flush=True)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        server.server_close()
    return {"stopped": True}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        emit(run(args))
        return 0
    except Exception as e:
        print(json.dumps({"error": str(e), "hint": getattr(e, "hint", "")}, ensure_ascii=False), file=sys.stderr)
        if args.verbose:
            traceback.print_exc()
        return 2 if isinstance(e, settings.ConfigError) else 3


if __name__ == "__main__":
    sys.exit(main())
