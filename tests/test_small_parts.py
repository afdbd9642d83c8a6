"""Parts that other tests pass by: times, hashes, the lock, the skill page, look-ups, the store's tables."""

from __future__ import annotations

import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from fernlight.operators import catalog, fusion
from fernlight.plans import cli
from fernlight.plans import config as settings
from fernlight.plans.config import ConfigError
from fernlight.plans.store import SCHEMA_VERSION, TABLES, Store
from fernlight.plans.sync import check_provider, lock, sync, touch_gitignore
from fernlight.sources import embeddings
from fernlight.sources import markdown as M

from .test_markdown_config import parse
from .test_sync_search import load, write


def test_times():
    found = parse("---\ncreated: 2024-01-02\nupdated: 2024-03-04T05:06:07+02:00\n---\nx\n")
    assert (found["created_ts"], found["updated_ts"]) == ("2024-01-02T00:00:00.000Z", "2024-03-04T03:06:07.000Z")
    both = parse("---\ntimestamp: '2023-05-06'\n---\nx\n")
    assert both["created_ts"] == both["updated_ts"] == "2023-05-06T00:00:00.000Z"
    odd = parse("---\ncreated: 5\n---\nx\n")
    assert odd["created_ts"] is None and [d["kind"] for d in odd["diagnostics"]] == ["frontmatter_normalization_warning"]
    assert parse("x\n")["created_ts"] is None


def test_stable_hash_and_reserved_names():
    a, b = ("---\nb: 1\na: [2, {d: 1, c: 2}]\n---\nx\n", "---\na: [2, {c: 2, d: 1}]\nb: 1\n---\nx\n")
    assert parse(a)["frontmatter_hash"] == parse(b)["frontmatter_hash"] == M.sha('{"a":[2,{"c":2,"d":1}],"b":1}')
    assert parse(a)["content_hash"] != parse(b)["content_hash"]
    assert [parse("x", p)["reserved"] for p in ("a/index.md", "a/log.md", "a/other.md")] == [True, True, False]
    assert M.scalar({"x": ["TRUE", date(2024, 1, 2), float("nan")]}) == {"x": [True, "2024-01-02T00:00:00.000Z", None]}


def test_lock(tmp_path):
    with lock(str(tmp_path)):
        assert json.load(open(tmp_path / ".fernlight/sync.lock"))["pid"] == os.getpid()
        with pytest.raises(ConfigError), lock(str(tmp_path)):
            pass
        with lock(str(tmp_path), break_lock=True):
            pass
    assert not (tmp_path / ".fernlight/sync.lock").exists()


def test_gitignore_is_touched_once(tmp_path):
    for _ in range(2):
        touch_gitignore(str(tmp_path))
    assert (tmp_path / ".gitignore").read_text() == ".fernlight/\n"
    (tmp_path / ".gitignore").write_text("a")
    touch_gitignore(str(tmp_path))
    assert (tmp_path / ".gitignore").read_text() == "a\n.fernlight/\n"


def test_skill_page(tmp_path):
    path = cli.install_skill(load(tmp_path))
    text = open(path, encoding="utf-8").read()
    assert path.startswith(str(tmp_path)) and "fernlight search" in text and "- `concepts/`: 1.3" in text


def test_provider_check(tmp_path):
    config = load(tmp_path, **{"embedding.provider": "local", "embedding.dimensions": 8})

    def refuse(*_):
        raise embeddings.EmbeddingError("HTTP 401: no", False)

    assert check_provider(load(tmp_path)) == {"ok": True, "provider": "none", "dimensions": 0}
    assert check_provider(config) == {"ok": True, "provider": "local", "dimensions": 8}
    assert check_provider(config, lambda *_: [[1.0]])["ok"] is False
    assert check_provider(config, refuse) == {"ok": False, "provider": "local", "error": "HTTP 401: no", "retryable": False}


@pytest.mark.parametrize(
    "wrong",
    [
        {"embedding.provider": "openai-compatible", "embedding.model": ""}, {"embedding.provider": "openai-compatible", "embedding.base_url": ""}, {"search.vector_candidates": 5}, {"search.vector_candidates": -1},
        {"search.vector_candidates": 5, "embedding.provider": "local", "embedding.dimensions": 0}, {"search.rrf_k": float("inf")}, {"search.rrf_k": 0}, {"search.mode": "other"}, {"search.rank_fusion": "sum"},
        {"search.rank_fusion": "weighted_rrf", "search.rrf_weights": {"keyword": 0, "vector": 0}}, {"search.rrf_weights": {"keyword": -1, "vector": 1}}, {"storage.backend": "jdbc"}, {"chunking.max_tokens": 5},
    ],
)
def test_wrong_settings(tmp_path, wrong):
    config = load(tmp_path)
    for dotted, value in wrong.items():  # as a file might have them; empty arguments are ignored
        settings.put(config.values, dotted, value)
    with pytest.raises(ConfigError):
        settings.validate(config)


def test_lookups_and_tables(spark, tmp_path):
    write(tmp_path, "a/one.md", "# One\n[[two]] and [[gone]]\n")
    write(tmp_path, "b/two.md", "# Two\n[[one]]\n")
    config = load(tmp_path)
    sync(spark, config)
    store = Store(spark, config.data_dir())
    assert store.state("schema_version") == SCHEMA_VERSION
    for name, ddl in TABLES.items():
        assert store.table(name).columns == spark.createDataFrame([], ddl).columns
    documents = store.table("documents")
    for wanted in ("one", "a/one", "a/one.md"):
        assert [r.path for r in catalog.resolve(documents, wanted).collect()] == ["a/one.md"]
    assert catalog.resolve(documents, "none").isEmpty()
    first = catalog.resolve(documents, "one").first()
    links = store.table("links")
    assert [r.normalized_target for r in catalog.outgoing(links, documents, first.doc_id).collect()] == ["gone", "two"]
    assert [r.src_path for r in catalog.incoming(links, documents, first.doc_id).collect()] == ["b/two.md"]
    assert [r.normalized_target for r in catalog.broken(links, documents, first.doc_id).collect()] == ["gone"]


def test_scores_without_rows_are_dropped(spark):
    scores = spark.createDataFrame([("a", 2.0), ("lost", 9.0)], "chunk_uid string, keyword_score double")
    vectors = spark.createDataFrame([("b", 0.5), ("lost too", 0.9)], "chunk_uid string, vector_score double")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "chunk_uid string")
    found = rows.join(fusion.fuse(scores, vectors, "chunk_uid"), "chunk_uid").orderBy("chunk_uid").collect()
    # Ranks count the lost rows; the results don't.
    assert [(r.chunk_uid, r.keyword_rank, r.vector_rank) for r in found] == [("a", 2, None), ("b", None, 2)]
    alone = fusion.fuse(scores, None, "chunk_uid").orderBy("keyword_rank").collect()
    assert [(r.chunk_uid, r.vector_score, r.rrf) for r in alone] == [("lost", None, 1 / 61), ("a", None, 1 / 62)]


def test_links_with_null_targets_do_not_join(spark):
    links = spark.createDataFrame([("s", "wikilink", ""), ("s", "external", "https://x.org"), ("s", "wikilink", "t"), ("s", "mdlink_relative", "t.md")], "src_doc_id string, kind string, normalized_target string")
    documents = spark.createDataFrame([("1", "t.md", "t", "active"), ("2", "", "", "active")], "doc_id string, path string, slug string, status string")
    found = {(r.kind, r.normalized_target): (r.resolved_doc_id, r.ambiguous) for r in catalog.resolve_links(links, documents).collect()}
    assert found == {("wikilink", ""): (None, False), ("external", "https://x.org"): (None, False), ("wikilink", "t"): ("1", False), ("mdlink_relative", "t.md"): ("1", False)}


def test_ranks_at_both_sizes(spark, monkeypatch):
    from fernlight.functions import shared

    rows = spark.createDataFrame([(i, (i * 7) % 50) for i in range(200)], "k long, s long").repartition(5)
    one = {r.k: r.rank for r in shared.global_rank(rows, "rank", F.desc("s"), F.col("k")).collect()}
    monkeypatch.setattr(shared, "ONE_TASK", 10)
    assert one == {r.k: r.rank for r in shared.global_rank(rows, "rank", F.desc("s"), F.col("k")).collect()}
    assert sorted(one.values()) == list(range(1, 201))
