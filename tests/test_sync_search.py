"""Sync and search over small trees of files."""

from __future__ import annotations

import json

import pytest

from fernlight.plans import config as settings
from fernlight.plans.search import document_result, search
from fernlight.plans.serve import Service, start
from fernlight.plans.store import Store
from fernlight.plans.sync import sync
from fernlight.sources.embeddings import EmbeddingError


def write(root, path, text):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text, "utf-8")


def load(root, **more):
    return settings.load(str(root), overrides=more or None, env={})


@pytest.fixture()
def tree(tmp_path):
    write(tmp_path, "concepts/alpha.md", "---\ntitle: Alpha\nsafe: true\n---\n# Alpha\nThe alpha guide [[beta]] and [x](../raw/gone.md).\n")
    write(tmp_path, "concepts/beta.md", "---\ntitle: Beta\nsafe: false\n---\n# Beta\nThe beta guide of alpha.\n")
    write(tmp_path, "_meta/rules.md", "# Rules\nalpha zeta targeted\n")
    return tmp_path


def test_sync_steps(spark, tree):
    config = load(tree)
    first = sync(spark, config)
    assert (first.discovered, first.indexed, first.skipped, first.tombstoned) == (3, 3, 0, 0)
    revision = first.revision
    again = sync(spark, config)
    assert (again.indexed, again.skipped, again.revision) == (0, 3, revision)
    store = Store(spark, config.data_dir())
    links = {(r.kind, r.normalized_target): r for r in store.table("links").collect()}
    assert links["wikilink", "beta"].resolved_doc_id is not None
    assert links["mdlink_relative", "raw/gone.md"].resolved_doc_id is None
    write(tree, "concepts/beta.md", "# Beta\nchanged words\n")
    (tree / "_meta/rules.md").unlink()
    write(tree, "new.md", "# New\nfresh\n")
    third = sync(spark, config)
    assert (third.indexed, third.skipped, third.tombstoned) == (2, 1, 1)
    status = {r.path: r.status for r in store.table("documents").collect()}
    assert status == {"concepts/alpha.md": "active", "concepts/beta.md": "active", "new.md": "active", "_meta/rules.md": "deleted"}
    write(tree, "new.md", "---\nexcluded_from_wiki_knowledge_base: true\n---\n# New\n")
    fourth = sync(spark, config)
    assert (fourth.excluded, fourth.tombstoned, fourth.indexed) == (1, 1, 0)
    assert sync(spark, config, dry_run=True).indexed == 0
    assert sync(spark, config, full=True).indexed == 2


def test_too_large_file_leaves_the_index(spark, tmp_path):
    write(tmp_path, "a.md", "# A\nword\n")
    sync(spark, load(tmp_path))
    out = sync(spark, load(tmp_path, **{"discovery.max_file_bytes": 4}))
    assert (out.excluded, out.diagnostics, out.tombstoned) == (1, 1, 1)


def test_search_filters_pooling_and_http(spark, tree):
    config = load(tree)
    sync(spark, config)
    store = Store(spark, config.data_dir())
    found = search(store, config, "alpha guide", k=3, explain=True)
    assert found["retrieval_mode"] == "keyword_only" and found["diagnostics"]["keyword_algorithm"] == "bm25"
    assert found["results"][0]["path"] == "concepts/alpha.md"
    assert len({r["path"] for r in found["results"]}) == len(found["results"])
    assert found["results"][0]["explain"]["keyword_rank"] == 1
    assert document_result(found["results"][0])["slug"] == "alpha"
    assert search(store, config, "the of")["results"] == []
    only = search(store, config, "alpha guide", facets={"safe": "false"})
    assert {r["path"] for r in only["results"]} == {"concepts/beta.md"}
    service = Service(store, config, api_key="k")
    head = "Bearer k"
    body = {"knowledge_id": "default", "query": "alpha", "retrieval_setting": {"top_k": 2, "score_threshold": 0.5}, "metadata_condition": {"conditions": [{"name": "safe", "comparison_operator": "is", "value": "true"}]}}
    ask = lambda path, value, key=head, method="POST": service.answer(method, path, key, json.dumps(value).encode())
    status, reply = ask("/retrieval", body)
    assert status == 200 and {r["metadata"]["path"] for r in reply["records"]} == {"concepts/alpha.md"} and reply["records"][0]["score"] == 1
    assert ask("/retrieval", body, None)[1]["error_code"] == 1001
    assert ask("/retrieval", body, "Bearer no")[1]["error_code"] == 1002
    assert ask("/retrieval", body | {"knowledge_id": "x"})[1]["error_code"] == 2001
    assert ask("/search", {"query": "alpha", "k": 0})[0] == 400
    assert ask("/search", {"query": "alpha"}, method="GET")[0] == 405
    status, reply = ask("/search", {"query": "beta guide", "filters": {"safe": False}})
    assert status == 200 and reply["count"] == 2 and reply["results"][0]["score"] == reply["results"][0]["normalized_score"]
    assert ask("/health", {}, None, "GET")[1]["documents_active"] == 3
    server = start(service)
    server.server_close()


def test_embedding_queue(spark, tree):
    config = load(tree, **{"embedding.provider": "local", "embedding.dimensions": 32})

    def refuse(texts, _):
        raise EmbeddingError("HTTP 429: slow down", True)

    failed = sync(spark, config, provider=refuse).embedding
    assert failed["succeeded"] == 0 and failed["failed"] > 0 and failed["remaining"] >= failed["failed"]
    from fernlight.plans.sync import embed_pending

    store = Store(spark, config.data_dir())
    done = embed_pending(store, config)
    assert done["failed"] == 0 and done["remaining"] == 0
    assert store.state("embedding_fingerprint")["dimensions"] == 32
    found = search(store, config, "alpha guide", k=2)
    assert found["retrieval_mode"] == "hybrid"
    with pytest.raises(settings.ConfigError):
        sync(spark, load(tree, **{"embedding.provider": "local", "embedding.dimensions": 16}))
    again = sync(spark, load(tree, **{"embedding.provider": "local", "embedding.dimensions": 32}), full=True)
    assert again.indexed == 3 and store.table("embed_queue").isEmpty()
