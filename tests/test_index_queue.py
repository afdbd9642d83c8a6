"""Segmentation, the persisted index, the embedding queue and the log of runs."""

from __future__ import annotations

import http.server
import json
import math
import os
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fernlight.functions import segment
from fernlight.functions import text as T
from fernlight.functions.shared import staged
from fernlight.operators import catalog, keyword
from fernlight.plans import search as searching
from fernlight.plans.config import ConfigError
from fernlight.plans.store import Store
from fernlight.plans.sync import embed_pending, gone, reindex, sync
from fernlight.sources import embeddings

from .test_sync_search import load, write

CHINESE = "冠状动脉旁路移植术是治疗冠心病的常用手术，术后 Beta Blocker 可以降低心率。"


def segmented(spark, text):
    segment.register(spark)
    return spark.createDataFrame([(text,)], "t string").select(segment.terms(F.col("t"))).first()[0]


def test_segments_chinese_and_folds(spark):
    got = segmented(spark, CHINESE)
    assert {"治疗", "冠心病", "手术", "beta", "blocker", "降低"} <= set(got) and "的" not in got and "是" not in got
    assert segmented(spark, "The Ｖ1.2 ｶﾞ of don't, a_b 请问 中") == ["v1.2", "ガ", "don't", "a_b"]
    assert segmented(spark, None) == [] and segmented(spark, " \n") == []
    assert segment.query_terms(spark, "ＡＢＣ abc 手术的手术") == ["abc", "手术"]


def test_search_finds_chinese_and_full_width_words(spark, tmp_path):
    write(tmp_path, "concepts/heart.md", f"# 冠心病\n{CHINESE}\n")
    write(tmp_path, "concepts/wide.md", "# Ｆｕｌｌ　Ｗｉｄｔｈ\nＡＰＩ の ｶﾞｲﾄﾞ\n")
    write(tmp_path, "concepts/other.md", "# Other\nnothing of that\n")
    config = load(tmp_path)
    sync(spark, config)
    store = Store(spark, config.data_dir())
    best = lambda query: [r["path"] for r in searching.search(store, config, query, k=5)["results"]]
    assert best("降低心率的手术") == ["concepts/heart.md"]
    assert best("beta blocker 冠心病")[0] == "concepts/heart.md"
    assert best("api") == best("ＡＰＩ") == best("ガイド") == ["concepts/wide.md"]
    assert best("full width") == ["concepts/wide.md"]
    terms = {r.term for r in store.table("postings").collect()}
    assert {"手术", "api", "full"} <= terms


def test_search_is_bm25_from_the_index(spark, tmp_path):
    """Scores by the formula over the stored chunks, after a second sync that changes, adds and removes."""
    texts = {"a": "alpha beta beta", "b": "alpha gamma", "c": "beta delta delta"}
    for n, t in texts.items():
        write(tmp_path, f"{n}.md", f"# {n.upper()}\n{t}\n")
    config = load(tmp_path)
    sync(spark, config)
    (tmp_path / "c.md").unlink()
    write(tmp_path, "b.md", "# B\nalpha alpha epsilon\n")
    write(tmp_path, "d.md", "# Alpha beta\nzeta\n")
    sync(spark, config)
    store = Store(spark, config.data_dir())
    rows = store.table("chunks").join(store.table("documents").where("status = 'active'").select("doc_id", "title", "slug"), "doc_id").collect()
    split = lambda t: segmented(spark, t)
    counts = {r.chunk_uid: Counter(split(r.title) * 4 + split(r.slug) * 3 + split(r.body)) for r in rows}
    length = {u: max(1, sum(c.values())) for u, c in counts.items()}
    mean = sum(length.values()) / len(length)
    want = {}
    for r in rows:
        score = 2.0 * ("alpha beta" in r.title.lower())
        for t in ("alpha", "beta"):
            tf, df = counts[r.chunk_uid][t], sum(t in c for c in counts.values())
            score += math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[r.chunk_uid] / mean)) if tf else 0
        if score:
            want[r.chunk_uid] = score
    found = searching.search(store, config, "Alpha beta", k=50, pooled=False)
    assert found["diagnostics"]["corpus_chunks"] == len(rows)
    assert {r["chunk_uid"]: pytest.approx(r["keyword_score"]) for r in found["results"]} == want
    assert all(r["snippet"] and r["body"] for r in found["results"])
    before = {tuple(r) for r in store.table("postings").where(F.col("chunk_uid").isin(list(counts))).collect()}
    assert before == {(t, u, n) for u, c in counts.items() for t, n in c.items()}
    reindex(store)
    assert {tuple(r) for r in store.table("postings").where(F.col("chunk_uid").isin(list(counts))).collect()} == before


def test_queries_read_postings_not_bodies(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"T{i}", f"s-{i}", "word " * i) for i in range(1, 9)], "chunk_uid long, title string, slug string, body string")
    own = staged(keyword.index(rows), "indexed")
    inverted = staged(keyword.by_term(staged(keyword.postings(own), "postings")), "postings")
    plan = keyword.score(own.drop("body", *keyword.FIELD_TERMS), inverted, ["word"])._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "In(term" in plan.replace("EqualTo(term", "In(term")


def test_whole_queue_is_not_ordered_in_one_task(spark):
    queue = spark.createDataFrame([("u", "t", 0, None, None)], "chunk_uid string, enqueued_at string, attempts int, last_error string, retryable boolean")
    chunks = spark.createDataFrame([("u", "h", "b", 1)], "chunk_uid string, content_hash string, body string, token_est long")
    plan = lambda n: catalog.poll(queue, chunks, n)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan(None) and "Sort [enqueued" not in plan(None) and "SinglePartition" not in plan(None)
    assert "TakeOrdered" in plan(5) and catalog.poll(queue, chunks).count() == 1


def test_one_bad_vector_fails_alone(spark, tmp_path):
    write(tmp_path, "a.md", "# A\nfirst\n# B\nsecond\n# C\nthird\n")
    config = load(tmp_path, **{"embedding.provider": "local", "embedding.dimensions": 4})

    def uneven(texts, _):
        return [[1.0] * (3 if "second" in t else 4) for t in texts]

    out = sync(spark, config, provider=uneven).embedding
    store = Store(spark, config.data_dir())
    failed = store.table("embed_queue").where("last_error IS NOT NULL").collect()
    assert out["failed"] == len(failed) == 1 and out["succeeded"] == 3 and failed[0].retryable is False and "3 dimensions" in failed[0].last_error
    assert store.table("chunks").where("embedding IS NULL").count() == 1
    # A failed row that may not be tried again isn't polled; a limit takes the oldest only.
    assert embed_pending(store, config)["attempted"] == 0
    assert sync(spark, config, retry_failed=True, embed_limit=0).embedding["attempted"] == 0


def test_every_run_is_logged(spark, tmp_path, monkeypatch):
    write(tmp_path, "a.md", "# A\nword\n")
    config = load(tmp_path)
    first, second = sync(spark, config), sync(spark, config)
    assert second.indexed == 0 and second.revision == first.revision
    sync(spark, config, dry_run=True)
    store = Store(spark, config.data_dir())
    # A file whose state can't be told deletes nothing, and the run is logged as failed.
    (tmp_path / "a.md").unlink()
    real = os.stat

    def refuse(path, *more, **options):
        if str(path).endswith("a.md"):
            raise PermissionError(13, "no")
        return real(path, *more, **options)

    monkeypatch.setattr(os, "stat", refuse)
    with pytest.raises(ConfigError):
        sync(spark, config)
    monkeypatch.undo()
    assert store.table("documents").where("status = 'active'").count() == 1
    assert sync(spark, config).tombstoned == 1
    runs = [(r.status, json.loads(r.plan_summary)["tombstoned"]) for r in store.table("sync_runs").orderBy("started_at").collect()]
    assert runs == [("success", 0), ("success", 0), ("failed", 0), ("success", 1)]
    (tmp_path / "d").mkdir()
    assert gone(str(tmp_path), "d") and gone(str(tmp_path), "none/x.md") and not gone(str(tmp_path), ".fernlight/journal/" + os.listdir(tmp_path / ".fernlight/journal")[0])


def test_any_vector_score_makes_a_search_hybrid(spark, tmp_path):
    write(tmp_path, "a.md", "# A\nalpha alpha alpha\n")
    write(tmp_path, "b.md", "# B\nbeta\n")
    config = load(tmp_path, **{"embedding.provider": "local", "embedding.dimensions": 2, "search.vector_candidates": 0})
    calls = lambda texts, _: [[1.0, 0.0] if "beta" in t.lower() else [0.0, 1.0] for t in texts]
    sync(spark, config, provider=calls)
    store = Store(spark, config.data_dir())
    # The only result is a keyword's, beside a vector score that comes second.
    one = lambda query, c=config: searching.search(store, c, query, k=1, provider=lambda *_: [[1.0, 0.0]])
    found = one("alpha")
    assert found["retrieval_mode"] == "hybrid"
    assert one("alpha", load(tmp_path, **{"search.mode": "keyword"}))["retrieval_mode"] == "keyword_only"
    near = load(tmp_path, **{"embedding.provider": "local", "embedding.dimensions": 2, "search.vector_candidates": 1})
    assert sum(1 for r in searching.search(store, near, "zzz", k=9, pooled=False, provider=lambda *_: [[1.0, 0.0]])["results"] if r["vector_score"]) == 1


class Endpoint(http.server.BaseHTTPRequestHandler):
    replies: list = []
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Endpoint.seen.append((body, self.headers.get("Authorization")))
        status, reply = Endpoint.replies.pop(0)
        if callable(reply):
            reply = reply(body)
        data = json.dumps(reply).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


def test_http_vectors(monkeypatch):
    server = http.server.HTTPServer(("127.0.0.1", 0), Endpoint)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    monkeypatch.setenv("FERNLIGHT_EMBEDDING_API_KEY", "k1")
    settings = {"base_url": f"http://127.0.0.1:{server.server_port}/embeddings", "model": "m", "dimensions": 2, "request_dimensions": True, "timeout_ms": 5000}
    turned = lambda body: {"data": [{"index": i, "embedding": [float(i), 0.0]} for i in reversed(range(len(body["input"])))]}
    try:
        Endpoint.replies[:] = [(200, turned), (429, {"error": "slow"}), (503, {}), (400, {"error": "bad"}), (200, {"nothing": 1}), (200, {"data": []})]
        assert embeddings.http_vectors(["a", "b"], settings) == [[0.0, 0.0], [1.0, 0.0]]
        assert Endpoint.seen[0] == ({"model": "m", "input": ["a", "b"], "dimensions": 2}, "Bearer k1")
        for retryable in (True, True, False, False, False):
            with pytest.raises(embeddings.EmbeddingError) as e:
                embeddings.http_vectors(["a"], settings)
            assert e.value.retryable is retryable
    finally:
        server.shutdown()
        server.server_close()
    with pytest.raises(embeddings.EmbeddingError) as e:
        embeddings.http_vectors(["a"], settings)
    assert e.value.retryable


def test_batches_by_force():
    rows = [{"body": "x" * n, "token_est": n} for n in (5, 900, 30, 30, 2000, 1, 1, 1, 1, 40)]
    found = embeddings.batches(rows, 3, 1000, 1500)
    assert [r["token_est"] for b in found for r in b] == [r["token_est"] for r in rows]
    for i, b in enumerate(found):
        size = sum(min(r["token_est"], 1500) for r in b)
        assert len(b) <= 3 and (size <= 1000 or len(b) == 1)
        if i:  # the first row of a batch didn't fit into the one before
            held = found[i - 1]
            assert len(held) == 3 or sum(min(r["token_est"], 1500) for r in held) + min(b[0]["token_est"], 1500) > 1000
    assert found[-1][-1]["text"] == "x" * 40 and embeddings.cut("y" * 3000, 3000, 1500) == "y" * 1228 + embeddings.CUT_MARK


def test_trim_of_wide_blanks(spark):
    assert spark.range(1).select(T.trim(F.lit("　 a﻿"))).first()[0] == "a"
