"""Embedding providers, batching by tokens, and the queue's distributed run."""

from __future__ import annotations

import hashlib
import json
import math
import os
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CUT_MARK = "\n[truncated]"
SHORTEST_CUT = 1000


class EmbeddingError(RuntimeError):
    def __init__(self, message: str, retryable: bool):
        super().__init__(message)
        self.retryable = retryable


def local_vectors(texts: list[str], settings: dict) -> list[list[float]]:
    """Unit vectors by hashed words: the same text has the same vector anywhere."""
    n, out = settings["dimensions"] or 64, []
    for text in texts:
        v = [0.0] * n
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % n] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / norm for x in v])
    return out


def http_vectors(texts: list[str], settings: dict) -> list[list[float]]:
    """An OpenAI-compatible endpoint. Rate limits, server errors, timeouts and lost connections may be tried again."""
    body = {"model": settings["model"], "input": texts}
    if settings["request_dimensions"]:
        body["dimensions"] = settings["dimensions"]
    key = os.environ.get("FERNLIGHT_EMBEDDING_API_KEY") or os.environ.get("OPENAI_API_KEY") or ""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(settings["base_url"], json.dumps(body).encode(), head), timeout=settings["timeout_ms"] / 1000) as reply:
            data = json.load(reply)["data"]
    except urllib.error.HTTPError as e:
        raise EmbeddingError(f"HTTP {e.code}: {e.read()[:500].decode('utf-8', 'replace')}", e.code == 429 or e.code >= 500) from None
    except (OSError, TimeoutError) as e:
        raise EmbeddingError(str(e), True) from None
    except (ValueError, KeyError, TypeError) as e:
        raise EmbeddingError(f"the reply can't be read: {e}", False) from None
    if len(data) != len(texts):
        raise EmbeddingError(f"{len(texts)} texts gave {len(data)} vectors", False)
    return [x["embedding"] for x in sorted(data, key=lambda x: x.get("index", 0))]


PROVIDERS = {"local": local_vectors, "openai-compatible": http_vectors}


def cut(text: str, tokens: int, most: int) -> str:
    """A text that is too long, shortened by fifths until its share of the tokens fits."""
    if tokens <= most:
        return text
    out = text
    while len(out) > SHORTEST_CUT and tokens * len(out) / max(1, len(text)) > most:
        out = out[: int(len(out) * 0.8)]
    return out + CUT_MARK


def batches(rows: list[dict], size: int, most_tokens: int, most_input: int) -> list[list[dict]]:
    """Rows in order, as many to a batch as its number and its tokens allow; one alone may be larger."""
    out: list[list[dict]] = []
    held, tokens = [], 0
    for r in rows:
        n = min(r["token_est"], most_input)
        if held and (len(held) >= size or tokens + n > most_tokens):
            out.append(held)
            held, tokens = [], 0
        held.append(r | {"text": cut(r["body"], r["token_est"], most_input)})
        tokens += n
    return [*out, held] if held else out


RESULT = "chunk_uid string, content_hash string, vector array<double>, error string, may_retry boolean"


def embed(pending: DataFrame, settings: dict, provider=None) -> DataFrame:
    """RESULT of each pending row (chunk_uid, content_hash, body, token_est).

    A failed call fails each row of its batch; a vector of the wrong length fails its row alone. After a failure that may be
    tried again a partition leaves its other rows alone: they don't come back and stay queued. Other partitions find out
    for themselves, so a provider that refuses is called once for each partition.
    """
    call = provider or PROVIDERS[settings["provider"]]
    kind = pa.schema([("chunk_uid", pa.string()), ("content_hash", pa.string()), ("vector", pa.list_(pa.float64())), ("error", pa.string()), ("may_retry", pa.bool_())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in batches(part.to_pylist(), settings["batch_size"], settings["max_batch_tokens"], settings["max_input_tokens"]):
                failure, vectors = None, [None] * len(batch)
                try:
                    vectors = call([r["text"] for r in batch], settings)
                except EmbeddingError as e:
                    failure = e
                out = []
                for r, v in zip(batch, vectors, strict=True):
                    error, retry = (str(failure), failure.retryable) if failure else (None, None)
                    if v is not None and settings["dimensions"] and len(v) != settings["dimensions"]:
                        error, retry, v = f"the vector has {len(v)} dimensions instead of {settings['dimensions']}", False, None
                    out.append({"chunk_uid": r["chunk_uid"], "content_hash": r["content_hash"], "vector": v, "error": error, "may_retry": retry})
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                if failure and failure.retryable:
                    return

    return pending.select("chunk_uid", "content_hash", "body", "token_est").mapInArrow(run, RESULT)
