"""The catalogue as revisions of Parquet tables under one folder, which any Hadoop file system may hold.

A revision is written whole beside the current one and becomes current when a one-line pointer file is replaced. What
doesn't change is not written again: the pointer names, for each table, the revision that holds it.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.markdown import CHUNK, DOCUMENT, LINK
from .config import Config, ConfigError

SCHEMA_VERSION = 2
TABLES = {
    "documents": f"{DOCUMENT}, status string, diag_flags array<string>, last_synced_at string",
    "chunks": f"doc_id string, {CHUNK}, embedding array<double>, length long, title_folded string, slug_folded string",
    "postings": "term string, chunk_uid string, tf long",
    "links": f"src_doc_id string, {LINK}, resolved_doc_id string, ambiguous boolean",
    "embedding_cache": "provider string, model string, dimensions int, content_hash string, vector array<double>",
    "embed_queue": "chunk_uid string, enqueued_at string, attempts int, last_error string, retryable boolean",
    "sync_runs": "run_id string, started_at string, finished_at string, status string, plan_summary string",
}
KEPT_ON_RESET = ("embedding_cache",)
#: Tables that only grow: each addition is files of its own beside the revisions, and makes no new revision.
APPENDED = ("sync_runs",)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _replace(self, name: str, text: str) -> None:
        """Written beside and renamed, so that readers see the old text or the new."""
        beside = self._path(f"{self.folder}/.{name}-{uuid.uuid4().hex}")
        stream = self._fs.create(beside, True)
        stream.write(text.encode())
        stream.close()
        jvm = self.spark._jvm
        beside, target = self._fs.makeQualified(beside), self._fs.makeQualified(self._path(f"{self.folder}/{name}"))
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        flags = self.spark.sparkContext._gateway.new_array(rename, 1)
        flags[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, target, flags)

    def pointer(self) -> dict[str, Any]:
        text = self._read("current.json")
        return json.loads(text) if text else {"revision": 0, "tables": {}, "state": {"schema_version": SCHEMA_VERSION}}

    def state(self, key: str) -> Any:
        return self.pointer()["state"].get(key)

    def table(self, name: str) -> DataFrame:
        if name in APPENDED:
            schema, path = StructType.fromDDL(TABLES[name]), f"{self.folder}/{name}"
            return self.spark.read.schema(schema).parquet(path) if self._fs.exists(self._path(path)) else self.spark.createDataFrame([], schema)
        revision = self.pointer()["tables"].get(name)
        schema = StructType.fromDDL(TABLES[name])
        if revision is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/revision={revision}/{name}")

    def commit(self, tables: dict[str, DataFrame], state: dict[str, Any] | None = None) -> int:
        """Writes a revision of these tables and makes it current; a state value of None is removed."""
        now = self.pointer()
        revision = now["revision"] + 1
        for name, df in tables.items():
            columns = StructType.fromDDL(TABLES[name]).fieldNames()
            df.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/revision={revision}/{name}")
        own = {k: v for k, v in (now["state"] | (state or {})).items() if v is not None}
        self._replace("current.json", json.dumps({"revision": revision, "tables": now["tables"] | dict.fromkeys(tables, revision), "state": own}))
        return revision

    def append(self, name: str, rows: DataFrame) -> None:
        rows.select(*StructType.fromDDL(TABLES[name]).fieldNames()).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def set_state(self, **state: Any) -> None:
        self.commit({}, state)

    def reset(self) -> None:
        """Empties the index; the embedding cache and the log of runs stay."""
        now = self.pointer()
        now["tables"] = {k: v for k, v in now["tables"].items() if k in KEPT_ON_RESET}
        now["state"] = {k: v for k, v in now["state"].items() if k not in ("last_sync", "embedding_fingerprint")}
        self._replace("current.json", json.dumps(now | {"revision": now["revision"] + 1}))

    def vacuum(self) -> list[str]:
        """Removes revisions that no table of the current pointer is in."""
        now = self.pointer()
        used, gone = set(now["tables"].values()), []
        if self._fs.exists(self._path(self.folder)):
            for s in self._fs.listStatus(self._path(self.folder)):
                m = re.fullmatch(r"revision=(\d+)", s.getPath().getName())
                if m and int(m[1]) not in used and int(m[1]) <= now["revision"]:
                    self._fs.delete(s.getPath(), True)
                    gone.append(s.getPath().getName())
        return sorted(gone)


def open_store(spark: SparkSession, config: Config) -> Store:
    if config["storage.backend"] != "parquet":
        raise ConfigError("storage.backend jdbc needs a driver jar that isn't here", "Use parquet, or copy the tables with export_jdbc.")
    return Store(spark, config.data_dir())


def export_jdbc(store: Store, url: str, properties: dict[str, str] | None = None) -> None:
    """Copies all tables to a database; needs its driver on Spark's class path. Arrays go as JSON texts."""
    from pyspark.sql import functions as F

    for name in TABLES:
        df = store.table(name)
        flat = df.select(*(F.to_json(c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes))
        flat.write.mode("overwrite").jdbc(url, name, properties=properties or {})
