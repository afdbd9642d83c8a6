"""Keeping the catalogue up to date while files arrive: a file stream triggers syncs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.config import Config
from ..plans.sync import sync


def watch(spark: SparkSession, config: Config, checkpoint: str, every: str = "30 seconds", **options) -> StreamingQuery:
    """A query that syncs whenever the stream of files under the root brings something new.

    Spark's listing doesn't see names with a leading dot or underscore, nor deletions; each sync it triggers does.
    """
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(config.root).select("path")

    def on_batch(batch, _number: int) -> None:
        if not batch.isEmpty():
            sync(spark, config, **options)

    return files.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
