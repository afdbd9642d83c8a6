"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fernlight-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/fernlight/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task ranks; they are keys and scores, some dozen bytes each.
ONE_TASK = 200_000


def global_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with a column of ranks 1.. in the given total order.

    df is written and counted. Up to ONE_TASK rows are ranked by a window. More are range-partitioned and sorted; a row's
    place in its partition is added to the rows of the partitions before, which are counted from the same written table.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written before, since range partitioning reads its input twice.
    held = staged(df, "unranked")
    if held.count() <= ONE_TASK:
        return held.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("long"))
    placed = staged(held.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("__at", 33)
    counts = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}  # one row for each partition
    before, total = [], 0
    for p in sorted(counts):
        before += [F.lit(p), F.lit(total)]
        total += counts[p]
    offset = F.create_map(*before)[part] if before else F.lit(0)
    return placed.withColumn(name, (offset + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("__at")
