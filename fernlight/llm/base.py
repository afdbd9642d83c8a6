"""What the operators share: columns, folds, text slices and the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_dir, staged

__all__ = ["SPACE", "documents", "free_name", "id_and_text", "id_fold", "rows_of", "shared_dir", "slices", "staged"]

#: ASCII white space, as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows that Python holds as objects at a time.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % modulus


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *extra: Column) -> DataFrame:
    """Just the columns an operator reads, under names of its own, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *extra)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, of at most SLICE_BYTES or one row, so that few texts are Python objects at once."""
    for batch in batches:
        held = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while held:
            part = held.pop()
            half = part.num_rows // 2
            if half and part.nbytes > SLICE_BYTES:
                held += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def free_name(docs: DataFrame, name: str) -> str:
    """A name that no column of docs begins with."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name = "_" + name
    return name


def rows_of(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=schema)
