"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.scratch import drop_scratch, shared_dir, stored

__all__ = ["drop_scratch", "shared_dir", "slices", "stored", "table", "text_and_kept", "with_kept"]

#: Rows and bytes in an Arrow batch: texts may be long, so batches are kept small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Characters that a Python step works on at a time.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`.

    It also sets the session's bounds of an Arrow batch, which are read when a query runs: texts may be
    long, and the default is ten thousand rows.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` of about `chars` characters each, and of one text at least."""
    first = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > chars:
            yield first, i
            first, size = i, 0
        size += n
    if texts:
        yield first, len(texts)


def with_kept(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A struct `kept` of the columns to keep, and the text beside it if it isn't among them."""
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept")
    return docs.select(kept) if "text" in keep else docs.select(kept, F.col("text").alias("text"))


def text_and_kept(batch: pa.RecordBatch) -> tuple[list[str | None], pa.StructArray]:
    """The texts and the struct of a batch of with_kept()."""
    kept = batch.column("kept")
    text = batch.column("text") if batch.num_columns > 1 else kept.flatten()[kept.type.get_field_index("text")]
    return text.to_pylist(), kept
