"""Token ids in ORC: run-length encoded integers, row indexes, and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.bytebpe import byte_bpe, default_path
from plumbline.llm.common import shared_dir, slices, table

END_ID = 2
SCHEMA = "doc_id long, n_tokens long, ids array<int>"
#: With the number of the row: the writing partition in the upper bits, the row's place in it below.
STORED = f"{SCHEMA}, place long"
#: Stripes are read apart; a row index entry covers so many documents.
ORC_OPTIONS = {"compression": "zstd", "orc.stripe.size": str(32 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def _encode(path: str, end_id: int | None):
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            doc_id, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in slices(texts):
                ids = [x + end for x in bpe.encode(texts[i:j])]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32())
                offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([doc_id.slice(i, j - i), pa.array(n), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "n_tokens", "ids"])

    return step


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = END_ID) -> None:
    """Writes the ids of each whole text as ORC at `path`, in ascending doc_id order over all files.

    The file names sort as the documents do: the rows are range-partitioned on doc_id and sorted
    within partitions, and no step sees more than its partition; each row is stored with its place.
    Null text is empty (only the end id, if any); null doc_ids come first; rows of one doc_id are
    ordered by text; repeated rows stay; further columns, of whatever name, aren't read; an empty
    table gives no rows.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ids = texts.mapInArrow(_encode(tokenizer or default_path(), end_id), SCHEMA).withColumn("place", F.monotonically_increasing_id())
    ids.write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids; with doc_ids, stripes are skipped by their statistics and Bloom filters."""
    found = spark.read.schema(SCHEMA).orc(path)
    return found if doc_ids is None else found.where(F.col("doc_id").isin(doc_ids))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy()
        data = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        n = np.diff(offsets).astype(np.int64)
        if (n != batch.column("n_tokens").to_numpy()).any():
            raise ValueError("a stored list of ids differs from its stored length")
        crc = [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "place", "doc_id")), pa.array(n), pa.array(crc, pa.int64())], ["part", "place", "doc_id", "n_tokens", "ids_crc32"])


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all read back from `path`.

    The order is that of the stored places. Sums within a writing partition are taken by its rows
    alone; only a sum for each partition meets in one place.
    """
    files = spark.read.schema(STORED).orc(path).withColumn("part", F.shiftright("place", 33))
    sizes = files.select("part", "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    sizes = F.broadcast(sizes.select("part", before.alias("before")))
    rows = files.select("part", "place", "doc_id", "n_tokens", "ids").mapInArrow(_digest, "part long, place long, doc_id long, n_tokens long, ids_crc32 long")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.join(sizes, "part").select("doc_id", (within + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written by write_tokens() and read back by token_starts(); see there for awkward rows."""
    path = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_starts(spark, path)
