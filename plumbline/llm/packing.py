"""Sum-of-squares packing of token sequences into bins of fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bytebpe import CACHE, byte_bpe, default_path
from plumbline.llm.common import slices, stored, table

CAPACITY, END_ID = 1024, 2
#: Documents that one task packs together.
CHUNK_ROWS = 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, all of 1 to capacity - 1 units, taken in the order given.

    count[g] is the number of open bins with gap g. An item goes to the open bin for which the sum
    of count[g] ** 2 becomes smallest (full bins are closed and don't count; ties: the smaller gap;
    of equal bins the one used last), and to a new bin only where it fits no open one.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins = 0
    for i, size in enumerate(lengths.tolist()):
        here = count[size:capacity]
        change = 2 * (count[: capacity - size] - here) + 2
        change[0] = 1 - 2 * here[0]  # the bin is closed
        change[here == 0] = np.iinfo(np.int64).max
        k = int(change.argmin())
        if here[k]:
            gap = size + k
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, bins = capacity, bins, bins + 1
        where[i], offset[i] = b, capacity - gap
        if gap > size:
            count[gap - size] += 1
            open_bins[gap - size].append(b)
    return where, offset


def _measure(path: str, capacity: int, end_id: int, cache: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, cache)
        for batch in batches:
            doc_id, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in slices(texts):
                n, crcs = [], []
                for ids in bpe.encode(texts[i:j]):
                    ids += end
                    n.append(len(ids) // 4)
                    cuts = [0, *range(len(ids) % (4 * capacity) or 4 * capacity, len(ids) + 1, 4 * capacity)]
                    crcs.append([zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([doc_id.slice(i, j - i), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "n_tokens", "crcs"])

    return step


def _pack(capacity: int):
    def step(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.assign(part=docs.n_tokens % capacity, c0=docs.crcs.str[0])
        docs = docs.sort_values(["part", "doc_id", "n_tokens", "c0"], ascending=[False, True, True, True], na_position="first")
        n, part = docs.n_tokens.to_numpy(), docs.part.to_numpy()
        bins, offset = sum_of_squares(part[part > 0], capacity)
        used = int(bins.max()) + 1 if len(bins) else 0
        pieces = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        short = np.where(part > 0, part, capacity)
        first = piece == 0
        packed = first & (part[row] > 0)
        sequence, at = np.empty(len(row), np.int64), np.zeros(len(row), np.int64)
        sequence[packed], at[packed] = bins, offset
        sequence[~packed] = used + np.arange((~packed).sum())
        return pd.DataFrame({
            "doc_id": docs.doc_id.array[row], "piece": piece.astype("int32"), "start": np.where(first, 0, short[row] + (piece - 1) * capacity), "length": np.where(first, short[row], capacity),
            "ids_crc32": np.concatenate([np.asarray(c) for c in docs.crcs]) if len(docs) else [], "sequence_id": (int(key[0]) << 32) + sequence, "offset": at,
        })

    return step


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, chunk_rows: int = CHUNK_ROWS, cache: int = CACHE) -> DataFrame:
    """Packs the documents' ids, each with end_id appended, into sequences of at most `capacity` ids.

    Only longer documents are cut, into pieces of `capacity` ids, of which the first may be
    shorter; those full pieces are sequences of their own. The short pieces are packed by
    sum-of-squares in descending length, in chunks of about chunk_rows documents by a hash of
    doc_id, length and the row's stored place, so that equal rows are dealt out too; a chunk leaves a
    few bins open, under 0.3 % of all. Null text is empty (the
    end id alone); null doc_ids and repeated rows are packed like others; an empty table gives no
    rows. A Python worker keeps the ids of at most `cache` units of text; fewer take less memory and more
    time, and give the same ids.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    facts = stored(texts.mapInArrow(_measure(tokenizer or default_path(), capacity, end_id, cache), "doc_id long, n_tokens long, crcs array<long>").withColumn("at", F.monotonically_increasing_id()))
    chunks = max(1, -(-facts.count() // chunk_rows))
    chunk = F.pmod(F.xxhash64("doc_id", "n_tokens", "at"), F.lit(chunks)).alias("chunk")
    return facts.select("*", chunk).groupBy("chunk").applyInPandas(_pack(capacity), PIECES)


def op7_pack_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all documents; see there for null, empty, repeated and tied rows and empty tables."""
    return pack(table(spark, sf_dir, "documents"))
