"""Contiguous shards of least largest size (minimax partition) over ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored, table

#: Cells that one pass over the groups may resolve; the driver sees two sums for each.
CELLS = 8192
#: Groups of slots in a shard.
BUCKETS = 4096


class PrefixIndex:
    """What the driver knows about the sorted running sums of group sizes.

    It is a list of cells (least sum, largest sum, number of sums); no sum lies between cells.
    """

    def __init__(self, cells: list[tuple[int, int, int]]):
        self.cells = sorted(cells)
        self.least = [c[0] for c in self.cells]

    def furthest(self, x: int) -> tuple[int, int]:
        """Bounds of the largest running sum up to x (0 if there is none)."""
        i = bisect_right(self.least, x) - 1
        if i < 0:
            return 0, 0
        low, high, n = self.cells[i]
        if high <= x:
            return high, high
        return (low, low) if n <= 2 else (low, x)

    def fill(self, capacity: int, shards: int, upper: int) -> list[int]:
        """Where shards of this capacity end if each is filled as far as it goes."""
        ends = [0]
        for _ in range(shards):
            ends.append(self.furthest(ends[-1] + capacity)[upper])
        return ends[1:]

    def smallest(self, low: int, high: int, shards: int, upper: int) -> int:
        """By binary search, the least capacity in low..high for which fill() reaches the end."""
        total = self.cells[-1][1]
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, upper)[-1] >= total:
                high = mid
            else:
                low = mid + 1
        return low

    def unclear(self, low: int, high: int, shards: int) -> list[tuple[int, int]]:
        """Spans of cells that must be known better to place the ends for capacities low..high."""
        spans = []
        a = [0, *self.fill(low, shards, 0)]
        b = [0, *self.fill(high, shards, 1)]
        for s in range(shards):
            i = max(0, bisect_right(self.least, a[s] + low) - 1)
            j = max(0, bisect_right(self.least, b[s] + high) - 1)
            open_cells = [c for c in self.cells[i : j + 1] if c[2] > 2]
            if open_cells:
                spans.append((open_cells[0][0], open_cells[-1][1]))
        merged: list[tuple[int, int]] = []
        for x, y in sorted(spans):
            if merged and x <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(y, merged[-1][1]))
            else:
                merged.append((x, y))
        return merged


def _resolve(groups: DataFrame, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The cells of the running sums `upto` in the spans, CELLS for each span at most."""
    span, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k, (x, y) in enumerate(spans):
        inside = F.col("upto").between(x, y)
        step = max(1, -(-(y - x + 1) // CELLS))
        span = F.when(inside, F.lit(k)).otherwise(span)
        cell = F.when(inside, F.floor((F.col("upto") - F.lit(x)) / F.lit(step))).otherwise(cell)
    found = groups.select("upto", span.alias("span"), cell.alias("cell")).where("span is not null")
    found = found.groupBy("span", "cell").agg(F.min("upto"), F.max("upto"), F.count("*"))
    return [(r[2], r[3], r[4]) for r in found.collect()]


def minimax_cuts(groups: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the running sum at which each shard ends.

    groups: a row for each group with its running sum `upto` (sizes are positive). Each pass
    resolves the sums near the possible ends 8192 / (a few) times finer, so that four passes do
    for 100 TB, and the driver never holds more than shards * CELLS cells a pass.
    """
    index = PrefixIndex(_resolve(groups, [(0, total)]))
    while True:
        least = max(largest, -(-total // shards))
        low, high = index.smallest(least, total, shards, 1), index.smallest(least, total, shards, 0)
        if low == high and index.fill(high, shards, 0) == index.fill(high, shards, 1):
            return high, index.fill(high, shards, 0)
        spans = index.unclear(low, high, shards)
        rest = [c for c in index.cells if not any(x <= c[0] and c[1] <= y for x, y in spans)]
        index = PrefixIndex(rest + _resolve(groups, spans))


def minimax_shards(facts: DataFrame, shards: int = 8) -> DataFrame:
    """Gives each row of `facts` a shard (0 to shards - 1) and a slot, gapless from 0 in each shard.

    facts: columns id, size (positive long), group (binary: rows of equal group stay together).
    The groups are ordered by `group`, a digest, so contents don't bias the order. The shards are
    contiguous runs of groups, and no other cut of that order has a smaller largest shard.
    Null ids come first among the slots of their bucket; repeated rows each get a slot; an empty
    table gives an empty result; further columns pass through, but for any named shard or slot, which
    the result's replace.

    Groups are aggregated before they are shuffled, so a group with a third of all rows is one row
    from there on, and rows get their shard by comparing digests, without a join.
    """
    byte = lambda i: F.conv(F.hex(F.substring("group", i, 1)), 16, 10).cast("int")
    groups = facts.groupBy("group").agg(F.sum("size").alias("bytes"))
    groups = stored(groups.withColumn("cell", byte(1) * 256 + byte(2)))
    cells = groups.groupBy("cell").agg(F.sum("bytes").alias("bytes"))  # 65,536 rows at most
    before = F.sum("bytes").over(Window.orderBy("cell")) - F.col("bytes")
    cells = F.broadcast(cells.select("cell", before.alias("before")))
    run = F.sum("bytes").over(Window.partitionBy("cell").orderBy("group"))
    groups = stored(groups.join(cells, "cell").select("group", "bytes", (run + F.col("before")).alias("upto")))
    total, largest = groups.agg(F.max("upto"), F.max("bytes")).first()
    shard = F.lit(0)
    if total is not None:
        _, ends = minimax_cuts(groups, total, largest, shards)
        last = groups.where(F.col("upto").isin([e for e in set(ends) if e < total])).select("group").collect()
        for row in last:
            shard = shard + (F.col("group") > F.lit(row[0])).cast("int")
    rest = [c for c in facts.columns if c not in ("shard", "slot")]
    bucket = F.pmod(F.xxhash64("id", "size"), F.lit(BUCKETS)).cast("int")
    placed = facts.select(F.struct(*rest).alias("r"), "id", "group", shard.alias("shard"), bucket.alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # shards * BUCKETS rows at most
    start = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    counts = F.broadcast(counts.select("shard", "bucket", start.alias("first")))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "group"))
    placed = placed.join(counts, ["shard", "bucket"])
    return placed.select("r", "shard", (F.col("first") + place - F.lit(1)).alias("slot")).select("r.*", "shard", "slot")


def text_facts(docs: DataFrame) -> DataFrame:
    """id, size (UTF-8 bytes plus 1), text_crc32, group (SHA-256) of each document; null is empty."""
    text: Column = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(F.col("doc_id").alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"))


def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards by the law `bytes`; equal texts share a shard."""
    facts = stored(text_facts(table(spark, sf_dir, "documents")))
    return minimax_shards(facts, 8).select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
