import random
import zlib
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from plumbline.llm import shards as S


def brute(sizes, k):
    """The least largest shard of a contiguous cut, by dynamic programming."""
    sums = [0, *accumulate(sizes)]
    best = [0.0] + [float("inf")] * len(sizes)
    for _ in range(k):
        best = [min([best[j], *(max(best[i], sums[j] - sums[i]) for i in range(j))]) for j in range(len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_least(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "CELLS", 8)  # forces several passes
    rng = random.Random(seed)
    n = rng.choice([1, 5, 30, 60])
    rows = [(i, rng.choice([1, 5, 50, 400]) + (5000 if seed == 3 and i == 4 else 0), rng.randrange(n)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, size long, g int").withColumn("group", F.unhex(F.sha2(F.col("g").cast("string"), 256)))
    k = rng.choice([1, 3, 8])
    got = S.minimax_shards(df, k).collect()
    groups = {}
    for r in got:
        groups.setdefault(bytes(r.group), [0, set()])
        groups[bytes(r.group)][0] += r.size
        groups[bytes(r.group)][1].add(r.shard)
    assert all(len(s) == 1 for _, s in groups.values())
    ordered = [groups[g] for g in sorted(groups)]
    shards = [next(iter(s)) for _, s in ordered]
    assert shards == sorted(shards)
    load = {}
    for (size, _), s in zip(ordered, shards, strict=True):
        load[s] = load.get(s, 0) + size
    assert max(load.values()) == brute([s for s, _ in ordered], k)
    for s in load:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_query(spark, small):
    rows = S.op1_minimax_shards(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)


def test_awkward(spark, awkward, nothing):
    got = S.minimax_shards(S.text_facts(awkward), 8).collect()
    assert len(got) == awkward.count()
    assert len({r.shard for r in got if r.id in (0, 3, None)}) == 1
    extra = S.text_facts(awkward).withColumns({c: F.lit(9) for c in ("shard", "slot", "bucket", "first", "r", "n", "cell")})
    more = S.minimax_shards(extra, 8)
    assert sorted(more.columns) == sorted(extra.columns) and {r.bucket for r in more.collect()} == {9}
    assert sorted((str(r.id), r.shard, r.slot) for r in more.collect()) == sorted((str(r.id), r.shard, r.slot) for r in got)
    assert S.minimax_shards(S.text_facts(nothing), 8).count() == 0
