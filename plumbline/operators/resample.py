"""Cluster bootstrap and permutation tests from additive statistics.

A replicate draws targets with replacement. Its metrics are sums over the drawn targets' bin
statistics, so replicates multiply counts of draws with a small table (targets times bins) and never
see residues. Draws are digests of (seed, replicate, draw): the same on every engine and in every retry.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from plumbline.functions.derive import bin_index, clip, confidence, interval_text
from plumbline.operators.calibration import metrics
from plumbline.operators.ranks import average_ranks, covariate_scan
from plumbline.scratch import numbered, stored

#: Targets whose draws one group multiplies (at most 2^16), draws of a replicate that are made at once,
#: and draws that a task makes.
BLOCK, PIECE, TASK_DRAWS = 4096, 1 << 20, 2_000_000


def digest_int(*parts: Column) -> Column:
    """The first 32 bits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


def slabs(df: DataFrame, by: list[str], n_bins: int = 20) -> DataFrame:
    """candidate, by, bin, c, sc, sa, sp of all rows, stored: one pass over df. bin is null where plddt
    or lddt is; such rows make their target known, but don't count."""
    whole = F.col("plddt").isNotNull() & F.col("lddt").isNotNull()
    rows = df.select("candidate", *by, "plddt", "lddt", F.when(whole, bin_index(confidence(F.col("plddt")), n_bins)).alias("bin"))
    sums = (F.sum(confidence(F.col("plddt"))).alias("sc"), F.sum("lddt").alias("sa"), F.sum("plddt").alias("sp"))
    return stored(rows.groupBy("candidate", *by, "bin").agg(F.count("*").alias("c"), *sums))


def target_index(df: DataFrame) -> DataFrame:
    """candidate and idx: every candidate of the frame, numbered from 0 in string order."""
    return stored(numbered(df.where("candidate is not null").select("candidate").distinct(), ["candidate"], "idx"))


def _draw_step(seed: int, n: int, pieces: int):
    """rep, block, at: for each block of targets that a piece of a replicate draws from, the drawn
    places in it (unsigned 16-bit integers, one for each draw)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column("id").to_pylist():
                rep, k = divmod(piece, pieces)
                head = b"%d:%d:" % (seed, rep)
                heads = b"".join([hashlib.md5(b"%b%d" % (head, d), usedforsecurity=False).digest()[:4] for d in range(k * PIECE, min(n, (k + 1) * PIECE))])
                idx = np.sort(np.frombuffer(heads, ">u4").astype(np.int64) % n)  # digest_int() of seed, rep and draw
                blocks, first = np.unique(idx // BLOCK, return_index=True)
                at = [x.tobytes() for x in np.split((idx % BLOCK).astype("<u2"), first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([rep] * len(at), pa.int64()), pa.array(blocks, pa.int64()), pa.array(at, pa.binary())], ["rep", "block", "at"])

    return step


def _sum_step(by: list[str]):
    """rep, by, c, sc, sa of a block's drawn targets; groups of which a replicate draws none have no row."""

    def step(draws: pa.Table, own: pa.Table) -> pa.Table:
        groups: dict[tuple, int] = {}
        group = np.array([groups.setdefault(g, len(groups)) for g in zip(*(own.column(c).to_pylist() for c in by), strict=True)], np.int64)
        keys = own.select(by).take(np.unique(group, return_index=True)[1])
        sums = np.zeros((BLOCK, len(groups), 3))
        for k, c in enumerate(("c", "sc", "sa")):
            np.add.at(sums, (own.column("at").to_numpy(), group, k), own.column(c).to_numpy())
        sums = sums.reshape(BLOCK, -1)
        broken = ~np.isfinite(sums).all(axis=1)  # these count only where they are drawn
        parts = []
        for i in range(0, draws.num_rows if groups else 0, 256):
            some = draws.slice(i, 256)
            m = np.array([np.bincount(np.frombuffer(x, "<u2"), minlength=BLOCK) for x in some.column("at").to_pylist()], float)
            total = m[:, ~broken] @ sums[~broken]
            for t in np.flatnonzero(broken):
                drawn = m[:, t] > 0
                total[drawn] += m[drawn, t, None] * sums[t]
            total = total.reshape(len(m), -1, 3)
            row, col = np.nonzero(total[:, :, 0])
            c, sc, sa = total[row, col].T
            found = keys.take(col)
            parts.append(pa.Table.from_arrays([some.column("rep").combine_chunks().take(pa.array(row)), *found.columns, pa.array(np.rint(c).astype(np.int64)), pa.array(sc), pa.array(sa)], ["rep", *by, "c", "sc", "sa"]))
        kinds = pa.schema([("rep", pa.int64()), *own.select(by).schema, ("c", pa.int64()), ("sc", pa.float64()), ("sa", pa.float64())])
        return pa.concat_tables(p.cast(kinds) for p in parts) if parts else kinds.empty_table()

    return step


def replicate_sums(stats: DataFrame, targets: DataFrame, by: list[str], reps: int, seed: int = 0) -> DataFrame:
    """rep, by, c, sc, sa: the sums of stats (candidate, by, c, sc, sa) over the targets that each
    replicate draws, as often as it does; a group of which it draws none has no row.

    A replicate draws as many targets as there are, by digests of (seed, rep, draw). The draws are made
    PIECE at a time and dealt by blocks of BLOCK targets, two bytes each; a block's counts of draws
    are multiplied with its targets' sums, and only the products are added up across blocks.
    """
    spark, n = stats.sparkSession, targets.count()  # targets are stored
    pieces = max(1, -(-n // PIECE))
    parts = min(reps * pieces, max(spark.sparkContext.defaultParallelism, reps * n // TASK_DRAWS))
    draws = spark.range(0, reps * pieces if n else 0, 1, max(1, parts)).mapInArrow(_draw_step(seed, n, pieces), "rep long, block long, at binary")
    own = stats.join(targets, "candidate").select(F.floor(F.col("idx") / BLOCK).cast("long").alias("block"), F.pmod("idx", F.lit(BLOCK)).cast("int").alias("at"), *by, *(F.col(c).cast("double").alias(c) for c in ("c", "sc", "sa")))
    kinds = StructType([StructField("rep", LongType()), *(StructField(c, stats.schema[c].dataType) for c in by), StructField("c", LongType()), StructField("sc", DoubleType()), StructField("sa", DoubleType())])
    sums = draws.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_sum_step(by), kinds)
    return sums.groupBy("rep", *by).agg(*(F.sum(c).alias(c) for c in ("c", "sc", "sa")))


def replicate_bins(stats: DataFrame, targets: DataFrame, reps: int, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """rep, by, bin, c, sc, sa of each replicate; targets without rows in the slabs draw zeros."""
    return replicate_sums(stats.where("bin is not null"), targets, [*(by or []), "bin"], reps, seed)


def pooled(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, bin and the sums over all targets."""
    return stats.where("bin is not null").groupBy(*(by or []), "bin").agg(*(F.sum(c).alias(c) for c in ("c", "sc", "sa", "sp")))


def interval(values: DataFrame, value: str, by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """lo, hi and se by percentiles and population deviation; nulls don't count."""
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    found = values.groupBy(*(by or [])).agg(q.alias("q"), F.stddev_pop(value).alias("se"), F.count(value).alias("n_reps"))
    return found.select(*(by or []), F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"), "se", "n_reps")


def bootstrap_metric(df: DataFrame, metric: str, reps: int = 2000, seed: int = 0, n_bins: int = 20, alpha: float = 0.05) -> DataFrame:
    """One row: the metric of all rows as `point`, and its interval over target replicates."""
    stats = slabs(df, [], n_bins)
    targets = target_index(stats)
    values = metrics(replicate_bins(stats, targets, reps, seed), ["rep"], clipped=True)
    point = metrics(pooled(stats), [], clipped=True).select(F.col(metric).alias("point"))
    return point.join(interval(values, metric, alpha=alpha))  # one row each


def bootstrap_contrast(df: DataFrame, column: str, a, b, metric: str = "overconfidence", reps: int = 2000, seed: int = 0, n_bins: int = 20, alpha: float = 0.05) -> DataFrame:
    """metric(column = a) - metric(column = b), both strata by the same draws of all targets.

    One pass over df; a level without rows gives nulls.
    """
    level = lambda v: F.lit(v).cast(df.schema[column].dataType)
    stats = slabs(df.withColumn("__level", F.when(F.col(column).isin(level(a), level(b)), F.col(column))), ["__level"], n_bins)
    targets = target_index(stats)
    stats = stats.where("__level is not null")
    of = lambda v: F.max(F.when(F.col("__level") == level(v), F.col(metric)))
    values = metrics(replicate_bins(stats, targets, reps, seed, ["__level"]), ["rep", "__level"], clipped=True)
    values = values.groupBy("rep").agg((of(a) - of(b)).alias("d"))
    point = metrics(pooled(stats, ["__level"]), ["__level"], clipped=True).agg((of(a) - of(b)).alias("point"))
    found = point.join(interval(values, "d", alpha=alpha))  # one row each
    return found.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


def curve_intervals(df: DataFrame, reps: int = 2000, seed: int = 0, n_bins: int = 20, alpha: float = 0.05) -> DataFrame:
    """bin, gap_lo, gap_hi over the replicates in which the bin isn't empty."""
    return _curve_intervals(slabs(df, [], n_bins), reps, seed, alpha)


def _curve_intervals(stats: DataFrame, reps: int, seed: int, alpha: float) -> DataFrame:
    targets = target_index(stats)
    gaps = replicate_bins(stats, targets, reps, seed)
    gaps = gaps.withColumn("gap", F.try_divide(F.col("sc") - F.col("sa"), F.col("c")))
    return interval(gaps, "gap", ["bin"], alpha).select("bin", F.col("lo").alias("gap_lo"), F.col("hi").alias("gap_hi"))


def classified_curve(df: DataFrame, reps: int = 2000, seed: int = 0, n_bins: int = 20, min_count: int = 100, alpha: float = 0.05) -> DataFrame:
    """The reliability curve with its intervals, in percentage points, each bin classified.

    bin, bin_lo, bin_hi, n, share, mean_plddt, mean_lddt, gap_pp, gap_lo, gap_hi, flag ('sparse' under
    min_count rows, else empty), ci (as text), verdict: 'overconfident' or 'underconfident' if the
    interval of a bin that isn't sparse lies above or below 0, else null.
    """
    stats = slabs(df, [], n_bins)
    rows = pooled(stats).join(_curve_intervals(stats, reps, seed, alpha), "bin", "left")
    rows = rows.join(F.broadcast(pooled(stats).agg(F.sum("c").alias("total"))))  # one row
    pp = lambda c: F.lit(100.0) * c
    rows = rows.select(
        "bin", (F.col("bin") * F.lit(100.0) / n_bins).alias("bin_lo"), ((F.col("bin") + 1) * F.lit(100.0) / n_bins).alias("bin_hi"), F.col("c").alias("n"), (F.col("c") / F.col("total")).alias("share"), pp(F.col("sc") / F.col("c")).alias("mean_plddt"),
        (F.col("sa") / F.col("c")).alias("mean_lddt"), pp((F.col("sc") - F.col("sa")) / F.col("c")).alias("gap_pp"), pp(F.col("gap_lo")).alias("gap_lo"), pp(F.col("gap_hi")).alias("gap_hi"),
    )
    dense = F.col("n") >= min_count
    rows = rows.withColumn("flag", F.when(dense, "").otherwise("sparse")).withColumn("ci", interval_text(F.col("gap_lo"), F.col("gap_hi")))
    return rows.withColumn("verdict", F.when(dense & (F.col("gap_lo") > 0), "overconfident").when(dense & (F.col("gap_hi") < 0), "underconfident"))


def threshold_table(df: DataFrame, thresholds: list[float], reps: int = 500, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """For each threshold: the residues of at least that plddt, their share of all, means, and the
    overconfidence with its interval over target replicates (all targets are drawn). One pass over df."""
    whole = F.col("plddt").isNotNull() & F.col("lddt").isNotNull()
    passed = F.filter(F.array(F.lit(-1), *(F.lit(k) for k in range(len(thresholds)))), lambda k: (k < 0) | (F.col("plddt") >= F.get(F.array(*(F.lit(float(t)) for t in thresholds)), k)))
    rows = df.select("candidate", "plddt", "lddt", F.explode(F.when(whole, passed).otherwise(F.array(F.lit(None).cast("int")))).alias("k"))
    conf = clip(F.col("plddt") / F.lit(100.0), 0.0, 1.0)
    stats = stored(rows.groupBy("candidate", "k").agg(F.count("*").alias("c"), F.sum(conf).alias("sc"), F.sum("lddt").alias("sa"), F.sum("plddt").alias("sp")))
    targets = target_index(stats)
    kept = stats.where("k >= 0").withColumn("threshold", F.get(F.array(*(F.lit(float(t)) for t in thresholds)), F.col("k")))
    total = stats.where("k = -1").agg(F.sum("c").alias("total"))
    point = kept.groupBy("threshold").agg(F.sum("c").alias("residues_kept"), (F.sum("sp") / F.sum("c")).alias("mean_plddt"), (F.sum("sa") / F.sum("c")).alias("mean_lddt"), ((F.sum("sc") - F.sum("sa")) / F.sum("c")).alias("gap"))
    values = replicate_sums(kept, targets, ["threshold"], reps, seed).withColumn("gap", F.try_divide(F.col("sc") - F.col("sa"), F.col("c")))
    ci = interval(values, "gap", ["threshold"], alpha).select("threshold", F.col("lo").alias("gap_lo"), F.col("hi").alias("gap_hi"))
    found = point.join(ci, "threshold").join(F.broadcast(total))  # total is one row
    return found.select("threshold", "residues_kept", (F.col("residues_kept") / F.col("total")).alias("share_kept"), "mean_plddt", "mean_lddt", "gap", "gap_lo", "gap_hi")


def permutation_p(table: DataFrame, key: str, value: str, flag: str, perms: int = 5000, seed: int = 0) -> DataFrame:
    """One row: n, k, hits and the two-sided p_perm of the AUC of `value` for `flag`, by relabelling.

    Ranks are taken once; a permutation flags the k rows of smallest digests (ties by key). p is
    (hits + 1) / (perms + 1). Rows of null value don't count, a null flag is no. Under 5 rows, or with no
    flagged or no other row, hits and p are null.
    """
    rows = table.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("v"), F.coalesce(flag, F.lit(False)).alias("f"))
    rows = stored(average_ranks(rows, "v", "r").select("key", "f", "r"))
    n, k, own = rows.agg(F.count("*"), F.count_if("f"), F.sum(F.when(F.col("f"), F.col("r")))).first()
    if n < 5 or not 0 < k < n:
        return table.sparkSession.createDataFrame([(n, k, None, None)], "n long, k long, hits long, p_perm double")
    draws = rows.select("key", "r", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))).alias("perm"))
    # a bound on the rank, so that each task keeps the smallest k of its rows before the shuffle
    place = F.row_number().over(Window.partitionBy("perm").orderBy(digest_int(F.lit(seed), F.col("perm"), F.col("key")), "key"))
    draws = draws.withColumn("place", place).where(F.col("place") <= k)
    auc = lambda s: (s - k * (k + 1) / 2.0) / (k * (n - k))
    sums = draws.groupBy("perm").agg(F.sum("r").alias("s"))
    hits = F.count_if(F.abs(auc(F.col("s")) - 0.5) >= abs(auc(own) - 0.5) - 1e-12)
    return sums.agg(F.lit(n).cast("long").alias("n"), F.lit(k).cast("long").alias("k"), hits.alias("hits"), ((hits + 1) / F.lit(perms + 1.0)).alias("p_perm"))


def scan_with_p(table: DataFrame, key: str, covariates: list[str], flag: str, perms: int = 5000, seed: int = 0) -> DataFrame:
    """covariate_scan() with p_perm beside each covariate, the largest effect first."""
    parts = [permutation_p(table, key, c, flag, perms, seed).select(F.lit(c).alias("covariate"), "p_perm") for c in covariates]
    found = covariate_scan(table, covariates, flag)
    return found.join(functools.reduce(DataFrame.unionByName, parts), "covariate", "left").orderBy(F.desc("effect"), "covariate")
