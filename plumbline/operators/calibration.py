"""Reliability bins and the metrics made of them.

All metrics derive from additive bin statistics (count, sum of confidence, sum of accuracy), so one
partial aggregation over the residues is all that is ever shuffled. Rows without plddt or lddt do
not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.derive import bin_index, confidence
from plumbline.schemas import require_columns

METRICS = ("ece", "mce", "overconfidence", "mean_plddt", "mean_lddt")


def scored(df: DataFrame) -> DataFrame:
    require_columns(df, "plddt", "lddt")
    return df.where("plddt is not null and lddt is not null").withColumn("conf", confidence(F.col("plddt")))


def bin_stats(df: DataFrame, by: list[str], n_bins: int = 20) -> DataFrame:
    """by, bin, c, sc, sa, sp: the count and the sums of confidence, lddt and plddt of each bin."""
    rows = scored(df).withColumn("bin", bin_index(F.col("conf"), n_bins))
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("c"), F.sum("conf").alias("sc"), F.sum("lddt").alias("sa"), F.sum("plddt").alias("sp"))


def reliability_curve(df: DataFrame, n_bins: int = 20) -> DataFrame:
    """A row for each bin that isn't empty."""
    width = 1.0 / n_bins
    s = bin_stats(df, [], n_bins)
    return s.select("bin", (F.col("bin") * F.lit(width)).alias("bin_lo"), ((F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), F.col("c").alias("n"), (F.col("sc") / F.col("c")).alias("mean_conf"), (F.col("sa") / F.col("c")).alias("mean_acc"), ((F.col("sc") - F.col("sa")) / F.col("c")).alias("gap"))


def metrics(stats: DataFrame, by: list[str], clipped: bool = False) -> DataFrame:
    """n and METRICS by group, from bin statistics; mean_plddt of plddt as it is, or clipped."""
    gap = F.abs(F.col("sc") - F.col("sa"))
    n = F.sum("c")
    return stats.groupBy(*by).agg(
        n.alias("n"), F.try_divide(F.sum(gap), n).alias("ece"), F.max(F.try_divide(gap, F.col("c"))).alias("mce"), F.try_divide(F.sum("sc") - F.sum("sa"), n).alias("overconfidence"),
        (F.try_divide(F.sum("sc"), n) * F.lit(100.0) if clipped else F.try_divide(F.sum("sp"), n)).alias("mean_plddt"), F.try_divide(F.sum("sa"), n).alias("mean_lddt"),
    )


def summarize(df: DataFrame, n_bins: int = 20) -> DataFrame:
    """One row; n is 0 and the metrics null if there are no scored rows."""
    return metrics(bin_stats(df, [], n_bins), []).withColumn("n", F.coalesce("n", F.lit(0)))


def stratified_summary(df: DataFrame, by: list[str], n_bins: int = 20, min_count: int = 50) -> DataFrame:
    """metrics() by the strata of at least min_count rows; null is a stratum, and sorted last."""
    require_columns(df, *by)
    found = metrics(bin_stats(df, by, n_bins), by).where(F.col("n") >= min_count)
    return found.orderBy(*(F.asc_nulls_last(c) for c in by))


def interaction_gap(strata: DataFrame, outer: str, inner: str, levels: list[str], metric: str = "overconfidence") -> DataFrame:
    """A row for each level of outer, a column for each of inner; with two levels, their difference."""
    levels = sorted(levels)
    wide = strata.groupBy(outer).pivot(inner, levels).agg(F.first(metric))
    if len(levels) == 2:
        wide = wide.withColumn(f"{levels[0]}_minus_{levels[1]}", F.col(levels[0]) - F.col(levels[1]))
    return wide


def per_target_table(df: DataFrame, n_bins: int = 20) -> DataFrame:
    """metrics() by candidate, without a null one; the most overconfident first."""
    found = metrics(bin_stats(require_columns(df, "candidate").where("candidate is not null"), ["candidate"], n_bins), ["candidate"])
    return found.orderBy(F.desc("overconfidence"), "candidate")


def spread(table: DataFrame, value: str) -> DataFrame:
    """Exact quartiles, extremes, and the share above 0."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return table.agg(q.alias("q"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg((F.col(value) > 0).cast("double")).alias("share_positive"), F.count(value).alias("n")).select(F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"), "low", "high", "share_positive", "n")


def composition(df: DataFrame) -> DataFrame:
    """Shares of residue kinds and means of the covariates by candidate; a null kind counts as no."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    kinds = [("frac_flexible", "flexibility", "flexible"), ("frac_rigid", "flexibility", "rigid"), ("frac_coil", "structured", "coil"), ("frac_exposed", "exposure", "exposed")]
    parts: list[Column] = [F.count("*").alias("n_residues")]
    parts += [share(F.col(c) == v).alias(name) for name, c, v in kinds if c in df.columns]
    if "near_chain_gap" in df.columns:
        parts.append(F.avg(F.coalesce("near_chain_gap", F.lit(True)).cast("double")).alias("frac_near_gap"))
    parts += [F.avg(c).alias(f"mean_{c}") for c in ("ref_bfactor_z", "ref_bfactor", "rsa", "coverage") if c in df.columns]
    return df.groupBy("candidate").agg(*parts)


def crosstab_percent(df: DataFrame, rows: str, columns: str, levels: list[str]) -> DataFrame:
    """Row-wise percentages, to one decimal."""
    wide = df.groupBy(rows).pivot(columns, levels).count().na.fill(0, levels)
    total = sum((F.col(c) for c in levels), F.lit(0))
    return wide.select(rows, *(F.round(F.col(c) * F.lit(100.0) / total, 1).alias(c) for c in levels))


def mce_diagnosis(curve: DataFrame, min_count: int) -> DataFrame:
    """The bin that owns the largest gap (the first of equal ones), and the largest of dense bins."""
    size = F.abs("gap")
    best = F.max_by(F.struct("bin", "n", "gap"), F.struct(size, -F.col("bin"))).alias("best")
    found = curve.agg(best, F.max(size).alias("mce"), F.max(F.when(F.col("n") >= min_count, size)).alias("mce_dense"), F.sum("n").alias("total"))
    return found.select(F.col("best.bin").alias("bin"), F.col("best.n").alias("n"), (F.col("best.n") / F.col("total")).alias("share"), F.col("best.gap").alias("gap"), "mce", "mce_dense")


def low_coverage(df: DataFrame, min_coverage: float = 0.8) -> DataFrame:
    """The candidates to leave out; coverage is one value for each target. None at a bound of 0."""
    first = df.groupBy("candidate").agg(F.first("coverage", ignorenulls=True).alias("coverage"))
    return first.where((F.col("coverage") < min_coverage) & F.lit(min_coverage > 0)).select("candidate")
