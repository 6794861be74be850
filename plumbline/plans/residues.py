"""The driver's tables seen as the engine's logical tables.

A residue is a line item; its target is the supplier, its chain the return flag, its number the
order. This keeps every operator on real rows of the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import derive
from plumbline.plans import sql
from plumbline.schemas import require_columns
from plumbline.scratch import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of each residue, without covariates."""
    sse = F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "R", "b").otherwise("c")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("candidate"), F.col("l_returnflag").alias("chain"), F.col("l_orderkey").alias("res_id"), (F.col("l_quantity") + 50).alias("plddt"), (1 - 5 * F.col("l_tax")).alias("lddt"),
        F.col("l_extendedprice").alias("ref_bfactor"), (F.nullif(F.col("l_discount"), F.lit(0.05)) * 10).alias("rsa"), sse.alias("sse"),
    )


def target_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each target."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("candidate"), F.nullif(F.col("s_nationkey") % 4, F.lit(3)).alias("nonpolymer_entity_count"), F.col("s_acctbal").alias("max_identity"))


def dataset(spark: SparkSession, sf_dir: str, tertiles: bool = False) -> DataFrame:
    """The fact table, with the targets' tertiles on demand."""
    return build_dataset(residues(spark, sf_dir), target_covariates(spark, sf_dir), tertiles=tertiles)


def build_dataset(scores: DataFrame, covariates: DataFrame, min_coverage: float = 0.8, one_row: bool = False, tertiles: bool = True) -> DataFrame:
    """Scores with covariates and the derived strata; columns are derived where their source exists.

    Targets of low coverage go first, before any join. All that a target contributes (its size, its
    B-factor moments, its covariates and tertiles) is one table, which joins the residues once; AQE
    broadcasts it while it is small and splits a hot target's rows beyond. A left join: targets without
    covariates stay, and a target with several rows of covariates has its residues once for each, as
    the definition has it; with one_row, the least of them alone is taken. Tertiles are of targets; of
    several values of a target, the least counts; they need all targets ordered, so they can be left out.
    """
    from plumbline.operators.calibration import low_coverage
    from plumbline.operators.ranks import tertile

    require_columns(scores, "candidate", "plddt", "lddt")
    if "coverage" in scores.columns and min_coverage > 0:
        scores = scores.join(low_coverage(scores, min_coverage), "candidate", "left_anti")
    rest = [c for c in covariates.columns if c != "candidate"]
    if one_row:
        covariates = covariates.groupBy("candidate").agg(F.min(F.struct(*rest)).alias("x")).select("candidate", "x.*")
    has_b = "ref_bfactor" in scores.columns
    own = [F.count("*").alias("neff")] if "neff" not in rest else []
    if has_b:
        own += [F.avg("ref_bfactor").alias("__mean"), F.stddev_pop("ref_bfactor").alias("__sd")]
    targets = scores.groupBy("candidate").agg(*(own or [F.count("*").alias("__n")])).join(covariates, "candidate", "left")
    levels = [(v, n) for v, n in (("max_identity", "novelty_bin"), ("neff", "msa_depth_bin")) if tertiles and v in targets.columns]
    if levels:
        targets = stored(targets)
        ranked = targets.groupBy("candidate").agg(*(F.min(v).alias(v) for v, _ in levels))
        for value, name in levels:
            ranked = tertile(ranked, value, "candidate", name)
        targets = targets.join(ranked.select("candidate", *(n for _, n in levels)), "candidate", "left")
    df = scores.join(targets, "candidate", "left")
    if "nonpolymer_entity_count" in df.columns:
        df = df.withColumn("ligand_state", derive.ligand_state(F.col("nonpolymer_entity_count")))
    if has_b:
        df = df.withColumn("ref_bfactor_z", derive.zscore(F.col("ref_bfactor"), F.col("__mean"), F.col("__sd"))).withColumn("flexibility", derive.flexibility(F.col("ref_bfactor_z")))
    df = df.drop("__mean", "__sd", "__n")
    if "sse" in df.columns:
        df = df.withColumn("structured", derive.structured(F.col("sse")))
    if "rsa" in df.columns:
        df = df.withColumn("exposure", derive.exposure(F.col("rsa")))
    return df


def rounded(df: DataFrame, digits: int = sql.DIGITS) -> DataFrame:
    """Doubles rounded, so that engines that add in another order agree; no negative zero."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
