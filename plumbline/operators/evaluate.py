"""Evaluation of predicted structures: validated residue join, lookups, assembly of the result tables.

A case is (target, condition, model_idx). Violations are a column, so that one bad case doesn't end a
run; strict() turns them into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASE = ["target", "condition", "model_idx"]
#: How the aligner's output states its results.
TM_SCORE, RMSD, ALIGNED_LENGTH = r"TM-score=\s+([0-9.]+)", r"RMSD=\s+([0-9.]+)", r"Aligned length=\s+(\d+)"
LEAST_JOINED = 0.9


def aligner_output(text: Column) -> Column:
    """struct<tm_score, rmsd, aligned_length, problem> of an aligner's output: the first match of each;
    a problem if one is missing."""
    get = lambda pattern, kind: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast(kind)
    tm, rmsd, length = get(TM_SCORE, "double"), get(RMSD, "double"), get(ALIGNED_LENGTH, "int")
    problem = F.when(tm.isNull() | rmsd.isNull() | length.isNull(), "aligner output without score, deviation or length")
    return F.struct(tm.alias("tm_score"), rmsd.alias("rmsd"), length.alias("aligned_length"), problem.alias("problem"))


def join_residues(predicted: DataFrame, reference: DataFrame, mapping: DataFrame) -> DataFrame:
    """The residues of both sides by their place, and `problem`: null, or the first of 'count' (the
    case's sides differ in length), 'unmapped', 'number' (the map says another one), 'name'.

    predicted, reference: the case, place (of the residue in its structure), number, name; mapping: the
    case, predicted, reference (numbers).
    """
    side = lambda d, name: d.select(*CASE, "place", F.col("number").alias(f"{name}_residue_number"), F.col("name").alias(f"{name}_residue_name"))
    sizes = lambda d, name: d.groupBy(*CASE).agg(F.count("*").alias(name))
    rows = side(predicted, "predicted").join(side(reference, "reference"), [*CASE, "place"], "full")
    counts = sizes(predicted, "n_p").join(sizes(reference, "n_r"), CASE, "full")
    rows = rows.join(counts, CASE, "left")
    maps = mapping.select(*CASE, F.col("predicted").alias("predicted_residue_number"), F.col("reference").alias("mapped"))
    rows = rows.join(maps, [*CASE, "predicted_residue_number"], "left")
    number, name = F.col("mapped") != F.col("reference_residue_number"), ~F.col("predicted_residue_name").eqNullSafe(F.col("reference_residue_name"))
    problem = F.when(~F.col("n_p").eqNullSafe(F.col("n_r")), "count").when(F.col("mapped").isNull(), "unmapped").when(number, "number").when(name, "name")
    return rows.select(*CASE, "place", "predicted_residue_number", "reference_residue_number", "predicted_residue_name", "reference_residue_name", problem.alias("problem"))


def strict(joined: DataFrame) -> DataFrame:
    """joined without the column `problem`; an error that names the case if a row has one."""
    text = F.concat(F.lit("residues of "), F.concat_ws("/", *CASE), F.lit(" at place "), F.col("place").cast("string"), F.lit(": "), F.col("problem"))
    ok = F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    return joined.where(ok).drop("problem")


def per_residue(joined: DataFrame, confidence: DataFrame, metrics: DataFrame) -> DataFrame:
    """joined with pLDDT (by the predicted number), global_lddt, local_lddt, tm_score and rmsd; null where
    there is none.

    confidence: the case, residue, plddt; metrics: the case, tm_score, rmsd, aligned_length, global_lddt and
    local_lddt, a map by keys like `A.12.`.
    """
    scores = confidence.select(*CASE, F.col("residue").alias("predicted_residue_number"), F.col("plddt").alias("pLDDT"))
    rows = joined.join(scores, [*CASE, "predicted_residue_number"], "left").join(metrics.drop("aligned_length"), CASE, "left")
    key = F.concat(F.lit("A."), F.col("predicted_residue_number").cast("string"), F.lit("."))
    return rows.withColumn("local_lddt", F.try_element_at("local_lddt", key))


def per_structure(joined: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row for each case: its metrics, joined_fraction (residues without a problem), and `warning` under 0.9."""
    share = F.try_divide(F.count_if(F.col("problem").isNull()), F.greatest(F.count("*"), F.lit(1)))
    cases = joined.groupBy(*CASE).agg(share.alias("joined_fraction"))
    rows = cases.join(metrics.drop("local_lddt"), CASE, "left")
    return rows.withColumn("warning", F.col("joined_fraction") < LEAST_JOINED)


def reference_files(predictions: DataFrame, listing: DataFrame, extensions: tuple[str, ...] = (".cif.gz", ".bcif.gz")) -> DataFrame:
    """candidate and the path of its entry's structure file (null if there is none): the first extension
    that the listing (column path) has. The entry is the candidate up to its first `_`."""
    name = F.element_at(F.split("path", "/"), -1)
    files = None
    for k, e in enumerate(extensions):
        one = listing.where(F.endswith(name, F.lit(e))).select(F.substr(name, F.lit(1), F.length(name) - F.lit(len(e))).alias("entry"), F.lit(k).alias("rank"), "path")
        files = one if files is None else files.unionByName(one)
    files = files.groupBy("entry").agg(F.min(F.struct("rank", "path")).alias("f"))
    return predictions.withColumn("entry", F.get(F.split("candidate", "_"), F.lit(0))).join(files, "entry", "left").select("candidate", F.col("f.path").alias("path"))


def with_annotations(scores: DataFrame, annotations: DataFrame, keys: tuple[str, ...] = ("chain", "res_id")) -> DataFrame:
    """scores with the annotations of their residues, null where there are none."""
    return scores.join(annotations, list(keys), "left")


def agreement_join(scores: DataFrame, agreement: DataFrame) -> DataFrame:
    """The residues that have scores and agreement; an error if there are none."""
    joined = scores.join(agreement, ["candidate", "chain", "res_id"])
    if joined.isEmpty():
        raise ValueError("no residue has both scores and agreement: check candidate, chain and res_id")
    return joined
