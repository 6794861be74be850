"""Derived columns of the residue table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The largest solvent accessible area of each residue, in square angstroms.
MAX_ASA = {
    "ALA": 129.0, "ARG": 274.0, "ASN": 195.0, "ASP": 193.0, "CYS": 167.0, "GLN": 225.0, "GLU": 223.0, "GLY": 104.0, "HIS": 224.0, "ILE": 197.0,
    "LEU": 201.0, "LYS": 236.0, "MET": 224.0, "PHE": 240.0, "PRO": 159.0, "SER": 155.0, "THR": 172.0, "TRP": 285.0, "TYR": 263.0, "VAL": 174.0,
}
#: One-letter codes of the residues.
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def clip(x: Column, low: float, high: float) -> Column:
    """x within the bounds; null stays null (least and greatest skip nulls)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def confidence(plddt: Column) -> Column:
    return clip(plddt / F.lit(100.0), 0.0, 1.0)


def edges(n_bins: int) -> list[float]:
    """The bin edges as an evenly spaced array has them: i * (1 / n), and exactly 1 at the end."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def bin_index(conf: Column, n_bins: int = 20) -> Column:
    """The half-open bin of a confidence; 1 is in the last one. It counts the edges not above it."""
    passed = sum(((F.lit(e) <= conf).cast("int") for e in edges(n_bins)[1:-1]), F.lit(0))
    return F.when(conf.isNotNull(), passed)


def ligand_state(count: Column) -> Column:
    """Null counts as no ligand."""
    return F.when(F.coalesce(count, F.lit(0)) > 0, "holo").otherwise("apo")


def flexibility(z: Column) -> Column:
    return F.when(z.isNull(), None).when(z >= 1.0, "flexible").when(z <= -0.5, "rigid").otherwise("intermediate")


def structured(sse: Column) -> Column:
    return F.when(sse.isin("a", "b"), "helix_or_sheet").when(sse == "c", "coil")


def exposure(rsa: Column) -> Column:
    return F.when(rsa.isNull(), None).when(rsa >= 0.5, "exposed").when(rsa <= 0.2, "buried").otherwise("partial")


def zscore(x: Column, mean: Column, sd: Column) -> Column:
    """Standard score by a group's mean and population deviation; 0 where that is 0."""
    return F.when(x.isNull(), None).when(sd > 0, (x - mean) / sd).otherwise(F.lit(0.0))


def with_zscore(df: DataFrame, value: str, by: str, out: str) -> DataFrame:
    """df with the standard score of `value` in its group.

    The groups' moments are aggregated before they are shuffled and joined back, so a group with a
    third of all rows is no task's burden (a window would gather it in one).
    """
    stats = df.groupBy(by).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"))
    return df.join(stats, by, "left").withColumn(out, zscore(F.col(value), F.col("__mean"), F.col("__sd"))).drop("__mean", "__sd")


def _lookup(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def relative_accessibility(area: Column, res_name: Column) -> Column:
    """Area over the residue's largest, within 0 and 1.5; null for an unknown residue."""
    return clip(area / F.try_element_at(_lookup(MAX_ASA), res_name), 0.0, 1.5)


def one_letter(res_name: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(ONE_LETTER), res_name), F.lit("X"))


def candidate_parts(candidate: Column) -> tuple[Column, Column]:
    """Entry and entity of ENTRY_ENTITY; an error for any other shape."""
    parts = F.split(candidate, "_")
    bad = F.raise_error(F.concat(F.lit("not ENTRY_ENTITY: "), candidate))
    return F.when(F.size(parts) == 2, F.get(parts, 0)).otherwise(bad), F.when(F.size(parts) == 2, F.get(parts, 1)).otherwise(bad)


def entry_id(candidate: Column, entry: Column) -> Column:
    """The candidate up to its first `_`; without a candidate, the entry."""
    return first_text(F.get(F.split(candidate, "_"), F.lit(0)), entry)


def first_text(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def sequence_text(*values: Column) -> Column:
    """The first given sequence, without line feeds."""
    return F.replace(first_text(*values), F.lit("\n"), F.lit(""))


def interval_text(low: Column, high: Column) -> Column:
    return F.format_string("[%+.2f, %+.2f]", low, high)


def near_chain_gap(order: str, *by: str) -> Column:
    """Whether a jump of res_id lies beside the row, in the structure's order within a chain."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.coalesce(F.col(order) - F.lag(order).over(w) > 1, F.lit(False)) | F.coalesce(F.lead(order).over(w) - F.col(order) > 1, F.lit(False))


def run_number(df: DataFrame, by: list[str], order: list[str], change: list[str]) -> DataFrame:
    """Numbers, from 0, the runs of rows in which the columns `change` stay the same."""
    w = Window.partitionBy(*by).orderBy(*order)
    moved = F.lit(False)
    for c in change:
        moved = moved | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    moved = (moved & (F.row_number().over(w) > 1)).cast("int")
    return df.withColumn("__moved", moved).withColumn("run", F.sum("__moved").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__moved")
