"""Strata, contrasts and pools that are given as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.resample import bootstrap_contrast

_YES, _NO = ("true", "t", "1", "yes"), ("false", "f", "0", "no")


def _is_number(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")


def coerce_level(df: DataFrame, column: str, level: str) -> bool | float | str:
    """The level as the column's type has it: words for yes and no, numbers; else the text."""
    kind = dict(df.dtypes)[column]
    if kind == "boolean":
        low = level.strip().lower()
        return True if low in _YES else False if low in _NO else level
    if _is_number(kind):
        try:
            return float(level)
        except ValueError:
            return level
    return level


def level_mask(df: DataFrame, column: str, level: str) -> Column:
    """Whether a row is of the level; a text selects nothing in a column of numbers or booleans."""
    value = coerce_level(df, column, level)
    if isinstance(value, str) and dict(df.dtypes)[column] != "string":
        return F.lit(False)
    return F.coalesce(F.col(column) == F.lit(value), F.lit(False))


def parse_contrast(spec: str) -> tuple[str, str, str]:
    """column, level a and level b of COLUMN:A-B, cut at the first colon and the first hyphen after it."""
    column, colon, levels = spec.partition(":")
    a, hyphen, b = levels.partition("-")
    if not colon or not hyphen:
        raise ValueError(f"{spec!r} isn't COLUMN:LEVEL_A-LEVEL_B")
    return column, a, b


def contrasts(df: DataFrame, specs: list[str], metric: str = "overconfidence", **options) -> tuple[DataFrame | None, list[str]]:
    """contrast, point, lo, hi, se, n_reps, excludes_zero for each spec, and why others were skipped
    (malformed, an unknown column, a level without rows)."""
    found, skipped = None, []
    for spec in specs:
        try:
            column, a, b = parse_contrast(spec)
        except ValueError as e:
            skipped.append(str(e))
            continue
        if column not in df.columns:
            skipped.append(f"{spec!r}: no column {column!r}")
            continue
        sizes = df.agg(F.count_if(level_mask(df, column, a)), F.count_if(level_mask(df, column, b))).first()
        if not all(sizes):
            skipped.append(f"{spec!r}: {sizes[0]} and {sizes[1]} rows")
            continue
        one = bootstrap_contrast(df, column, coerce_level(df, column, a), coerce_level(df, column, b), metric, **options)
        one = one.select(F.lit(f"{column}: {a} - {b}").alias("contrast"), *one.columns)
        found = one if found is None else found.unionByName(one)
    return found, skipped


def where_spec(df: DataFrame, spec: str) -> DataFrame:
    """The rows of COLUMN=VALUE. In a boolean column all but a word for yes means no; a column of numbers
    needs a number. An unknown column, or no row, is an error. Targets without such rows are gone."""
    column, _, value = spec.partition("=")
    if column not in df.columns:
        raise KeyError(f"no column {column!r}")
    kind = dict(df.dtypes)[column]
    wanted = value.strip().lower() in _YES if kind == "boolean" else float(value) if _is_number(kind) else value
    rows = df.where(F.col(column) == F.lit(wanted))
    if rows.isEmpty():
        raise ValueError(f"{spec} selects no rows")
    return rows


def standard_monomers(entries: DataFrame, count: str = "rcsb_non_std_monomer_count") -> DataFrame:
    """The entries without non-standard monomers; a missing count is none."""
    return entries.where(F.coalesce(F.col(count), F.lit(0)) <= 0)


def pool_sweep(table: DataFrame, variants: dict[str, str], cluster: str) -> DataFrame:
    """variant, entities and clusters for each filter (SQL conditions), in one pass over the table."""
    names = F.array(*(F.when(F.expr(w), F.lit(n)) for n, w in variants.items()))
    rows = table.select(F.col(cluster).alias("cluster"), F.explode(names).alias("variant")).where("variant is not null")
    return rows.groupBy("variant").agg(F.count("*").alias("entities"), F.count_distinct("cluster").alias("clusters"))


def representatives(table: DataFrame, cluster: str, best: str, key: str) -> DataFrame:
    """cluster, key and value of each cluster's row of largest value (ties: the least key)."""
    first = table.groupBy(cluster).agg(F.max(best).alias(best))
    return table.select(cluster, best, key).join(first, [cluster, best]).groupBy(cluster, best).agg(F.min(key).alias(key))
