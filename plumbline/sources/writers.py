"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, skip_empty: bool = False) -> bool:
    """CSV with a header; with skip_empty, nothing is written for no rows. Whether it wrote."""
    if skip_empty and df.isEmpty():
        return False
    df.write.option("header", True).csv(path)
    return True


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.json(path)


def fasta(name: Column, sequence: Column, width: int | None = 80) -> Column:
    """A FASTA record; lines of `width` letters, or one line."""
    body = sequence if width is None else F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">protein|name="), name, F.lit("\n"), body)


def write_fasta(targets: DataFrame, path: str, width: int | None = 80) -> None:
    """candidate and sequence as FASTA text."""
    targets.select(fasta(F.col("candidate"), F.col("sequence"), width).alias("value")).write.text(path)


def sparkline(value: Column) -> Column:
    """A bar of one block for every 2 of the value."""
    return F.repeat(F.lit("█"), F.greatest((value / 2).cast("int"), F.lit(0)))


def pending(wanted: DataFrame, done: DataFrame, key: str = "candidate") -> DataFrame:
    """What isn't there yet."""
    return wanted.join(done, key, "left_anti")
