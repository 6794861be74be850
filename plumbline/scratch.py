"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share.

    The cluster names that folder in spark.checkpoint.dir. Only where it is unset and all tasks run on
    the driver's machine (as in tests) a temporary folder takes its place; elsewhere that's an error.
    What the application leaves there is deleted when the driver's JVM ends.
    """
    context = spark.sparkContext
    root = getattr(context, "_plumbline_scratch", None)
    if root is None:
        shared = context.getConf().get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = shared or tempfile.mkdtemp(prefix="plumbline-")
        root = context._plumbline_scratch = f"{shared.rstrip('/')}/{context.applicationId}"
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{root}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet to the shared folder, and read from there.

    This cuts the lineage, so that a lost executor costs no repeated work.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes at once what stored() of this application has written."""
    context = spark.sparkContext
    root = getattr(context, "_plumbline_scratch", None)
    if root is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        context._plumbline_scratch = None


def running(df: DataFrame, order: list[str | Column], weight: Column, out: str) -> DataFrame:
    """df, stored in the order given, with `out`: the sum of `weight` over all rows before a row.

    The rows are dealt by ranges of the order and sorted there, and stored with their places. A range's
    rows are summed in its task; only one sum for each range meets in one place.
    """
    rows = df.withColumn("__w", weight).orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = stored(rows).withColumn("__part", F.shiftright("__at", 33))
    sums = rows.groupBy("__part").agg(F.sum("__w").alias("__s"))  # a row for each writing task
    before = F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")
    sums = F.broadcast(sums.select("__part", before.alias("__before")))
    within = F.sum("__w").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__w")
    return rows.withColumn("__within", within).join(sums, "__part").withColumn(out, F.col("__before") + F.col("__within")).drop("__w", "__at", "__part", "__within", "__before")


def numbered(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """df, stored, with the number of each row in the order, from 0."""
    rows = stored(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__s"))  # a row for each writing task
    before = F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")
    sizes = F.broadcast(sizes.select("__part", before.alias("__before")))
    return rows.join(sizes, "__part").withColumn(out, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__before")
