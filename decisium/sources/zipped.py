"""Lines of files by their place over all files, and two folders zipped by it.

A line's place follows from the file's name, the split of the file that a task
read and the line's number in that split. Lines are written once with these;
then only the splits, a row each, meet in a window that adds up their counts,
and each line gets its split's base. So no window holds the lines, and the
places of Parquet rows or lines of text are the same however they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import scratch

#: Most splits whose bases are broadcast.
SPLITS = 100_000


def placed_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """place (from 0, in the order of file names), value."""
    lines = spark.read.option("recursiveFileLookup", "true").text(list(paths))
    told = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    path = scratch(spark, "lines")
    told.write.parquet(path)
    rows = spark.read.schema(told.schema).parquet(path)
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    bases = splits.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("base"))
    if splits.limit(SPLITS + 1).count() <= SPLITS:
        bases = F.broadcast(bases)
    return rows.join(bases, ["file", "block"]).select((F.col("base") + F.col("at") - F.col("first")).alias("place"), "value")


def zipped(left: DataFrame, right: DataFrame, tails: str = "report") -> DataFrame:
    """place, left, right, of lines with the same place. tails: `report` keeps
    the longer side's rest, with null on the other side; `drop` leaves it out;
    `forbid` raises if there is one."""
    if tails not in ("report", "drop", "forbid"):
        raise ValueError(tails)
    both = left.select("place", F.col("value").alias("left"), F.lit(True).alias("_l")).join(right.select("place", F.col("value").alias("right"), F.lit(True).alias("_r")), "place", "inner" if tails == "drop" else "full")
    if tails == "forbid":
        alone = F.col("_l").isNull() | F.col("_r").isNull()
        both = both.withColumn("place", F.when(alone, F.raise_error(F.lit("the two sides differ in length"))).otherwise(F.col("place")))
    return both.select("place", "left", "right")
