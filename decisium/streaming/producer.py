"""A producer that stops itself: candidates are launched in batches until n of
them were kept.

How many to launch next follows from the yield so far: as many as should give
what is missing, but at most `cap`, so that little is launched in vain. Each
batch is one Spark job over its candidates alone; what it kept is written under
the batch's number, and its count comes with the write. A stop and a new start
with the same folder go on after the last whole batch. Candidates have whole
places from 0; the first n kept in their order are the result, so it doesn't
depend on the batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Produced:
    kept: int = 0
    launched: int = 0
    batches: list[tuple[int, int]] = field(default_factory=list)  # launched, kept


def produce(candidates: DataFrame, gate: Callable[[DataFrame], DataFrame], n: int, out: str, cap: int, expected: float = 0.5, most: int | None = None) -> Produced:
    """Runs batches of candidates (with `place`) through gate, a filter, and
    writes what it keeps, until n were kept or `most` candidates launched (the
    number of all, if not given)."""
    spark, done = candidates.sparkSession, Produced()
    total = candidates.count() if most is None else most
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = fs_path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    number = 0
    while done.kept < n and done.launched < total:
        rate = max(done.kept / done.launched, 1 / (done.launched + 1)) if done.launched else expected
        size = max(1, min(cap, int(-(-(n - done.kept) // rate)), total - done.launched))
        folder = f"{out}/batch={number:06d}-{done.launched}-{size}"
        if files.exists(fs_path(f"{folder}/_SUCCESS")):  # of an earlier start
            kept = spark.read.parquet(folder).count()
        else:
            seen = Observation()
            batch = candidates.where(F.col("place").between(done.launched, done.launched + size - 1))
            gate(batch).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(folder)
            kept = seen.get["n"]
        done.launched += size
        done.kept += kept
        done.batches.append((size, kept))
        number += 1
    return done


def first_kept(rows: DataFrame, n: int) -> DataFrame:
    """The first n of what was kept; at most n and a batch are there."""
    return rows.orderBy("place").limit(n)
