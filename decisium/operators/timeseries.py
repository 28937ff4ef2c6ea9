"""Control-loop state: histories, repeats, moving means, nearest things, bearings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def loop_state(steps: DataFrame, group: str | list[str], order: list[str], action: str, value: str, position: list[str], moves: list[str], k: int = 4, mean_of: int = 20) -> DataFrame:
    """Adds history (the last k actions before), stuck (a step stands where the
    one before stood, though that one moved) and moving (mean of the last
    values): one sort serves all three. A step with a null position isn't stuck,
    nor is the one after it."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    stays = reduce(lambda a, b: a & b, [F.lag(p).over(w) == F.col(p) for p in position])
    return (
        steps.withColumn("history", F.collect_list(action).over(w.rowsBetween(-k, -1)))
        .withColumn("stuck", F.coalesce(stays & F.lag(action).over(w).isin(moves), F.lit(False)))
        .withColumn("moving", F.avg(value).over(w.rowsBetween(1 - mean_of, 0)))
    )


def bearing(x: Column, y: Column, heading: Column) -> Column:
    """Angle to a thing relative to the heading, in [-180, 180)."""
    raw = F.degrees(F.atan2(y, x)) - heading
    return F.pmod(raw + 180, F.lit(360.0)) - 180


def side(b: Column, ahead: float = 10.0) -> Column:
    return F.when(F.abs(b) < ahead, "ahead").when(b > 0, "left").otherwise("right")


BLOCK, MOST_IN_BLOCK = 512, 4096


def nearest(rows: DataFrame, queries: str, key: str, vector: str, group: str, k: int) -> DataFrame:
    """The k nearest others of the same group for the rows that `queries` picks.

    Queries and rows meet in blocks, one task per pair of blocks, and only the k
    best of each block are returned; a window then ranks those."""
    size = rows.groupBy(group).agg(F.count("*").alias("_n"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") / MOST_IN_BLOCK)).cast("int")
    named = rows.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(vector).alias("v"))
    per = F.broadcast(size.select(F.col(group).alias("g"), blocks.alias("b")))
    members = named.join(per, "g").select("g", F.pmod(F.xxhash64("k"), F.col("b")).cast("int").alias("mb"), "k", "v")
    asked = rows.where(queries).select(F.col(key).alias("qk"), F.col(group).alias("g"), F.col(vector).alias("qv")).join(per, "g")
    asked = asked.select(F.col("g").alias("qg"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("qmb"), "qk", "qv")

    def best(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch] | pa.Table:
        out: dict[str, list] = {"vec_id": [], "other": [], "d": []}
        if left.num_rows and right.num_rows:
            ids = left.column("k").to_numpy()
            x, q = np.array(left.column("v").to_pylist(), np.float64), np.array(right.column("qv").to_pylist(), np.float64)
            for i, name in enumerate(right.column("qk").to_pylist()):
                d = ((x - q[i]) ** 2).sum(1)
                d[ids == name] = np.inf
                top = np.lexsort((ids, d))[:k] if len(d) <= 4 * k else (lambda c: c[np.lexsort((ids[c], d[c]))][:k])(np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]))
                top = top[np.isfinite(d[top])]
                out["vec_id"] += [name] * len(top)
                out["other"] += ids[top].tolist()
                out["d"] += d[top].tolist()
        return pa.table({"vec_id": pa.array(out["vec_id"], pa.int64()), "other": pa.array(out["other"], pa.int64()), "d": pa.array(out["d"], pa.float64())})

    found = members.groupBy("g", "mb").cogroup(asked.groupBy("qg", "qmb")).applyInArrow(best, "vec_id long, other long, d double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "other"))
    return found.withColumn("rk", rank.cast("long")).where(F.col("rk") <= k)
