"""Evaluation: accuracy, macro-F1, calibration error, Brier score, MAE, reports.

Inputs are one row per answered question; every metric is one or two partial
aggregations, so what is shuffled is a row per group and task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 10


def bin_of(conf: Column, bins: int = BINS) -> Column:
    """b with b / bins <= conf < (b + 1) / bins; 1.0 is in the last. Compared
    with the bounds themselves: multiplying misplaces values next to them."""
    out = F.when(conf == 1.0, bins - 1)
    for b in range(bins):
        out = out.when((conf >= b / bins) & (conf < (b + 1) / bins), b)
    return out


def expected_calibration_error(df: DataFrame, by: list[str], conf: str = "conf", correct: str = "correct") -> DataFrame:
    binned = df.groupBy(*by, bin_of(F.col(conf)).alias("bin")).agg(F.count("*").alias("n"), F.avg(correct).alias("acc"), F.avg(conf).alias("mean"))
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("acc") - F.col("mean"))).otherwise(0.0)
    return binned.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def macro_f1(df: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Mean F1 over the labels that occur as truth or prediction; an undefined
    F1 counts as 0. Labels are unpivoted, so one aggregation gives all counts."""
    pair = F.inline(F.array(F.struct(F.col(truth).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("q")), F.struct(F.col(pred).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("q"))))
    sides = df.select(*by, (F.col(truth) == F.col(pred)).cast("int").alias("same"), pair)
    counts = sides.groupBy(*by, "cls").agg(F.sum(F.col("same") * F.col("t")).alias("tp"), F.sum("t").alias("n_true"), F.sum("q").alias("n_pred"))
    f1 = F.try_divide(2 * F.col("tp"), F.col("n_true") + F.col("n_pred"))
    return counts.groupBy(*by).agg(F.avg(F.coalesce(f1, F.lit(0.0))).alias("macro_f1"), F.count("*").alias("labels"))


def macro_report(df: DataFrame, baselines: DataFrame) -> DataFrame:
    """accuracy by subset beside published baselines, a win flag, and the macro
    row over all subsets. df: subset, accuracy; baselines: subset, baseline."""
    alias = F.regexp_replace("subset", "^pub_", "")
    joined = df.withColumn("subset", alias).join(F.broadcast(baselines), "subset", "left")
    return joined.rollup("subset").agg(
        F.avg("accuracy").alias("accuracy"), F.avg("baseline").alias("baseline"), F.sum(F.when(F.col("accuracy") > F.col("baseline"), 1).otherwise(0)).alias("wins")
    ).withColumn("subset", F.coalesce("subset", F.lit("macro")))


def routing_curve(df: DataFrame, thresholds: list[float], conf: str = "conf", correct: str = "correct") -> DataFrame:
    """Coverage and accuracy of the answers kept at each confidence threshold."""
    cut = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    kept = F.col(conf) >= F.col("threshold")
    return cut.groupBy("threshold").agg(F.avg(kept.cast("double")).alias("coverage"), F.avg(F.when(kept, F.col(correct))).alias("accuracy"), F.count_if(~kept).alias("escalated"))


def side_by_side(rows: DataFrame, key: str, run: str, runs: list[str], value: Column) -> DataFrame:
    """One row per key with a column for each run, by one aggregation."""
    return rows.groupBy(key).agg(*[F.avg(F.when(F.col(run) == r, value)).alias(r) for r in runs])


def latency(rows: DataFrame, by: str, order: list[str], value: str, warm_up: int = 1) -> DataFrame:
    """Mean over a run's repeats after its first ones."""
    turns = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return turns.where(F.col("_turn") > warm_up).groupBy(by).agg(F.count("*").alias("repeats"), F.avg(value).alias("latency"))
