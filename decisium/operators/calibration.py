"""Temperatures that fit: Newton's method on aggregated gradients.

The loss of a question at inverse temperature b is the negative log-likelihood
of its gold slot plus `weight` times the Brier term, over all options and
abstain. One pass over the data adds up, for all types of question at once, the
loss, its slope and a curvature by log b; the driver only sees a row a type.
The curvature is the exact one of the likelihood and the Gauss-Newton part of
the Brier term, so it is never negative and each step goes downhill; a step
that doesn't lower the loss is halved. A type is done when its slope is under
`tolerance`. Rows without a gold slot are left out; a type without rows has no
temperature. Where temperatures are to come from a list of published steps,
`on_grid` moves each fit to the step of the least loss: a mean temperature and
its nearest step may round differently."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .decide import ABSTAIN, IGNORE, let, total

#: Longest step, and bounds of log b.
LONGEST, BOUND = 1.5, 7.0


def _sums(rows: DataFrame, at: dict[str, float], weight: float) -> dict[str, tuple[float, float, float]]:
    """Mean loss, slope and curvature by log b of each type at the b given."""
    b = F.coalesce(*[F.when(F.col("qtype") == k, F.lit(math.exp(u))) for k, u in at.items()])
    d = rows.withColumn("b", b).withColumn("e", let(F.array_max("z"), lambda m: let(F.col("b"), lambda c: F.transform("z", lambda x: F.exp(c * (x - m))))))
    d = d.withColumn("s", total(F.col("e"))).withColumn("p", let(F.col("s"), lambda s: F.transform("e", lambda x: x / s)))
    d = d.withColumn("mean", total(F.zip_with("p", "z", lambda p, z: p * z))).withColumn("own", F.element_at("z", F.col("y") + 1))
    d = d.withColumn("hit", F.transform("z", lambda _, i: F.when(i == F.col("y"), 1.0).otherwise(0.0)))
    # slopes of the probabilities by b
    d = d.withColumn("q", let(F.col("mean"), lambda m: F.zip_with("p", "z", lambda p, z: p * (z - m))))
    off: Column = F.zip_with("p", "hit", lambda p, y: p - y)
    loss = F.log("s") + F.col("b") * (F.array_max("z") - F.col("own")) + weight * total(F.transform(off, lambda x: x * x))
    slope = F.col("mean") - F.col("own") + weight * total(F.zip_with(off, "q", lambda x, q: 2 * x * q))
    spread = total(F.zip_with("q", "z", lambda q, z: q * z))
    curve = spread + weight * total(F.transform("q", lambda q: 2 * q * q))
    sums = d.groupBy("qtype").agg(F.avg(loss).alias("loss"), F.avg(F.col("b") * slope).alias("slope"), F.avg(F.col("b") * F.col("b") * curve).alias("curve"))
    return {r["qtype"]: (r["loss"], r["slope"], r["curve"]) for r in sums.collect()}


def labelled(df: DataFrame) -> DataFrame:
    """qtype, z (logits and abstain's) and y (a slot of z) of rows with a gold slot, written once."""
    known = df.where(F.col("label").isNotNull() & (F.col("label") != IGNORE))
    y = F.when(F.col("label") == ABSTAIN, F.size("logits")).otherwise(F.col("label")).cast("int")
    path = scratch(df.sparkSession, "calibration")
    known.select("qtype", F.concat("logits", F.array("abstain_logit")).alias("z"), y.alias("y")).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def calibrate(df: DataFrame, weight: float = 0.5, tolerance: float = 1e-6, rounds: int = 60) -> dict[str, dict[str, float | int | bool]]:
    """temperature, loss, slope (by the log), rounds and converged by qtype.
    df: qtype, logits, abstain_logit, label (a slot, ABSTAIN or IGNORE)."""
    return newton(labelled(df), weight, tolerance, rounds)


def newton(rows: DataFrame, weight: float = 0.5, tolerance: float = 1e-6, rounds: int = 60) -> dict[str, dict[str, float | int | bool]]:
    """calibrate of rows that `labelled` gives."""
    at = {r["qtype"]: 0.0 for r in rows.select("qtype").distinct().collect()}
    best: dict[str, tuple[float, float, float, float]] = {}  # log b, loss, slope, curvature
    step: dict[str, float] = {}
    out: dict[str, dict[str, float | int | bool]] = {}
    n = 0
    while at and n < rounds:
        n += 1
        for k, (loss, slope, curve) in _sums(rows.where(F.col("qtype").isin(list(at))), at, weight).items():
            if k not in best or loss <= best[k][1]:
                best[k] = (at[k], loss, slope, curve)
                step[k] = max(-LONGEST, min(LONGEST, -slope / max(curve, 1e-12)))
            else:
                step[k] /= 2
            u, low, slope, _ = best[k]
            done = abs(slope) < tolerance
            out[k] = {"temperature": math.exp(-u), "loss": low, "slope": slope, "rounds": n, "converged": done}
            at[k] = max(-BOUND, min(BOUND, u + step[k]))
            if done or abs(step[k]) < 1e-12 or at[k] == u:
                del at[k]
    return out


def _losses(rows: DataFrame, steps: dict[str, list[float]], weight: float) -> dict[str, dict[float, float]]:
    """Mean loss of each type at the temperatures given."""
    t = F.coalesce(*[F.when(F.col("qtype") == k, F.array(*[F.lit(x) for x in v])) for k, v in steps.items()])
    d = rows.where(F.col("qtype").isin(list(steps))).withColumn("t", F.explode(t))
    d = d.withColumn("e", let(F.array_max("z"), lambda m: let(F.col("t"), lambda c: F.transform("z", lambda x: F.exp((x - m) / c))))).withColumn("s", total(F.col("e")))
    off = let(F.col("s"), lambda s: let(F.col("y"), lambda y: F.transform("e", lambda x, i: x / s - F.when(i == y, 1.0).otherwise(0.0))))
    loss = F.log("s") + (F.array_max("z") - F.element_at("z", F.col("y") + 1)) / F.col("t") + weight * total(F.transform(off, lambda x: x * x))
    out: dict[str, dict[float, float]] = {k: {} for k in steps}
    for r in d.groupBy("qtype", "t").agg(F.avg(loss).alias("loss")).collect():  # a row a step
        out[r["qtype"]][r["t"]] = r["loss"]
    return out


def on_grid(rows: DataFrame, fit: dict[str, dict[str, float | int | bool]], grid: Sequence[float], weight: float = 0.5, wide: int = 100, near: int = 3) -> dict[str, tuple[float, float]]:
    """The step of an ascending grid with the least loss, and that loss, by type.
    The first pass has the steps nearest to the fit and each `wide`-th of all, in
    case the fit is in a dip that isn't the deepest; next come the steps about the
    best one so far, closer each time, until its neighbours have been tried."""
    best: dict[str, int] = {}
    known: dict[str, dict[int, float]] = {k: {} for k in fit}
    nearest = {k: bisect_left(grid, v["temperature"]) for k, v in fit.items()}
    ask = {k: {*range(0, len(grid), wide), len(grid) - 1, *range(i - near, i + near + 1)} for k, i in nearest.items()}
    while ask := {k: sorted(i for i in v if 0 <= i < len(grid) and i not in known[k]) for k, v in ask.items() if v}:
        ask = {k: v for k, v in ask.items() if v}
        if not ask:
            break
        for k, losses in _losses(rows, {k: [grid[i] for i in v] for k, v in ask.items()}, weight).items():
            known[k] |= {i: losses[grid[i]] for i in ask[k]}
            best[k] = min(known[k], key=lambda i: (known[k][i], i))  # noqa: B023
        # about the best step, a tenth of the way to the nearest known ones on either side
        ask = {}
        for k in known:
            i = best[k]
            below, above = max((j for j in known[k] if j < i), default=i), min((j for j in known[k] if j > i), default=i)
            ask[k] = {*range(below, i, max(1, (i - below) // 10)), *range(i, above, max(1, (above - i) // 10))}
    return {k: (grid[i], known[k][i]) for k, i in best.items()}
