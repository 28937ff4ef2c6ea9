"""The decision kernel: from slot logits to calibrated, decoded answers.

All steps are array expressions on the request's own row, so a plan has no
shuffle; only averaging over option orders groups rows. Options are arrays in
the caller's order, which is the order of slots; ties go to the first option."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS, ABSTAIN, MOST_OPTIONS, IGNORE = 256, 255, 255, -100
AUTO_ORDERS, AUTO_FROM = 8, 11
TINY = 1e-12
QTYPES = ("choice", "score", "noul")


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: an expression that a lambda
    captures would be evaluated for each element of its array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slot_valid(count: Column, slot: Column) -> Column:
    """Slots of options and abstain; a padding question keeps slot 0."""
    return (slot < count) | (slot == ABSTAIN) | ((count == 0) & (slot == 0))


def masked(logits: Column, count: Column) -> Column:
    """Logits by slot, null where the slot isn't valid."""
    return F.transform(logits, lambda x, j: F.when(slot_valid(count, j), x))


def with_probabilities(df: DataFrame, logits: str = "logits", abstain: str = "abstain_logit", temperature: Column | float = 1.0) -> DataFrame:
    """Adds p (softmax over options and abstain), p_abstain and pk (options alone)."""
    t = F.lit(temperature) if isinstance(temperature, float | int) else temperature
    return (
        df.withColumn("_z", F.transform(logits, lambda x: x / t))
        .withColumn("_za", F.col(abstain) / t)
        .withColumn("_m", F.greatest(F.array_max("_z"), "_za"))
        .withColumn("_e", let(F.col("_m"), lambda m: F.transform("_z", lambda x: F.exp(x - m))))
        .withColumn("_ea", F.exp(F.col("_za") - F.col("_m")))
        .withColumn("_s", total(F.col("_e")) + F.col("_ea"))
        .withColumn("p", let(F.col("_s"), lambda s: F.transform("_e", lambda x: x / s)))
        .withColumn("p_abstain", F.col("_ea") / F.col("_s"))
        .withColumn("pk", normal(F.col("p")))
        .drop("_z", "_za", "_m", "_e", "_ea", "_s")
    )


def normal(p: Column) -> Column:
    return let(p, lambda q: let(F.greatest(total(q), F.lit(TINY)), lambda s: F.transform(q, lambda x: x / s)))


def confidence(pk: Column) -> Column:
    """1 less the entropy over its largest value; 1 for a single option."""
    c = normal(F.transform(pk, lambda x: F.greatest(x, F.lit(TINY))))
    h = -total(F.transform(c, lambda x: x * F.log(x)))
    k = F.size(pk)
    return F.when(k <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - h / F.log(F.greatest(k, F.lit(2)).cast("double")))))


def best_slot(pk: Column) -> Column:
    return (F.array_position(pk, F.array_max(pk)) - 1).cast("int")


def expected_level(pk: Column) -> Column:
    return total(F.transform(pk, lambda x, i: x * i))


def order_count(option_counts: Column, explicit: Column | None = None) -> Column:
    """How many option orders a request takes: as asked, else AUTO_ORDERS if a
    choice has AUTO_FROM options or more; 1 at least, the most options at most.
    option_counts: those of the request's choice questions."""
    most = F.coalesce(F.array_max(option_counts), F.lit(1))
    auto = F.when(most >= AUTO_FROM, AUTO_ORDERS).otherwise(1)
    return F.greatest(F.lit(1), F.least(auto if explicit is None else F.coalesce(explicit, auto), most))


def requested_orders(permutations: Column, order_invariant: Column) -> Column:
    """permutations, else order_invariant (8 or 1), else null for automatic."""
    return F.coalesce(permutations, F.when(order_invariant, AUTO_ORDERS).when(~order_invariant, 1))


def cyclic_shifts(k: Column, n: Column) -> Column:
    """n shifts spread evenly over k options, none first."""
    m = F.greatest(F.lit(1), F.least(n, k))
    return F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.pmod(F.bround(j * k / m).cast("int"), k))


def shifted(options: Column, shift: Column) -> Column:
    return let(options, lambda xs: F.transform(xs, lambda _, j: F.element_at(xs, F.pmod(j + shift, F.size(xs)) + 1)))


def averaged_orders(logits: Column, abstain: Column, shifts: Column, bias: float = 0.0) -> Column:
    """(pk, abstain, orders) over cyclic orders of the options, on the request's
    own row: each order's probabilities are turned back to the options' own
    places and added up. bias: what a slot's place adds to its logit."""

    def one(shift: Column) -> Column:
        turned = F.transform(shifted(logits, shift), lambda x, j: x + bias * j)

        def probs(z: Column) -> Column:
            return let(F.greatest(F.array_max(z), abstain), lambda m: let(F.transform(z, lambda x: F.exp(x - m)), lambda e: F.struct(normal(e).alias("pk"), (F.exp(abstain - m) / (total(e) + F.exp(abstain - m))).alias("a"))))

        back = lambda r: F.struct(F.transform(r["pk"], lambda _, i: F.element_at(r["pk"], F.pmod(i - shift, F.size(r["pk"])) + 1)).alias("pk"), r["a"].alias("a"))
        return let(let(turned, probs), back)

    def mean(rows: Column) -> Column:
        n = F.size(rows)
        added = F.aggregate(F.slice(rows, F.lit(2), n), F.element_at(rows, 1)["pk"], lambda s, r: F.zip_with(s, r["pk"], lambda x, y: x + y))
        return F.struct(F.transform(added, lambda x: x / n).alias("pk"), (total(F.transform(rows, lambda r: r["a"])) / n).alias("abstain"), n.cast("long").alias("orders"))

    return let(F.transform(shifts, one), mean)


def cross_entropy(p: Column, p_abstain: Column, label: Column, smoothing: float = 0.0) -> Column:
    """Negative log-likelihood with smoothing over valid slots; null if unlabelled."""
    logp = F.transform(p, lambda x: F.log(F.greatest(x, F.lit(1e-300))))
    la = F.log(F.greatest(p_abstain, F.lit(1e-300)))
    own = F.when(label == ABSTAIN, la).otherwise(F.try_element_at(logp, label + 1))
    smooth = -(total(logp) + la) / (F.size(p) + 1)
    return F.when(label != IGNORE, -(1 - smoothing) * own + smoothing * smooth)


def brier(p: Column, p_abstain: Column, label: Column) -> Column:
    hit = lambda x, i: (x - F.when(label == i, 1.0).otherwise(0.0))
    a = p_abstain - F.when(label == ABSTAIN, 1.0).otherwise(0.0)
    return F.when(label != IGNORE, total(F.transform(p, lambda x, i: hit(x, i) * hit(x, i))) + a * a)


def soft_cross_entropy(p: Column, target: Column) -> Column:
    """Negative log-likelihood of a soft target over the options."""
    return -total(F.zip_with(target, p, lambda t, x: t * F.log(F.greatest(x, F.lit(1e-300)))))


def fit_temperature(df: DataFrame, temperatures: list[float], brier_weight: float = 0.5) -> DataFrame:
    """Mean loss at each temperature of a fixed grid, in one pass and one row
    per temperature. df: logits, abstain_logit, label."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in temperatures]))
    scored = with_probabilities(df.withColumn("temperature", grid), temperature=F.col("temperature"))
    nll, b = cross_entropy(F.col("p"), F.col("p_abstain"), F.col("label")), brier(F.col("p"), F.col("p_abstain"), F.col("label"))
    return scored.groupBy("temperature").agg(F.avg(nll).alias("nll"), F.avg(b).alias("brier")).withColumn("loss", F.col("nll") + brier_weight * F.col("brier"))


def chance(option_counts: Column) -> Column:
    """Probability that blind guesses hit all labels."""
    return F.aggregate(option_counts, F.lit(1.0), lambda a, k: a / F.greatest(F.lit(2), k))


def learning_rate(step: Column, steps: int, peak: float, warmup: float, least: float) -> Column:
    """Linear warm-up, then a cosine down to least * peak."""
    warm = max(1, int(steps * warmup))
    done = F.least(F.lit(1.0), (step - warm) / max(1, steps - warm))
    return F.when(step < warm, peak * step / warm).otherwise(peak * (least + (1 - least) * 0.5 * (1 + F.cos(math.pi * done))))


def by_probability(names: Column, pk: Column) -> Column:
    """Option names from the likeliest on; ties in the caller's order."""
    keyed = F.transform(F.arrays_zip(names.alias("n"), pk.alias("p")), lambda x, i: F.struct((-x["p"]).alias("k"), i.alias("i"), x["n"].alias("n")))
    return F.transform(F.array_sort(keyed), lambda x: x["n"])


def legend(descs: Column) -> Column:
    """Level texts by number; a level without one has its number."""
    return F.transform(descs, lambda d, i: F.when(F.coalesce(d, F.lit("")) != "", d).otherwise(i.cast("string")))


def response(answer: Column, model: Column, input_ids: Column, orders: Column | int, default: str = "decisium") -> Column:
    """The answer with the model asked for (else the default) and usage: the
    ids of one order, however many orders were averaged."""
    n = F.lit(orders) if isinstance(orders, int) else orders
    return F.struct(F.coalesce(model, F.lit(default)).alias("model"), answer.alias("answer"), F.struct(F.size(input_ids).alias("input_tokens"), F.lit(0).alias("output_tokens"), n.cast("int").alias("permutations")).alias("usage"))


def scored(df: DataFrame, scorer: Callable[[DataFrame], DataFrame], temperature: Column | float = 1.0) -> DataFrame:
    """Probabilities of requests by any scorer: it adds logits (by option) and
    abstain_logit to the requests, as columns, by a join or by a model's UDF."""
    return with_probabilities(scorer(df), temperature=temperature)
