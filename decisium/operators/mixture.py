"""Corpus mixtures: budgets, holdout, packing, windows, samplers.

Orders are keyed hashes, so every step gives the same rows whatever the
partitioning. Global running sums are made in two phases: sums by range of the
order, then offsets added to sums within a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import hash32, uniform

BEFORE = (Window.unboundedPreceding, -1)


def sum_before(rows: DataFrame, groups: list[str], seed: str, key: str | list[str], size: str, into: str) -> DataFrame:
    """Adds the sum of `size` over a group's rows before each one in hash order:
    sums of 4096 hash ranges, then sums within a range, so that no window holds
    a whole group."""
    keys = [key] if isinstance(key, str) else key
    h = rows.withColumn("_h", hash32(seed, *keys))
    return _sum_by_range(h.withColumn("_b", F.shiftright("_h", 20)), groups, ["_h", *keys], size, into).drop("_h")


def place_in(rows: DataFrame, groups: list[str], order: str, into: str, width: int = 1 << 16) -> DataFrame:
    """Adds each row's place (from 0) in its group by `order`, a unique whole
    number: counts by range of the order, then places within a range. There is a
    range for every `width` rows, so no window holds a whole group."""
    ranged = rows.withColumn("_b", _range_of(rows, order, width)).withColumn("_one", F.lit(1).cast("long"))
    return _sum_by_range(ranged, groups, [order], "_one", into).drop("_one")


def _range_of(rows: DataFrame, order: str, width: int) -> Column:
    """Number of a row's range of `order`: equal steps from its least to its
    greatest value, as many as rows / width. Ids may be dense or 64-bit hashes."""
    at = F.col(order).cast("double")
    ends = rows.agg(F.struct(F.min(at).alias("lo"), F.max(at).alias("hi"), F.greatest(F.lit(1), F.ceil(F.count("*") / width)).alias("n"))).scalar()
    step = (at - ends.getField("lo")) / (ends.getField("hi") - ends.getField("lo") + 1)
    return F.floor(step * ends.getField("n"))


def _sum_by_range(rows: DataFrame, groups: list[str], order: list[str], size: str, into: str) -> DataFrame:
    """Sums of a group's rows before each one, from sums by its ranges _b, which follow the order."""
    sums = rows.groupBy(*groups, "_b").agg(F.sum(size).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_b").rowsBetween(*BEFORE))
    bases = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_b").alias("_r"), F.coalesce(upto, F.lit(0)).alias("_base"))
    inner = F.sum(size).over(Window.partitionBy(*groups, "_b").orderBy(*order).rowsBetween(*BEFORE))
    same = F.col("_b") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = rows.withColumn("_in", F.coalesce(inner, F.lit(0))).join(bases, same)
    return out.withColumn(into, F.col("_in") + F.col("_base")).drop("_b", "_r", "_in", "_base", *[f"_g{i}" for i in range(len(groups))])


def token_budget(docs: DataFrame, budget: Column, seed: str, source: str = "source", key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Rows of each source, in hash order, while those before are under the
    budget; the last may go over it. Adds got (tokens before)."""
    return sum_before(docs, [source], seed, key, size, "got").where(F.col("got") < budget)


def holdout(docs: DataFrame, rate: float, cap: int, seed: str, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Adds held: drawn by hash, while all that were drawn before, of whatever
    source, hold under `cap` tokens. docs: the rows of a mixture within their
    budgets."""
    drawn = docs.withColumn("_drawn", uniform(seed, key) < rate)
    before = sum_before(drawn, ["_drawn"], seed, key, size, "_before")
    return before.withColumn("held", F.col("_drawn") & (F.col("_before") < cap)).drop("_drawn", "_before")


def running_offset(rows: DataFrame, order: str, size: str, width: int = 1 << 12) -> DataFrame:
    """Adds offset: the sum of `size` over all rows of lower `order` (a unique
    whole number). Rows are summed by range, one for every `width` rows, the
    ranges by range of ranges, until one window holds few rows; no window holds
    the whole input."""
    placed = rows.withColumn("_o", F.col(order).cast("long"))
    return _offset(placed, size, _range_of(placed, "_o", width), width).drop("_o")


def _offset(rows: DataFrame, size: str, block: Column, width: int, depth: int = 3) -> DataFrame:
    if depth == 0:
        w = Window.partitionBy(F.lit(0)).orderBy("_o").rowsBetween(*BEFORE)
        return rows.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))
    ranged = rows.withColumn("_b", block)
    sums = ranged.groupBy("_b").agg(F.sum(size).alias("_n")).select(F.col("_b").alias("_o"), F.col("_n").alias(size))
    bases = _offset(sums, size, F.floor(F.col("_o") / width), width, depth - 1).select(F.col("_o").alias("_b"), F.col("offset").alias("_base"))
    w = Window.partitionBy("_b").orderBy("_o").rowsBetween(*BEFORE)
    inner = ranged.withColumn("_in", F.coalesce(F.sum(size).over(w), F.lit(0)))
    return inner.join(bases, "_b").withColumn("offset", F.col("_in") + F.col("_base")).drop("_b", "_in", "_base")


def shards_of(docs: DataFrame, shard: int, size: str = "n_tokens") -> DataFrame:
    """shard, first (place in the shard), begin (place in the document), length
    of each part of a document; documents run on over shard ends."""
    at, end = F.col("offset"), F.col("offset") + F.col(size)
    k = F.explode(F.sequence(F.floor(at / shard), F.floor((end - 1) / shard)))
    parts = docs.where(F.col(size) > 0).withColumn("shard", k)
    lo, hi = F.greatest(at, F.col("shard") * shard), F.least(end, (F.col("shard") + 1) * shard)
    return parts.withColumn("first", lo - F.col("shard") * shard).withColumn("begin", lo - at).withColumn("length", hi - lo)


def windows_of(shards: DataFrame, seq: int) -> DataFrame:
    """window, begin and length (seq + 1) of each full window of a shard of
    n_tokens tokens; neighbours share one token, the tail is left out."""
    n = F.floor((F.col("n_tokens") - 1) / seq)
    w = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    return shards.where(n > 0).withColumn("window", w).withColumn("begin", F.col("window") * seq).withColumn("length", F.lit(seq + 1).cast("long"))


def cumulative_weights(sizes: DataFrame, weight: Column, source: str = "source") -> DataFrame:
    """source, size, lo and hi of each source's share of [0, 1), by weight
    times the root of its size. One row per source."""
    w = Window.partitionBy(F.lit(0)).orderBy(source)
    share = sizes.withColumn("_w", weight * F.sqrt("size"))
    upto = F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_w").over(Window.partitionBy(F.lit(0)))
    return share.withColumn("hi", upto).withColumn("lo", F.lag("hi", 1, 0.0).over(w)).select(source, "size", "lo", "hi")


def weighted_draws(draws: DataFrame, shares: DataFrame, pool: DataFrame, seed: str, source: str = "source", key: str = "doc_id") -> DataFrame:
    """For draws 0..n-1 a source by its share and a row of its pool; the pool is
    taken in hash order and shuffled anew for each epoch."""
    u = uniform(seed, "draw")
    picked = draws.withColumn("u", u).join(F.broadcast(shares), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    turns = place_in(picked, [source], "draw", "_n").withColumn("epoch", F.floor(F.col("_n") / F.col("size"))).withColumn("place", F.col("_n") % F.col("size"))
    epochs = turns.select(source, "epoch").distinct()
    each = pool.select(source, key).join(epochs, source).withColumn("_one", F.lit(1).cast("long"))
    ranked = sum_before(each, [source, "epoch"], seed, ["epoch", key], "_one", "place").drop("_one")
    return turns.join(ranked, [source, "epoch", "place"]).select("draw", source, "epoch", "place", key)


def first_per_group(rows: DataFrame, group: str, most: int, *order: Column | str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def whole_families(rows: DataFrame, limit: int, seed: str, key: str, family: str, domain: str) -> DataFrame:
    """Whole families, round-robin over the domains in hash order, up to the
    first that would exceed the limit. A family's domain is its first member's.
    Only families, not rows, meet in the window that adds sizes up."""
    fam = rows.groupBy(family).agg(F.min_by(domain, key).alias("_domain"), F.count("*").alias("_size"))
    turn = F.row_number().over(Window.partitionBy("_domain").orderBy(hash32(seed, family), family))
    upto = Window.partitionBy(F.lit(0)).orderBy("_turn", "_domain").rowsBetween(Window.unboundedPreceding, 0)
    # no family after the first `limit` turns of a domain can be taken
    taken = fam.withColumn("_turn", turn).where(F.col("_turn") <= limit).withColumn("_upto", F.sum("_size").over(upto)).where(F.col("_upto") <= limit)
    return rows.join(taken.select(family, F.col("_domain").alias("family_domain")), family)


def negatives(rows: DataFrame, seed: str, key: str) -> DataFrame:
    """Each row with the key of another as its negative, drawn with replacement
    (it may be the row itself): places in hash order are drawn by hash. Places
    come from counts by hash range, so no window holds the whole input."""
    h = rows.withColumn("_h", hash32(seed, key)).withColumn("_b", F.shiftright("_h", 20))
    counts = h.groupBy("_b").agg(F.count("*").alias("_n"))
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(*BEFORE)), F.lit(0)))  # 4096 rows
    placed = h.join(F.broadcast(bases.select("_b", "_base")), "_b").withColumn("_place", F.col("_base") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1)
    total = counts.agg(F.sum("_n")).scalar()
    drawn = rows.withColumn("_place", hash32(seed + "-draw", key) % total)
    return drawn.join(placed.select("_place", F.col(key).alias("negative")), "_place").drop("_place")
