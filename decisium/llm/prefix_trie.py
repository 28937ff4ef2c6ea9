"""Trie of conversation prefixes: which conversations share their first turns.

Turns are sorted by conversation and order over range partitions, so a long
conversation lies in several tasks. In each of them a numpy scan gives every
turn its place and a polynomial rolling fingerprint of the turns so far in its
task; what stood in earlier tasks is put before that by a small table of the
conversations that cross a border. As fingerprints are polynomials, those of a
rebuilt conversation follow from those of its two parts without a new scan.

Turns with one depth and fingerprint are candidates for a node. Each turn also
has an exact number of its role and text (a hash, and a rank among texts with
that hash), and the fingerprint of the prefix before it. A group is verified
turn by turn: all members must have the representative's last turn and prefix,
and as the prefix's group is verified too, the whole sequence. Members that
differ are collisions: from that depth on they get fingerprints of another
seed, until nothing differs.

The least member of a node owns it, and the nodes of an owner are a chain of
depths. Chains hang on other chains, so sums over subtrees are made over chains
first, by pointer doubling in as many rounds as the logarithm of their height,
then along each chain from its end, in blocks of depths. The hash over the
conversations that end at a node takes sorted runs of ids that range partitions
have written, one after the other.

Nulls and edges: null roles and texts are empty; turns of a null conv_id belong
to no conversation and are left out. Order: turn, null first, then role, then
text, so ties and repeated rows have one order. No rows: no nodes, not even a
root. Other columns of the table aren't read, whatever their names."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, stored, task_id
from .words import mix

#: Seeds of fingerprints, and bits of each that are kept; the next ones serve for collisions.
SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
BITS = (64, 64, 64)
#: Most turns that a conversation takes from its base, depths in a block of a chain, ids in a run.
TAKEN, DEPTHS, RUN_IDS = 8, 4096, 4096


def taken(conv: np.ndarray) -> np.ndarray:
    """How many turns of the base a conversation takes: crc32 of its id's digits, modulo 9."""
    return np.array([zlib.crc32(b"%d" % c) % (TAKEN + 1) for c in conv.tolist()], np.int64)


def power(r: int, n: np.ndarray) -> np.ndarray:
    """r ** n modulo 2**64 for each n."""
    out, base, left = np.ones(len(n), np.uint64), np.uint64(r), n.copy()
    with np.errstate(over="ignore"):
        while left.any():
            out = np.where(left & 1, out * base, out)
            base, left = base * base, left >> 1
    return out


def scan(value: np.ndarray, first: np.ndarray, r: int) -> np.ndarray:
    """Rolling fingerprints of runs: at each place, the sum of the run's values
    so far, each times r to the number of places since. first: start of each
    value's run."""
    if not len(value):
        return value
    place = np.arange(len(value)) - first
    with np.errstate(over="ignore"):
        upto = np.cumsum(value * power(pow(r, -1, 1 << 64), place), dtype=np.uint64)
        before = np.where(first > 0, upto[first - 1], np.uint64(0))
        return (upto - before) * power(r, place)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _bits(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.ascontiguousarray(_column(batch, name).astype(np.int64)).view(np.uint64)


def contents(turns: DataFrame) -> DataFrame:
    """turns with an exact number of role and text: hash h, and rank k among
    different texts of one hash, which is 0 but for collisions."""
    hashed = turns.withColumn("h", _content_hash())
    distinct = hashed.groupBy("role", "text").agg(F.first("h").alias("h"))
    clash = stored(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "clashes")
    if clash.isEmpty():
        return hashed.withColumn("k", F.lit(0))
    ranks = distinct.join(clash, "h", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("role", "text")) - 1)
    return hashed.join(stored(ranks, "clash-ranks"), ["h", "role", "text"], "left").withColumn("k", F.coalesce("k", F.lit(0)))


def _content_hash() -> Column:
    return F.xxhash64("role", "text")


LOCAL = "part int, place long, conv_id long, ord long, size long, h long, k int, " + ", ".join(f"f{i} long" for i in range(len(SEEDS)))


def scanned(turns: DataFrame) -> DataFrame:
    """Turns in order with ord (from 1) and fingerprints f0.. of all turns of
    their conversation so far."""
    spark = turns.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, last, n, f = task_id(), 0, None, 0, [np.uint64(0)] * len(SEEDS)
        for b in batches:
            if not b.num_rows:
                continue
            conv = _column(b, "conv_id")
            new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
            goes_on = 0 if new[0] else (int(np.argmax(new)) if new.any() else len(conv))
            ord_ = np.arange(len(conv)) - first + 1
            ord_[:goes_on] += n
            value = turn_value(_bits(b, "h"), _column(b, "k"))
            prints = []
            for i, r in enumerate(SEEDS):
                p = scan(value, first, r)
                with np.errstate(over="ignore"):
                    p[:goes_on] += f[i] * power(r, np.arange(1, goes_on + 1))
                f[i] = p[-1]
                prints.append(p)
            last, n = conv[-1], int(ord_[-1])
            yield pa.record_batch(
                [pa.array(np.full(len(conv), part, np.int32)), pa.array(np.arange(place, place + len(conv))), b.column("conv_id"), pa.array(ord_), b.column("size"), b.column("h"), b.column("k"), *map(_long, prints)],
                [x.split()[0] for x in LOCAL.split(", ")],
            )
            place += len(conv)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.repartitionByRange(n, *order, F.col("id")).sortWithinPartitions(*order).select("conv_id", F.octet_length("text").cast("long").alias("size"), "h", F.col("k").cast("int").alias("k"))
    local = stored(rows.mapInArrow(run, LOCAL), "scanned")
    # conversations that cross a border: at most two rows a task
    ends = local.groupBy("part", "conv_id").agg(F.max("ord").alias("n"), *[F.max_by(f"f{i}", "ord").alias(f"f{i}") for i in range(len(SEEDS))])
    crossing = ends.withColumn("parts", F.count("*").over(Window.partitionBy("conv_id"))).where("parts > 1")
    before_ddl = "part int, conv_id long, n_before long, " + ", ".join(f"b{i} long" for i in range(len(SEEDS)))

    def before(pdf):
        import pandas as pd

        pdf = pdf.sort_values("part")
        n = pdf["n"].to_numpy(np.int64)
        out = {"part": pdf["part"], "conv_id": pdf["conv_id"], "n_before": np.cumsum(n) - n}
        for i, r in enumerate(SEEDS):
            f, at, so_far = pdf[f"f{i}"].to_numpy(np.int64).view(np.uint64), power(r, n), [np.uint64(0)]
            with np.errstate(over="ignore"):
                for x, p in zip(f[:-1], at[:-1], strict=True):
                    so_far.append(so_far[-1] * p + x)
            out[f"b{i}"] = np.array(so_far, np.uint64).view(np.int64)
        return pd.DataFrame(out)

    heads = stored(crossing.groupBy("conv_id").applyInPandas(before, before_ddl).where("n_before > 0"), "crossing")
    if heads.isEmpty():
        return local

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, r in enumerate(SEEDS):
                with np.errstate(over="ignore"):
                    out.append(_long(_bits(b, f"f{i}") + _bits(b, f"b{i}") * power(r, _column(b, "ord"))))
            yield pa.record_batch([*(b.column(c) for c in ("part", "place", "conv_id")), pa.array(_column(b, "ord") + _column(b, "n_before")), *(b.column(c) for c in ("size", "h", "k")), *out], [x.split()[0] for x in LOCAL.split(", ")])

    joined = local.join(heads, ["part", "conv_id"], "left")
    whole = joined.select(*local.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ["n_before", *(f"b{i}" for i in range(len(SEEDS)))]])
    return stored(whole.mapInArrow(put, LOCAL), "scanned")


def turn_value(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The number that stands for a turn in fingerprints."""
    with np.errstate(over="ignore"):
        return mix(h + k.astype(np.uint64) * np.uint64(SEEDS[0])) | np.uint64(1)


MEMBER = "conv_id long, depth long, size long, h long, k int, " + ", ".join(f"f{i} long, p{i} long" for i in range(len(SEEDS)))


def rebuilt(turns: DataFrame, n_taken: Callable[[np.ndarray], np.ndarray] = taken, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations: depth, last turn, fingerprint of all
    turns up to it (f0..) and before it (p0..); and conv_id, n of each."""
    seeds = range(len(SEEDS))

    def info(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("conv_id"), b.column("n"), pa.array(n_taken(_column(b, "conv_id")))], ["conv_id", "n", "take"])

    convs = stored(turns.groupBy("conv_id").agg(F.max("ord").alias("n")).mapInArrow(info, "conv_id long, n long, take long").withColumn("base", F.expr(f"conv_id - conv_id % {group}")), "convs")
    heads = turns.where(F.col("ord") <= TAKEN)
    # how the two parts join: fingerprints of what is taken and of what is dropped
    base = convs.select("conv_id", "take", "base").join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn("got", F.least("take", F.coalesce("n_base", F.lit(0))))
    got = heads.select(F.col("conv_id").alias("base"), F.col("ord").alias("got"), *[F.col(f"f{i}").alias(f"g{i}") for i in seeds])
    cut = heads.select("conv_id", F.col("ord").alias("take"), *[F.col(f"f{i}").alias(f"c{i}") for i in seeds])
    joints = stored(
        base.join(got, ["base", "got"], "left").join(cut, ["conv_id", "take"], "left").select("conv_id", "base", "take", "got", *[F.coalesce(f"{x}{i}", F.lit(0)).alias(f"{x}{i}") for i in seeds for x in "gc"]),
        "joints",
    )

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = _column(b, "ord") - _column(b, "take")
            value = turn_value(_bits(b, "h"), _column(b, "k"))
            prints = []
            for i, r in enumerate(SEEDS):
                with np.errstate(over="ignore"):
                    f = _bits(b, f"f{i}") + (_bits(b, f"g{i}") - _bits(b, f"c{i}")) * power(r, step)
                    prints += [_long(f), _long((f - value) * np.uint64(pow(r, -1, 1 << 64)))]
            yield pa.record_batch([b.column("conv_id"), pa.array(_column(b, "got") + step), *(b.column(c) for c in ("size", "h", "k")), *prints], [x.split()[0] for x in MEMBER.split(", ")])

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = turn_value(_bits(b, "h"), _column(b, "k"))
            prints = []
            for i, r in enumerate(SEEDS):
                f = _bits(b, f"f{i}")
                with np.errstate(over="ignore"):
                    prints += [_long(f), _long((f - value) * np.uint64(pow(r, -1, 1 << 64)))]
            yield pa.record_batch([*(b.column(c) for c in ("conv_id", "ord", "size", "h", "k")), *prints], [x.split()[0] for x in MEMBER.split(", ")])

    own = turns.join(joints, "conv_id").where("ord > take").mapInArrow(shifted, MEMBER)
    from_base = joints.select(F.col("conv_id").alias("own_id"), F.col("base").alias("conv_id"), "got").where("got > 0").join(heads, "conv_id").where("ord <= got")
    heads_of = from_base.select(F.col("own_id").alias("conv_id"), "ord", "size", "h", "k", *[f"f{i}" for i in seeds]).mapInArrow(copied, MEMBER)
    members = stored(own.union(heads_of), "rebuilt")
    lengths = convs.select("conv_id").join(members.groupBy("conv_id").agg(F.max("depth").alias("n")), "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n"))
    return members, stored(lengths, "lengths")


def _print(i: int, column: str) -> Column:
    """A fingerprint's bits that are kept; of no turns it is 0 for every seed."""
    return F.col(column) if BITS[i] == 64 else F.col(column).bitwiseAND(F.lit((1 << BITS[i]) - 1))


def verified(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members with seed and key, the prefix before as prev_seed and prev, so
    that equal keys of a depth mean equal turns; and the nodes: their size in
    bytes, number of members n_convs and least one conv_id."""
    columns = ["conv_id", "depth", "size", "h", "k"]
    first = members.select(*columns, F.lit(0).alias("seed"), _print(0, "f0").alias("key"), F.when(F.col("depth") > 1, F.lit(0)).otherwise(-1).alias("prev_seed"), F.when(F.col("depth") > 1, _print(0, "p0")).otherwise(0).alias("prev"))
    moved = None  # conv_id, from which depth on, and the seed then
    now = first
    while True:
        last = F.struct("prev_seed", "prev", "h", "k")
        nodes = stored(
            now.groupBy("depth", "seed", "key").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min_by(last, F.col("conv_id")).alias("own"), F.min(last).alias("lo"), F.max(last).alias("hi"), F.first("size").alias("size")),
            "nodes",
        )
        bad = nodes.where("lo <> hi").select("depth", "seed", "key", "own")
        if bad.isEmpty():
            return now, nodes.select("depth", "seed", "key", "n_convs", "conv_id", "size", "own.prev_seed", "own.prev")
        differ = now.join(bad, ["depth", "seed", "key"]).where(last != F.col("own"))
        to = stored(differ.groupBy("conv_id").agg(F.min(F.struct("depth", F.col("seed") + 1)).alias("x")).select("conv_id", F.col("x.depth").alias("since"), F.col("x.col2").alias("to")), "moved")
        if not to.where(F.col("to") >= len(SEEDS)).isEmpty():
            raise RuntimeError("fingerprints of all seeds collide")
        moved = to if moved is None else stored(moved.union(to), "moved")
        # by depth, the seed of the last move at or before it
        moves = moved.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("since", "to"))).alias("moves"))
        at = lambda depth: F.coalesce(F.array_max(F.transform(F.filter("moves", lambda m: m["since"] <= depth), lambda m: m["to"])), F.lit(0))
        pick = lambda seed, letter: F.coalesce(*[F.when(F.col(seed) == i, _print(i, f"{letter}{i}")) for i in range(len(SEEDS))])
        now = stored(
            members.join(moves, "conv_id", "left")
            .withColumn("seed", at(F.col("depth")))
            .withColumn("prev_seed", F.when(F.col("depth") > 1, at(F.col("depth") - 1)).otherwise(-1))
            .select(*columns, "seed", pick("seed", "f").alias("key"), "prev_seed", F.when(F.col("depth") > 1, pick("prev_seed", "p")).otherwise(0).alias("prev")),
            "keyed",
        )


def subtree_sums(chains: DataFrame) -> DataFrame:
    """chain, total: own + those of all chains below. chains: chain, parent
    (null at the top), leaves, saved. Pointer doubling: after round i each
    chain holds what lies less than 2**i below it."""
    now = stored(chains.select("chain", F.col("parent").alias("up"), "leaves", "saved"), "sums")
    while True:
        sent = now.where("up is not null").groupBy(F.col("up").alias("chain")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        if sent.isEmpty():
            return now.select("chain", "leaves", "saved")
        above = now.select(F.col("chain").alias("up"), F.col("up").alias("higher"))
        lifted = now.where("up is not null").join(above, "up", "left").select("chain", F.col("higher").alias("up"), "leaves", "saved")
        now = stored(
            lifted.union(now.where("up is null")).join(sent, "chain", "left").select("chain", "up", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]),
            "sums",
        )


def end_digests(ends: DataFrame) -> DataFrame:
    """chain, depth, ends_sha256 over the conversations (conv_id) that end at a
    node. Ids are sorted over range partitions and written in runs; a task then
    hashes a node's runs in their order, holding a batch of them at a time."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = task_id(), 0
        for b in batches:
            chain, depth = _column(b, "chain"), _column(b, "depth")
            cut = np.flatnonzero(np.concatenate([[True], (chain[1:] != chain[:-1]) | (depth[1:] != depth[:-1])])) if len(chain) else np.zeros(0, np.int64)
            cut = np.union1d(cut, np.arange(0, len(chain), RUN_IDS)).astype(np.int64)
            ids = b.column("conv_id").to_pylist()
            text = [",".join(map(str, ids[x:y])) for x, y in zip(cut, [*cut[1:], len(ids)], strict=True)]
            yield pa.record_batch([pa.array(chain[cut]), pa.array(depth[cut]), pa.array(np.full(len(cut), part, np.int32)), pa.array(np.arange(place, place + len(cut))), pa.array(text, pa.string())], ["chain", "depth", "part", "run", "ids"])
            place += len(cut)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        out: list[tuple[int, int, str]] = []

        def sent() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], [], []]
            batch = pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["chain", "depth", "ends_sha256"])
            out.clear()
            return batch

        for b in batches:
            for chain, depth, ids in zip(b.column("chain").to_pylist(), b.column("depth").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if (chain, depth) == node:
                    sha.update(b"," + ids.encode())
                else:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (chain, depth), hashlib.sha256(ids.encode())
            yield sent()
        if node is not None:
            out.append((*node, sha.hexdigest()))
        yield sent()

    order = ["chain", "depth", "conv_id"]
    written = stored(ends.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(runs, "chain long, depth long, part int, run long, ids string"), "ends")
    return written.repartition(n, "chain", "depth").sortWithinPartitions("chain", "depth", "part", "run").mapInArrow(digests, "chain long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, n_taken: Callable[[np.ndarray], np.ndarray] = taken, group: int = 5) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 of each node."""
    prepare(conversations.sparkSession)
    none = F.lit("")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    turns = contents(turns).withColumn("id", F.monotonically_increasing_id())
    members, lengths = rebuilt(scanned(turns), n_taken, group)
    keyed, nodes = verified(members)
    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    root = top["conv_id"]
    if root is None:
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    # owner of the node above, which for depth 1 is the root's
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("seed").alias("prev_seed"), F.col("key").alias("prev"), F.col("conv_id").alias("above"))
    deep = nodes.where("depth > 1").join(above, ["depth", "prev_seed", "prev"])
    names = ["conv_id", "depth", "n_convs", "size", "above"]
    owned = deep.select(*names).union(nodes.where("depth = 1").withColumn("above", F.lit(root)).select(*names))
    spark = conversations.sparkSession
    owned = stored(owned.union(spark.createDataFrame([(root, 0, top["n_convs"], 0, None)], "conv_id long, depth long, n_convs long, size long, above long")), "owned")

    # chains that hang on a node, and how long each chain is
    tops = owned.where("above <> conv_id").select(F.col("conv_id").alias("chain"), F.col("above").alias("parent"), (F.col("depth") - 1).alias("at"))
    bottoms = owned.groupBy(F.col("conv_id").alias("chain")).agg(F.max("depth").alias("bottom"))
    hung = tops.groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("hung"))
    sized = stored(
        owned.join(hung, ["conv_id", "depth"], "left")
        .join(bottoms.withColumnRenamed("chain", "conv_id"), "conv_id")
        .select(
            "conv_id",
            "depth",
            "above",
            "n_convs",
            (F.coalesce("hung", F.lit(0)) + (F.col("depth") < F.col("bottom")).cast("long")).alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
        ),
        "sized",
    )
    own = sized.groupBy(F.col("conv_id").alias("chain")).agg(F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"), F.sum("saved").alias("saved"))
    totals = subtree_sums(own.join(tops.select("chain", "parent"), "chain", "left"))
    arrived = totals.join(tops, "chain").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    here = stored(
        sized.join(arrived, ["conv_id", "depth"], "left")
        .withColumn("block", F.floor(F.col("depth") / DEPTHS))
        .withColumn("leaves", F.coalesce("hung_leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long"))
        .withColumn("saved", F.col("saved") + F.coalesce("hung_saved", F.lit(0)))
        .drop("hung_leaves", "hung_saved"),
        "here",
    )
    from_end = lambda w: w.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = here.groupBy("conv_id", "block").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in ("leaves", "saved")])
    within = from_end(Window.partitionBy("conv_id", "block"))
    summed = here.withColumns({f"own_{c}": F.sum(c).over(within) for c in ("leaves", "saved")}).join(blocks, ["conv_id", "block"])

    # conversations by the node that they end at; those without turns end at the root
    last = keyed.join(lengths.withColumnRenamed("n", "depth"), ["conv_id", "depth"]).select(F.col("conv_id").alias("ended"), "depth", "seed", "key")
    ends = last.join(nodes.select("depth", "seed", "key", "conv_id"), ["depth", "seed", "key"]).select(F.col("conv_id").alias("chain"), "depth", F.col("ended").alias("conv_id"))
    ends = ends.union(lengths.where("n = 0").select(F.lit(root).cast("long").alias("chain"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    digests = end_digests(ends).select(F.col("chain").alias("conv_id"), "depth", "ends_sha256")
    return summed.join(digests, ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        F.col("above").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        (F.col("own_leaves") + F.col("later_leaves")).alias("n_leaves"),
        (F.col("own_saved") + F.col("later_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
