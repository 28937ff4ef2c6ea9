"""MinHash near-duplicates with bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles; its sketch the
KEEP least of them. Documents with equal sets are one class, whose least doc_id
stands for it. Of the KEEP least values of two sets' union, those in both sets
are in both sketches; at similarity t their number is below `need` with a
probability under 1e-9 (for sets that fit the sketches: never, with the exact
bound). So two similar sketches share a value among the first
size - need + 1 of each in any common order. Taken rarest first, these values
make inverted lists in which common lines and phrases hardly occur.

Pairs of a list are not all made as rows. First each list's most typical member
(fewest values of its own) is compared with all others. Members that are then in
one component need no further comparison. Where a list still has several
components, those outside its largest one are compared with all others there:
for all lists with that largest component at once, in blocks of bounded size, as
matrix products within a task: first of sketches, then, for members that may
have a partner, of full sets, which gives back a spanning forest of the links.
So each pair of a list has been compared or is in one component: no link is
lost, and n near copies cost about n rows.

A pair is compared in three steps: set sizes, the estimate from the sketch of
the union, and, only then, the exact Jaccard similarity of the full sets, which
are made from the texts again. More ids than BROADCAST_IDS go to the texts as a
Bloom filter first. The estimate is taken from short forms of the
sketches, the SHORT least values' lower 15 bits in rising order of the values:
a value with places i and j (from 1) in the two, after k - 1 shared ones, has
place i + j - k in the union, so equality alone tells how many of the SHORT
least values of the union are shared. Values of one sketch that fall together
in 15 bits count as shared, so that none is missed.

Nulls and edges: a null or wordless text has an empty set, linked with nothing;
fewer words than a shingle has make one shingle; a null doc_id is linked with
nothing and kept. Rows that repeat a doc_id each link by their own text; those
whose texts have that doc_id as their least one are one class. Ties don't matter, as links are a set. Long
texts count whole; other columns of the input aren't read, so their names can't
clash. An empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import forget
from .common import bloom, passing, prepare, slices, stored, text_buffer
from .components import Forest, components
from .words import BLANK, Words, find, grams

KEEP, SHORT, TEXT_BYTES, BROADCAST_IDS = 80, 48, 500_000, 1_000_000
A_BLOCK, B_BLOCK, COLUMNS = 512, 2048, 4096


def least_shared(percent: int, keep: int = KEEP, miss: float = 1e-9) -> int:
    """How many of the `keep` least values of a union two sets share at least,
    at a similarity of percent / 100, but for the probability `miss`."""
    p, total, n = percent / 100, 0.0, 0
    while True:
        total += comb(keep, n) * p**n * (1 - p) ** (keep - n)
        if total > miss:
            return max(1, n)
        n += 1


def shingle_sets(w: Words, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct 63-bit shingle hashes of each document."""
    g = grams(w.hashes, shingle) >> np.uint64(1)
    first = w.first.tolist()
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= shingle:
            x = np.sort(g[a : b - shingle + 1])
            yield x[np.append(True, x[1:] != x[:-1])]
        elif n:
            yield grams(w.hashes[a:b], n) >> np.uint64(1)
        else:
            yield g[:0]


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n (set size), sig (digest of the set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                sets = list(shingle_sets(find(*text_buffer(b.column("text")), BLANK, lower=True), shingle))
                yield pa.record_batch(
                    [
                        b.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([s[:KEEP].astype(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "sig", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id long, n int, sig binary, sketch array<long>")


def packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """rep, z: the texts of the documents in ids (rep). While the counted ids
    are few they go to the texts by broadcast, else a Bloom filter of them does,
    and both are shuffled: only texts that pass it are packed and moved."""
    ids, rows = stored(ids.distinct(), "ids"), docs.select(F.col("doc_id").alias("rep"), "text")
    few = ids.count() <= BROADCAST_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(1)
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                yield pa.record_batch([b.column("rep"), pa.array([z.compress((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary())], ["rep", "z"])

    packed = lambda df: df.mapInArrow(run, "rep long, z binary")
    found = packed(rows.join(F.broadcast(ids), "rep", "left_semi")) if few else packed(passing(rows, F.xxhash64("rep"), bloom(ids.select(F.xxhash64("rep"))))).join(ids, "rep", "left_semi")
    return stored(found.select("rep", "z").distinct(), "texts")  # several for an id with several texts


def short_sketches(reps: DataFrame) -> DataFrame:
    """rep, n, load: 15 bits of the SHORT least values, in their order."""
    return reps.select("rep", "n", F.transform(F.slice("sketch", 1, SHORT), lambda x: x.bitwiseAND(F.lit(0x7FFF).cast("long")).cast("short")).alias("load"))


def union_shared(s: str, t: str) -> tuple[Column, Column]:
    """Of two short sketches: the number of values shared, and of those among
    the SHORT least of the union; both with values that can't be told apart."""
    shared = F.array_intersect(s, t)
    hidden = F.size(s) - F.size(F.array_distinct(s)) + F.size(t) - F.size(F.array_distinct(t))
    places = F.array_sort(F.transform(shared, lambda x: F.array_position(s, x) + F.array_position(t, x)))
    return F.size(shared) + hidden, F.size(F.filter(places, lambda p, k: p - (k + 1) <= SHORT + hidden)) + hidden


def star_links(star: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (a, b, n_a, n_b) those that are similar, exactly."""
    turn = F.col("a") > F.col("b")
    swap = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    pairs = star.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    pairs = stored(pairs.select(swap("a", "b").alias("a"), swap("b", "a").alias("b"), swap("n_a", "n_b").alias("n_a"), swap("n_b", "n_a").alias("n_b")).distinct(), "star")
    short = short_sketches(reps)
    side = lambda x: short.select(F.col("rep").alias(x), F.col("load").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared, in_union = union_shared("s_a", "s_b")
    n = F.col("n_a") + F.col("n_b")
    # sets that fit their sketches whole are known exactly
    worth = F.when(F.greatest("n_a", "n_b") > SHORT, in_union >= least_shared(percent, SHORT)).otherwise(100 * shared >= percent * (n - shared))
    worth = stored(both.where(worth).select("a", "b").distinct(), "worth")
    t = packed_texts(docs, worth.select(F.col("a").alias("rep")).union(worth.select("b")))
    full = worth.join(t.select(F.col("rep").alias("a"), F.col("z").alias("z_a")), "a").join(t.select(F.col("rep").alias("b"), F.col("z").alias("z_b")), "b")
    return stored(full.select("a", "b", "z_a", "z_b").mapInArrow(_verify(shingle, percent), "a long, b long"), "links")


def estimate(s: np.ndarray, t: np.ndarray) -> tuple[int, int]:
    """How many of the KEEP least values of the union are in both, and how many
    there are."""
    c = np.sort(np.concatenate([s[:KEEP], t[:KEEP]]))
    first = np.append(True, c[1:] != c[:-1])
    union = c[first][:KEEP]
    return int(np.count_nonzero(c[1:][~first[1:]] <= union[-1])), len(union)


def _unpacked(raw: bytes, sets: dict[bytes, np.ndarray], shingle: int, most: int = 0) -> np.ndarray:
    """The set of a packed text; of the last `most` texts it is made once."""
    if raw not in sets:
        if most and len(sets) >= most:
            sets.pop(next(iter(sets)))
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
        (sets[raw],) = shingle_sets(find(data, np.array([0, len(data)]), BLANK, lower=True), shingle)
    return sets[raw]


def _verify(shingle: int, percent: int):  # noqa: ANN202
    need = least_shared(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, np.ndarray] = {}
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("z_a"), batch.column("z_b"), strict=True):
                s, t = _unpacked(x.as_py(), sets, shingle, 64), _unpacked(y.as_py(), sets, shingle, 64)
                shared, size = estimate(s, t)
                if size == KEEP and shared < need:
                    ok.append(False)
                    continue
                c = np.sort(np.concatenate([s, t]))
                both = int(np.count_nonzero(c[1:] == c[:-1]))
                ok.append(100 * both >= percent * (len(c) - both) and both > 0)
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _lists(reps: DataFrame, percent: int) -> DataFrame:
    """value, rep, n: inverted lists of each class's rarest sketch values,
    lists of one member left out."""
    need = least_shared(percent)
    values = reps.select("rep", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("value"))
    often = stored(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "values")
    # Sets whose partners all fit their sketches have the exact bound.
    exact = F.col("n") * 100 <= KEEP * percent
    least = F.when(exact, F.ceil(F.col("n") * percent / 100)).otherwise(F.least(F.lit(need), "m"))
    mine = values.join(often, "value").groupBy("rep", "n", "m").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"))
    rest = (F.col("m") - least + 1) - (F.col("m") - F.size("v"))  # values in one set only come first
    return stored(mine.where(rest > 0).select("rep", "n", (F.col("m") - F.size("v")).alias("own"), F.explode(F.slice("v", 1, rest.cast("int"))).alias("v")).select("v.value", "rep", "n", "own"), "lists")


def link_classes(docs: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b: links that join all similar classes into their components."""
    lists = _lists(reps, percent)
    heads = lists.groupBy("value").agg(F.count("*").alias("size"), F.min(F.struct("own", "rep", "n")).alias("hub")).where("size > 1")
    heads = stored(heads.select("value", "size", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "heads")
    lists = stored(lists.join(heads, "value"), "lists")
    star = lists.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"), F.col("hub_n").alias("n_a"), F.col("n").alias("n_b"))
    found = star_links(star, docs, reps, shingle, percent)
    label = components(found).select(F.col("node").alias("rep"), "component")
    # lists of two are done
    named = stored(lists.where("size > 2").join(label, "rep", "left").select("value", "rep", F.coalesce("component", "rep").alias("c")), "named")
    sizes = named.groupBy("value", "c").agg(F.count("*").alias("k"))
    major = stored(sizes.groupBy("value").agg(F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("value", F.col("top.c").alias("major")), "major")
    both = stored(named.join(major, "value").select("major", "rep", "c").distinct(), "open")
    near = stored(_blocks_of(both, short_sketches(reps), _sketch_blocks(percent), "major long, rep long, c long").distinct(), "near")
    loads = packed_texts(docs, near.select("rep")).select("rep", F.lit(0).alias("n"), F.col("z").alias("load"))
    return found.union(stored(_blocks_of(near, loads, _text_blocks(shingle, percent), "a long, b long"), "block-links"))


def _blocks_of(both: DataFrame, loads: DataFrame, compare, schema: str) -> DataFrame:  # noqa: ANN001
    """compare() on members of the same `major`: those outside its component, in
    blocks, against all, in blocks, each with its load. both: major, rep, c.
    Small groups share a task's group, so that their number costs little."""
    outside = F.col("c") != F.col("major")
    size = both.groupBy("major").agg(F.count_if(outside).alias("out"), F.count("*").alias("n"))
    blocks = stored(size.withColumn("a_blocks", F.ceil(F.col("out") / A_BLOCK).cast("int")).withColumn("b_blocks", F.ceil(F.col("n") / B_BLOCK).cast("int")).select("major", "a_blocks", "b_blocks"), "blocks")
    buckets = max(1, -(-both.count() // (2 * B_BLOCK)))
    salt = lambda name: F.pmod(F.xxhash64("rep"), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    small = (F.col("a_blocks") == 1) & (F.col("b_blocks") == 1)
    group = F.when(small, F.pmod(F.xxhash64("major"), F.lit(buckets))).otherwise(-1 - F.pmod(F.xxhash64("major"), F.lit(1 << 40)))
    # loads come last, so that they are dealt out once
    placed = stored(both.join(blocks, "major").withColumn("g", group), "placed")
    left = placed.where(outside).withColumn("ab", salt("a_blocks")).withColumn("bb", each("b_blocks")).select("g", "ab", "bb", "major", "rep", "c").join(loads, "rep")
    right = placed.withColumn("bb", salt("b_blocks")).withColumn("ab", each("a_blocks")).select("g", "ab", "bb", "major", "rep", "c").join(loads, "rep")
    right = right.select(F.col("g").alias("rg"), F.col("ab").alias("rab"), F.col("bb").alias("rbb"), *[F.col(c).alias(f"r_{c}") for c in ("major", "rep", "c", "n", "load")])
    return left.groupBy("g", "ab", "bb").cogroup(right.groupBy("rg", "rab", "rbb")).applyInArrow(compare, schema)


def _by_major(left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of either side that have the same major."""
    if left.num_rows and right.num_rows:
        a, b = left.column("major").to_numpy(), right.column("r_major").to_numpy()
        a_order, b_order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        for m in np.unique(a).tolist():
            yield a_order[slice(*np.searchsorted(a, [m, m + 1], sorter=a_order))], b_order[slice(*np.searchsorted(b, [m, m + 1], sorter=b_order))]


def _sketch_blocks(percent: int):  # noqa: ANN202
    """Members (major, rep, c) with a partner that sizes and short sketches
    allow. What these share in all is never less than what they share of the
    union; it comes as a matrix product. Values of a sketch that fall together
    count as shared."""
    need = least_shared(percent, SHORT)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a_c, a_n, b_c, b_n = (t.column(c).to_numpy() for t, c in ((left, "c"), (left, "n"), (right, "r_c"), (right, "r_n")))
        a_s, b_s = ([np.unique(np.array(x, np.int64)) for x in t.column(c).to_pylist()] for t, c in ((left, "load"), (right, "r_load")))
        a_h, b_h = (np.array(t.column(c).combine_chunks().value_lengths().to_numpy() if t.num_rows else [], np.int64) - [len(x) for x in v] for t, c, v in ((left, "load", a_s), (right, "r_load", b_s)))
        keep_a, keep_b = np.zeros(left.num_rows, bool), np.zeros(right.num_rows, bool)
        for i, j in _by_major(left, right):
            ok = (a_c[i][:, None] != b_c[j][None]) & possible(a_n[i], b_n[j], percent)
            if ok.any():
                ok &= likely(a_n[i], b_n[j], shared_counts([a_s[k] for k in i.tolist()], [b_s[k] for k in j.tolist()]), percent, need, SHORT, a_h[i][:, None] + b_h[j][None])
                keep_a[i[ok.any(1)]] = True
                keep_b[j[ok.any(0)]] = True
        a, b = left.filter(pa.array(keep_a)), right.filter(pa.array(keep_b))
        return pa.table({c: pa.chunked_array([*a.column(c).chunks, *b.column(f"r_{c}").chunks], pa.int64()) for c in ("major", "rep", "c")})

    return run


def _text_blocks(shingle: int, percent: int):  # noqa: ANN202
    """Links, thinned to a forest by major."""
    need = least_shared(percent)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets: dict[bytes, np.ndarray] = {}
        out = []
        a_set, b_set = ([_unpacked(raw.as_py(), sets, shingle) for raw in t.column(load)] for t, load in ((left, "load"), (right, "r_load")))
        a_rep, a_c, b_rep, b_c = (t.column(c).to_numpy() for t, c in ((left, "rep"), (left, "c"), (right, "r_rep"), (right, "r_c")))
        for i, j in _by_major(left, right):
            x, y = linked([a_set[k] for k in i.tolist()], [b_set[k] for k in j.tolist()], a_c[i][:, None] != b_c[j][None], percent, need)
            if len(x):
                ids, back = np.unique(np.concatenate([a_rep[i][x], b_rep[j][y]]), return_inverse=True)
                forest = Forest(len(ids))
                forest.join(back[: len(x)], back[len(x) :])
                out.append(np.stack([ids, ids[forest.label]])[:, forest.label != np.arange(len(ids))])
        got = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(got[0], pa.int64()), "b": pa.array(got[1], pa.int64())})

    return run


def possible(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    a, b = na[:, None].astype(np.int64), nb[None].astype(np.int64)
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def likely(na: np.ndarray, nb: np.ndarray, shared: np.ndarray, percent: int, need: int, keep: int = 0, hidden: np.ndarray | int = 0) -> np.ndarray:
    """Whether what two sketches of `keep` values share allows similarity of
    their sets; up to `hidden` shared values may not have been seen."""
    a, b, keep = na[:, None].astype(np.int64), nb[None].astype(np.int64), keep or KEEP
    return np.where(np.maximum(a, b) > keep, shared + hidden >= need, 100 * (shared + hidden) >= percent * (a + b - shared - hidden))


def shared_counts(sa: list[np.ndarray], sb: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of one side with all of the other, as
    products of incidence matrices over the values that both sides hold."""
    va, vb = (np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (sa, sb))
    vocabulary = np.intersect1d(va, vb)
    out = np.zeros((len(sa), len(sb)), np.float32)

    def places(v: np.ndarray, s: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(s)), [len(x) for x in s])
        at = np.minimum(np.searchsorted(vocabulary, v), max(0, len(vocabulary) - 1))
        ok = vocabulary[at] == v if len(vocabulary) else np.zeros(len(v), bool)
        return row[ok], at[ok]

    (ra, pa_), (rb, pb) = places(va, sa), places(vb, sb)
    for lo in range(0, len(vocabulary), COLUMNS):
        hi = min(len(vocabulary), lo + COLUMNS)
        m = np.zeros((len(sa) + len(sb), hi - lo), np.float32)
        for r, p, base in ((ra, pa_, 0), (rb, pb, len(sa))):
            mine = (p >= lo) & (p < hi)
            m[base + r[mine], p[mine] - lo] = 1
        out += m[: len(sa)] @ m[len(sa) :].T
    return out


def linked(sa: list[np.ndarray], sb: list[np.ndarray], wanted: np.ndarray, percent: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in sa, place in sb) among the wanted with similar sets:
    by size, by what their sketches share, then exactly."""
    na, nb = np.array([len(s) for s in sa]), np.array([len(s) for s in sb])
    ok = wanted & possible(na, nb, percent)
    if ok.any():
        ok &= likely(na, nb, shared_counts([s[:KEEP] for s in sa], [s[:KEEP] for s in sb]), percent, need)
    i, j = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
    if not len(i):
        return i, j
    both = shared_counts([sa[k] for k in i.tolist()], [sb[k] for k in j.tolist()])
    good = ok[np.ix_(i, j)] & (both > 0) & (100 * both >= percent * (na[i][:, None] + nb[j][None] - both))
    x, y = np.nonzero(good)
    return i[x], j[y]


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the least of its component)
    per row of docs."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    all_ = stored(sketches(rows, shingle), "sketches")
    classes = stored(all_.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    found = components(link_classes(rows, classes.select("rep", "n", "sketch"), shingle, percent))
    named = stored(classes.select("sig", "rep").join(found, F.col("rep") == F.col("node"), "left").select("sig", F.coalesce("component", "rep").alias("component")), "components")
    joined = all_.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("sig")).alias("sig")).join(named, "sig", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
