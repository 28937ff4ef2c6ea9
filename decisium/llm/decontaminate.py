"""Benchmark decontamination by winnowing.

Words are hashed, runs of GRAM words give k-gram hashes, and each window of
`span` words keeps its least k-gram hash as fingerprint. Equal windows have
equal fingerprints, so a document window whose fingerprint no benchmark window
has is clean: every shared run of `span` words is found. A hit is then extended:
each of its windows is compared, word by word, with the benchmark's, and words
inside an equal window are marked.

While the benchmark's counted bytes stay under INDEX_BYTES its index is
broadcast and documents pass it once. A larger benchmark stays distributed:
fingerprints of texts that pass a Bloom filter of the benchmark's (at most 16
MB) are joined with them, then the windows of texts with a common fingerprint
with the benchmark's, word by word. A window stands for its set of items by
number, and documents with the same numbers share one list of items. Texts are
known by their sha-256 there. So documents are read a fixed number of times, nothing unbounded
is broadcast, and skewed fingerprints are split by adaptive execution.

Nulls and edges: null texts have no words; an item of fewer than `span` words,
but not none, is one window; repeated rows and items are judged each, an item
id being listed once; a null item_id is listed as 'null'; a null doc_id is
judged like others. Long texts count whole. An input column with the name of an
added one comes back as <name>_input. Empty tables give no hits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import forget
from .common import bloom, maybe_in, passing, prepare, quoted, slices, stored, text_buffer, unwrapped, with_row, wrapped
from .words import ALNUM, Words, find, grams

GRAM, INDEX_BYTES, TEXT_BYTES = 5, 8 << 20, 500_000
STATE = "n_words int, marks array<int>, items array<string>"


def window_minimum(h: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Least gram hash of each window of `span` words."""
    g = grams(h, gram)
    n = len(g) - (span - gram)
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = g[:n].copy()
    for j in range(1, span - gram + 1):
        np.minimum(out, g[j : j + n], out=out)
    return out


class Index:
    """Fingerprints and windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], span: int, gram: int = GRAM):
        self.span, self.gram = span, min(gram, span)
        self.windows: dict[bytes, list[int]] = {}
        self.names: list[str] = []
        self.short: dict[int, set[int]] = {}
        prints: list[np.ndarray] = []
        for name, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            w = find(data, np.array([0, len(data)]), ALNUM, lower=True)
            n = len(w.starts)
            if not n:
                continue
            k = len(self.names)
            self.names.append(name)
            word = [w.text(i) for i in range(n)]
            m = min(span, n)
            for i in range(n - m + 1):
                owners = self.windows.setdefault(b" ".join(word[i : i + m]), [])
                if not owners or owners[-1] != k:
                    owners.append(k)
            if n < span:
                self.short.setdefault(n, set()).update(grams(w.hashes, n).tolist())
            else:
                prints.append(window_minimum(w.hashes, span, self.gram))
        # windows with the same items share one list
        sets: dict[tuple[int, ...], int] = {}
        self.groups: list[tuple[int, ...]] = []
        for key, owners in self.windows.items():
            t = tuple(owners)
            if t not in sets:
                sets[t] = len(self.groups)
                self.groups.append(t)
            self.windows[key] = sets[t]  # type: ignore[assignment]
        self.filters = {0: _Filter(np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64))}
        self.filters |= {m: _Filter(np.array(sorted(x), np.uint64)) for m, x in self.short.items()}

    def candidates(self, w: Words) -> Iterator[tuple[int, np.ndarray]]:
        """Window lengths with the starts of possible windows of that length."""
        if len(self.filters[0].values):
            yield self.span, self.filters[0].hits(window_minimum(w.hashes, self.span, self.gram))
        for m in self.short:
            yield m, self.filters[m].hits(grams(w.hashes, m))


class _Filter:
    """Sorted values behind a table of their lower bits."""

    def __init__(self, values: np.ndarray):
        self.values = values
        bits = min(22, max(10, int(np.ceil(np.log2(len(values) + 1))) + 5))
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(values & self.mask).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[(h & self.mask).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0]
        k = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        return at[self.values[k] == h[at]]


def scan(index: Index, column: pa.Array) -> tuple[np.ndarray, list[tuple[list[int], list[str]]]]:
    """Word counts, and for each text its marked runs [from, to, ...] of words
    and the names of the items whose windows occur in it."""
    w = find(*text_buffer(column), ALNUM, lower=True)
    n = len(column)
    runs: list[dict[int, int]] = [{} for _ in range(n)]
    seen: list[set[int]] = [set() for _ in range(n)]
    for m, at in index.candidates(w):
        doc = np.searchsorted(w.first, at, "right") - 1
        inside = at + m <= w.first[doc + 1]
        for i, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
            group = index.windows.get(b" ".join([w.text(j) for j in range(i, i + m)]))
            if group is not None:
                a = i - int(w.first[d])
                runs[d][a] = max(runs[d].get(a, 0), a + m)
                seen[d].add(group)  # type: ignore[arg-type]
    return np.diff(w.first), [(_runs(runs[d].items()), sorted({index.names[k] for g in seen[d] for k in index.groups[g]})) for d in range(n)]


def _runs(spans: Iterable[tuple[int, int]]) -> list[int]:
    """Overlapping and touching spans joined, from and to in turn."""
    marks: list[int] = []
    for a, b in sorted(spans):
        if marks and a <= marks[-1]:
            marks[-1] = max(marks[-1], b)
        else:
            marks += [a, b]
    return marks


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """All columns of docs with n_words, marks (runs of words, from and to in
    turn) and items (ids of the items with windows in the text)."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.coalesce(quoted(item_col).cast("string"), F.lit("null")).alias("item"), quoted(text_col if text_col in benchmark.columns else "text").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + F.lit(64))).collect()[0][0] or 0
    base = wrapped(docs, id_col, text_col)
    if total <= INDEX_BYTES:
        shared = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])
        out = base.select("row", "text").mapInArrow(_pass(shared, span), with_row(base, f"text string, {STATE}"))
    else:
        out = _by_join(base, stored(items, "benchmark"), span)
    return unwrapped(out, docs, text_col, ["n_words", "marks", "items"])


def _pass(shared, span: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        index = Index(shared.value, span)
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                n_words, found = scan(index, b.column("text"))
                yield pa.record_batch(
                    [b.column("row"), b.column("text"), pa.array(n_words.astype(np.int32)), pa.array([m for m, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.string()))],
                    ["row", "text", "n_words", "marks", "items"],
                )

    return run


def _prints(w: Words, m: int, span: int) -> np.ndarray:
    """Fingerprint of each window of m words, over text borders."""
    return (window_minimum(w.hashes, span, min(GRAM, span)) if m == span else grams(w.hashes, m)).astype(np.int64)


def _windows(span: int):  # noqa: ANN202
    """item, m (words), print and window of each window of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                w = find(data, np.array([0, len(data)]), ALNUM, lower=True)
                n = len(w.starts)
                if n:
                    m = min(span, n)
                    word = [w.text(i) for i in range(n)]
                    k = n - m + 1
                    yield pa.record_batch([pa.array([item] * k, pa.string()), pa.array([m] * k, pa.int32()), pa.array(_prints(w, m, span)), pa.array([b" ".join(word[i : i + m]) for i in range(k)], pa.binary())], ["item", "m", "print", "window"])

    return run


def _text_prints(span: int, sizes: list[int], known: Broadcast[np.ndarray]):  # noqa: ANN202
    """key, m and print of the texts' windows that pass the Bloom filter of the
    benchmark's prints, equal neighbours once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                w = find(*text_buffer(b.column("text")), ALNUM, lower=True)
                for m in sizes:
                    h = _prints(w, m, span)
                    doc = np.searchsorted(w.first, np.arange(len(h)), "right") - 1
                    ok = np.arange(len(h)) + m <= w.first[doc + 1] if len(h) else np.zeros(0, bool)
                    ok[1:] &= (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                    at = np.flatnonzero(ok)
                    at = at[maybe_in(known.value, h[at])]
                    yield pa.record_batch([b.column("key").take(pa.array(doc[at])), pa.array(np.full(len(at), m, np.int32)), pa.array(h[at])], ["key", "m", "print"])

    return run


def _text_windows(span: int):  # noqa: ANN202
    """key, m, start and window of a text's windows with one of its common prints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, common in zip(batch.column("key"), batch.column("text").to_pylist(), batch.column("common").to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                w = find(data, np.array([0, len(data)]), ALNUM, lower=True)
                for m in sorted({c["m"] for c in common}):
                    at = np.flatnonzero(np.isin(_prints(w, m, span), np.array([c["print"] for c in common if c["m"] == m], np.int64)))
                    found = [b" ".join([w.text(j) for j in range(i, i + m)]) for i in at.tolist()]
                    yield pa.record_batch([pa.array([key.as_py()] * len(at), pa.binary()), pa.array(np.full(len(at), m, np.int32)), pa.array(at.astype(np.int32)), pa.array(found, pa.binary())], ["key", "m", "start", "window"])

    return run


def _merged(base: DataFrame):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                n_words = np.diff(find(*text_buffer(b.column("text")), ALNUM, lower=True).first)
                marks = [_runs([(s["start"], s["start"] + s["m"]) for s in x or []]) for x in b.column("spans").to_pylist()]
                yield pa.record_batch([b.column("row"), b.column("text"), pa.array(n_words.astype(np.int32)), pa.array(marks, pa.list_(pa.int32())), b.column("items")], ["row", "text", "n_words", "marks", "items"])

    return run, with_row(base, f"text string, {STATE}")


def _by_join(base: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """Prints that pass a Bloom filter are joined, then windows. A window goes on
    with the number of its set of items, and documents with the same numbers
    share one list, so that a passage common to many documents and items makes a
    row a document and window, not one for each item."""
    key = F.unhex(F.sha2("text", 256)).alias("key")
    windows = items.mapInArrow(_windows(span), "item string, m int, print long, window binary").distinct()
    sets = windows.groupBy("m", "print", "window").agg(F.array_sort(F.collect_list("item")).alias("items"))
    sets = stored(sets.withColumn("group", F.sha2(F.to_json("items"), 256)), "benchmark-windows")
    sizes = sorted(r["m"] for r in sets.select("m").distinct().collect())  # at most `span` rows
    texts = base.where("text is not null").select(key, "text")
    prints = texts.mapInArrow(_text_prints(span, sizes, bloom(sets.select("print").distinct())), "key binary, m int, print long").distinct()
    common = prints.join(sets.select("m", "print").distinct(), ["m", "print"], "left_semi")
    common = stored(common.groupBy("key").agg(F.collect_list(F.struct("m", "print")).alias("common")), "common-prints")
    near = passing(texts, F.xxhash64("key"), bloom(common.select(F.xxhash64("key")))).join(common, "key").dropDuplicates(["key"]).mapInArrow(_text_windows(span), "key binary, m int, start int, window binary")
    hits = stored(near.join(sets.select("m", "window", "group"), ["m", "window"]).select("key", "start", "m", "group"), "hits")
    mine = hits.groupBy("key").agg(F.collect_set(F.struct("start", "m")).alias("spans"), F.array_sort(F.collect_set("group")).alias("groups"))
    mine = stored(mine.withColumn("combo", F.sha2(F.concat_ws(",", "groups"), 256)), "found")
    combos = mine.select("combo", "groups").dropDuplicates(["combo"]).select("combo", F.explode("groups").alias("group"))
    named = combos.join(sets.select("group", "items").dropDuplicates(["group"]), "group").select("combo", F.explode("items").alias("item"))
    names = stored(named.distinct().groupBy("combo").agg(F.array_sort(F.collect_list("item")).alias("items")), "names")
    found = mine.select("key", "spans", "combo").join(names, "combo").drop("combo")
    # only texts that may be hit are moved
    keyed, h, known = base.withColumn("key", key), F.coalesce(F.xxhash64("key"), F.lit(0)), bloom(mine.select(F.xxhash64("key")))
    hit = passing(keyed, h, known).join(found, "key", "left").select("row", "text", "spans", "items")
    rest = passing(keyed, h, known, inside=False).select("row", "text", F.lit(None).cast(found.schema["spans"].dataType).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    every = hit.unionByName(rest).withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))
    return every.mapInArrow(*_merged(base))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.expr("cast(aggregate(sequence(1, size(marks), 2), 0, (s, i) -> s + element_at(marks, i + 1) - element_at(marks, i)) as long)")
    n_hit = F.when(F.size("marks") > 0, hit).otherwise(F.lit(0).cast("long"))
    return got.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("marks") > 0).alias("contaminated"),
    )
