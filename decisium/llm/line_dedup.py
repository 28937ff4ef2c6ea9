"""Line dedup by pairwise alignment.

A line goes if it lies in a run of consecutive lines with `min_words` words in
all that an earlier document (one of a smaller doc_id) also holds. Empty lines
are left out of runs and stay.

Documents that hold the same lines in the same order are one class, whose least
doc_id stands for it; in its copies every line is a common block. Other pairs
come from shared runs: those which reach min_words and have no line to spare, at
their end or at their begin. They cover every block that can go, as a block of
common lines is a run of many holders too. A document is aligned with the first
holder (least doc_id) of each of its runs, so its pairs are at most its runs,
however many documents share them, and no holder is passed over: what a later
holder could take, the first one takes as well. A holder meets its later
documents in blocks of some HELD_TOGETHER, so a popular one isn't copied to each.

Aligning is patience diff over line hashes: common heads and tails, then lines
that are unique on both sides, in their longest increasing order, then the gaps
between them. What one alignment can't hold, as blocks crossed others or their
lines repeat, is aligned again by itself: stretches of runs that still stand,
until that finds nothing more, then runs whose lines repeat. Blocks with
min_words words go from the later document; nothing else does.

Words are parted by blanks; in scripts without blanks two characters of Chinese
or Japanese or four of Thai, Lao, Tibetan, Burmese or Khmer are a word.

Judged on the input: what is deleted from one document still counts as the
first occurrence for others. Null texts stay null, empty ones empty; a null
doc_id is neither deduplicated nor first; rows that repeat a doc_id are one
document if their texts are equal, and else none is earlier than the other.
Long texts are worked on line by line; an empty table gives no rows. An input
column with the name of an added one comes back as <name>_input."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import forget
from .common import prepare, slices, stored, text_buffer, unwrapped, with_row, wrapped
from .words import BLANK, find, mix

TEXT_BYTES = 500_000
#: Later documents of one holder that are aligned in one block, about.
HELD_TOGETHER = 32
_R = 0x9E3779B97F4A7C15
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words in each run of bytes without blanks: more than one in scripts that have none."""
    if not (data >= 0xE0).any():
        return np.ones(len(starts), np.int64)
    after = np.append(data[1:], np.uint8(0))
    is_in = lambda x, lo, hi: (x >= lo) & (x <= hi)
    half = is_in(data, 0xE3, 0xE9) & ~((data == 0xE3) & (after == 0x80)) | (data == 0xEF) & is_in(after, 0xA4, 0xAB) | (data == 0xF0) & is_in(after, 0xA0, 0xB3)
    quarter = (data == 0xE0) & (after >= 0xB8) | (data == 0xE1) & (is_in(after, 0x80, 0x82) | is_in(after, 0x9E, 0x9F))
    c = np.concatenate([[0], np.cumsum(2 * half + quarter, dtype=np.int64)])
    return np.maximum(1, (c[ends] - c[starts]) // 4)


def line_rows(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], list[bytes]]:
    """Hashes and word counts of the lines of each text that aren't empty, and
    a digest of the line hashes."""
    data, offsets = text_buffer(column)
    lines, words = find(data, offsets, _LINE), find(data, offsets, BLANK)
    before = np.concatenate([[0], np.cumsum(_units(data, words.starts, words.ends))])
    count = np.diff(before[np.searchsorted(words.starts, np.append(lines.starts, len(data)))]) if len(lines.starts) else np.zeros(0, np.int64)
    cuts = lines.first[1:-1]
    hashes = np.split(lines.hashes.astype(np.int64), cuts)
    return hashes, np.split(count.astype(np.int32), cuts), [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in hashes]


def lines(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                h, w, sig = line_rows(b.column("text"))
                yield pa.record_batch([b.column("doc_id"), pa.array(sig, pa.binary()), pa.array(h, pa.list_(pa.int64())), pa.array(w, pa.list_(pa.int32()))], ["doc_id", "sig", "h", "w"])

    return docs.mapInArrow(run, "doc_id long, sig binary, h array<long>, w array<int>")


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned blocks (place in a, place in b, length) in rising order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        at_a, at_b = _single(a, i, m), _single(b, j, n)
        both = sorted((k, at_b[x]) for x, k in at_a.items() if k >= 0 and at_b.get(x, -1) >= 0)
        chain = _rising(both)
        if not chain:
            continue
        out += chain
        ends = [(i - 1, j - 1), *chain, (m, n)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False) if p + 1 < r and q + 1 < s]
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(out):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def _single(x: list[int], lo: int, hi: int) -> dict[int, int]:
    """Place of each value, -1 for those that occur more than once."""
    at: dict[int, int] = {}
    for k in range(lo, hi):
        at[x[k]] = -1 if x[k] in at else k
    return at


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain in which both places rise; the first ones rise already."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        before.append(ends[p - 1] if p else -1)
        tops[p : p + 1] = [j]
        ends[p : p + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common_lines(first: list[int], later: list[int], words: list[int], spans: list[tuple[int, int]], min_words: int, places: dict[int, list[int]] | None = None) -> list[int]:
    """Places in `later` of the lines that go, as patience aligns them. spans:
    its runs, by rising begin; places: of each line in `first`, if known.

    The first alignment is that of the two whole documents. Runs that it leaves,
    all of whose lines `first` has, may stand elsewhere there: stretches of them
    are aligned anew, until that adds nothing. What is left then has lines that
    repeat, and each such run is aligned with the stretches of its length that
    begin with its first line."""
    gone = np.zeros(len(later), bool)
    weight = np.concatenate([[0], np.cumsum(words)])

    def aligned(s: int, e: int) -> bool:
        before = int(gone[s:e].sum())
        for _, j, n in patience(first, later[s:e]):
            if weight[s + j + n] - weight[s + j] >= min_words:
                gone[s + j : s + j + n] = True
        return int(gone[s:e].sum()) > before

    aligned(0, len(later))
    spans = [x for x in spans if not gone[x[0] : x[1]].all()]
    if spans and places is None:
        places = places_of(first)
    spans = [(s, e) for s, e in spans if all(x in places for x in later[s:e])]
    more = True
    while spans and more:
        more = False
        for s, e in _stretches(spans):
            more |= aligned(s, e)
        spans = [x for x in spans if not gone[x[0] : x[1]].all()]
    known: dict[tuple[int, ...], bool] = {}
    for s, e in spans:
        run = later[s:e]
        key = tuple(run)
        if key not in known:
            known[key] = any(first[i + e - s - 1 : i + e - s] == run[-1:] and patience(first[i : i + e - s], run) == [(0, 0, e - s)] for i in places[run[0]])
        if known[key]:
            gone[s:e] = True
    return np.flatnonzero(gone).tolist()


def places_of(x: list[int]) -> dict[int, list[int]]:
    at: dict[int, list[int]] = {}
    for k, v in enumerate(x):
        at.setdefault(v, []).append(k)
    return at


def _stretches(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _align(min_words: int):  # noqa: ANN202
    """Of each row, a holder's lines (h_a) and some of its later documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, first in enumerate(b.column("h_a")):
                first, docs = first.as_py(), b.column("docs")[i].values
                h, w = docs.field("h_b"), docs.field("w_b")
                at = np.concatenate([[0], np.cumsum(h.value_lengths().to_numpy())])
                flat, weight = h.flatten().to_numpy(), w.flatten().to_numpy()
                _, doc, s, e = runs(flat, weight, at, min_words)
                order = np.lexsort((s, doc))
                doc, s, e = doc[order], s[order] - at[doc[order]], e[order] - at[doc[order]]
                edge = np.searchsorted(doc, np.arange(len(docs) + 1)).tolist()
                spans = list(zip(s.tolist(), e.tolist(), strict=True))
                places = places_of(first)
                gone = [common_lines(first, flat[at[k] : at[k + 1]].tolist(), weight[at[k] : at[k + 1]].tolist(), spans[edge[k] : edge[k + 1]], min_words, places) for k in range(len(docs))]
                yield pa.record_batch([docs.field("rep"), docs.field("tag"), pa.array(gone, pa.list_(pa.int32()))], ["rep", "tag", "gone"])

    return run


def runs(h: np.ndarray, w: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, document, begin and end of the runs of consecutive lines that reach
    min_words, but not without their last line or not without their first."""
    n, c = len(h), np.concatenate([[0], np.cumsum(w, dtype=np.int64)])
    i, doc = np.arange(n), np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = np.maximum(np.searchsorted(c, c[:-1] + min_words), i + 1)
    begin = np.minimum(np.searchsorted(c, c[1:] - min_words, "right") - 1, i)
    ahead, back = end <= first[1:][doc], begin >= first[:-1][doc]
    both = np.unique(np.concatenate([i[ahead] * (n + 1) + end[ahead], begin[back] * (n + 1) + i[back] + 1]))
    s, e = both // (n + 1), both % (n + 1)
    up, down = (np.cumprod(np.where(np.arange(n + 1) > 0, np.uint64(r), np.uint64(1)), dtype=np.uint64) for r in (_R, pow(_R, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h.astype(np.uint64) * up[:-1], dtype=np.uint64)])
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)).astype(np.int64), doc[s], s, e


def _lists(b: pa.RecordBatch, lines: str, words: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines and their words of all rows, and where each row's begin."""
    h, w = b.column(lines), b.column(words)
    return h.flatten().to_numpy(), w.flatten().to_numpy(), np.concatenate([[0], np.cumsum(h.value_lengths().to_numpy())])


def _keys(min_words: int):  # noqa: ANN202
    """The keys of each row's runs, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key, doc, _, _ = runs(*_lists(b, "h", "w"), min_words)
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            once = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(key)]
            mine = pa.array(doc[once])
            yield pa.record_batch([pa.array(key[once]), b.column("rep").take(mine), b.column("tag").take(mine)], ["run", "rep", "tag"])

    return run


def removals(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, sig and gone (places among the lines that aren't empty; null:
    all of them) of each document that loses lines. docs: doc_id, text."""
    every = stored(lines(docs.where("doc_id is not null and text is not null")).where(F.size("h") > 0), "lines")
    total = F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x)
    # rows of one doc_id may hold different texts: tag tells their classes apart
    tag = F.hash("sig").alias("tag")
    classes = stored(every.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("h").alias("h"), F.first("w").alias("w")).select("*", tag), "line-classes")
    side = classes.select("rep", "tag", "h", "w")
    held = stored(side.mapInArrow(_keys(min_words), "run long, rep long, tag int"), "runs")
    heads = stored(held.groupBy("run").agg(F.min(F.struct("rep", "tag")).alias("owner"), F.count("*").alias("df")).where("df > 1").drop("df"), "run-heads")
    pairs = stored(held.join(heads, "run").where("owner.rep < rep").select("owner", "rep", "tag").distinct(), "line-pairs")
    # a holder goes to blocks of its later documents, not to each of them
    blocks = pairs.groupBy("owner").agg(F.ceil(F.count("*") / HELD_TOGETHER).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "owner").select("owner", F.pmod(F.hash("rep", "tag"), "blocks").alias("block"), "rep", "tag")
    docs_of = dealt.join(side.select("rep", "tag", F.col("h").alias("h_b"), F.col("w").alias("w_b")), ["rep", "tag"]).groupBy("owner", "block").agg(F.collect_list(F.struct("rep", "tag", "h_b", "w_b")).alias("docs"))
    holders = blocks.select("owner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(side.select(F.struct("rep", "tag").alias("owner"), F.col("h").alias("h_a")), "owner")
    full = docs_of.join(holders, ["owner", "block"])
    aligned = full.select("h_a", "docs").mapInArrow(_align(min_words), "rep long, tag int, gone array<int>").where(F.size("gone") > 0)
    gone = aligned.groupBy("rep", "tag").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    by_class = stored(classes.select("sig", "rep", "tag", (total >= min_words).alias("long")).join(gone, ["rep", "tag"], "left"), "line-classes")
    mine = every.select("doc_id", "sig").join(by_class, "sig").where(F.expr("(doc_id <> rep and long) or (doc_id = rep and gone is not null)"))
    return mine.select("doc_id", "sig", F.when(F.col("doc_id") == F.col("rep"), F.col("gone")).alias("gone")).dropDuplicates(["doc_id", "sig"])


def line_dedup(docs: DataFrame, min_words: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, the text without the lines that go (null where no
    line is left), n_lines and n_removed (lines that aren't empty)."""
    prepare(docs.sparkSession)
    base = wrapped(docs, id_col, text_col)
    cut = stored(removals(base.select("doc_id", "text"), min_words).groupBy(F.col("doc_id").alias("cut_id")).agg(F.collect_list(F.struct("sig", "gone")).alias("cut")), "removals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                h, _, sigs = line_rows(b.column("text"))
                texts, cuts = b.column("text").to_pylist(), b.column("cut").to_pylist()
                n, removed = [len(x) for x in h], [0] * len(h)
                for i, text in enumerate(texts):
                    for c in cuts[i] or []:
                        if c["sig"] != sigs[i]:
                            continue  # of another row with this doc_id
                        drop = set(range(n[i]) if c["gone"] is None else c["gone"])
                        removed[i], k, keep = len(drop), -1, []
                        for line in text.split("\n"):
                            k += line != ""
                            if line == "" or k not in drop:
                                keep.append(line)
                        texts[i] = "\n".join(keep) if len(drop) < n[i] else None
                yield pa.record_batch([b.column("row"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], ["row", "text", "n_lines", "n_removed"])

    joined = base.join(cut, base.doc_id == cut.cut_id, "left").select("text", "cut", "row")
    return unwrapped(joined.mapInArrow(run, with_row(base, "text string, n_lines long, n_removed long")), docs, text_col, ["n_lines", "n_removed"])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
