"""Best-fit packing: best-fit decreasing over the lengths of all pieces.

Best fit looks only at remaining capacities, so equal lengths can be placed
together: the plan is made on the driver from the counts of the lengths 1 to
max_tokens, which is all that reaches it, and equals placing piece by piece. A
segment tree over remaining capacities finds the tightest open bin in
logarithmic time. Pieces of one length take the plan's places in the order of
their rank, which tasks count for themselves and a window over (task, length)
counts makes global.

Nulls and repeats: a null text counts as empty, so its sequence part is the end
id alone; repeated rows are packed each; an empty table gives no rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import prepare, slices, stored, task_id
from .token_store import TEXT_BYTES


class Capacities:
    """Segment tree over 0..size that tells the least capacity that is open."""

    def __init__(self, size: int):
        self.leaf = 1
        while self.leaf <= size:
            self.leaf *= 2
        self.open = [False] * (2 * self.leaf)

    def set(self, c: int, is_open: bool) -> None:
        i = c + self.leaf
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, need: int) -> int:
        """The least open capacity of at least `need`, or -1."""
        i = need + self.leaf
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaf:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaf
            i //= 2
        return -1


def plan(counts: dict[int, int], size: int) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """For each length its runs (first rank, pieces in a bin, first bin, bins,
    offset): piece `rank` goes to bin first + (rank - first rank) // in a bin,
    at offset + length * remainder. The number of runs depends on `size` alone."""
    tree = Capacities(size)
    bins: dict[int, list[list[int]]] = {}
    made = 0
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}

    def put(c: int, first: int, n: int) -> None:
        runs = bins.setdefault(c, [])
        if runs and runs[-1][0] + runs[-1][1] == first:
            runs[-1][1] += n
        else:
            runs.append([first, n])
        tree.set(c, True)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left, rank, runs = counts[length], 0, []
        while left:
            c = tree.tightest(length)
            if c < 0:
                each = size // length
                first, have, c, fresh = made, -(-left // each), size, True
            else:
                each = c // length
                first, have, fresh = *bins[c][0], False
            full = min(have, left // each)
            n, q = (full, each) if full else (1, left)
            runs.append((rank, q, first, n, size - c))
            rank, left = rank + n * q, left - n * q
            if fresh:
                made += n
            else:
                bins[c][0] = [first + n, have - n]
                if have == n:
                    bins[c].pop(0)
                    if not bins[c]:
                        tree.set(c, False)
            if c - q * length:
                put(c - q * length, first, n)
        out[length] = runs
    return out


PIECES = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, rank long"


def pieces(docs: DataFrame, tokenizer: str, size: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """Token pieces of at most `size`; of a longer document the first piece
    takes what is over. rank counts a task's pieces of the same length."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(tokenizer), task_id()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                ids, o = e.batch(b.column("text"), end)
                ids = ids.astype("<u4", copy=False)
                n = np.diff(o)
                k = -(-n // size)
                doc = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                head = (n - 1) % size + 1
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * size)
                length = np.where(piece == 0, head[doc], size)
                at = o[:-1][doc] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                sizes, first, count = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(first - seen[sizes], count)
                seen[sizes] += count
                yield pa.record_batch(
                    [pa.array(np.full(len(doc), part, np.int32)), b.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64()), pa.array(rank)],
                    ["part", "doc_id", "piece", "start", "length", "ids_crc32", "rank"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, size, end, id_col, text_col), "pieces")
    counts = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = {length: np.array(x, np.int64).T for length, x in plan(totals, size).items()}
    shared = spark.sparkContext.broadcast(runs)  # bounded by size, whatever the input

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, length = b.column("rank").to_numpy(), b.column("length").to_numpy()
            seq, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                first, each, begin, _, at = shared.value[int(x)]
                k = np.searchsorted(first, rank[mine], "right") - 1
                over = rank[mine] - first[k]
                seq[mine] = begin[k] + over // each[k]
                offset[mine] = at[k] + over % each[k] * x
            yield pa.record_batch(
                [*(b.column(c) for c in ("doc_id", "piece", "start")), b.column("length").cast(pa.int64()), b.column("ids_crc32"), pa.array(seq), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cut.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
