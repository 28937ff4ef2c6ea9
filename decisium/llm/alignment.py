"""Alignment of two tokenizers' tokens by their bytes, and counts of linked ids.

A text with a space before it is cut by a byte-level BPE (A) and by a piece
model (B). A token of A and one of B that share a byte are an edge of a
bipartite graph; union-find over the edges gives its connected components, the
minimal groups of tokens that cover the same bytes. All A-B pairs of a group
are its links. How many documents hold an id pair linked is counted over the
whole corpus: every task counts the distinct pairs of its documents, Spark adds
them up by pair.

A first pass tokenises, writes each document's figures and its distinct pairs
as packed integers; later passes read only these. Counts of frequent pairs, at
most BROADCAST_PAIRS of them, go to all tasks; occurrences of the others are
joined with the rest of the counts by pair. The highest count of each A id is
broadcast too, a number per vocabulary entry.

Nulls and edges: a text that is null, empty or not reproduced by the tokens of
A or B (one that holds U+2581, say) has no tokens, zeros and an empty
groups_sha256. Strings of special tokens are plain text. Repeated rows count as
documents of their own, a null doc_id too; an empty table gives no rows; other
columns of docs aren't read, whatever their names. Texts of any length are
taken whole; a group's links are expanded in blocks, and a group of more than
BLOCK links by its distinct ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _LETTERS, SLOTS, WIDTH, Encoder, _ready, _steps, encoder
from .common import prepare, slices, stored, task_id, text_buffer

#: Most pairs whose counts are broadcast; links expanded at once; bytes of text
#: aligned at once; distinct pairs that a task holds before it sends its counts.
BROADCAST_PAIRS, BLOCK, TEXT_BYTES, HELD = 1 << 21, 1 << 22, 1 << 20, 1 << 22

FIGURES = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
ALIGNED = f"{FIGURES}, pairs binary, times binary"


class PieceEncoder(Encoder):
    """Ids of a piece model with byte fallback. No piece has a space after
    another character, so that texts can be cut before each run of spaces."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.processor.get_piece_size()
        self.kind = np.uint16 if self.size <= 65536 else np.uint32
        self.slots = np.zeros((SLOTS // 2, 3 + WIDTH * np.dtype(self.kind).itemsize // 8), np.uint64)
        pieces = [self.processor.id_to_piece(i) for i in range(self.size)]
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.blank = [self.processor.piece_to_id("▁")]

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.zeros(len(data) + 1, bool)
        if self.cuttable:
            cut[1:-1] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        cut[offsets] = True
        starts = np.flatnonzero(cut[:-1])
        return starts, np.zeros(len(starts), bool)

    def fresh(self, raw: bytes, starts: list[int], ends: list[int], odd: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        which: dict[bytes, int] = {}
        back = np.array([which.setdefault(raw[a:b], len(which)) for a, b in zip(starts, ends, strict=True)], np.int64)
        # the model puts the first space back, but not before nothing
        ids = [x or self.blank for x in self.processor.encode([p[1:].decode() for p in which], num_threads=1)]
        return np.array([x for i in ids for x in i], np.uint32), np.array([len(i) for i in ids], np.int64), back

    def entries(self) -> list[bytes]:
        p = self.processor
        return [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size)]


def _byte_entries(e: Encoder) -> list[bytes]:
    """Bytes of each entry of a byte-level vocabulary."""
    byte = {c: b for b, c in _LETTERS.items()}
    out = [b""] * e.size
    for entry, i in e.tokenizer.get_vocab(with_added_tokens=True).items():
        shown = [byte.get(ord(c)) for c in entry]
        out[i] = entry.encode() if None in shown else bytes(shown)
    return out


class Vocabulary:
    """Bytes of all entries in one buffer."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.bytes[np.repeat(self.begin[ids], n) + _steps(n)]


def tokenizers(path_a: str, path_b: str) -> tuple[Encoder, Vocabulary, PieceEncoder, Vocabulary]:
    """The worker's two encoders and their entries' bytes."""
    key = f"aligned {path_a} {path_b}"
    if key not in _ready:
        a, b = encoder(path_a, plain=True), PieceEncoder(path_b)
        _ready[key] = a, Vocabulary(_byte_entries(a)), b, Vocabulary(b.entries())
    return _ready[key]


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component over edges a-b: roots are
    hooked to smaller roots and paths compressed until all edges agree."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of each token, in the order of the text; both kinds
    of tokens cover the same bytes."""
    at = np.union1d(ends_a, ends_b)
    in_a, in_b = np.searchsorted(ends_a, at), np.searchsorted(ends_b, at)
    root = union_find(len(ends_a) + len(ends_b), in_a, len(ends_a) + in_b)
    first = root[: len(ends_a)] == np.arange(len(ends_a))
    number = np.cumsum(first) - 1
    return number[root[: len(ends_a)]], number[root[len(ends_a) :]]


def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of all ids below `most`, left-aligned with a place to spare, and their number."""
    n = np.arange(most)
    width = np.char.str_len(n.astype(str)).astype(np.int64)
    digits = np.zeros((most, int(width.max()) + 1), np.uint8)
    for k in range(int(width.max())):
        has = width > k
        digits[has, k] = 0x30 + n[has] // 10 ** (width[has] - 1 - k) % 10
    return digits, width


def rendered(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_groups: int, decimals: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of all groups, and where each group's part ends."""
    upto_a, upto_b = np.searchsorted(group_a, np.arange(n_groups + 1)), np.searchsorted(group_b, np.arange(n_groups + 1))
    ids, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    ids[np.arange(len(ids_a)) + upto_b[group_a]] = ids_a
    ids[np.arange(len(ids_b)) + upto_a[group_b + 1]] = ids_b
    mark[upto_a[1:] + upto_b[:-1] - 1], mark[upto_a[1:] + upto_b[1:] - 1] = ord("|"), ord(";")
    digits, width = decimals[0][ids], decimals[1][ids]
    digits[np.arange(len(ids)), width] = mark
    ends = np.cumsum(width + 1)
    return digits[np.arange(digits.shape[1]) <= width[:, None]], ends[upto_a[1:] + upto_b[1:] - 1]


def linked(doc: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, ids packed as a << 16 | b, and occurrences of each document's
    distinct linked pairs in order; links of each group. doc: of each group."""
    n = len(doc)
    begin_a, begin_b = np.searchsorted(group_a, np.arange(n + 1)), np.searchsorted(group_b, np.arange(n + 1))
    n_a, n_b = np.diff(begin_a), np.diff(begin_b)
    size = n_a * n_b
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    i, upto = 0, np.cumsum(size)
    while i < n:
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + BLOCK, "right")))
        if size[i] > BLOCK:
            a, ca = np.unique(ids_a[begin_a[i] : begin_a[i + 1]], return_counts=True)
            b, cb = np.unique(ids_b[begin_b[i] : begin_b[i + 1]], return_counts=True)
            j, key, times = i + 1, (int(doc[i]) << 32) + ((a << 16)[:, None] | b).ravel(), np.outer(ca, cb).ravel()
        else:
            at = np.repeat(np.arange(i, j), size[i:j])
            step = _steps(size[i:j])
            key, times = np.unique((doc[at] << 32) | (ids_a[begin_a[at] + step // n_b[at]] << 16) | ids_b[begin_b[at] + step % n_b[at]], return_counts=True)
        parts.append((key, times))
        i = j
    if len(parts) == 1:
        key, times = parts[0]
    else:
        key, times = added([k for k, _ in parts], [t for _, t in parts])
    return key >> 32, key & 0xFFFFFFFF, times, size


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ALIGNED of each document: its figures and distinct linked pairs."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, vocab_a, b, vocab_b = tokenizers(path_a, path_b)
        if a.size > 65536 or b.size > 65536:
            raise ValueError("vocabularies of more than 65536 entries can't be packed")
        decimals = _decimals(max(a.size, b.size))
        row = task_id() << 40
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                out = align(part.column("text"), a, vocab_a, b, vocab_b, decimals)
                yield pa.record_batch([pa.array(np.arange(row, row + part.num_rows)), part.column("doc_id"), *out], ALIGNED_NAMES)
                row += part.num_rows

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ALIGNED)


ALIGNED_NAMES = [x.split()[0] for x in ALIGNED.split(", ")]


def align(texts: pa.Array, a: Encoder, vocab_a: Vocabulary, b: PieceEncoder, vocab_b: Vocabulary, decimals: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
    texts = texts.fill_null("")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    data, offsets = text_buffer(texts)
    ids, tokens = [], []
    good = np.diff(offsets) > 0
    for e, v in ((a, vocab_a), (b, vocab_b)):
        i, o = e.batch(texts)
        n = np.concatenate([[0], np.cumsum(v.size[i])])[o]
        good &= np.diff(n) == np.diff(offsets)
        ids.append(i.astype(np.int64))
        tokens.append(o)
    # bytes of texts whose lengths agree
    for _ in range(2):
        kept = [i[np.repeat(good, np.diff(o))] for i, o in zip(ids, tokens, strict=True)]
        own = np.repeat(good, np.diff(offsets))
        differs = np.zeros(len(data), bool)
        for i, v in zip(kept, (vocab_a, vocab_b), strict=True):
            differs[own] |= v.joined(i) != data[own]
        if not differs.any():
            break
        good[np.searchsorted(offsets, np.flatnonzero(differs), "right") - 1] = False
    ids_a, ids_b = kept
    count = [np.where(good, np.diff(o), 0) for o in tokens]
    n_docs = len(texts)
    group_a, group_b = groups_of(np.cumsum(vocab_a.size[ids_a]), np.cumsum(vocab_b.size[ids_b]))
    doc_a = np.repeat(np.arange(n_docs), count[0])
    n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
    doc = doc_a[np.searchsorted(group_a, np.arange(n_groups))]
    sums, n_links = [""] * n_docs, np.zeros(n_docs, np.int64)
    pair_doc, pair, times = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    groups = np.bincount(doc, minlength=n_docs)
    if n_groups:
        text, ends = rendered(ids_a, ids_b, group_a, group_b, n_groups, decimals)
        pair_doc, pair, times, size = linked(doc, ids_a, ids_b, group_a, group_b)
        np.add.at(n_links, doc, size)
        last = np.cumsum(groups)
        begin = 0
        for d in np.flatnonzero(groups).tolist():
            end = int(ends[last[d] - 1])
            sums[d] = hashlib.sha256(text[begin : end - 1].tobytes()).hexdigest()
            begin = end
    upto = np.searchsorted(pair_doc, np.arange(n_docs + 1)).tolist()
    pairs, many = pair.astype("<u4"), times.astype("<u8")
    return [
        pa.array(count[0]),
        pa.array(count[1]),
        pa.array(groups),
        pa.array(n_links),
        pa.array(sums, pa.string()),
        pa.array([pairs[x:y].tobytes() for x, y in zip(upto, upto[1:], strict=False)], pa.binary()),
        pa.array([packed(many[x:y]) for x, y in zip(upto, upto[1:], strict=False)], pa.binary()),
    ]


def packed(n: np.ndarray) -> bytes:
    """Numbers in the fewest bytes each that hold the largest, after that width."""
    if not len(n):
        return b""
    width = next(w for w in (1, 2, 4, 8) if int(n.max()) < 1 << 8 * w)
    return bytes([width]) + n.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64) if raw else np.zeros(0, np.int64)


def _all_pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of all rows of a batch, and which row each is of."""
    raw = [x or b"" for x in batch.column("pairs").to_pylist()]
    return np.frombuffer(b"".join(raw), "<u4").astype(np.int64), np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, n: in how many documents each id pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count = added([], [])
        for batch in batches:
            own, times = np.unique(_all_pairs(batch)[0], return_counts=True)
            key, count = added([key, own], [count, times])
            if len(key) > HELD:
                yield pa.record_batch([pa.array(key), pa.array(count)], ["pair", "n"])
                key, count = added([], [])
        yield pa.record_batch([pa.array(key), pa.array(count)], ["pair", "n"])

    return table.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def cross_alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    table = stored(aligned(docs, path_a, path_b, id_col, text_col), "aligned")
    return with_counts(table, stored(pair_counts(table), "pairs"))


def with_counts(table: DataFrame, counts: DataFrame) -> DataFrame:
    """Figures of aligned documents with those that need the corpus's counts."""
    spark = table.sparkSession
    # a row per power of two, then a number per entry of the vocabulary, then at most BROADCAST_PAIRS rows
    levels = {r["k"]: r["n"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}
    least, many = 64, 0
    while least and many + levels.get(least - 1, 0) <= BROADCAST_PAIRS:
        least -= 1
        many += levels.get(least, 0)
    tops = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(1 << 16, np.int64)
    best[tops["a"].to_numpy()] = tops["n"].to_numpy()
    frequent = F.floor(F.log2("n")) >= least
    top = counts.where(frequent).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast((top["pair"].to_numpy().astype(np.uint32), top["n"].to_numpy(), best))

    def known(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of pairs, and which of them are among the frequent."""
        key, n, _ = shared.value
        if not len(key):
            return np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
        at = np.minimum(np.searchsorted(key, pair.astype(np.uint32)), len(key) - 1)
        hit = key[at] == pair
        return np.where(hit, n[at], 0), hit

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, doc = _all_pairs(batch)
            times = np.concatenate([np.zeros(0, np.int64), *(unpacked(x or b"") for x in batch.column("times").to_pylist())])
            n, hit = known(pair)
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n_best, doc, np.where(hit & (n == shared.value[2][pair >> 16]), times, 0))
            np.add.at(total, doc, times * n)
            yield pa.record_batch([*(batch.column(c) for c in ALIGNED_NAMES[:7]), pa.array(n_best), pa.array(total)], [*ALIGNED_NAMES[:7], "n_best", "count_sum"])

    out = table.mapInArrow(figures, f"{FIGURES}, n_best long, count_sum long")
    if least:

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pair, doc = _all_pairs(batch)
                times = np.concatenate([np.zeros(0, np.int64), *(unpacked(x or b"") for x in batch.column("times").to_pylist())])
                rare = np.flatnonzero(~known(pair)[1])
                pair = pair[rare]
                yield pa.record_batch([batch.column("row").take(pa.array(doc[rare])), pa.array(pair), pa.array(times[rare]), pa.array(shared.value[2][pair >> 16])], ["row", "pair", "times", "best"])

        rare = table.select("row", "pairs", "times").mapInArrow(others, "row long, pair long, times long, best long").join(counts.where(~frequent), "pair")
        rest = rare.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times"))).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
        out = out.join(rest, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return cross_alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
