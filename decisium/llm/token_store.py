"""Token-id output: a static range asymmetric numeral system (rANS).

File format (a folder): `table` holds the frequency table that all blocks
share, token and frequency, the sum being 2**SCALE; `blocks` holds Parquet
parts in ascending document order, one row per block: part, first token in the
part, number of tokens, the index of its documents, the payload and checksums.

A block is coded on its own. Its tokens are dealt over `lanes` interleaved
states; every state is at least 2**31 and below 2**63 and gives 32-bit words.
The payload has a header, the checkpoints (the states and the place among the
words before every STEPS-th step) and the words, so a reader can begin at any
checkpoint, and other readers at others: read_range deals the stretches between
checkpoints to tasks. Both the payload and the decoded ids have a crc32.

Nulls and repeats: a null text counts as empty, a null doc_id sorts first,
repeated doc_ids keep a row each. A long text is cut over several blocks. Other
columns of the input aren't read. An empty table gives no blocks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .bpe import encoder, forget
from .common import new_path, prepare, slices, stored, task_id

SCALE, LOW = 20, np.uint64(1 << 31)
LANES, BLOCK, STEPS = 4096, 1 << 20, 128
MAGIC = b"rNS1"
_S, _32, _MASK = np.uint64(SCALE), np.uint64(32), np.uint64((1 << SCALE) - 1)
TEXT_BYTES = 200_000

BLOCKS = (
    "part int, first long, n_tokens long, payload binary, payload_crc32 long, ids_crc32 long,"
    "docs array<struct<doc_id:long,start:long,piece:int,pieces:int,length:long>>"
)


@dataclass
class Table:
    """Frequencies scaled to 2**SCALE, at least 1 for each token that occurs."""

    freq: np.ndarray

    def __post_init__(self) -> None:
        self.freq = self.freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)]).astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    @staticmethod
    def of(counts: np.ndarray) -> "Table":
        counts = counts.astype(np.float64)
        seen = counts > 0
        if not seen.any():
            return Table(np.zeros(len(counts), np.uint64))
        room = (1 << SCALE) - int(seen.sum())
        share = counts / counts.sum() * room
        freq = np.floor(share).astype(np.int64) + seen
        left = (1 << SCALE) - int(freq.sum())
        order = np.lexsort((np.arange(len(counts)), np.floor(share) - share))
        freq[order[:left]] += 1
        return Table(freq)


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = STEPS) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    f, c = table.freq[ids], table.cum[ids]
    most = ((LOW >> _S) << _32) * f
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    total = 0
    for t in range(steps - 1, -1, -1):
        lo, hi = t * lanes, min(n, (t + 1) * lanes)
        y, ft = x[: hi - lo], f[lo:hi]
        full = y >= most[lo:hi]
        if full.any():
            out = y[full]
            words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
            total += len(out)
            y[full] = out >> _32
        q = y // ft
        x[: hi - lo] = (q << _S) + (y - q * ft) + c[lo:hi]
        if t % every == 0:
            marks.append((total, x.copy()))
    head = struct.pack("<4sIIIII", MAGIC, n, lanes, every, len(marks), total)
    body = [struct.pack("<I", total - used) + s.astype("<u8").tobytes() for used, s in reversed(marks)]
    return head + b"".join(body) + b"".join(w.tobytes() for w in reversed(words))


def decode_block(payload: bytes, table: Table, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Tokens lo to hi of a block, begun at the last checkpoint before lo."""
    magic, n, lanes, every, marks, total = struct.unpack_from("<4sIIIII", payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    hi = n if hi is None else min(hi, n)
    if lo >= hi:
        return np.zeros(0, np.uint32)
    size = 4 + 8 * lanes
    mark = lo // lanes // every
    (at,) = struct.unpack_from("<I", payload, 24 + mark * size)
    x = np.frombuffer(payload, "<u8", lanes, 24 + mark * size + 4).astype(np.uint64)
    words = np.frombuffer(payload, "<u4", total, 24 + marks * size).astype(np.uint64)
    begin = mark * every * lanes
    last = -(-hi // lanes)
    out = np.empty(last * lanes - begin, np.uint32)
    symbol, freq, cum = table.symbol, table.freq, table.cum
    for t in range(mark * every, last):
        k = min(n, (t + 1) * lanes) - t * lanes
        y = x[:k]
        slot = y & _MASK
        s = symbol[slot]
        y = freq[s] * (y >> _S) + slot - cum[s]
        low = y < LOW
        m = int(np.count_nonzero(low))
        if m:
            y[low] = (y[low] << _32) | words[at : at + m]
            at += m
        x[:k] = y
        out[t * lanes - begin : t * lanes - begin + k] = s
    return out[lo - begin : hi - begin]


def stretch(payload: bytes) -> int:
    """Tokens between two checkpoints of a block."""
    _, _, lanes, every, _, _ = struct.unpack_from("<4sIIIII", payload)
    return lanes * every


def part_of(payload: bytes, lo: int, hi: int) -> bytes:
    """What decode_block needs of a block for tokens lo to hi: its checkpoints
    stay, and of the words those between the two around lo and hi."""
    magic, n, lanes, every, marks, total = struct.unpack_from("<4sIIIII", payload)
    size, body = 4 + 8 * lanes, 24 + marks * (4 + 8 * lanes)
    a, z = lo // (lanes * every), -(-hi // (lanes * every))
    begin = struct.unpack_from("<I", payload, 24 + a * size)[0]
    end = struct.unpack_from("<I", payload, 24 + z * size)[0] if z < marks else total
    head = bytearray(24 + (a + 1) * size)
    struct.pack_into("<4sIIIII", head, 0, magic, n, lanes, every, a + 1, end - begin)
    head[24 + a * size :] = struct.pack("<I", 0) + payload[24 + a * size + 4 : 24 + (a + 1) * size]
    return bytes(head) + payload[body + 4 * begin : body + 4 * end]


def crc32_join(crcs: list[int], sizes: list[int]) -> int:
    """crc32 of pieces joined, from the crc32 and byte length of each."""
    out = 0
    for crc, n in zip(crcs, sizes, strict=True):
        out = _shift(out, n) ^ crc
    return out


def _shift(crc: int, n: int) -> int:
    """What crc becomes when n zero bytes follow, by squared bit matrices."""

    def times(m: list[int], v: int) -> int:
        s, i = 0, 0
        while v:
            if v & 1:
                s ^= m[i]
            v >>= 1
            i += 1
        return s

    m = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        m = [times(m, x) for x in m]
    while n and crc:
        if n & 1:
            crc = times(m, crc)
        m = [times(m, x) for x in m]
        n >>= 1
    return crc


def tokens(docs: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (as bytes) of every document, and from each task
    one row (n_tokens -1) of packed counts by token."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, z = encoder(path), zstandard.ZstdCompressor(1)
        counts = np.zeros(e.size + end + 1, np.int64)
        kind = np.uint16 if len(counts) <= 65536 else np.uint32
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                ids, o = e.batch(part.column("text"), end)
                counts += np.bincount(ids, minlength=len(counts))
                raw = ids.astype(kind)
                at = (o * raw.itemsize).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(o) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]) if int(o[-1]) * raw.itemsize < 1 << 31 else pa.array([raw[a:b].tobytes() for a, b in zip(o[:-1], o[1:], strict=True)], pa.binary())
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(o)), packed], ["doc_id", "n_tokens", "ids"])
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([-1]), pa.array([z.compress(counts.tobytes())], pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.int64)


def count_tokens(packed: DataFrame, fan: int = 64) -> np.ndarray:
    """Sum of the tasks' count rows, in rounds of `fan` rows a task; what
    reaches the driver is one row of the vocabulary's size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for raw in b.column(0).to_pylist():
                got = unpack_counts(raw)
                total = got.copy() if total is None else total + got
        if total is not None:
            yield pa.record_batch([pa.array([zstandard.ZstdCompressor(1).compress(total.tobytes())], pa.binary())], ["ids"])

    rows = packed.where("n_tokens = -1").select("ids")
    n = rows.count()
    while n > 1:
        n = -(-n // fan)
        rows = stored(rows.repartition(n).mapInArrow(add, "ids binary"), "counts")
    got = rows.collect()
    return unpack_counts(got[0]["ids"]) if got else np.zeros(0, np.int64)


class _Pack:
    """Cuts a task's documents into blocks and codes them."""

    def __init__(self, part: int, table: Table, block: int):
        self.part, self.table, self.block = part, table, block
        self.at = self.first = self.have = 0
        self.ids: list[np.ndarray] = []
        self.docs: list[dict] = []

    def flush(self) -> Iterator[dict]:
        if self.docs:
            ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
            payload = encode_block(ids, self.table)
            yield {"part": self.part, "first": self.first, "n_tokens": len(ids), "payload": payload, "payload_crc32": zlib.crc32(payload), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "docs": self.docs}
        self.first, self.have, self.ids, self.docs = self.at, 0, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[dict]:
        start, pieces = self.at, max(1, -(-len(ids) // self.block))
        for k in range(pieces):
            piece = ids[k * self.block : (k + 1) * self.block]
            if self.have + len(piece) > self.block:
                yield from self.flush()
            self.docs.append({"doc_id": doc_id, "start": start, "piece": k, "pieces": pieces, "length": len(piece)})
            self.ids.append(piece)
            self.at += len(piece)
            self.have += len(piece)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> None:
    """Encode all documents, in ascending order of their ids, into folder `path`,
    in blocks of at most `block` tokens."""
    spark = docs.sparkSession
    packed = stored(tokens(docs, tokenizer, end, id_col, text_col), "tokens")
    table = Table.of(count_tokens(packed))
    rows = spark.createDataFrame([(int(t), int(f)) for t, f in enumerate(table.freq)], "token int, freq long")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/table")
    freq = spark.sparkContext.broadcast(table.freq)  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        pack = _Pack(task_id(), Table(freq.value), block)
        kind = np.uint16 if len(freq.value) <= 65536 else np.uint32
        schema = _schema()

        def out(block: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([block], schema)

        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(raw.as_py(), kind).astype(np.uint32)
                yield from map(out, pack.add(doc_id, ids))
        yield from map(out, pack.flush())

    ordered = packed.where("n_tokens >= 0").select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, BLOCKS).write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")


def _schema() -> pa.Schema:
    doc = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("length", pa.int64())])
    return pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary()), ("payload_crc32", pa.int64()), ("ids_crc32", pa.int64()), ("docs", pa.list_(doc))])


def read_table(spark: SparkSession, path: str) -> Table:
    rows = spark.read.schema("token int, freq long").parquet(f"{path}/table").orderBy("token").collect()
    return Table(np.array([r["freq"] for r in rows], np.uint64))


def part_bases(spark: SparkSession, path: str) -> dict[int, int]:
    """Tokens before each part; a part is a file, so this is its directory."""
    rows = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    out, at = {}, 0
    for r in sorted(rows, key=lambda r: r["part"]):
        out[r["part"]] = at
        at += r["n"]
    return out


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Decode all blocks in parallel: one row per document piece with doc_id,
    start (tokens of all documents before it), piece, pieces, length, the
    piece's crc32 and, if asked for, its ids."""
    prepare(spark)
    freq, bases = spark.sparkContext.broadcast(read_table(spark, path).freq), part_bases(spark, path)
    schema = "doc_id long, start long, piece int, pieces int, length long, crc long" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        table = Table(freq.value)
        for batch in batches:
            for i in range(batch.num_rows):
                part, payload, check, crc = (batch.column(c)[i].as_py() for c in ("part", "payload", "payload_crc32", "ids_crc32"))
                if zlib.crc32(payload) != check:
                    raise ValueError(f"damaged payload in part {part}")
                got = decode_block(payload, table).astype("<u4")
                if zlib.crc32(got.tobytes()) != crc:
                    raise ValueError(f"wrong ids in part {part}")
                docs, at, rows = batch.column("docs")[i].as_py(), 0, []
                for d in docs:
                    piece = got[at : at + d["length"]]
                    at += d["length"]
                    row = d | {"start": d["start"] + bases[part], "crc": zlib.crc32(piece.tobytes())}
                    rows.append(row | {"ids": piece.astype(np.int32).tolist()} if ids else row)
                yield pa.RecordBatch.from_pylist(rows, out)

    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("length", pa.int64()), ("crc", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if ids else []))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("part", "payload", "payload_crc32", "ids_crc32", "docs")
    return blocks.mapInArrow(run, schema)


def read_range(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """Tokens lo to hi of the whole store: start and ids of each stretch of a
    block between two checkpoints, decoded apart. Blocks outside aren't read."""
    prepare(spark)
    freq = spark.sparkContext.broadcast(read_table(spark, path).freq)
    bases = part_bases(spark, path)
    base = F.create_map(*[F.lit(x) for kv in bases.items() for x in kv]) if bases else F.create_map(F.lit(0), F.lit(0))  # an entry per file
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").withColumn("first", F.col("first") + base[F.col("part")])
    near = blocks.where((F.col("first") < hi) & (F.col("first") + F.col("n_tokens") > lo)).select("first", "n_tokens", "payload", "payload_crc32")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, payload, check in zip(*(b.column(c).to_pylist() for c in ("first", "n_tokens", "payload", "payload_crc32")), strict=True):
                if zlib.crc32(payload) != check:
                    raise ValueError("damaged payload")
                size = stretch(payload)
                edges = [max(lo - first, 0), *(x for x in range(size, n, size) if lo < first + x < hi), min(hi - first, n)]
                for a, z in zip(edges, edges[1:], strict=False):
                    yield pa.record_batch([pa.array([first + a], pa.int64()), pa.array([a], pa.int64()), pa.array([z], pa.int64()), pa.array([part_of(payload, a, z)], pa.binary())], ["start", "lo", "hi", "payload"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq.value)
        for b in batches:
            for start, a, z, payload in zip(*(b.column(c).to_pylist() for c in ("start", "lo", "hi", "payload")), strict=True):
                ids = decode_block(payload, table, a, z)
                yield pa.record_batch([pa.array([start], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], ["start", "ids"])

    # stretches, not blocks, are dealt to the tasks that decode
    return near.mapInArrow(cut, "start long, lo long, hi long, payload binary").repartition("start").mapInArrow(decode, "start long, ids array<int>")


@F.udf(LongType())
def _joined(pieces: list) -> int:
    pieces = sorted(pieces)
    return crc32_join([p["crc"] for p in pieces], [4 * p["length"] for p in pieces])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files.
    Blocks are decoded once; only documents cut over several blocks are grouped."""
    pieces = stored(read(spark, path), "pieces")
    one = pieces.where("pieces = 1").select("doc_id", "start", F.col("length").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    more = (
        pieces.where("pieces > 1")
        .groupBy("doc_id", "start")
        .agg(F.sum("length").alias("n_tokens"), F.collect_list(F.struct("piece", "length", "crc")).alias("p"))
        .select("doc_id", "start", "n_tokens", _joined("p").alias("ids_crc32"))
    )
    return one.unionByName(more)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-store")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return documents(spark, path)
