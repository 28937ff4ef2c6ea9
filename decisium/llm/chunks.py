"""Documents in chunks of bounded size, and an exchange of sorted hash lists.

A chunk is one row of a written table: its number, how many documents it has
and their doc_ids and texts, packed. Chunks send the hashes they hold to hash
buckets, one packed row per chunk and bucket, and get answers back the same
way, a bit for each hash in the order sent. The number of buckets grows with
the text, so a bucket's group stays of bounded size. A hash that every document
holds is sent once by each chunk; above PART_CHUNKS chunks they are dealt into
parts, which reduce a bucket first and then meet in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, task_id, text_buffer

CHUNK_BYTES, PART_CHUNKS = 1 << 20, 1 << 15
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def squeeze(x: np.ndarray) -> bytes:
    """zstd over the byte planes of an integer array."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unsqueeze(raw: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()


def rising(x: np.ndarray) -> bytes:
    """Packed differences of a sorted unsigned array."""
    return squeeze(np.diff(x, prepend=x.dtype.type(0)))


def unrising(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw, np.uint64), dtype=np.uint64)


def pack_docs(ids: list, texts: list) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SCHEMA) as w:
        w.write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], schema=_SCHEMA))
    return zstandard.ZstdCompressor(3).compress(sink.getvalue().to_pybytes())


def unpack_docs(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_next_batch()


def make(docs: DataFrame) -> DataFrame:
    """chunk, bytes, payload; the documents of a chunk by rising doc_id, nulls
    last. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, have = task_id() << 32, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda r: (r[0] is None, r[0] or 0))
            return pa.record_batch([pa.array([at], pa.int64()), pa.array([have], pa.int64()), pa.array([pack_docs([r[0] for r in held], [r[1] for r in held])], pa.binary())], ["chunk", "bytes", "payload"])

        for batch in batches:
            for b in slices(batch, "text", CHUNK_BYTES // 8):
                n = int(text_buffer(b.column("text"))[1][-1])
                if held and have + n > CHUNK_BYTES:
                    yield flush()
                    at, have, held = at + 1, 0, []
                held += zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
                have += n
        if held:
            yield flush()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "chunk long, bytes long, payload binary"), "chunks")


def bucket_bits(total: int, each: int) -> int:
    """Bits of the bucket number, for about `each` of `total` in a bucket."""
    return max(0, int(np.ceil(np.log2(max(1, total / each)))))


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    if not len(x):
        return []
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist()
    return list(zip(at, [*at[1:], len(x)], strict=True))


def by_bucket(h: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Ranges of a sorted hash array that fall into the same bucket."""
    b = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    for i, j in runs(b):
        yield int(b[i]), slice(i, j)


def pack_bits(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.packbits(x).tobytes())


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), count=n).astype(bool)


def answered(h: np.ndarray, bits: int, answers: dict[int, bytes]) -> np.ndarray:
    """The answers to a chunk's sorted hashes, in their order."""
    out = np.zeros(len(h), bool)
    for b, s in by_bucket(h, bits):
        if b in answers:
            out[s] = unpack_bits(answers[b], s.stop - s.start)
    return out


#: What chunks send. Owners are counted from base; null: base is each hash's owner.
SENT = "bucket long, chunk long, base long, hashes binary, owners binary"
ANSWERS = "chunk long, bucket long, bits binary"


def settle(sent: DataFrame, n_chunks: int) -> DataFrame:
    """Per chunk and bucket a bit for each hash sent: does any other owner hold
    it? Rows without a set bit are left out."""
    if n_chunks <= PART_CHUNKS:
        return stored(sent.groupBy("bucket").applyInPandas(_answer, ANSWERS), "answers")
    parts = -(-n_chunks // PART_CHUNKS)
    sent = stored(sent.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts))), "sent")
    least = "bucket long, part long, hashes binary, least binary, most binary"
    reduced = sent.groupBy("bucket", "part").applyInPandas(_reduce, least)
    known = stored(reduced.groupBy("bucket").applyInPandas(_meet, least), "met")
    return stored(sent.groupBy("bucket", "part").cogroup(known.groupBy("bucket", "part")).applyInPandas(_apply, ANSWERS), "answers")


def _sent(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes by row, then all hashes and owners."""
    hashes = [unrising(x) for x in rows["hashes"]]
    owners = [np.full(len(h), b) if x is None else unsqueeze(x, np.uint64).astype(np.int64) + b for h, x, b in zip(hashes, rows["owners"], rows["base"], strict=True)]
    return hashes, np.concatenate(hashes), np.concatenate(owners)


def _bounds(h: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the least and most of each, and where each h stands."""
    order = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    back = np.empty(len(h), np.int64)
    back[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
    return h[order][starts], np.minimum.reduceat(least[order], starts), np.maximum.reduceat(most[order], starts), back


def _bits(rows: pd.DataFrame, hashes: list[np.ndarray], bit: np.ndarray) -> pd.DataFrame:
    by_row = np.split(bit, np.cumsum([len(x) for x in hashes])[:-1])
    keep = [i for i, x in enumerate(by_row) if x.any()]
    return pd.DataFrame({"chunk": rows["chunk"].to_numpy()[keep], "bucket": rows["bucket"].to_numpy()[keep], "bits": [pack_bits(by_row[i]) for i in keep]})


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    hashes, h, o = _sent(rows)
    _, least, most, back = _bounds(h, o, o)
    return _bits(rows, hashes, least[back] < most[back])


def _reduce(rows: pd.DataFrame) -> pd.DataFrame:
    _, h, o = _sent(rows)
    h, least, most, _ = _bounds(h, o, o)
    return pd.DataFrame({"bucket": rows["bucket"][:1], "part": rows["part"][:1], "hashes": [rising(h)], "least": [squeeze(least)], "most": [squeeze(most)]})


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    hashes = [unrising(x) for x in rows["hashes"]]
    least, most = (np.concatenate([unsqueeze(x, np.int64) for x in rows[c]]) for c in ("least", "most"))
    _, lo, hi, back = _bounds(np.concatenate(hashes), least, most)
    cuts = np.cumsum([len(x) for x in hashes])[:-1]
    return rows.assign(least=[squeeze(x) for x in np.split(lo[back], cuts)], most=[squeeze(x) for x in np.split(hi[back], cuts)])


def _apply(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    hashes, h, _ = _sent(rows)
    at = np.searchsorted(unrising(known["hashes"].iloc[0]), h)
    least, most = (unsqueeze(known[c].iloc[0], np.int64)[at] for c in ("least", "most"))
    return _bits(rows, hashes, least < most)
