"""Exact substring dedup on bytes by a depth-limited radix sort of suffixes.

Equal strings of `depth` bytes have equal anchors: an anchor is the least, and
then leftmost, hash of the GRAM-byte strings inside. Anchors are few (two in
depth - GRAM + 2 bytes), and a suffix whose anchor occurs once is unique to its
first `depth` bytes, so it needs no sorting.

1. Chunks of documents send their anchors' hashes to hash buckets and are
   answered which occur in other chunks.
2. For each occurrence of a recurring anchor, the bytes of all windows that
   have it as anchor (at most 2 * depth - GRAM) go to the anchor's bucket.
3. There, suffixes are sorted by most-significant-digit passes of eight bytes,
   through `depth` bytes and no further. Groups of one are left out after each
   pass; those that remain after the last are exactly the repeated windows.
   Occurrences with equal bytes all around share their windows, so only the
   first of them takes part in the sort. In a group all but the first window go.
4. Spans return to their chunks, are merged, and cut out of the documents.

The text is read a fixed number of times; a bucket's group is bounded, as the
number of buckets grows with the input; copies cost one row each.

A null text counts as empty; a null doc_id is earlier than none and keeps its
bytes; of rows that repeat a doc_id the same start is not earlier. An empty
table gives no rows. A text longer than a chunk (1 MB) makes a chunk of its own
and counts whole; other columns of the input aren't read, so their names can't
clash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as C
from .common import prepare, stored, text_buffer
from .words import _BYTE, mix

GRAM, SEGMENT = 24, 1 << 19
BUCKET_ANCHORS, BUCKET_BYTES, SORT_SUFFIXES = 2_000_000, 24 << 20, 400_000
_R = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each run of GRAM (= 16 + 8) bytes, by doubling."""
    h, r, by = _BYTE[data], _R, {}
    for n in (1, 2, 4, 8):
        m = len(h) - n
        if m <= 0:
            return np.zeros(0, np.uint64)
        h = h[:m] * r + h[n : n + m]
        r = r * r
        by[2 * n] = h
    r8 = _R
    for _ in range(3):
        r8 = r8 * r8
    n = len(data) - GRAM + 1
    return mix(by[16][:n] * r8 + by[8][16 : 16 + n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    size, out = 1, x
    while 2 * size <= n:
        out = np.minimum(out[:-size], out[size:]) if len(out) > size else out[:0]
        size *= 2
    if size < n:
        k = n - size
        out = np.minimum(out[:-k], out[k:]) if len(out) > k else out[:0]
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, known: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, ...]]:
    """hash, place, first and last window start of each anchor of the texts, in
    segments. A long text's anchors may be given in several parts."""
    n = len(data)
    with np.errstate(over="ignore"):
        for s in range(0, n, SEGMENT):
            e = min(n, s + SEGMENT + depth - 1)
            h = gram_hashes(data[s:e])
            key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
            place = (sliding_least(key, depth - GRAM + 1) & _PLACE).astype(np.int64)
            if not len(place):
                continue
            start = np.arange(len(place)) + s
            doc = np.searchsorted(offsets, start, "right") - 1
            ok = (start + depth <= offsets[doc + 1]) & known[doc]
            start, place = start[ok], place[ok]
            if not len(start):
                continue
            at = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)))
            last = np.append(at[1:], len(start)) - 1
            # least hashes are small, so they are mixed anew to spread over buckets
            yield mix(h[place[at]] ^ _R), place[at] + s, start[at], start[last]


class Chunk:
    def __init__(self, payload: bytes, depth: int):
        rows = C.unpack_docs(payload)
        self.ids = rows.column("doc_id").to_pylist()
        self.data, self.offsets = text_buffer(rows.column("text"))
        known = np.array([x is not None for x in self.ids], bool)
        parts = list(anchors(self.data, self.offsets, known, depth))
        self.hash, self.place, self.first, self.last = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        self.distinct, self.back, self.count = np.unique(self.hash, return_inverse=True, return_counts=True)


def _send(depth: int, bits: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload"), strict=True):
                c = Chunk(payload.as_py(), depth)
                parts = list(C.by_bucket(c.distinct, bits))
                if parts:
                    yield pa.record_batch([pa.array([k for k, _ in parts], pa.int64()), pa.array([chunk] * len(parts), pa.int64()), pa.array([chunk] * len(parts), pa.int64()), pa.array([C.rising(c.distinct[s]) for _, s in parts], pa.binary()), pa.nulls(len(parts), pa.binary())], ["bucket", "chunk", "base", "hashes", "owners"])

    return run


CONTEXT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("meta", pa.binary()), ("bytes", pa.binary()), ("copies", pa.binary())])
CONTEXT_DDL = "bucket long, chunk long, meta binary, bytes binary, copies binary"


def _contexts(depth: int, bits: int, wide: int):  # noqa: ANN202
    """The bytes around each occurrence of a recurring anchor, by bucket.
    meta holds, for each: hash, doc_id, document in the chunk, first window's
    start in the document, bytes, and the anchor's place in them. Of occurrences
    with the same bytes in a chunk only the first is sent; the others go, and
    their spans (document in the chunk, from, to) come along as copies."""

    def run(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        got = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        z = zstandard.ZstdCompressor(3)
        out: dict[str, list] = {n: [] for n in CONTEXT.names}
        for number, payload in zip(chunk.column("chunk").to_pylist(), chunk.column("payload").to_pylist(), strict=True):
            c = Chunk(payload, depth)
            recur = C.answered(c.distinct, bits, got) | (c.count > 1)
            pick = np.flatnonzero(recur[c.back])
            pick = pick[np.argsort(c.first[pick], kind="stable")]
            doc = np.searchsorted(c.offsets, c.first[pick], "right") - 1
            ids = np.array([0 if x is None else x for x in c.ids], np.int64)
            h, begin, size = c.hash[pick], c.first[pick], c.last[pick] - c.first[pick] + depth
            place, pos = c.place[pick] - begin, begin - c.offsets[doc]
            copy = np.zeros(len(pick), bool)
            raw, seen = c.data.tobytes(), {}
            for k in np.flatnonzero(c.count[c.back[pick]] > 1).tolist():
                i = int(begin[k])
                lead = seen.setdefault((int(h[k]), int(place[k]), raw[i : i + int(size[k])]), k)
                copy[k] = lead != k and (ids[doc[lead]], pos[lead]) < (ids[doc[k]], pos[k])
            if copy.any():
                spans = np.stack([doc[copy], pos[copy], pos[copy] + size[copy]])
                for name, value in zip(CONTEXT.names, (number % (1 << wide), number, None, None, C.squeeze(spans.ravel())), strict=True):
                    out[name].append(value)
            # within a bucket in order of place, so that neighbours' bytes repeat
            b = (h >> np.uint64(64 - wide)).astype(np.int64) if wide else np.zeros(len(pick), np.int64)
            own = np.flatnonzero(~copy)
            order = own[np.lexsort((begin[own], b[own]))]
            for i, j in C.runs(b[order]):
                o = order[i:j]
                meta = np.stack([h[o].view(np.int64), ids[doc[o]], doc[o], pos[o], size[o], place[o]])
                where = np.arange(int(size[o].sum())) + np.repeat(begin[o] - (np.cumsum(size[o]) - size[o]), size[o])
                for name, value in zip(CONTEXT.names, (int(b[o[0]]), number, C.squeeze(meta.ravel()), z.compress(c.data[where].tobytes()), None), strict=True):
                    out[name].append(value)
        return pa.Table.from_pydict(out, CONTEXT)

    return run


def radix_groups(data: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (places in `start`) whose first `depth` bytes occur more than
    once in their group, and the numbers of their final groups."""
    item = np.arange(len(start))
    for d in range(0, depth, 8):
        if not len(item):
            break
        n = min(8, depth - d)
        digit = np.zeros(len(item), np.uint64)
        for k in range(n):
            digit = (digit << np.uint64(8)) | data[start[item] + d + k]
        order = np.lexsort((digit, group))
        item, group, digit = item[order], group[order], digit[order]
        new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))
        group = np.cumsum(new) - 1
        many = np.bincount(group) > 1
        keep = many[group]
        item, group = item[keep], group[keep]
    return item, group


def repeated_windows(data: np.ndarray, at: np.ndarray, size: np.ndarray, place: np.ndarray, anchor: np.ndarray, doc: np.ndarray, pos: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows go: occurrence number and offset of each. Occurrences with
    the bytes data[at : at + size] around an anchor; pos is the first window's."""
    windows = size - depth + 1
    gone_o, gone_w = [], []
    # in blocks of anchors, to bound the suffixes that are sorted together
    order = np.argsort(anchor, kind="stable")
    edge = np.flatnonzero(np.append(True, anchor[order][1:] != anchor[order][:-1]))
    upto = np.concatenate([[0], np.cumsum(windows[order])])
    ends = np.append(edge[1:], len(order))
    i = 0
    while i < len(edge):
        j = max(i + 1, int(np.searchsorted(upto[ends], upto[edge[i]] + SORT_SUFFIXES, "right")))
        occ = order[edge[i] : ends[j - 1]]
        o = np.repeat(occ, windows[occ])
        w = np.arange(len(o)) - np.repeat(np.cumsum(windows[occ]) - windows[occ], windows[occ])
        # suffixes of one anchor at one distance from it stand in one group
        far = (place[o] - w).astype(np.int64)
        _, named = np.unique(anchor[occ], return_inverse=True)
        group = np.repeat(named, windows[occ]) * (2 * depth) + far
        item, final = radix_groups(data, at[o] + w, group, depth)
        if len(item):
            oo, ww = o[item], w[item]
            first = np.lexsort((pos[oo] + ww, doc[oo], final))
            f, oo, ww = final[first], oo[first], ww[first]
            lead = np.append(True, f[1:] != f[:-1])
            head = np.maximum.accumulate(np.where(lead, np.arange(len(f)), 0))
            later = (doc[oo] != doc[oo[head]]) | (pos[oo] + ww != pos[oo[head]] + ww[head])
            gone_o.append(oo[later])
            gone_w.append(ww[later])
        i = j
    if not gone_o:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(gone_o), np.concatenate(gone_w)


def _sort(depth: int):  # noqa: ANN202
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        z = zstandard.ZstdDecompressor()
        extra = rows[rows["meta"].isna()]
        out: dict[str, list] = {"chunk": extra["chunk"].tolist(), "spans": extra["copies"].tolist()}
        rows = rows[rows["meta"].notna()]
        if not len(rows):
            return pd.DataFrame(out)
        metas = [C.unsqueeze(m, np.int64).reshape(6, -1) for m in rows["meta"]]
        meta = np.concatenate(metas, axis=1)
        chunk = np.repeat(rows["chunk"].to_numpy(), [m.shape[1] for m in metas])
        anchor, doc, row, pos, size, place = meta
        anchor = anchor.view(np.uint64)
        raw = b"".join(z.decompress(x) for x in rows["bytes"])
        at = np.cumsum(size) - size
        # Occurrences with the same bytes around the same anchor share all windows.
        rank = np.lexsort((pos, doc))
        seen: dict[tuple[int, bytes], int] = {}
        lead = np.empty(len(at), np.int64)
        a_list, s_list, h_list, p_list = at.tolist(), size.tolist(), anchor.tolist(), place.tolist()
        for k in rank.tolist():
            lead[k] = seen.setdefault((h_list[k] * 256 + p_list[k], raw[a_list[k] : a_list[k] + s_list[k]]), k)
        del seen
        copies = np.flatnonzero(lead != np.arange(len(at)))
        same = (doc[copies] == doc[lead[copies]]) & (pos[copies] == pos[lead[copies]])
        ties, copies = copies[same], copies[~same]
        own = np.flatnonzero(lead == np.arange(len(at)))
        _, back, count = np.unique(anchor[own], return_inverse=True, return_counts=True)
        sort = own[count[back] > 1]
        o, w = repeated_windows(np.frombuffer(raw, np.uint8), at[sort], size[sort], place[sort], anchor[sort], doc[sort], pos[sort], depth)
        o = sort[o]
        if len(ties):  # rows that repeat a doc_id lose what their first does
            twins = pd.DataFrame({"lead": lead[ties], "o": ties}).merge(pd.DataFrame({"lead": o, "w": w}), on="lead")
            o, w = np.concatenate([o, twins["o"].to_numpy(np.int64)]), np.concatenate([w, twins["w"].to_numpy(np.int64)])
        by = np.lexsort((w, o))
        o, w = o[by], w[by]
        new = np.append(True, (o[1:] != o[:-1]) | (w[1:] != w[:-1] + 1)) if len(o) else np.zeros(0, bool)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(o)) - 1 if len(a) else a
        occ = np.concatenate([o[a], copies])
        lo = np.concatenate([pos[o[a]] + w[a], pos[copies]])
        hi = np.concatenate([pos[o[a]] + w[b] + depth, pos[copies] + size[copies]])
        order = np.argsort(chunk[occ], kind="stable")
        for i, j in C.runs(chunk[occ][order]):
            k = order[i:j]
            out["chunk"].append(int(chunk[occ[k[0]]]))
            out["spans"].append(C.squeeze(np.stack([row[occ[k]], lo[k], hi[k]]).ravel()))
        return pd.DataFrame(out)

    return run


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def _cut(key: tuple, chunk: pa.Table, spans: pa.Table) -> pa.Table:
    rows: dict[str, list] = {n: [] for n in OUT.names}
    for payload in chunk.column("payload").to_pylist():
        docs = C.unpack_docs(payload)
        data, offsets = text_buffer(docs.column("text"))
        delta = np.zeros(len(data) + 1, np.int32)
        for packed in spans.column("spans").to_pylist():
            row, lo, hi = C.unsqueeze(packed, np.int64).reshape(3, -1)
            np.add.at(delta, offsets[row] + lo, 1)
            np.add.at(delta, offsets[row] + hi, -1)
        gone = np.cumsum(delta[:-1]) > 0
        for d, doc_id in enumerate(docs.column("doc_id").to_pylist()):
            mine, text = gone[offsets[d] : offsets[d + 1]], data[offsets[d] : offsets[d + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
            kept = text[~mine] if len(edge) else text
            for name, value in zip(OUT.names, (doc_id, len(text), int(mine.sum()), len(edge) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), edge.tolist()), strict=True):
                rows[name].append(value)
    return pa.Table.from_pydict(rows, OUT)


def repeated_bytes(docs: DataFrame, depth: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, sha256 of the bytes kept, and spans
    (removed bytes, from and to in turn) of each row of docs."""
    if depth <= GRAM + 1 or depth > 250:
        raise ValueError(f"depth must lie between {GRAM + 2} and 250")
    prepare(docs.sparkSession)
    chunks = C.make(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    n, total = chunks.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).collect()[0]
    bits = C.bucket_bits(2 * total // (depth - GRAM + 2), BUCKET_ANCHORS)
    wide = C.bucket_bits(total, BUCKET_BYTES // 4)
    body = chunks.select("chunk", "payload")
    answers = C.settle(body.mapInArrow(_send(depth, bits), C.SENT), n)
    context = body.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_contexts(depth, bits, wide), CONTEXT_DDL)
    spans = stored(context.groupBy("bucket").applyInPandas(_sort(depth), "chunk long, spans binary"), "spans")
    return body.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(_cut, OUT_DDL)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
