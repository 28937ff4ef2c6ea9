"""Substring dedup of repeated phrases with Aho-Corasick automata.

1. Confirm: every chunk of documents sends the hashes of its windows of `span`
   words, once each with the least doc_id that holds it, to hash buckets. A
   bucket tells the chunk with the least doc_id which windows later documents
   hold, and the other chunks which parts of earlier documents they share (doc_id
   and number of a part of PART_WORDS words), not where.
2. Passages: the first holder merges neighbouring recurring windows of a part
   into passages, whole texts in a written table, keyed by doc_id and part.
3. Compile: a chunk's passages, the parts that it was told of and those that
   recur within it, are compiled into automata in shards of at most
   MOST_PATTERNS. The patterns are every passage's consecutive pieces of half a
   window: a window of 13 words holds one whole piece of 7. Where the same
   piece stands in several places, the windows around it are patterns
   themselves, so that no place multiplies another.
4. Stream: every document of the chunk passes them. A found piece is compared
   with its passage, word by word, for each window that holds it; a window whose
   passage is of a smaller doc_id is covered.

So the text is read a fixed number of times, whatever the number of phrases,
and where a phrase occurs is known from the automata alone. A passage that
every document holds is one row a chunk. Windows are judged on the input.
Phrases are confirmed, and words told apart, by 64-bit hashes.

A null text has no words; a null doc_id is smaller than none and keeps its
words; rows that repeat a doc_id are neither's smaller; an empty table gives no
rows. A text longer than a chunk (1 MB) makes a chunk of its own and counts
whole; other columns of the input aren't read, so their names can't clash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as C
from .common import prepare, stored, text_buffer
from .words import BLANK, Words, find, grams

BUCKET_WINDOWS, MOST_PATTERNS, PART_WORDS, COMPARED = 2_000_000, 50_000, 1024, 1 << 16


class Windows:
    """Windows of a chunk: the distinct hashes, sorted, and of each the first
    start, the document there and whether a later document of the chunk has it."""

    def __init__(self, payload: bytes, span: int):
        rows = C.unpack_docs(payload)
        self.ids, self.words = known_ids(rows), find(*text_buffer(rows.column("text")), BLANK)
        first = self.words.first
        h = grams(self.words.hashes, span)
        start = np.arange(len(h))
        doc = np.searchsorted(first, start, "right") - 1
        ok = (start + span <= first[doc + 1]) & (self.ids[1][doc]) if len(h) else np.zeros(0, bool)
        start, doc = start[ok], doc[ok]
        self.hashes, at, back = np.unique(h[ok], return_index=True, return_inverse=True)
        # documents stand by rising doc_id
        self.start, self.doc, owner = start[at], doc[at], self.ids[0][doc]
        self.owner = owner[at]
        last = self.owner.copy()
        np.maximum.at(last, back, owner)
        self.again = last > self.owner
        self.part = (self.start - first[self.doc]) // PART_WORDS


def known_ids(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids, and which of them aren't null."""
    col = rows.column("doc_id")
    return col.fill_null(0).to_numpy(zero_copy_only=False), col.is_valid().to_numpy(zero_copy_only=False)


SENT = "bucket long, chunk long, base long, hashes binary, owners binary, parts binary"


def _send(span: int, bits: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload"), strict=True):
                w = Windows(payload.as_py(), span)
                if not len(w.hashes):
                    continue
                base = int(w.owner.min())
                cuts = list(C.by_bucket(w.hashes, bits))
                yield pa.record_batch(
                    [
                        pa.array([k for k, _ in cuts], pa.int64()),
                        pa.array([chunk] * len(cuts), pa.int64()),
                        pa.array([base] * len(cuts), pa.int64()),
                        pa.array([C.rising(w.hashes[s]) for _, s in cuts], pa.binary()),
                        pa.array([C.squeeze((w.owner[s] - base).astype(np.uint64)) for _, s in cuts], pa.binary()),
                        pa.array([C.squeeze(w.part[s]) for _, s in cuts], pa.binary()),
                    ],
                    ["bucket", "chunk", "base", "hashes", "owners", "parts"],
                )

    return run


#: Per chunk and bucket: bits of windows that later documents of other chunks
#: hold, of windows that earlier ones do, and where those stand first (doc_ids,
#: then parts).
ANSWERS = "chunk long, bucket long, later binary, earlier binary, shared binary"
#: The distinct hashes of a bucket, with the first holder and the last doc_id.
FIRSTS = "bucket long, slot long, hashes binary, least binary, most binary, chunks binary, parts binary"


def firsts(h: np.ndarray, least: np.ndarray, most: np.ndarray, chunk: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each distinct hash: least and most doc_id, and chunk and part of the
    first entry with the least one."""
    order = np.argsort(h, kind="stable")
    h, least = h[order], least[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    low = np.minimum.reduceat(least, at)
    is_low = least == np.repeat(low, np.diff(np.append(at, len(h))))
    one = order[np.minimum.reduceat(np.where(is_low, np.arange(len(h)), len(h)), at)]
    return h[at], low, np.maximum.reduceat(most[order], at), chunk[one], part[one]


def _entries(rows: pd.DataFrame) -> tuple[list[int], tuple[np.ndarray, ...]]:
    hashes, h, owner = C._sent(rows)
    sizes = [len(x) for x in hashes]
    return sizes, (h, owner, owner, np.repeat(rows["chunk"].to_numpy(), sizes), np.concatenate([C.unsqueeze(x, np.int64) for x in rows["parts"]]))


def _tell(rows: pd.DataFrame, sizes: list[int], sent: tuple, known: tuple) -> pd.DataFrame:
    h, owner, _, chunk, _ = sent
    at = np.searchsorted(known[0], h)
    least, most, home, part = (x[at] for x in known[1:])
    earlier, later = owner > least, (owner == least) & (chunk == home) & (most > least)
    out: dict[str, list] = {c.split()[0]: [] for c in ANSWERS.split(", ")}
    ends = np.cumsum(sizes)
    for k, (number, bucket) in enumerate(zip(rows["chunk"].tolist(), rows["bucket"].tolist(), strict=True)):
        s = slice(ends[k] - sizes[k], ends[k])
        if not (earlier[s].any() or later[s].any()):
            continue
        shared = np.unique(np.stack([least[s][earlier[s]], part[s][earlier[s]]]), axis=1)
        for name, value in zip(out, (number, bucket, C.pack_bits(later[s]), C.pack_bits(earlier[s]), C.squeeze(shared.ravel()) if shared.size else None), strict=True):
            out[name].append(value)
    return pd.DataFrame(out)


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("chunk")
    sizes, sent = _entries(rows)
    return _tell(rows, sizes, sent, firsts(*sent))


def _packed(rows: pd.DataFrame, found: tuple) -> pd.DataFrame:
    return pd.DataFrame({"bucket": rows["bucket"][:1].tolist(), "slot": rows["slot"][:1].tolist(), "hashes": [C.rising(found[0])]} | {n: [C.squeeze(x)] for n, x in zip(("least", "most", "chunks", "parts"), found[1:], strict=True)})


def _unpacked(rows: pd.DataFrame) -> list[tuple]:
    return [(C.unrising(r.hashes), *(C.unsqueeze(x, np.int64) for x in (r.least, r.most, r.chunks, r.parts))) for r in rows.itertuples()]


def _reduce(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("chunk")
    return _packed(rows, firsts(*_entries(rows)[1]))


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("slot")
    slots = _unpacked(rows)
    met = firsts(*(np.concatenate(x) for x in zip(*slots, strict=True)))
    at = [np.searchsorted(met[0], s[0]) for s in slots]
    return pd.concat([_packed(rows.iloc[k : k + 1], (slots[k][0], *(x[at[k]] for x in met[1:]))) for k in range(len(slots))])


def _apply(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    sizes, sent = _entries(rows)
    return _tell(rows, sizes, sent, _unpacked(known)[0])


def confirm(sent: DataFrame, n_chunks: int) -> DataFrame:
    """Answers to what chunks sent. Above PART_CHUNKS chunks they are dealt into
    slots, which reduce a bucket first and then meet in it."""
    if n_chunks <= C.PART_CHUNKS:
        return stored(sent.groupBy("bucket").applyInPandas(_answer, ANSWERS), "answers")
    slots = -(-n_chunks // C.PART_CHUNKS)
    sent = stored(sent.withColumn("slot", F.pmod(F.xxhash64("chunk"), F.lit(slots))), "sent")
    known = stored(sent.groupBy("bucket", "slot").applyInPandas(_reduce, FIRSTS).groupBy("bucket").applyInPandas(_meet, FIRSTS), "met")
    return stored(sent.groupBy("bucket", "slot").cogroup(known.groupBy("bucket", "slot")).applyInPandas(_apply, ANSWERS), "answers")


PASSAGES = pa.schema([("owner", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("passages", pa.list_(pa.binary()))])
PASSAGES_DDL = "owner long, part long, chunk long, passages array<binary>"


def _passages(span: int, bits: int):  # noqa: ANN202
    """Merged recurring windows of a chunk, a row for each document's part; then
    a row without passages for each part, its own or another chunk's, whose
    passages the chunk must look for."""

    def run(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in PASSAGES.names}
        got = {c: dict(zip(answers.column("bucket").to_pylist(), answers.column(c).to_pylist(), strict=True)) for c in ("later", "earlier")}
        shared = [C.unsqueeze(x, np.int64).reshape(2, -1) for x in answers.column("shared").to_pylist() if x is not None]
        for number, payload in zip(chunk.column("chunk").to_pylist(), chunk.column("payload").to_pylist(), strict=True):
            w = Windows(payload, span)
            within = w.again & ~C.answered(w.hashes, bits, got["earlier"])
            pick = np.flatnonzero(within | C.answered(w.hashes, bits, got["later"]))
            pick = pick[np.argsort(w.start[pick])]
            start, doc, part = w.start[pick], w.doc[pick], w.part[pick]
            place = doc * (int(part.max(initial=0)) + 1) + part
            cut = np.append(True, (start[1:] != start[:-1] + 1) | (place[1:] != place[:-1]))
            lead = np.flatnonzero(cut) if len(pick) else np.zeros(0, np.int64)
            end = w.words.ends[np.append(start[lead[1:] - 1], start[-1:]) + span - 1]
            texts = [w.words.data[a:b].tobytes() for a, b in zip(w.words.starts[start[lead]].tolist(), end.tolist(), strict=True)]
            for i, j in C.runs(place[lead]):
                k = pick[lead[i]]
                for name, value in zip(PASSAGES.names, (int(w.owner[k]), int(w.part[k]), number, texts[i:j]), strict=True):
                    out[name].append(value)
            own = np.stack([w.owner[within], w.part[within]])
            for owner, at in np.unique(np.concatenate([*shared, own], axis=1), axis=1).T.tolist():
                for name, value in zip(PASSAGES.names, (owner, at, number, None), strict=True):
                    out[name].append(value)
        return pa.Table.from_pydict(out, PASSAGES)

    return run


def patterns(p: Words, owner: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of passages p: where pieces that stand once begin; where the windows that
    hold any other piece begin, each distinct one once, with its least owner."""
    size = (span + 1) // 2
    length = np.diff(p.first)
    count = np.maximum(0, (length - size) // size + 1)
    of = np.repeat(np.arange(len(count)), count)
    piece = p.first[of] + size * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    _, back, times = np.unique(grams(p.hashes, size)[piece], return_inverse=True, return_counts=True)
    once = times[back] == 1
    many, of = piece[~once], of[~once]
    window = (many[:, None] - np.arange(size)).ravel()
    of = np.repeat(of, size)
    ok = (window >= p.first[of]) & (window + span <= p.first[of + 1])
    window, who = window[ok], owner[of[ok]]
    order = np.lexsort((who, grams(p.hashes, span)[window]))
    window, who = window[order], who[order]
    h = grams(p.hashes, span)[window]
    new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    return piece[once], window[new], who[new]


def locate(words: Words, passages: list[bytes], owner: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of the words that occur in passages, and the owner
    of the passage. A start may come from several passages."""
    import ahocorasick

    offsets = np.concatenate([[0], np.cumsum([len(x) for x in passages])]).astype(np.int64)
    p = find(np.frombuffer(b"".join(passages), np.uint8), offsets, BLANK)
    size, n = (span + 1) // 2, len(words.hashes)
    vocabulary, code = np.unique(p.hashes, return_inverse=True)
    width = 1
    while 256**width <= len(vocabulary):
        width += 1
    seen = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
    mine = np.where(vocabulary[seen] == words.hashes, seen, len(vocabulary))

    def letters(codes: np.ndarray) -> str:
        # A letter's place in a word's code shows in its range, so matches can't shift.
        text = np.empty((len(codes), width), np.uint16)
        for k in range(width):
            text[:, k] = (codes >> (8 * k) & 255) + 256 * (k + 1)
        return text.tobytes().decode("utf-16-le")

    text, known = letters(mine), letters(code)
    once, window, who = patterns(p, owner, span)
    of = np.searchsorted(p.first, once, "right") - 1
    entries = np.concatenate([once, window])
    sizes = np.concatenate([np.full(len(once), size), np.full(len(window), span)])
    starts, owners = [], []
    for s in range(0, len(entries), MOST_PATTERNS):
        automaton = ahocorasick.Automaton()
        e = min(len(entries), s + MOST_PATTERNS)
        for k, at, many in zip(range(s, e), entries[s:e].tolist(), sizes[s:e].tolist(), strict=True):
            automaton.add_word(known[at * width : (at + many) * width], k)
        automaton.make_automaton()
        hits = np.array(list(automaton.iter(text)), np.int64).reshape(-1, 2)
        at, k = (hits[:, 0] + 1) // width - sizes[hits[:, 1]], hits[:, 1]
        whole = k >= len(once)
        starts.append(at[whole])
        owners.append(who[k[whole] - len(once)])
        at, k = at[~whole], k[~whole]
        for i in range(0, len(at), COMPARED):
            a, b = at[i : i + COMPARED], k[i : i + COMPARED]
            # the words from the first window's begin to the last one's end
            off = np.arange(1 - size, span)
            here, there = a[:, None] + off, once[b][:, None] + off
            inside = (here >= 0) & (here < n) & (there >= p.first[of[b]][:, None]) & (there < p.first[of[b] + 1][:, None])
            same = inside & (mine[np.clip(here, 0, n - 1)] == code[np.clip(there, 0, len(code) - 1)])
            upto = np.pad(np.cumsum(same, axis=1), ((0, 0), (1, 0)))
            hit, shift = np.nonzero(upto[:, span:] - upto[:, :-span] == span)
            starts.append(a[hit] + shift + 1 - size)
            owners.append(owner[of[b[hit]]])
    return np.concatenate(starts), np.concatenate(owners)


def covered(words: Words, ids: tuple[np.ndarray, np.ndarray], passages: list[bytes], owner: np.ndarray, span: int) -> np.ndarray:
    """Which words lie in a window that also starts in a smaller doc_id."""
    delta = np.zeros(len(words.starts) + 1, np.int32)
    if len(passages) and len(words.starts):
        start, who = locate(words, passages, owner, span)
        doc = np.searchsorted(words.first, start, "right") - 1
        ok = (start + span <= words.first[doc + 1]) & ids[1][doc] & (who < ids[0][doc])
        start = np.unique(start[ok])
        delta[start] += 1
        delta[start + span] -= 1
    return np.cumsum(delta[:-1]) > 0


def _finish(span: int):  # noqa: ANN202
    def run(key: tuple, chunk: pa.Table, shared: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k: [] for k in OUT.names}
        lists = shared.column("passages").to_pylist()
        owner = np.repeat(shared.column("owner").to_numpy(), [len(x) for x in lists])
        passages = [x for some in lists for x in some]
        for payload in chunk.column("payload").to_pylist():
            docs = C.unpack_docs(payload)
            words = find(*text_buffer(docs.column("text")), BLANK)
            gone = covered(words, known_ids(docs), passages, owner, span)
            first = words.first
            for d, (doc_id, text) in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True)):
                mine = gone[first[d] : first[d + 1]]
                kept = (text or "").encode().split()
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                if len(edge):
                    keep = np.flatnonzero(~mine).tolist()
                    kept = [kept[i] for i in keep]
                rows["doc_id"].append(doc_id)
                rows["n_words"].append(len(mine))
                rows["n_removed"].append(int(mine.sum()))
                rows["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                rows["runs"].append(edge.tolist())
        return pa.Table.from_pydict(rows, OUT)

    return run


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("runs", pa.list_(pa.int64()))])
OUT_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, runs array<long>"


def repeated_phrases(docs: DataFrame, span: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, sha256 of the kept words joined by a space,
    and runs (covered words, from and to in turn) of each row of docs."""
    prepare(docs.sparkSession)
    chunks = C.make(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    n, total = chunks.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).collect()[0]
    bits = C.bucket_bits(total // 6, BUCKET_WINDOWS)
    body = chunks.select("chunk", "payload")
    answers = confirm(body.mapInArrow(_send(span, bits), SENT), n)
    passages = stored(body.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_passages(span, bits), PASSAGES_DDL), "passages")
    wanted = passages.where("passages is null").drop("passages")
    shared = wanted.join(passages.where("passages is not null").drop("chunk"), ["owner", "part"]).select("chunk", "owner", "passages")
    return body.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_finish(span), OUT_DDL)


def op4_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeated_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "n_removed", "kept_sha256")
