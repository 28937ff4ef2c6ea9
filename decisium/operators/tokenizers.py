"""Tokenizers behind one interface, to be handed to encoding and length filters.

A tokenizer is anything with encode_batch(list of texts) that gives a list of id
lists. It is handed over as a function without arguments that makes one, which
each Python worker calls once; texts go to it in Arrow batches. One that also has
encode_arrow and decode_arrow gets these as they are, without a Python object for
each id. Null has null ids. records.simple_tokens stays the default where no
tokenizer is given.

ByteBpe is byte-level BPE by merge ranks from a tokenizers JSON file: texts are
cut by the published pattern of that family, each distinct piece is merged once
a worker, cheapest rank first, and kept in a cache of bounded size. Whole batches
are first cut in numpy where that pattern surely cuts as well; of the distinct
parts of some megabytes of text, those of one class of plain characters are pieces
and merged side by side, and only others are looked at one by one. Control
tokens that it is told of have the ids after the vocabulary's, wherever they
stand in a text; strings of any other special tokens are a text's own."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE cuts texts.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that the vocabulary shows as themselves; the others are shown from U+0100 on.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
MOST_CACHED = 1 << 18
#: Bytes of text, ids and pieces that are worked on at a time, and most bytes of a piece that is merged beside others.
TEXT_BYTES, ID_COUNT, PIECES, WIDE = 4 << 20, 1 << 19, 1 << 15, 32
NONE = np.iinfo(np.int32).max
#: Classes of bytes: those of ASCII, and letters from U+00C0 to U+027F; all else is ODD.
LETTER, DIGIT, MARK, QUOTE, SPACE, ODD = range(6)
CLASS = np.full(256, ODD, np.uint8)
CLASS[0x21:0x7F] = MARK
CLASS[0x30:0x3A], CLASS[0x41:0x5B], CLASS[0x61:0x7B], CLASS[0x27], CLASS[0x20] = DIGIT, LETTER, LETTER, QUOTE, SPACE
CLASS[0xC3:0xCA] = LETTER


class Tokenizer(Protocol):
    def encode_batch(self, texts: list[str]) -> list[list[int]]: ...


class ByteBpe:
    def __init__(self, path: str, control: tuple[str, ...] = ()):
        import regex

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {m: i for i, m in enumerate(pairs)}
        self.pieces = regex.compile(PATTERN)
        hidden = [b for b in range(256) if b not in set(SHOWN)]
        self.shown = {b: chr(b) for b in SHOWN} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
        self.cache: dict[str, list[int]] = {}
        top = max([*self.vocabulary.values(), *(t["id"] for t in whole.get("added_tokens", []))], default=-1) + 1
        self.control = {t: top + i for i, t in enumerate(control)}
        longest = sorted(control, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, longest))) if control else None
        self.cut_bytes = regex.compile(b"|".join(regex.escape(t.encode()) for t in longest)) if control else None

    def merged(self, piece: str) -> list[int]:
        """Ids of one piece: neighbours of the least rank merge first, from the left."""
        part = [self.shown[b] for b in piece.encode()]
        after, before = [*range(1, len(part)), -1], [-1, *range(len(part) - 1)]
        heap = [(r, i) for i in range(len(part) - 1) if (r := self.ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if part[i] else -1
            if j < 0 or self.ranks.get((part[i], part[j])) != r:
                continue  # one of the two has merged since
            part[i], part[j] = part[i] + part[j], ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((part[a], part[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [self.vocabulary[p] for p in part if p]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            ids: list[int] = []
            at = 0
            for m in self.cut.finditer(text) if self.cut else ():
                ids += self.plain(text[at : m.start()])
                ids.append(self.control[m[0]])
                at = m.end()
            out.append(ids + self.plain(text[at:]))
        return out

    def plain(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces.findall(text):
            known = self.cache.get(piece)
            if known is None:
                known = self.merged(piece)
                if len(self.cache) >= MOST_CACHED:
                    self.cache.clear()
                if len(piece) < 64:
                    self.cache[piece] = known
            ids += known
        return ids

    def encode_arrow(self, texts: pa.Array) -> pa.Array:
        """encode_batch of an Arrow array, equal texts once; null for null."""
        texts = texts.cast(pa.large_string())
        whole = texts.dictionary_encode()
        known = whole.dictionary
        flat, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for part in _runs(_bounds(known), TEXT_BYTES):
            ids, n = self._encoded(known[part])
            flat.append(ids)
            size.append(n)
        out = pa.ListArray.from_arrays(_upto(np.concatenate(size)).astype(np.int32), pa.array(np.concatenate(flat)))
        return out if len(known) == len(texts) else out.take(whole.indices)

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        at = _bounds(texts)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        cut = np.zeros(len(data) + 1, bool)
        kind = _classes(data)
        a, b = kind[:-1], kind[1:]
        # a run of letters or digits ends, or other marks end before one; after a quote it takes the pattern
        cut[1:-1] = (a != b) & (b <= QUOTE) & ((a <= DIGIT) | ((a == MARK) & (b <= DIGIT)))
        # a space after a character that surely isn't white: of ASCII, or U+00C0 to U+07FF
        lead = np.concatenate([data[:1], data[:-2]])
        cut[1:-1] |= (b == SPACE) & ((a <= QUOTE) | ((data[:-1] >= 0x80) & (lead >= 0xC3) & (lead < 0xE0)))
        told = []
        if self.cut_bytes:
            raw = data.tobytes()
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for m in self.cut_bytes.finditer(raw, a, b):
                    cut[m.start() : m.end()] = False
                    cut[[m.start(), m.end()]] = True
                    told.append(m.start())
        cut[at] = True
        ends = np.flatnonzero(cut)
        n = max(len(ends) - 1, 0)
        parts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        code = parts.indices.to_numpy()
        flat, size = self._of_parts(parts.dictionary, code[np.searchsorted(ends, told)])
        upto = _upto(size[code])
        return flat[_places(_upto(size)[code], size[code])], np.diff(upto[np.searchsorted(ends, at)])

    def _of_parts(self, parts: pa.Array, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, and how many each has; told: which are control tokens."""
        at = _bounds(parts)
        data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)
        size, out = np.diff(at), np.zeros(len(parts), np.int64)
        plain = self._single(data, at) & (size <= WIDE) & self._pairs()
        plain[told] = False
        one, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        one = one[np.argsort(size[one], kind="stable")]
        flat = [np.zeros(0, np.int32)]
        for i in range(0, len(one), PIECES):
            ids, out[one[i : i + PIECES]] = self._side_by_side(data, at[one[i : i + PIECES]], size[one[i : i + PIECES]])
            flat.append(ids)
        ids, out[rest] = self._cut_again(parts.take(pa.array(rest)).to_pylist())
        # as they were merged, back to the order of the parts
        order = np.concatenate([one, rest])
        first = np.zeros(len(parts), np.int64)
        first[order] = _upto(out[order])[:-1]
        return np.concatenate([*flat, ids])[_places(first, out)], out

    @staticmethod
    def _single(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which parts are one piece: letters, digits or marks, and a space before them at most."""
        kind, out = _classes(data), np.zeros(len(at) - 1, bool)
        own = np.diff(at)
        own[own > 0] -= kind[at[:-1][own > 0]] == SPACE
        for c in (LETTER, DIGIT, MARK):
            n = _upto(kind == c)
            out |= (own > 0) & (n[at[1:]] - n[at[:-1]] == own)
        return out

    def _cut_again(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that the pattern cuts, or that are control tokens, and how many each has."""
        pieces = [[p] if p in self.control else self.pieces.findall(p) for p in parts]
        met = set(chain.from_iterable(pieces))
        fresh = [p for p in met if p not in self.cache and p not in self.control]
        if len(self.cache) + len(fresh) > MOST_CACHED:
            self.cache = {p: self.cache[p] for p in met if p in self.cache}
        self.cache.update(zip(fresh, self.merged_all(fresh), strict=True))
        ids = [[self.control[p]] if p in self.control else self.cache[p] for x in pieces for p in x]
        upto = _upto(np.fromiter(map(len, ids), np.int64, len(ids)))
        size = np.diff(upto[_upto(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
        return np.fromiter(chain.from_iterable(ids), np.int32, int(upto[-1])), size

    def merged_all(self, pieces: list[str]) -> list[list[int]]:
        """merged of each piece; short ones side by side."""
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data, first = np.frombuffer(b"".join(raw), np.uint8), _upto(size)[:-1]
        out: list[list[int]] = [[]] * len(raw)
        short = np.flatnonzero((size > 0) & (size <= WIDE)) if self._pairs() else np.zeros(0, np.int64)
        short = short[np.argsort(size[short], kind="stable")]
        for i in range(0, len(short), PIECES):
            which = short[i : i + PIECES]
            ids, n = self._side_by_side(data, first[which], size[which])
            ids, upto = ids.tolist(), _upto(n).tolist()
            for k, a, b in zip(which.tolist(), upto[:-1], upto[1:], strict=True):
                out[k] = ids[a:b]
        return [ids or self.merged(p) for p, ids in zip(pieces, out, strict=True)]

    def _pairs(self) -> bool:
        """Tables of pairs by ids; whether the vocabulary has all bytes and merges."""
        if not hasattr(self, "pairs"):
            v, self.pairs = self.vocabulary, None
            if len(set(v.values())) == len(v) and all(c in v for c in self.shown.values()) and all(x in v for a, b in self.ranks for x in (a, b, a + b)):
                self.span = max(v.values()) + 1
                key = np.array([v[a] * self.span + v[b] for a, b in self.ranks], np.int64)
                rank = np.fromiter(self.ranks.values(), np.int32, len(key))
                by = np.argsort(key)
                self.pairs = np.append(key[by], np.int64(-1)), np.append(rank[by], np.int32(NONE))
                self.product = np.zeros(int(rank.max(initial=-1)) + 1, np.int32)
                self.product[rank] = [v[a + b] for a, b in self.ranks]
                self.of_byte = np.array([v[self.shown[b]] for b in range(256)], np.int32)
                a, b = np.divmod(np.arange(1 << 16), 256)
                self.of_bytes = self._rank(self.of_byte[a], self.of_byte[b])
        return self.pairs is not None

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE for one that isn't merged, or whose second id is -1."""
        keys, ranks = self.pairs
        key = a.astype(np.int64) * self.span + b
        at = np.searchsorted(keys[:-1], key)
        return np.where((keys[at] == key) & (b >= 0), ranks[at], np.int32(NONE))

    def _side_by_side(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has. A round merges, in every piece
        that isn't done, the first of its pairs of the least rank."""
        wide = int(size.max())
        there = np.arange(wide) < size[:, None]
        letters = np.zeros(there.shape, np.int32)
        letters[there] = data[_places(first, size)]
        ids = np.where(there, self.of_byte[letters], np.int32(-1))
        rank = np.where(there[:, 1:], self.of_bytes[letters[:, :-1] * 256 + letters[:, 1:]], np.int32(NONE))
        out, which = np.full(ids.shape, -1, np.int32), np.arange(len(ids))
        while rank.shape[1]:
            at = rank.argmin(1)
            least = rank[np.arange(len(which)), at]
            go = least != NONE
            out[which[~go], : ids.shape[1]] = ids[~go]
            which, ids, rank, at, least = which[go], ids[go], rank[go], at[go], least[go]
            ids[np.arange(len(which)), at] = self.product[least]
            after = np.arange(ids.shape[1] - 1) > at[:, None]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            rank = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            for shift in (0, 1):  # the pairs that the new id begins, and ends
                k = np.flatnonzero((at >= shift) & (at - shift < rank.shape[1]))
                rank[k, at[k] - shift] = self._rank(ids[k, at[k] - shift], ids[k, at[k] - shift + 1])
        out[which, : ids.shape[1]] = ids
        return out[out >= 0], (out >= 0).sum(1)

    def _entries(self) -> dict[int, bytes]:
        if not hasattr(self, "entries"):
            byte = {c: b for b, c in self.shown.items()}
            self.entries = {i: bytes(byte[c] for c in e) for e, i in self.vocabulary.items() if all(c in byte for c in e)}
            self.entries |= {i: t.encode() for t, i in self.control.items()}
        return self.entries

    def decode(self, ids: Iterable[int]) -> str:
        known = self._entries()
        return b"".join(known[i] for i in ids).decode("utf-8", "replace")

    def decode_arrow(self, rows: pa.Array) -> pa.Array:
        """decode of each list of an Arrow array; null for null."""
        if not hasattr(self, "spelled"):
            known = self._entries()
            size = np.full(max(known, default=-1) + 1, -1, np.int64)
            size[list(known)] = [len(e) for e in known.values()]
            first = _upto(np.maximum(size, 0))
            self.spelled = np.frombuffer(b"".join(known[i] for i in sorted(known)), np.uint8), first[:-1], size
        letters, first, size = self.spelled
        at, ids, out = _bounds(rows), rows.values, []
        for part in _runs(at, ID_COUNT):
            a, b = at[part.start], at[part.stop]
            mine = ids[a:b].to_numpy()
            if len(mine) and not (mine.min() >= 0 and mine.max() < len(size) and size[mine].min() >= 0):
                raise KeyError("an id that the vocabulary doesn't have")
            each = size[mine]
            ends = _upto(each)[at[part.start : part.stop + 1] - a]
            out.append(_utf8(letters[_places(first[mine], each)], ends))
        got = pa.concat_arrays(out) if out else pa.array([], pa.string())
        return pc.if_else(rows.is_null(), pa.scalar(None, pa.string()), got) if rows.null_count else got


def _bounds(x: pa.Array) -> np.ndarray:
    """Where the values of texts (large) or lists begin and end, in their buffers."""
    if not len(x):
        return np.zeros(1, np.int64)
    wide = pa.types.is_large_string(x.type) or pa.types.is_large_list(x.type)
    return np.frombuffer(x.buffers()[1], np.int64 if wide else np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)


def _classes(data: np.ndarray) -> np.ndarray:
    """Classes of the bytes of UTF-8; both bytes of a letter are LETTER."""
    kind = CLASS[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] < 0xCA))
    kind[lead + 1] = LETTER
    sign = lead[(data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))]
    kind[sign] = kind[sign + 1] = ODD
    return kind


def _runs(at: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows of about `most` in all; a larger row is a run of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1))
        yield slice(i, j)
        i = j


def _upto(size: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, .. for each of the sizes, one after the other."""
    upto = _upto(size)
    return np.repeat(first - upto[:-1], size) + np.arange(upto[-1])


def _utf8(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts of stretches of bytes; what isn't UTF-8 in them is replaced."""
    raw = data.tobytes()
    inner = ends[1:-1][ends[1:-1] < len(data)]
    try:
        raw.decode()
        whole = not ((data[inner] & 0xC0) == 0x80).any()
    except UnicodeDecodeError:
        whole = False
    if whole and len(raw) < 1 << 31:
        return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw))
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())


def byte_bpe(path: str, control: Iterable[str] = ()) -> Callable[[], ByteBpe]:
    """What makes a ByteBpe of a file that all workers can open."""
    return partial(ByteBpe, path, tuple(control))


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Keeps Arrow batches of texts and their ids small, unless the session says how large they are."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


_made: dict[object, Tokenizer] = {}


def made(make: Callable[[], Tokenizer], name: object) -> Tokenizer:
    """The worker's tokenizer of that name."""
    if name not in _made:
        _made[name] = make()
    return _made[name]


def _name(make: Callable[[], Tokenizer]) -> object:
    return (make.func.__qualname__, make.args) if isinstance(make, partial) else getattr(make, "__qualname__", repr(make))


def token_ids(text: Column | str, make: Callable[[], Tokenizer]) -> Column:
    """Ids of texts by the tokenizer that `make` makes."""
    name = _name(make)

    @F.arrow_udf("array<int>")
    def ids(texts):  # noqa: ANN001, ANN202
        own = made(make, name)
        if hasattr(own, "encode_arrow"):
            return own.encode_arrow(texts)
        given = texts.to_pylist()
        encoded = iter(own.encode_batch([t for t in given if t is not None]))
        return pa.array([None if t is None else next(encoded) for t in given], pa.list_(pa.int32()))

    return ids(text)


def decoded(ids: Column | str, make: Callable[[], Tokenizer]) -> Column:
    """Texts of ids, by a tokenizer that can decode."""
    name = _name(make)

    @F.arrow_udf("string")
    def texts(rows):  # noqa: ANN001, ANN202
        own = made(make, name)
        if hasattr(own, "decode_arrow"):
            return own.decode_arrow(rows)
        return pa.array([None if x is None else own.decode(x) for x in rows.to_pylist()], pa.string())

    return texts(ids)


def within(df: DataFrame, text: str, most: int, measure: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows whose text measures at most `most`; measure: from text to a number
    (characters if not given), such as measured_by(tokenizer)."""
    return df.where((measure or F.length)(F.col(text)) <= most)


def measured_by(make: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """A measure of texts: their number of ids."""
    return lambda text: F.size(token_ids(text, make))
