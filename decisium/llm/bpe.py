"""Token ids of whole texts by the tokenizers library, each distinct piece once.

Byte-level pre-tokenisation cuts a text into runs of letters, of digits, of
other marks and of white space, and looks at nothing to the left of a cut. So
texts are cut here, in numpy, at places where it surely cuts as well; pieces
are encoded by the library when first met and kept with their bytes in a
direct-mapped cache of fixed size: a piece is found only if all its bytes are
equal. Pieces of more than WIDE bytes
or WIDTH ids aren't kept. A text with characters whose class isn't plain from
its bytes, or with the string of a special token, goes to the library whole."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import text_buffer
from .words import mix

#: Slots of a worker's cache, and most ids and bytes of a piece in it.
SLOTS, WIDTH, WIDE = 1 << 21, 8, 22
_AT, _COUNT = np.uint64(48), np.uint64(255 << 48)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
LETTER, DIGIT, MARK, QUOTE, SPACE, WHITE, ODD = range(7)
_CLASS = np.full(256, ODD, np.uint8)
_CLASS[:128] = MARK
_CLASS[0x1C:0x20] = ODD
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = LETTER
_CLASS[0x27], _CLASS[0x20], _CLASS[9:14] = QUOTE, SPACE, WHITE
# U+00C0 to U+027F are letters but for two signs, which are looked for apart.
_CLASS[0xC3:0xCA] = _CLASS[0x80:0xC0] = LETTER
# Bytes as byte-level vocabularies write them: plain ones as they are, others from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = {b: b for b in _SHOWN} | {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_ready: dict[str, object] = {}


class Encoder:
    """plain: strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.size <= 65536 else np.uint32
        # a slot's words: the piece's key, with the number of its ids, and the ids
        self.slots = np.zeros((SLOTS, 3 + WIDTH * np.dtype(self.kind).itemsize // 8), np.uint64)
        model, cuts = self.tokenizer.model, str(self.tokenizer.pre_tokenizer)
        byte_level = cuts.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in cuts and self.tokenizer.normalizer is None
        self.model = model if byte_level and type(model).__name__ == "BPE" else None

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of runs of letters that may begin with a space. No cut falls in
        them, so they go to the library's model itself, as its byte letters."""
        if self.model is None:
            return self.whole([p.decode() for p in pieces])
        return [[t.id for t in self.model.tokenize(p.decode("latin-1").translate(_LETTERS))] for p in pieces]

    def fresh(self, raw: bytes, starts: list[int], ends: list[int], odd: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct ones of some pieces, how many each has, and which
        of them each piece is."""
        plain: dict[bytes, int] = {}
        other: dict[bytes, int] = {}
        back = np.empty(len(starts), np.int64)
        for k, (a, b, o) in enumerate(zip(starts, ends, odd, strict=True)):
            p = raw[a:b]
            if not o and _CLASS[p[p[0] == 0x20 and b - a > 1]] == LETTER:
                back[k] = plain.setdefault(p, len(plain))
            else:
                back[k] = -1 - other.setdefault(p, len(other))
        ids = [*self.words(list(plain)), *self.whole([p.decode() for p in other])]
        back[back < 0] = len(plain) - 1 - back[back < 0]
        return np.array([x for i in ids for x in i], np.uint32), np.array([len(i) for i in ids], np.int64), back

    def odd(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Which texts must be encoded whole."""
        bad = kind == ODD
        high = np.flatnonzero(data[:-1] == 0xC3)
        bad[high[(data[high + 1] == 0x97) | (data[high + 1] == 0xB7)]] = True
        # a continuation byte must follow one of the lead bytes above
        tail = np.flatnonzero((data >= 0x80) & (data < 0xC0))
        bad[tail[(tail == 0) | ~((data[tail - 1] >= 0xC3) & (data[tail - 1] < 0xCA))]] = True
        at = np.flatnonzero(bad)
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, at, "right") - 1] = True
        raw = data.tobytes()
        for s in self.special:
            k = raw.find(s)
            while k >= 0:
                out[np.searchsorted(offsets, k, "right") - 1] = True
                k = raw.find(s, k + 1)
        return out

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of pieces, and which of them are whole odd texts."""
        kind = _CLASS[data]
        odd = self.odd(data, offsets, kind)
        n = len(data)
        white = (kind == SPACE) | (kind == WHITE)
        cut = np.zeros(n + 1, bool)
        a, b, wa, wb = kind[:-1], kind[1:], white[:-1], white[1:]
        word = a <= DIGIT
        # a run of letters or digits ends, other marks end before one, or white space begins
        cut[1:n] = (a != b) & ~wa & ~wb & (word | ((a == MARK) & (b <= DIGIT)))
        cut[1:n] |= ~wa & wb
        # after one mark of white space other than a space, between others
        cut[2:n] |= (kind[1:-1] == WHITE) & ~white[:-2] & ~white[2:]
        for i in np.flatnonzero(odd):
            cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets] = True
        starts = np.flatnonzero(cut[:n])
        which = np.zeros(len(starts), bool)
        if odd.any():
            which = odd[np.searchsorted(offsets, starts, "right") - 1]
        return starts, which

    def batch(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, null as empty, and the offsets of each; with
        `end` appended to each text if given."""
        data, offsets = text_buffer(column)
        extra = 0 if end is None else 1
        if not len(data):
            return np.full(extra * (len(offsets) - 1), end or 0, np.uint32), np.arange(len(offsets)) * extra
        starts, odd = self.cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        size = ends - starts
        small = (size <= WIDE) & ~odd
        key = piece_keys(data, starts, np.minimum(size, WIDE))
        slot = (mix((key[2] * _MIX[1] + key[1]) * _MIX[0] + key[0]) & np.uint64(len(self.slots) - 1)).astype(np.int64)
        got = np.take(self.slots, slot, axis=0)
        hit = small & (got[:, 0] == key[0]) & (got[:, 1] == key[1]) & ((got[:, 2] & ~_COUNT) == key[2])
        got = got[hit]
        lens, known = np.zeros(len(starts), np.int64), np.ascontiguousarray(got[:, 3:]).view(self.kind)
        lens[hit] = (got[:, 2] & _COUNT) >> _AT
        miss = np.flatnonzero(~hit)
        flat, count, back = self.fresh(data.tobytes(), starts[miss].tolist(), ends[miss].tolist(), odd[miss].tolist()) if len(miss) else (np.zeros(0, np.uint32), np.zeros(0, np.int64), miss)
        lens[miss] = count[back]
        upto = np.concatenate([[0], np.cumsum(lens)])
        first = np.searchsorted(starts, offsets)
        out_off = upto[first] + np.arange(len(offsets)) * extra
        out = np.full(int(out_off[-1]), end or 0, np.uint32)
        at = upto[:-1] + (np.repeat(np.arange(len(offsets) - 1), np.diff(first)) if extra else 0)
        row, at_hit, left = np.arange(len(known)), at[hit], lens[hit]
        for k in range(WIDTH):
            more = left > k
            if not more.all():
                row, at_hit, left = row[more], at_hit[more], left[more]
            if not len(row):
                break
            out[at_hit + k] = known[row, k]
        if len(miss):
            begin = np.cumsum(count) - count
            step = _steps(lens[miss])
            out[np.repeat(at[miss], lens[miss]) + step] = flat[np.repeat(begin[back], lens[miss]) + step]
            self._keep(key[:, miss], slot[miss], small[miss], back, flat, begin, count)
        return out, out_off

    def _keep(self, key: np.ndarray, slot: np.ndarray, small: np.ndarray, back: np.ndarray, flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> None:
        """New pieces go into the cache, in place of what their slots held."""
        new = np.flatnonzero(small & (count[back] <= WIDTH))
        where, one = np.unique(slot[new], return_index=True)
        one = new[one]
        piece = back[one]
        n = count[piece]
        ids, step = np.zeros((len(one), WIDTH), self.kind), _steps(n)
        ids[np.repeat(np.arange(len(one)), n), step] = flat[np.repeat(begin[piece], n) + step]
        self.slots[where, :3] = key[:, one].T
        self.slots[where, 2] |= n.astype(np.uint64) << _AT
        self.slots[where, 3:] = ids.view(np.uint64)


def _steps(n: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of the lengths."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def piece_keys(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of pieces of at most WIDE bytes in three words, the length in
    the last one's top byte, so that different pieces have different keys; the
    byte below is left free."""
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    word = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    out = np.zeros((3, len(starts)), np.uint64)
    out[0] = word[starts] & _LOW[np.minimum(size, 8)]
    for k in (1, 2):
        long = np.flatnonzero(size > 8 * k)
        out[k, long] = word[starts[long] + 8 * k] & _LOW[np.minimum(size[long] - 8 * k, 8)]
    out[2] |= size.astype(np.uint64) << np.uint64(56)
    return out


def encoder(path: str, plain: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    key = f"{path} {plain}"
    if key not in _ready:
        _ready[key] = Encoder(path, plain)
    return _ready[key]


def forget() -> None:
    """Frees a reused worker's encoders; for stages that don't tokenise."""
    _ready.clear()
