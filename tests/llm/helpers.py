"""Brute-force versions of the operators and small tables to hold them to."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [None, "", " ", "\n\n", "a", "a b", "a  b\tc\n", "Ünïcode Ça va", "日本語 テキスト 😀", "x" * 300, "ab " * 200, "<|endoftext|> a <|endoftext|>"]


def corpus(seed: int, n: int = 120) -> list[tuple]:
    """Rows with copies, near copies, shared lines and passages, and odd texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéñT") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    lines, passages = [say(rng.randint(5, 14)) for _ in range(4)], [say(60) for _ in range(3)]
    texts: list[str | None] = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.12:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.32:
            old = (rng.choice(texts) or "a b").split(" ")
            for _ in range(rng.randint(1, max(1, len(old) // 15))):
                old[rng.randrange(len(old))] = rng.choice(words)
            texts.append(" ".join(old))
        else:
            parts = [say(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))]
            parts += [rng.choice(lines) for _ in range(rng.randint(0, 2))] + [rng.choice(passages) for _ in range(rng.random() < 0.3)]
            rng.shuffle(parts)
            texts.append("\n".join(parts))
    texts += EDGES
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(3 * i, texts[k], rng.choice(["en", "fr", None]), f"s{i % 3}", len(texts[k] or "")) for i, k in enumerate(order)]


def links_to_components(n: list, links: list[tuple]) -> dict:
    up = {x: x for x in n}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in n}


def shingles(text: str | None, k: int) -> set:
    w = WORD.findall((text or "").translate(UPPER))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near(rows: list[tuple], k: int, percent: int = 80) -> dict:
    sets = {r[0]: shingles(r[1], k) for r in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = links_to_components(ids, links)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def phrases(rows: list[tuple], span: int = 13) -> dict:
    least: dict = {}
    words = {r[0]: WORD.findall(r[1] or "") for r in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - span + 1):
            least.setdefault(tuple(words[d][i : i + span]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - span + 1):
            if least[tuple(w[i : i + span])] < d:
                gone.update(range(i, i + span))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def substrings(rows: list[tuple], depth: int = 100) -> dict:
    seen, out = set(), {}
    for d, raw in sorted((r[0], (r[1] or "").encode()) for r in rows):
        gone = bytearray(len(raw))
        for i in range(len(raw) - depth + 1):
            s = raw[i : i + depth]
            if s in seen:
                gone[i : i + depth] = b"\1" * depth
            seen.add(s)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def contaminated(rows: list[tuple], items: list[tuple], span: int = 10) -> dict:
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(UPPER))
        m = min(span, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i : i + m])].add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for d, text, *_ in rows:
        w = ALNUM.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                got = windows.get(tuple(w[i : i + m]))
                if got:
                    hit.update(range(i, i + m))
                    found |= got
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def line_words(line: str) -> int:
    """Words of a line; in scripts without blanks some characters make one."""

    def quarters(c: str) -> int:
        o = ord(c)
        if 0x3040 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0x20000 <= o < 0x34000:
            return 2
        return int(0xE00 <= o < 0x10C0 or 0x1780 <= o < 0x1800)

    return sum(max(1, sum(map(quarters, w)) // 4) for w in WORD.findall(line))


def deduped_lines(rows: list[tuple], min_words: int = 10) -> dict:
    """Lines removed and text left of each document (null if no line is left):
    a line goes if it is in a run of lines, of min_words words, that a document
    with a smaller doc_id holds too. All runs of all documents are compared."""
    doc = {r[0]: [x for x in (r[1] or "").split("\n") if x] for r in rows}
    seen: dict = {}
    runs = {}
    for d in sorted(doc):
        x, size = doc[d], [line_words(y) for y in doc[d]]
        runs[d] = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1) if sum(size[i:j]) >= min_words]
        for i, j in runs[d]:
            seen.setdefault(tuple(x[i:j]), d)
    out = {d: {k for i, j in runs[d] if seen[tuple(doc[d][i:j])] < d for k in range(i, j)} for d in doc}
    kept = {}
    for d, text, *_ in rows:
        k, left = -1, []
        for line in (text or "").split("\n"):
            k += line != ""
            if line == "" or k not in out[d]:
                left.append(line)
        kept[d] = text if not out[d] else "\n".join(left) if len(out[d]) < len(doc[d]) else None
    return {d: (len(out[d]), kept[d]) for d in out}


def best_fit(counts: dict, size: int) -> list[int]:
    """Fill of each bin by best-fit decreasing, one piece at a time."""
    free: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            open_ = [(f, i) for i, f in enumerate(free) if f >= length]
            if open_:
                free[min(open_)[1]] -= length
            else:
                free.append(size - length)
    return sorted(size - f for f in free)


def bucket_counts(text: str | None) -> dict:
    """n-gram buckets of one text, by plain loops."""
    import unicodedata

    import numpy as np

    from decisium.llm import language_id

    out: dict = {}
    letters = [c.lower()[0] if c.isalpha() or unicodedata.category(c).startswith("M") else " " for c in text or ""]
    chars = " ".join(["", *"".join(letters).split(), ""]) if "".join(letters).strip() else " "
    for k in (1, 2, 3):
        for i in range(len(chars) - k + 1):
            g = chars[i : i + k]
            if " " in g[1:-1] or g == " " or (k > 1 and g[0] == " " == g[-1]):
                continue
            code = sum(ord(c) << (21 * (k - 1 - j)) for j, c in enumerate(g))
            b = int(language_id.mix(np.array([code], np.uint64))[0] >> np.uint64(49))
            out[b] = out.get(b, 0) + 1
    return out


def languages(rows: list[tuple]) -> dict:
    """(language, posterior) of each document by naive Bayes in plain loops."""
    import math
    import zlib

    from decisium.llm import language_id

    grams = {r[0]: bucket_counts(r[1]) for r in rows}
    train = [r for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    langs = sorted({r[2] for r in train})
    n = {x: defaultdict(int) for x in langs}
    docs = defaultdict(int)
    for r in train:
        docs[r[2]] += 1
        for b, k in grams[r[0]].items():
            n[r[2]][b] += k
    total = {x: sum(n[x].values()) + 0.5 * language_id.BUCKETS for x in langs}
    out = {}
    for d, text, *_ in rows:
        if not text or not any(c.isalpha() for c in text) or not langs:
            out[d] = ("und", 0.0)
            continue
        like = [sum(k * math.log((n[x][b] + 0.5) / total[x]) for b, k in grams[d].items()) for x in langs]
        prior = [math.log(docs[x] / len(train)) for x in langs]
        whole = [a + b for a, b in zip(like, prior, strict=True)]
        best = whole.index(max(whole))
        scale = min(1, language_id.SCORE_GRAMS / max(1, sum(grams[d].values())))
        low = [scale * a + b for a, b in zip(like, prior, strict=True)]
        out[d] = (langs[best], 1 / sum(math.exp(v - low[best]) for v in low))
    return out
