"""The trie of conversation prefixes, held to a trie built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("decisium.llm")
from decisium.llm import prefix_trie  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string"


def talks(seed, n=60):
    """Conversations with few texts, so that many prefixes are shared."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(120), n):
        for t in range(rng.choice([1, 2, 3, 5, 8, 12, 20])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hé", "", None, "yes, please"])))
    return rows


def trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    nodes = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for seq in nodes:
        if seq:
            children[seq[:-1]] += 1
    for seq, convs in nodes.items():
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += not children[seq]
            saved[seq[:d]] += (len(convs) - 1) * len(seq[-1][1].encode()) if seq else 0
    out = []
    for seq, convs in nodes.items():
        ends = ",".join(str(c) for c in sorted(convs) if whole[c] == seq)
        out.append((min(convs), len(seq), min(nodes[seq[:-1]]) if seq else None, len(convs), children[seq], leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=repr)


@pytest.mark.parametrize(("seed", "bits"), [(1, (64, 64, 64)), (2, (3, 6, 64)), (3, (1, 2, 64))])
def test_equals_trie(spark, monkeypatch, seed, bits):
    """Also with fingerprints of so few bits that they collide again and again."""
    monkeypatch.setattr(prefix_trie, "BITS", bits)
    rows = talks(seed)
    rows += [(None, 1, "user", "x"), (200, None, "user", "b"), (200, None, "user", "a"), (200, 0, "user", "a"), (200, 0, "user", "a"), (-7, 1, "user", "n"), (-6, 1, "user", "n"), (300, 1, "user", "long " * 5000)]
    assert got(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "2 as ord", "3 as h", "'x' as id").repartition(5)) == trie(rows)


def test_long_and_repeated(spark, monkeypatch):
    """One conversation of most turns, over many tasks and blocks, and one repeated by many."""
    monkeypatch.setattr(prefix_trie, "DEPTHS", 7)
    monkeypatch.setattr(prefix_trie, "RUN_IDS", 5)
    monkeypatch.setattr(spark.conf, "get", lambda k, *a, f=spark.conf.get: "9" if k == "spark.sql.shuffle.partitions" else f(k, *a))
    rows = [(5, t, "user", f"t{t % 7}") for t in range(300)] + [(10, t, "user", f"t{t % 7}") for t in range(150)]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(10)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == trie(rows)


def test_equal_hashes_of_texts(spark, monkeypatch):
    """Different texts with one hash keep apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(prefix_trie, "_content_hash", lambda: F.xxhash64("role", "text") % 3)
    rows = talks(4, 40)
    assert got(spark.createDataFrame(rows, SCHEMA)) == trie(rows)


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []


def test_scan():
    rng = np.random.default_rng(3)
    value = rng.integers(0, 2**63, 200).astype(np.uint64)
    new = rng.random(200) < 0.1
    new[0] = True
    first = np.maximum.accumulate(np.where(new, np.arange(200), 0))
    r, f, want = prefix_trie.SEEDS[0], 0, []
    for v, n in zip(value.tolist(), new.tolist(), strict=True):
        f = ((0 if n else f * r) + v) % 2**64
        want.append(f)
    assert prefix_trie.scan(value, first, r).tolist() == want
