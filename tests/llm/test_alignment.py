"""Token alignment, held to loops over the libraries' own tokens."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("decisium.llm")
P = pytest.importorskip("public_tokenizers")
from decisium.llm import alignment  # noqa: E402

from . import helpers as H  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["a▁b", " ", "  two  spaces ", "\ttab\n\nlines \n", "<s> x </s> <unk>", "<0x41><|endoftext|>", "é ﬁ \xa0z\x00\x1c", "naïve café — “quoted” 12345678 3.14", "мир 世界 สวัสดี 😀👨‍👩‍👧 ​", "aaaaaaaaaaaaaaaaaaaaaaa" * 40, "x1" * 3000, "=" * 777, "      def f(x):\n        return  x"]


def loops(texts):
    """Rows of all texts, tokenised whole, with groups cut where both end."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(A)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    docs, holders = [], defaultdict(int)
    for text in texts:
        groups, times = [], defaultdict(int)
        if text:
            ids_a = a_model.encode(" " + text, add_special_tokens=False).ids
            ids_b = b_model.encode(text)
            bytes_a = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
                i = j = 0
                for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
                    k, m = i, j
                    i, j = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
                    groups.append((ids_a[k:i], ids_b[m:j]))
        for ga, gb in groups:
            for x in ga:
                for y in gb:
                    times[x, y] += 1
        for p in times:
            holders[p] += 1
        docs.append((groups, times))
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    out = []
    for groups, times in docs:
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((sum(len(ga) for ga, _ in groups), sum(len(gb) for _, gb in groups), len(groups), sum(times.values()), sum(n for p, n in times.items() if holders[p] == best[p[0]]), sum(n * holders[p] for p, n in times.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("most", "block", "held"), [(1 << 21, 1 << 22, 1 << 22), (40, 8, 50), (0, 300, 1)])
def test_alignment(spark, monkeypatch, most, block, held):
    """With all counts broadcast, few of them and none; links in blocks; counts sent early."""
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
    rows = [r[:2] for r in H.corpus(31, 60)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (1001, "same id"), (1001, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pair", "2 as row", "3 as n").repartition(3)
    if block != 1 << 22:
        # workers import the module anew: set the limits there by hand
        monkeypatch.setattr(alignment, "BLOCK", block)
        monkeypatch.setattr(alignment, "HELD", held)
    got = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in alignment.cross_alignment(df, A, B).collect()), key=repr)
    assert got == sorted(((r[0], *x) for r, x in zip(rows, loops([r[1] for r in rows]), strict=True)), key=repr)


@pytest.mark.parametrize("block", [1, 7, 1 << 22])
def test_links_in_blocks(monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng = np.random.default_rng(5)
    n = 50
    sizes = rng.integers(1, 5, (2, n))
    groups = [np.repeat(np.arange(n), s) for s in sizes]
    ids = [rng.integers(0, 6, len(g)) for g in groups]
    doc = np.sort(rng.integers(0, 4, n))
    want = defaultdict(int)
    for i, g in enumerate(groups[0]):
        for j in np.flatnonzero(groups[1] == g):
            want[int(doc[g]), int(ids[0][i]) << 16 | int(ids[1][j])] += 1
    d, p, t, size = alignment.linked(doc, ids[0], ids[1], *groups)
    assert list(zip(d.tolist(), p.tolist(), strict=True)) == sorted(want) and t.tolist() == [want[k] for k in sorted(want)]
    assert size.tolist() == (sizes[0] * sizes[1]).tolist()


def test_groups_are_components():
    """Components of overlapping tokens are what lies between common ends."""
    rng = np.random.default_rng(6)
    for _ in range(30):
        n = int(rng.integers(1, 200))
        ends = [np.union1d(rng.choice(n, int(rng.integers(0, n)), replace=False) + 1, [n]) for _ in range(2)]
        common = np.intersect1d(*ends)
        got = alignment.groups_of(*ends)
        assert all((g == np.searchsorted(common, e)).all() for g, e in zip(got, ends, strict=True))


def test_empty_table(spark):
    assert alignment.cross_alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
