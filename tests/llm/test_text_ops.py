"""Near copies, phrases, substrings, lines and decontamination, held to brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("decisium.llm")
from decisium.llm import chunks, common, decontaminate, line_dedup, near_dup, phrase_dedup, suffix_dedup  # noqa: E402

from . import helpers as H  # noqa: E402


def table(spark, rows):
    return spark.createDataFrame(rows, H.SCHEMA)


def extra(df):
    """Columns whose names clash with those used inside."""
    return df.selectExpr("*", "1 as chunk", "2 as rep", "3 as sig", "4 as h", "5 as marks0", "6 as part", "7 as node")


@pytest.mark.parametrize(("seed", "shingle", "blocks"), [(1, 2, (512, 2048)), (2, 2, (2, 3)), (3, 5, (512, 2048))])
def test_near_duplicates(spark, seed, shingle, blocks, monkeypatch):
    monkeypatch.setattr(near_dup, "A_BLOCK", blocks[0])
    monkeypatch.setattr(near_dup, "B_BLOCK", blocks[1])
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 1_000_000 if blocks[0] > 2 else 0)
    rows = H.corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(extra(table(spark, rows)), shingle).collect()}
    assert got == H.near(rows, shingle)


def test_near_duplicates_chain_and_hot_lists(spark):
    """A chain of ever further copies, and many unlinked texts with one long shared part."""
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(10**6)
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(base), "en", "s", 0))
        base[rng.randrange(len(base))] = word()
    shared = " ".join(word() for _ in range(60))
    rows += [(100 + i, shared + " " + " ".join(word() for _ in range(40)), "en", "s", 0) for i in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(table(spark, rows), 2).collect()}
    assert got == H.near(rows, 2)


def test_least_shared():
    assert 15 <= near_dup.least_shared(80, 48) <= 25 and 45 <= near_dup.least_shared(80, 96) <= 60


def test_estimate():
    rng = np.random.default_rng(1)
    for _ in range(50):
        s, t = (np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in rng.integers(1, 300, 2))
        union = np.union1d(s, t)[: near_dup.KEEP]
        assert near_dup.estimate(s, t) == (len(np.intersect1d(np.intersect1d(union, s), t)), len(union))


def test_estimate_by_places(spark):
    """The same number from short forms, and never less if some fall together."""
    rng = np.random.default_rng(2)
    sets = [(np.unique(rng.integers(0, 900, n)), np.unique(rng.integers(0, 900, m))) for n, m in rng.integers(1, 300, (60, 2))]
    k = near_dup.SHORT

    def shorts(bits):
        rows = [(i, [int(x) * 7919 & bits for x in s[:k]], [int(x) * 7919 & bits for x in t[:k]]) for i, (s, t) in enumerate(sets)]
        return sorted(map(tuple, spark.createDataFrame(rows, "i int, s array<int>, t array<int>").select("i", *near_dup.union_shared("s", "t")).collect()))

    def real(s, t):
        least = set(sorted({*s.tolist(), *t.tolist()})[:k])
        return len(set(s[:k].tolist()) & set(t[:k].tolist())), len(least & set(s.tolist()) & set(t.tolist()))

    want = [real(s, t) for s, t in sets]
    assert [r[1:] for r in shorts(0x7FFFFFFF)] == want
    for r, (a, b) in zip(shorts(0xFF), want, strict=True):
        assert r[1] >= a and r[2] >= b


def test_near_duplicates_with_colliding_short_values(spark, monkeypatch):
    """All values of a sketch fall together in their short forms: no link is lost."""
    real = near_dup.short_sketches
    monkeypatch.setattr(near_dup, "short_sketches", lambda reps: real(reps).selectExpr("rep", "n", "transform(load, x -> x % 3) load"))
    rows = H.corpus(8)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(table(spark, rows), 2).collect()}
    assert got == H.near(rows, 2)


def test_ids_with_several_texts(spark):
    say = lambda x, n=40: " ".join(f"{x}{i}" for i in range(n))
    a, b = say("a"), say("b")
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, a + " x", "en", "s", 0), (3, b + " y", "en", "s", 0), (4, say("c"), "en", "s", 0)]
    for turn in (rows, rows[::-1]):
        got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(table(spark, turn), 2).collect()}
        assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}


def test_near_duplicates_of_long_texts(spark):
    words = [f"w{i}" for i in range(120_000)]
    other = [*words[:110_000], *(f"v{i}" for i in range(10_000))]
    rows = [(1, " ".join(words), "en", "s", 0), (2, " ".join(other), "en", "s", 0), (3, "z" * 400_000, "en", "s", 0), (4, " ".join(words[:80_000]), "en", "s", 0)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(table(spark, rows), 5).collect()}
    assert got == {1: (119_996, 1), 2: (119_996, 1), 3: (1, 3), 4: (79_996, 4)}


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c", "en", "s", 0), (1, "a b c", "en", "s", 0), (1, "a b c", "en", "s", 0), (2, "a b c", "en", "s", 0)]
    got = sorted(map(tuple, near_dup.near_duplicates(table(spark, rows), 2).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)], key=repr)
    assert near_dup.near_duplicates(table(spark, []), 2).collect() == []


@pytest.mark.parametrize(("seed", "part"), [(1, 1 << 15), (2, 3)])
def test_phrases(spark, seed, part, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(chunks, "PART_CHUNKS", part)
    monkeypatch.setattr(phrase_dedup, "BUCKET_WINDOWS", 1000)
    rows = H.corpus(seed)
    got = {r[0]: tuple(r)[1:4] for r in phrase_dedup.repeated_phrases(extra(table(spark, rows)).repartition(3)).collect()}
    assert got == H.phrases(rows)


@pytest.mark.parametrize(("seed", "letters", "part"), [(1, 2, 1 << 15), (2, 3, 1 << 15), (3, 2, 3)])
def test_phrases_of_few_words(spark, seed, letters, part, monkeypatch):
    """The same pieces stand in many passages; small parts, shards and blocks."""
    for module, name, value in ((chunks, "CHUNK_BYTES", 1500), (chunks, "PART_CHUNKS", part), (phrase_dedup, "BUCKET_WINDOWS", 500), (phrase_dedup, "PART_WORDS", 20), (phrase_dedup, "MOST_PATTERNS", 7), (phrase_dedup, "COMPARED", 5)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        words = [rng.choice("abc"[:letters]) for _ in range(rng.randrange(60))]
        if rows and i % 3 == 0:
            words += (rng.choice(rows)[1]).split()[5:40]
        rows.append((rng.randrange(100) * 60 + i, " \t".join(words), "en", "s", 0))
    got = {r[0]: tuple(r)[1:4] for r in phrase_dedup.repeated_phrases(table(spark, rows).repartition(3)).collect()}
    assert got == H.phrases(rows)


@pytest.mark.parametrize("span", [12, 13])
def test_phrase_patterns_locate_every_window(span):
    """Against a loop; passages share pieces and windows, one with two owners."""
    rng = random.Random(span)
    word = lambda n: rng.choice("abcdefgh"[:n]).encode()
    passages = [b" ".join(word(n) for _ in range(rng.randrange(span, 50))) for n in (1, 2, 2, 8, 8, 8)]
    passages += [passages[3], b" ".join(passages[4].split()[3 : 4 + span])]
    owner = np.array([5, 4, 9, 7, 8, 3, 2, 1])
    text = b" ".join([passages[5], b"q", passages[0], passages[4], b"x", *passages[3].split()[2:], passages[2]])
    w = text.split()
    want: dict = {}
    for passage, o in zip(passages, owner.tolist(), strict=True):
        v = passage.split()
        has = {tuple(v[i : i + span]) for i in range(len(v) - span + 1)}
        for i in range(len(w) - span + 1):
            if tuple(w[i : i + span]) in has:
                want[i] = min(o, want.get(i, o))
    start, who = phrase_dedup.locate(phrase_dedup.find(np.frombuffer(text, np.uint8), np.array([0, len(text)])), passages, owner, span)
    got: dict = {}
    for i, o in zip(start.tolist(), who.tolist(), strict=True):
        got[i] = min(o, got.get(i, o))
    assert got == want and len(want) > 60


def test_phrases_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, "en", "s", 0), (1, text, "en", "s", 0), (1, text, "en", "s", 0), (2, text, "en", "s", 0)]
    got = sorted(((r["doc_id"], r["n_removed"], r["runs"]) for r in phrase_dedup.repeated_phrases(table(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 0, []), (1, 0, []), (1, 0, []), (2, 30, [0, 30])], key=repr)
    assert phrase_dedup.repeated_phrases(table(spark, [])).collect() == []


@pytest.mark.parametrize(("seed", "part"), [(1, 1 << 15), (2, 3)])
def test_substrings(spark, seed, part, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(chunks, "PART_CHUNKS", part)
    monkeypatch.setattr(suffix_dedup, "BUCKET_ANCHORS", 300)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 40_000)
    rows = H.corpus(seed)
    got = {r[0]: tuple(r)[1:5] for r in suffix_dedup.repeated_bytes(extra(table(spark, rows)).repartition(3)).collect()}
    assert got == H.substrings(rows)


def test_substring_segments(monkeypatch):
    """Anchors don't depend on where segments end."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    data[1500:2900] = data[100:1500]
    offsets, known = np.array([0, 700, 700, 3000]), np.ones(3, bool)

    def windows():
        return {(int(h), int(p), i) for x in suffix_dedup.anchors(data, offsets, known, 100) for h, p, a, b in zip(*x, strict=True) for i in range(a, b + 1)}

    whole = windows()
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 150)
    assert windows() == whole and len(whole) == 601 + 2201


def test_substring_edges(spark):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(80))
    rows = [(None, text, "en", "s", 0), (1, text, "en", "s", 0), (1, text, "en", "s", 0), (2, text, "en", "s", 0), (3, "z" * 250, "en", "s", 0)]
    n = len(text)
    got = sorted(((r["doc_id"], r["n_removed"], r["spans"]) for r in suffix_dedup.repeated_bytes(table(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, 0, []), (1, 0, []), (1, 0, []), (2, n, [0, n]), (3, 249, [1, 250])], key=repr)
    assert suffix_dedup.repeated_bytes(table(spark, [])).collect() == []


def test_gram_hashes_tell_strings_apart():
    data = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz" * 3, np.uint8)
    h = suffix_dedup.gram_hashes(data)
    assert len(h) == len(data) - suffix_dedup.GRAM + 1
    assert len(set(h.tolist())) == 26 and (h[:26] == h[26:52]).all()


@pytest.mark.parametrize("limit", [None, 0])
def test_contamination(spark, limit, monkeypatch):
    if limit is not None:
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", limit)
    rows = H.corpus(4)
    rng = random.Random(2)
    items = []
    for k in range(40):
        words = (rng.choice(rows)[1] or "q").split()
        a = rng.randrange(len(words) or 1)
        items.append((k % 35, " ".join(words[a : a + rng.choice([1, 4, 9, 10, 11, 30])]).upper() + "."))
    items += [(90, None), (91, ""), (92, "!!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = H.contaminated(rows, items)
    got = decontaminate.contamination(extra(table(spark, rows)), bench).collect()
    for r in got:
        n, hit, k, names, _ = want[r["doc_id"]]
        m = r["marks"]
        assert (r["n_words"], sum(m[1::2]) - sum(m[::2]), len(r["items"])) == (n, hit, k)
        assert m == sorted(set(m)) and hashlib.sha256(",".join(r["items"]).encode()).hexdigest() == names
    assert len(got) == len(rows)
    assert decontaminate.contamination(table(spark, []), bench).collect() == []


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_contamination_edges(spark, limit, monkeypatch):
    """Repeated rows, null ids, a long text, columns with the names of added ones."""
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", limit)
    item = " ".join(f"k{i}" for i in range(10))
    rows = [(None, item, 1), (1, f"x {item}. y", 2), (1, f"x {item}. y", 2), (2, " ".join(f"w{i}" for i in range(150_000)) + " " + item, 3), (3, "", 4), (4, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, items int").selectExpr("*", "7 as n_words", "8 as key", "9 as `a.b`")
    bench = spark.createDataFrame([(5, item, "q"), (None, item, "r"), (6, "w3", "s")], "item_id long, text string, item string")
    got = sorted((tuple(r[c] for c in ("doc_id", "items_input", "n_words_input", "key", "a.b", "n_words", "marks", "items")) for r in decontaminate.contamination(df, bench).collect()), key=repr)
    both = ["5", "null"]
    want = [(None, 1, 7, 8, 9, 10, [0, 10], both), *[(1, 2, 7, 8, 9, 12, [1, 11], both)] * 2, (2, 3, 7, 8, 9, 150_010, [3, 4, 150_000, 150_010], [*both[:1], "6", "null"]), (3, 4, 7, 8, 9, 0, [], []), (4, 5, 7, 8, 9, 0, [], [])]
    assert got == sorted(want, key=repr)


def test_patience():
    assert line_dedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0, 3)]
    assert line_dedup.patience([1, 9, 2, 3], [1, 2, 3, 4]) == [(0, 0, 1), (2, 1, 2)]
    assert line_dedup.patience([1, 2], [3, 4]) == []
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in got)
        ends = [(i + n, j + n) for i, j, n in got]
        assert all(i >= p and j >= q for (i, j, _), (p, q) in zip(got[1:], ends, strict=False))


@pytest.mark.parametrize("seed", [6, 7])
def test_lines(spark, seed):
    rows = H.corpus(seed)
    got = line_dedup.line_dedup(extra(table(spark, rows)))
    assert {r["doc_id"]: (r["n_removed"], r["text"]) for r in got.collect()} == H.deduped_lines(rows)
    assert line_dedup.line_dedup(table(spark, [])).collect() == []


def test_contamination_of_many_items_alike(spark, monkeypatch):
    """A passage that many documents and items share makes a row a document and window."""
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 0)
    made = {}

    def counted(df, name, codec="zstd"):
        got = common.stored(df, name, codec)
        made[name] = got.count()
        return got

    monkeypatch.setattr(decontaminate, "stored", counted)
    passage = " ".join(f"p{i}" for i in range(14))
    rows = [(i, f"d{i} {passage} e{i}", "en", "s", 0) for i in range(500)] + [(500, "clean", "en", "s", 0)]
    items = [(k, f"{passage} {'x' * (k % 3)}") for k in range(400)] + [(400, "none of these")]
    got = decontaminate.contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = H.contaminated(rows, items)
    for r in got:
        n, _, k, names, hit = want[r["doc_id"]]
        assert (r["n_words"], len(r["items"]), bool(r["marks"])) == (n, k, hit) and hashlib.sha256(",".join(r["items"]).encode()).hexdigest() == names
    assert len(got) == 501 and made["hits"] == 2500 and made["common-prints"] == 500 and made["names"] == 1


@pytest.mark.parametrize("most", [1 << 10, 1 << 27])
def test_bloom_loses_nothing(spark, most):
    """Every value passes, few others do while there is room."""
    known = common.bloom(spark.range(5000).selectExpr("xxhash64(id) as h"), most).value
    h = np.array([r["h"] for r in spark.range(20_000).selectExpr("xxhash64(id) as h").collect()], np.int64)
    passed = common.maybe_in(known, h)
    assert len(known) * 64 <= most and passed[:5000].all()
    assert most < 1 << 20 or passed[5000:].mean() < 0.03
    assert not common.maybe_in(common.bloom(spark.range(0).selectExpr("xxhash64(id) as h")).value, h).any()


def long_rows():
    """Texts of over one chunk (1 MB), whose shared passage stands across its end."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    body = [word() for _ in range(150_000)]
    passage = body[131_000:131_400]
    return [(1, " ".join(body), "en", "s", 0), (2, " ".join([word() for _ in range(131_060)] + passage + [word() for _ in range(9000)] + passage), "en", "s", 0), (3, " ".join(passage), "en", "s", 0)]


def test_phrases_of_texts_over_a_chunk(spark):
    rows = long_rows()
    assert min(len(r[1]) for r in rows[:2]) > chunks.CHUNK_BYTES
    got = {r[0]: tuple(r)[1:4] for r in phrase_dedup.repeated_phrases(table(spark, rows)).collect()}
    assert got == H.phrases(rows) and got[2][1] == 800 and got[3][1] == 400


def test_substrings_of_texts_over_a_chunk(spark):
    rows = long_rows()
    got = {r[0]: tuple(r)[1:5] for r in suffix_dedup.repeated_bytes(table(spark, rows)).collect()}
    assert got == H.substrings(rows) and got[2][1] > 6000 and got[3][1] == len(rows[2][1])
