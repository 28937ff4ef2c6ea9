"""Tokens, packing, language ID, URL filter and vectors, held to exact versions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("decisium.llm")
from decisium.llm import bpe, components, language_id, packing, token_store, url_filter, vector_links  # noqa: E402

from . import helpers as H  # noqa: E402

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_pieces_equal_the_library():
    rng = random.Random(1)
    texts = [r[1] for r in H.corpus(1)] + [" a", "a ", "a\n b", "a\n\nb", "'s'S '!", "12a3,4'5", "a×b", "\x1c a", "a\0b"]
    texts += ["".join(rng.choice("ab1 '.\n\té×s!<") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    e = bpe.encoder(TOKENIZER)
    for _ in range(2):
        ids, o = e.batch(pa.array(texts, pa.string()), 2)
        assert [ids[a:b].tolist() for a, b in zip(o[:-1], o[1:], strict=True)] == [[*x, 2] for x in plain_ids(texts)]


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 63, 64, 1000, 70_000):
        ids = (rng.zipf(1.3, n) % 5000).astype(np.uint32)
        table = token_store.Table.of(np.bincount(ids, minlength=6000))
        assert n == 0 or int(table.freq.sum()) == 1 << token_store.SCALE
        raw = token_store.encode_block(ids, table, lanes=16, every=32)
        assert (token_store.decode_block(raw, table) == ids).all()
        for _ in range(5):
            lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (token_store.decode_block(raw, table, lo, hi) == ids[lo:hi]).all()


def test_crc32_join():
    raw = np.random.default_rng(1).integers(0, 256, 999, dtype=np.uint8).tobytes()
    assert token_store.crc32_join([zlib.crc32(raw[:100]), zlib.crc32(b""), zlib.crc32(raw[100:])], [100, 0, 899]) == zlib.crc32(raw)


@pytest.mark.parametrize("block", [1 << 18, 500])
def test_token_store(spark, tmp_path, block):
    rows = H.corpus(2) + [(None, "no id", "en", "s", 0), (7, "twice", "en", "s", 0), (7, "twice", "en", "s", 0)]
    docs = spark.createDataFrame(rows, H.SCHEMA).selectExpr("*", "1 as part", "2 as start", "3 as ids").repartition(3)
    path = str(tmp_path / "t")
    token_store.write(docs, path, TOKENIZER, block=block)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.documents(spark, path).collect()), key=lambda r: r[1])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [[*x, 2] for x in plain_ids([r[1] for r in order])]
    starts = np.cumsum([0, *map(len, ids)])
    assert got == [(r[0], int(a), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x, a in zip(order, ids, starts, strict=False)]
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    firsts = [r["first"] for r in blocks if r["part"] == 0]
    assert firsts == sorted(firsts) and all(r["n_tokens"] <= block for r in blocks)
    if block == 500:
        assert len(blocks) > 10 and sum(r["pieces"] > 1 for r in token_store.read(spark, path).collect()) > 5
    flat = [x for i in ids for x in i]
    for lo, hi in ((0, len(flat)), (137, 1404), (len(flat) - 1, len(flat) + 9), (5, 5)):
        parts = sorted(token_store.read_range(spark, path, lo, hi).collect())
        assert [x for p in parts for x in p["ids"]] == flat[lo:hi]
        assert [p["start"] for p in parts] == [lo + sum(len(q["ids"]) for q in parts[:k]) for k in range(len(parts))]


def test_stretches_decode_alone():
    ids = (np.random.default_rng(2).zipf(1.3, 5000) % 900).astype(np.uint32)
    table = token_store.Table.of(np.bincount(ids, minlength=900))
    raw = token_store.encode_block(ids, table, lanes=16, every=8)
    assert token_store.stretch(raw) == 128
    for lo, hi in ((0, 128), (128, 300), (200, 5000), (4990, 5000), (7, 9)):
        cut = token_store.part_of(raw, lo, hi)
        assert (token_store.decode_block(cut, table, lo, hi) == ids[lo:hi]).all()
    assert len(token_store.part_of(raw, 0, 128)) < len(raw) / 3


def test_pieces_of_long_texts():
    """A word of 300,000 letters, a text of 400,000 words, and pieces as long as slots hold."""
    rng = random.Random(6)
    texts = ["q" * 300_000, " ".join(rng.choice(["a", "bé", "12", "c!"]) * rng.randint(1, 3) for _ in range(400_000)), *["z" * n + " " + "y" * n for n in range(18, 28)]]
    e = bpe.encoder(TOKENIZER)
    ids, o = e.batch(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(o[:-1], o[1:], strict=True)] == plain_ids(texts)


def test_token_store_damage_and_empty(spark, tmp_path):
    empty = spark.createDataFrame([], H.SCHEMA)
    token_store.write(empty, str(tmp_path / "e"), TOKENIZER)
    assert token_store.documents(spark, str(tmp_path / "e")).collect() == []
    token_store.write(spark.createDataFrame([(1, "a b", "en", "s", 3)], H.SCHEMA), str(tmp_path / "d"), TOKENIZER)
    path = str(tmp_path / "d" / "blocks")
    rows = spark.read.parquet(path).collect()
    bad = [r.asDict(True) | {"payload": bytes([r["payload"][0] ^ 1]) + bytes(r["payload"][1:])} for r in rows]
    spark.createDataFrame(bad, token_store.BLOCKS).write.mode("overwrite").parquet(path)
    with pytest.raises(Exception, match="damaged payload"):
        token_store.documents(spark, str(tmp_path / "d")).collect()


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(150):
        size = rng.choice([1, 7, 16, 50])
        counts = {i: rng.randint(0, 40) for i in range(1, size + 1) if rng.random() < 0.6}
        bins: dict = {}
        for length, runs in packing.plan(counts, size).items():
            n = 0
            for rank, each, first, many, offset in runs:
                assert rank == n
                n += each * many
                for b in range(first, first + many):
                    bins.setdefault(b, []).extend((offset + t * length, length) for t in range(each))
            assert n == counts[length]
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
        assert sorted(sum(x for _, x in p) for p in bins.values()) == H.best_fit(counts, size)


def test_packing(spark):
    rows = H.corpus(5)
    docs = spark.createDataFrame(rows, H.SCHEMA).selectExpr("*", "1 as rank", "2 as part").repartition(3)
    got = packing.pack(docs, TOKENIZER, size=64).collect()
    want, counts = {}, {}
    for (d, *_), ids in zip(rows, plain_ids([r[1] for r in rows]), strict=True):
        ids, at, k = [*ids, 2], 0, 0
        while at < len(ids):
            n = 64 if k else (len(ids) - 1) % 64 + 1
            want[d, k] = (at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))
            counts[n] = counts.get(n, 0) + 1
            at, k = at + n, k + 1
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    assert sorted(sum(x for _, x in p) for p in bins.values()) == H.best_fit(counts, 64)
    assert packing.pack(spark.createDataFrame([], H.SCHEMA), TOKENIZER).collect() == []


def test_language_id(spark):
    rng = random.Random(1)
    words = {"aa": ["bobo", "lalu", "kiri"], "bb": ["stren", "grolt", "plurk"], "cc": ["çéñ", "ñuñé", "éç"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randint(1, 60))), x if rng.random() < 0.9 else None, "s", 0) for i in range(300) for x in [rng.choice("abc") * 2]]
    truth = {r[0]: next(k for k, w in words.items() if r[1].split()[0] in w) for r in rows}
    rows += [(1000, None, "aa", "s", 0), (1001, "", "bb", "s", 0), (1002, "12 + 3 = 15!", "bb", "s", 0), (None, "bobo", "aa", "s", 0)]
    docs = spark.createDataFrame(rows, H.SCHEMA)
    model = language_id.fit(docs)
    assert model.langs == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in language_id.predict(docs.selectExpr("*", "1 as score", "2 as bucket"), model).collect()}
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 40 and all(got[k]["lang_pred"] == truth[k] for k in held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # labels of held-out rows don't matter
    other = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'zz', lang) lang")
    again = language_id.fit(other)
    assert again.langs == model.langs and all(np.allclose(a.logp, b.logp) for a, b in zip(again.blocks(), model.blocks(), strict=True))
    none = spark.createDataFrame([], H.SCHEMA)
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(none)).collect()} == {"und"}
    assert language_id.predict(none, model).collect() == []


def test_ngrams_stay_within_texts():
    texts = ["ab c", None, "", "  Dé!x ", "z", "q1q"]
    texts += ["ไทยไม่มีช่องว่าง ÀÉ", "我们 we", "İß 𝔄𐐀x😀"]
    grams, owners, letters = language_id.buckets(pa.array(texts, pa.string()))
    assert letters.tolist() == [any(c.isalpha() for c in x or "") for x in texts]
    want = np.zeros(language_id.BUCKETS, np.int64)
    for x in texts:
        for b, n in H.bucket_counts(x).items():
            want[b] += n
    assert (sum(np.bincount(g, minlength=language_id.BUCKETS) for g in grams) == want).all()
    for g, o in zip(grams, owners, strict=True):
        assert o[0] == 0 and o[-1] == len(g) and (np.diff(o) >= 0).all()


def test_languages_equal_loops_over_blocks(spark, monkeypatch):
    """300 labels, more than a block holds, beside plain loops; repeated rows, null ids and labels, long and odd texts."""
    rng = random.Random(3)
    alphabet = [chr(c) for c in (*range(97, 123), *range(0x3B1, 0x3C9), *range(0xE01, 0xE2E), *range(0x4E00, 0x4E40))]
    words = {f"l{i:03}": ["".join(rng.choices(alphabet, k=5)) for _ in range(4)] for i in range(300)}
    rows = [(5 * i + j, " ".join(rng.choices(w, k=rng.randint(1, 30))), x, "s", 0) for i, (x, w) in enumerate(words.items()) for j in range(3)]
    rows += [(9000, "x" * 300_000, None, "s", 0), (9001, None, "zz", "s", 0), (9002, "1 2 !", "l001", "s", 0), rows[0]]
    docs = spark.createDataFrame(rows, H.SCHEMA)
    model = language_id.fit(docs)
    assert len(model.langs) > 280 and len(list(model.blocks())) == 5
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    want = H.languages(rows)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-4 for k in want)


def test_language_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "ab", 0.5, 7, "q")], "doc_id long, text string, score double, total int, `x.y` string")
    (r,) = language_id.predict(df, language_id.Model([], [], None)).collect()
    assert r.asDict() == {"doc_id": 1, "text": "ab", "score_input": 0.5, "total": 7, "x.y": "q", "lang_pred": "und", "score": 0.0}


def test_held_out_accuracy(spark):
    """On documents in four languages, of rows that weren't learned from."""
    path = "/root/testdata/sf0.001/documents.parquet"
    if not __import__("os").path.exists(path):
        pytest.skip("no test data")
    docs = spark.read.parquet(path)
    rows = language_id.predict(docs, language_id.fit(docs)).where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 and lang is not null").collect()
    assert len(rows) > 30 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


URLS = [None, "", "nohost/path", "http://A.example.ORG/es/x", "https://example.org/en/1", "https://example.org/en/12?x#y", "https://example.org", "https://example.org?q", "ftp://notexample.org/es/", "http://x.com/fr/", "http://com/de/", "http://a.b.com/de/1", "http://x.net/", "http://example.org/es", "a://b://c.org/x", "http://u@host:80/p"]


def brute_rule(host, path, rules):
    fit = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, "allow")


@pytest.mark.parametrize("small", [True, False])
def test_url_filter(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    rules = [*url_filter.RULES, ("block", "x.com", "/fr/"), ("allow", "x.com", "/fr/"), *[("block", f"h{i}.io", f"/p{i}") for i in range(300)]]
    urls = [*URLS, *URLS[:3], *[f"https://www.h{i}.io/p{i}/z" for i in range(0, 400, 7)]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as host", "2 as block", "3 as rule")
    got = {r["page_id"]: r for r in url_filter.url_filter(pages, spark.createDataFrame(rules, "action string, host string, path string")).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end].translate(H.UPPER), rest[end:].split("?")[0].split("#")[0]
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert (got[i]["rule"], got[i]["verdict"]) == brute_rule(host, path, rules)
    none = spark.createDataFrame([], "action string, host string, path string")
    assert {r["verdict"] for r in url_filter.url_filter(pages, none).collect()} == {"allow"}


def test_url_filter_has_no_python(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    df = url_filter.url_filter(pages, spark.createDataFrame(url_filter.RULES, "action string, host string, path string"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(80)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == H.links_to_components(sorted({x for p in real for x in p}), real)


def brute_links(rows, least):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    pairs = [(a, b) for k, (a, x) in enumerate(good) for b, y in good[k + 1 :] if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least]
    comp = H.links_to_components([i for i, _ in rows if i is not None], pairs)
    return {i: (sum(i in p for p in pairs), comp[i], comp[i] == i) for i in comp}


def test_vector_links(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "LIST_SIZE", 16)
    monkeypatch.setattr(vector_links, "MEMBER_BLOCK", 20)
    monkeypatch.setattr(vector_links, "QUERY_BLOCK", 30)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = [centres[rng.integers(12)] + rng.normal(size=24) * rng.choice([0.05, 0.25, 0.4]) for _ in range(260)]
    x += [x[0]] * 25 + [2 * x[1]] + [list(rng.normal(size=24)) for _ in range(40)]
    rows = [(2 * i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(901, None), (903, []), (905, [0.0] * 24), (907, [None] + [1.0] * 23), (909, [float("nan")] * 24), (911, [1.0, 0.0]), (913, [1.0, 0.1]), (915, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as label", "2 as cell", "3 as rep")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_links.linked_vectors(df).collect()}
    want = brute_links(rows, 0.9)
    assert set(got) == set(want)
    found, real = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert real > 1000 and found <= real and found >= 0.9 * real
    assert all(got[k][0] <= want[k][0] for k in want)
    assert {k: got[k] for k in want if k > 900} == {k: want[k] for k in want if k > 900}
    assert vector_links.linked_vectors(df.limit(0)).collect() == []


def test_recall_with_many_more_lists_than_probes(spark, monkeypatch):
    """Pairs at cosines just over the threshold among spread vectors, 500 lists."""
    monkeypatch.setattr(vector_links, "LIST_SIZE", 6)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.93, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * side]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = []
    real = vector_links.train
    monkeypatch.setattr(vector_links, "train", lambda *a: made.append(real(*a)) or made[-1])
    got = {r["vec_id"]: r["n_links"] for r in vector_links.linked_vectors(df).collect()}
    assert len(made[0].coarse) >= 20 * vector_links.PROBES
    v = np.array([r[1] for r in rows])
    links = (v @ v.T / np.outer(*[np.linalg.norm(v, axis=1)] * 2) >= 0.9).sum(1) - 1
    assert links.sum() >= 3000 and all(got[i] <= n for i, n in enumerate(links.tolist()))
    recall = sum(got.values()) / links.sum()
    assert recall >= 0.97, recall


def test_repeated_vectors_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (None, None), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rows", "2 as v")
    got = sorted((tuple(r) for r in vector_links.linked_vectors(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (None, 0, None, True), (None, 0, None, True)], key=repr)


def test_packing_of_odd_rows(spark):
    """Null ids, repeated rows, a long text."""
    rows = [(None, "a b", "en", "s", 0), (1, "x", "en", "s", 0), (1, "x", "en", "s", 0), (2, "word " * 30_000, "en", "s", 0), (3, None, "en", "s", 0)]
    got = packing.pack(spark.createDataFrame(rows, H.SCHEMA), TOKENIZER, size=64).collect()
    want = sum(len(x) + 1 for x in plain_ids([r[1] for r in rows]))
    assert sum(r["length"] for r in got) == want
    assert sum(r["doc_id"] == 1 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
    long = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 2)
    assert [s for _, s, _ in long] == np.cumsum([0, *(n for *_, n in long)])[:-1].tolist() and all(n == 64 for k, _, n in long if k)
