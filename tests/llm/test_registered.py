"""Registered queries without SQL, on a whole small table, beside plain versions."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("decisium.llm")
from decisium.llm.queries import QUERIES  # noqa: E402

from . import helpers as H  # noqa: E402

DATA = "/root/testdata/sf0.001"
TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def rows(spark):
    return sorted(tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect())


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return [[*t.encode(text or "", add_special_tokens=False).ids, 2] for _, text, _ in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, rows, ids):
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op1_token_store"](spark, DATA).collect())
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    assert got == [(r[0], a, len(x), crc(x)) for r, a, x in zip(rows, starts, ids, strict=False)]


def test_op6(spark, rows, ids):
    got = QUERIES["op6_best_fit_packing"](spark, DATA).collect()
    want, counts = {}, {}
    for (d, *_), x in zip(rows, ids, strict=True):
        at, k = 0, 0
        while at < len(x):
            n = 1024 if k else (len(x) - 1) % 1024 + 1
            want[d, k] = (at, n, crc(x[at : at + n]))
            counts[n] = counts.get(n, 0) + 1
            at, k = at + n, k + 1
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
    assert sorted(sum(n for _, n in p) for p in bins.values()) == H.best_fit(counts, 1024)


def test_op8(spark, rows):
    got = {r["doc_id"]: r for r in QUERIES["op8_language_id"](spark, DATA).collect()}
    want = H.languages(rows)
    assert got.keys() == want.keys()
    for d, (lang, score) in want.items():
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert got[d]["lang_pred"] == lang and abs(got[d]["score"] - score) < 1e-5
