"""Tokenizers behind the common interface, and temperatures that are fitted."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from decisium.operators import calibration as C
from decisium.operators import decide as D
from decisium.operators import records as R
from decisium.operators import tokenizers as K

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
ODD = ["", " ", "a  b\n\n c", "don't we'll I'VE", "naïve café — “q” 12 345", "мир 世界 สวัสดี 😀👨‍👩‍👧", "<|endoftext|> x", "a" * 5000, "x1" * 700, "  \t tab", "\x00\x1c\x85"]


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()] + ODD + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    bpe = K.byte_bpe(P.path("byte_bpe_50k.json"))
    got = {r["i"]: r["ids"] for r in df.select("i", K.token_ids("text", bpe).alias("ids")).collect()}
    assert got == {i: None if t is None else library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    whole = {r["i"]: r["t"] for r in df.select("i", K.decoded(K.token_ids("text", bpe), bpe).alias("t")).collect()}
    assert whole == dict(enumerate(texts))


def test_control_tokens_and_measures(spark):
    bpe = K.byte_bpe(P.path("byte_bpe_50k.json"), R.special_tokens())
    t = K.made(bpe, "t")
    ids = t.encode_batch(["<|ts_state|>a<|ts_opt_12|><|ts_opt_1|>b<|ts_answer|>"])[0]
    assert [i - 50257 if i > 50256 else t.decode([i]) for i in ids] == [R.special_tokens().index("<|ts_state|>"), "a", R.special_tokens().index("<|ts_opt_12|>"), R.special_tokens().index("<|ts_opt_1|>"), "b", R.special_tokens().index("<|ts_answer|>")]
    df = spark.createDataFrame([("one two three four",), ("antidisestablishmentarianism",), (None,)], "text string")
    assert sorted(r[0] for r in K.within(df, "text", 4, K.measured_by(bpe)).collect()) == ["one two three four"]
    assert sorted(r[0] for r in K.within(df, "text", 20).collect()) == ["one two three four"]


@pytest.mark.parametrize("weight", [0.0, 0.5])
def test_calibration(spark, weight):
    """The slope vanishes, no temperature of a fine grid has less loss, and labels drawn at a temperature give it back."""
    rng = random.Random(7)
    rows = []
    for kind, k, t in (("choice", 6, 2.0), ("noul", 2, 0.5)):
        for _ in range(3000):
            z = [rng.gauss(0, 2) for _ in range(k + 1)]
            p = [math.exp(x / t) for x in z]
            y = rng.choices(range(k + 1), p)[0]
            rows.append((kind, z[:-1], z[-1], D.ABSTAIN if y == k else y))
    rows += [("choice", [1.0, 2.0], 0.0, D.IGNORE), ("score", [1.0, 2.0], 0.0, None)]
    df = spark.createDataFrame(rows, "qtype string, logits array<double>, abstain_logit double, label int").repartition(4)
    fit = C.calibrate(df, weight)
    assert set(fit) == {"choice", "noul"} and all(f["converged"] and abs(f["slope"]) < 1e-6 and f["rounds"] < 15 for f in fit.values())
    assert fit["choice"]["temperature"] == pytest.approx(2.0, rel=0.1) and fit["noul"]["temperature"] == pytest.approx(0.5, rel=0.1)
    for kind, f in fit.items():
        grid = D.fit_temperature(df.where(F.col("qtype") == kind).where("label <> -100"), [f["temperature"] * x for x in (0.9, 0.99, 1.0, 1.01, 1.1)], weight)
        losses = [r["loss"] for r in grid.orderBy("temperature").collect()]
        assert min(losses) == losses[2] and losses[2] == pytest.approx(f["loss"], abs=1e-9)


def test_calibration_without_rows(spark):
    assert C.calibrate(spark.createDataFrame([], "qtype string, logits array<double>, abstain_logit double, label int")) == {}
