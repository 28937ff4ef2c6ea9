"""Small cases of faults that only showed on larger tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from decisium.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("seed", [14, 44, 49])
def test_temperature_rounds_as_sql(spark, tmp_path, seed):
    """The best temperature is just under a half of the last digit, its step of the grid is on it."""
    rng = np.random.default_rng(seed)
    x, labels = rng.normal(0, 0.15, (25, 64)).astype("f4"), rng.integers(0, 10, 25)
    t = pa.table({"vec_id": np.arange(25), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": labels.astype("i4")})
    pq.write_table(t, tmp_path / "embeddings.parquet")
    got = QUERIES["temperature_newton"](spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert sorted(map(tuple, got)) == sorted(c.execute(ORACLES["temperature_newton"]).fetchall())


@pytest.mark.parametrize("across", [False, True])
def test_shard_readers_share_no_list_of_files(tmp_path, across):
    """Many small files make few partitions, each of which names its own files only, in order of their numbers."""
    import pickle

    from decisium.sources.raw_shards import PARTITION_TOKENS, ShardReader

    numbers = [*range(99_400, 100_600)]
    for i in numbers:
        np.full(33, i, "<u4").tofile(tmp_path / f"shard-{i:05d}.bin")
    reader = ShardReader(f"file:{tmp_path}", 16, across)
    parts = reader.partitions()
    assert len(parts) <= 1 + 33 * len(numbers) // PARTITION_TOKENS * 2
    assert len(pickle.dumps(reader)) < 1000
    flat = [(s, w, ids) for p in parts for b in reader.read(p) for s, w, ids in zip(*(b.column(c).to_pylist() for c in ("shard", "window", "ids")), strict=True)]
    stream = [i for i in numbers for _ in range(33)]
    if across:
        assert flat == [(0, w, stream[16 * w : 16 * w + 17]) for w in range((len(stream) - 1) // 16)]
    else:
        assert flat == [(k, w, [i] * 17) for k, i in enumerate(numbers) for w in range(2)]


def test_loop_asks_the_store_for_little():
    """A key's steps come as rows, and its timer only moves with its last step."""
    from pyspark.sql import Row

    from decisium.streaming.loop import Loop

    class Handle:
        def __init__(self):
            self.calls, self.value = [], None

        def getValueState(self, *_):
            return self

        def __getattr__(self, name):
            return lambda *x: self.calls.append(name) or (self.value if name == "get" else setattr(self, "value", x[0]) if name == "update" else None)

    handle, loop = Handle(), Loop(["MOVE"], 4, 20, 100)
    loop.init(handle)
    step = Row("micros", "step", "action", "value", "x", "y")
    first = list(loop.handleInputRows(("a",), iter([step(2_000_000, 1, "MOVE", 4.0, 0.0, 0.0), step(1_000_000, 0, "MOVE", 2.0, 0.0, 0.0)]), None))
    assert [(r.step, r.stuck, r.moving, r.episode) for r in first] == [(0, False, 2.0, 1_000_000), (1, True, 3.0, 1_000_000)]
    assert handle.calls == ["get", "update", "registerTimer"]
    list(loop.handleInputRows(("a",), iter([step(3_000_000, 2, "MOVE", 6.0, 1.0, 0.0)]), None))
    assert handle.calls[3:] == ["get", "update", "deleteTimer", "registerTimer"]


def test_mixture_batches_grow_slower_than_rows(spark, tmp_path):
    """Eighty draws take few batches; rows that go on are still the first ones up to the budget, over several row groups."""
    from pyspark.sql import functions as F

    from decisium.sources import lazy

    (tmp_path / "in" / "a").mkdir(parents=True)
    pq.write_table(pa.table({"text": [f"{i} w w" for i in range(2000)]}), tmp_path / "in" / "a" / "0.parquet", row_group_size=300)
    state = lazy.draw_mixture(spark, f"{tmp_path}/in", {"a": 1.0}, 4800, F.size(F.split("text", " ")), f"{tmp_path}/out", draw=20, home=f"{tmp_path}/home")
    rows = spark.read.parquet(f"{tmp_path}/out").where("kept").orderBy("place").collect()
    assert [r["text"] for r in rows] == [f"{i} w w" for i in range(1600)] and state["a"]["tokens"] == 4800
    assert len(list((tmp_path / "home" / "ledger").glob("batch-*.json"))) <= 8
    reader = lazy.MixtureReader({"path": f"file:{tmp_path}/in", "ledger": f"{tmp_path}/none", "weights": '{"a": 1.0}', "tokens": "1"})
    parts = reader.partitions({"a": 250}, {"a": 700})
    assert [(p.group, p.place, p.first, p.last) for p in parts] == [(0, 250, 250, 300), (1, 300, 0, 300), (2, 600, 0, 100)]


def test_rotating_shards_share_folders(spark, tmp_path):
    """A file a shard, but a folder for many of them, and the lines of a shard are those of its places."""
    import json

    from decisium.sources.jsonl import read_rotating, write_rotating

    write_rotating(spark.range(1000).selectExpr("id * 7 AS k").repartition(5), f"{tmp_path}/out", 3, "k")
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) == 2
    assert len(list((tmp_path / "out").glob("*/part-*"))) == 334
    got = sorted((r["shard"], json.loads(r["value"])["k"]) for r in read_rotating(spark, f"{tmp_path}/out").collect())
    assert got == [(i // 3, 7 * i) for i in range(1000)]


def test_bpe_batches_make_no_object_a_word(monkeypatch):
    """Ids of a batch equal those of its texts one by one, in any script, and pieces
    of plain letters, digits and marks are merged without passing the pattern or the cache."""
    import random

    from decisium.operators import records as R
    from decisium.operators import tokenizers as K

    public = pytest.importorskip("public_tokenizers")
    make = K.byte_bpe(public.path("byte_bpe_50k.json"), R.special_tokens())
    own, plain, rng = make(), make(), random.Random(3)
    monkeypatch.setattr(K, "TEXT_BYTES", 3000)
    monkeypatch.setattr(K, "ID_COUNT", 1000)
    monkeypatch.setattr(K, "PIECES", 50)
    monkeypatch.setattr(K, "MOST_CACHED", 40)
    parts = [*"abz!('7\x7f\x1c\x85\n\t×÷éßüก世😀-\u3000\xa0", " ", " ", " ", "'s", "'ll", "<|ts_q|>", "<|ts_opt_1|>", "<|ts_opt_12|>", "<|ts_", "word", "Ärger", "x" * 40]
    texts = ["", None, "<|ts_", "q|>", *["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)]]
    texts += texts[:50]
    whole = iter(plain.encode_batch([t for t in texts if t is not None]))
    ids = own.encode_arrow(pa.array(texts))
    assert ids.to_pylist() == [None if t is None else next(whole) for t in texts]
    assert own.decode_arrow(ids).to_pylist() == texts
    cut = pa.array([None, *[rng.choices(range(50_000), k=rng.randrange(4)) for _ in range(500)]], pa.list_(pa.int32()))[3:]
    assert own.decode_arrow(cut).to_pylist() == [own.decode(x) for x in cut.to_pylist()]
    with pytest.raises(KeyError):
        own.decode_arrow(pa.array([[1, 1 << 20]], pa.list_(pa.int32())))

    own.cache.clear()
    own.encode_arrow(pa.array([" ".join(f"word{i} (Größe), {i}" for i in range(500))]))
    assert not own.cache


def test_intents_are_told_option_by_option(spark):
    """No map of all descriptions is made anew for each option; those that are told are the same."""
    import hashlib
    import json

    from decisium.operators import tasks as K

    intents = {f"n{i}": None if i % 7 == 0 else "" if i % 7 == 1 else i if i % 7 == 2 else f"d{i}" for i in range(60)}
    generated = json.dumps({"intents": intents, "utterances": [{"text": "t", "intent": f"n{i}"} for i in (3, 14)]})
    rows = spark.createDataFrame([(5, "en", generated, json.dumps({"labels": ["n3", "n14"]}))], "idx long, lang string, generated string, relabel string")
    df = K.TASKS["finegrained_intent"](rows, {})
    assert "map_filter" not in df._jdf.queryExecution().optimizedPlan().toString()
    h = lambda *key: int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16)
    got = {r["id"]: r["questions"][0] for r in df.collect()}
    assert set(got) >= {"5-0-0", "5-1-0"} and {len(q["options"]) for q in got.values()} <= {20, 40, 60}
    for id_, q in got.items():
        _, pos, j = id_.split("-")
        for o in q["options"]:
            told = h("intent-told", 5, pos, j, o["name"]) / 2**32 < 0.6
            assert o["desc"] == (str(intents[o["name"]]) if told and intents[o["name"]] else None)
