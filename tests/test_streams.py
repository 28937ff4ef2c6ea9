"""Streams: keyed state over restarts, requests with errors and repeats, lazy sources."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from decisium.streaming import loop as L

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(seconds):
    return int(T0.timestamp() + seconds) * 1_000_000


def steps(spark, rows):
    """rows: key, step, seconds, action, value, x, y."""
    return spark.createDataFrame([(k, s, T0 + dt.timedelta(seconds=t), a, v, x, y) for k, s, t, a, v, x, y in rows], "key string, step long, ts timestamp, action string, value double, x double, y double")


@pytest.fixture
def run(spark, tmp_path):
    def feed(rows, **kw):
        df = steps(spark, rows)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with L.state_store(spark):
            out = L.loop_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["MOVE"], **kw)
            out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return {(r["key"], r["step"]): r for r in spark.read.schema(L.OUT).parquet(f"{tmp_path}/out").collect()}

    return feed


def test_loop_state_goes_on(run):
    """State over restarts: history of four, mean, stuck by position after a move, late steps, a new episode."""
    run([("a", i, i, "MOVE" if i < 3 else "TURN", float(i), [0.0, 1.0, 1.0, 1.0, 1.0, 2.0][i], 0.0) for i in range(6)] + [(None, 0, 0, None, None, None, 1.0)], delay="1 hour")
    got = run([("a", 6, 6, "TURN", 6.0, 2.0, 0.0), ("a", 9, 2, "MOVE", 9.0, 2.0, 0.0), ("b", 0, 1, "MOVE", None, 5.0, 5.0), ("b", 1, 2, "MOVE", 4.0, 5.0, 5.0), ("a", 7, 5000, "TURN", 1.0, 2.0, 0.0)], delay="1 hour", idle=1000)
    assert [got["a", i]["stuck"] for i in range(6)] == [False, False, True, True, False, False]
    assert got["a", 6]["history"] == ["MOVE", "TURN", "TURN", "TURN"] and got["a", 6]["moving"] == 3.0 and not got["a", 6]["late"]
    assert got["a", 9]["late"] and got["a", 9]["moving"] is None
    assert (got["a", 7]["episode"], got["a", 7]["history"], got["a", 7]["moving"]) == (at(5000), [], 1.0)
    assert got["b", 1]["stuck"] and got["b", 0]["moving"] is None and got["b", 1]["moving"] == 4.0
    assert got[None, 0]["history"] == [] and not got[None, 0]["stuck"]


def test_loop_state_expires(run, spark):
    """Keys that the watermark leaves behind lose their state, and start anew later."""
    run([("a", 0, 0, "MOVE", 1.0, 0.0, 0.0), ("b", 0, 0, "MOVE", 1.0, 0.0, 0.0)], idle=100)
    run([("b", 1, 90, "MOVE", 1.0, 0.0, 0.0), ("b", 2, 500, "MOVE", 1.0, 0.0, 0.0)], idle=100)
    got = run([("a", 1, 600, "MOVE", 2.0, 0.0, 0.0)], idle=100)
    assert got["a", 1]["history"] == [] and not got["a", 1]["stuck"] and got["b", 1]["stuck"] and got["b", 2]["episode"] == at(500) and got["a", 1]["episode"] == at(600)


def mixture(spark, root, sizes):
    for k, n in sizes.items():
        spark.createDataFrame([(f"{k}{i} " + "w " * (i % 7),) for i in range(n)], "text string").coalesce(1).write.mode("append").parquet(f"{root}/{k}")
        spark.createDataFrame([(f"{k}{n + i} " + "w " * (i % 5),) for i in range(n)], "text string").coalesce(1).write.mode("append").parquet(f"{root}/{k}")


def test_mixture_ends_and_restarts(spark, tmp_path):
    """Sources are drawn in order up to their budgets; one that ends early closes; a stop and restart change nothing."""
    from decisium.sources import lazy

    mixture(spark, f"{tmp_path}/in", {"a": 200, "b": 10, "c": 300})
    weights, total, size = {"a": 0.5, "b": 0.3, "c": 0.2, "none": 0.01}, 900, F.size(F.split(F.trim("text"), " "))
    home = f"{tmp_path}/home"
    state = lazy.draw_mixture(spark, f"{tmp_path}/in", weights, total, size, f"{tmp_path}/out", draw=40, most_batches=2, home=home)
    assert state["a"]["tokens"] < 450
    state = lazy.draw_mixture(spark, f"{tmp_path}/in", weights, total, size, f"{tmp_path}/out", draw=40, home=home)
    rows = spark.read.parquet(f"{tmp_path}/out").where("kept").orderBy("source", "place").collect()
    for k in "abc":
        mine = [r for r in rows if r["source"] == k]
        everything = [r["text"] for name in sorted((tmp_path / "in" / k).glob("*.parquet")) for r in spark.read.parquet(str(name)).collect()]
        want, n = [], 0
        for t in everything:
            if n >= int(total * weights[k]):
                break
            want.append(t)
            n += len(t.split())
        assert [r["text"] for r in mine] == want and state[k]["tokens"] == n
    assert state["b"]["tokens"] < 270 and "none" not in state


def test_raw_shards(spark, tmp_path):
    """Every token in its place, in windows of one shard and over file ends; ids up to 2**32 - 1."""
    import numpy as np

    from decisium.sources import raw_shards as S

    rng = np.random.default_rng(1)
    stream = rng.integers(0, 2**32, 1000).tolist()
    stream[7] = 2**32 - 1
    pieces, at = [], 0
    while at < 1000:
        n = min(int(rng.integers(1, 40)), 1000 - at, 300 - at % 300)
        pieces.append((at // 300, at % 300, stream[at : at + n]))
        at += n
    rng.shuffle(pieces)
    path = f"file:{tmp_path}/raw"
    S.write_raw(spark.createDataFrame([(int(a), int(b), c) for a, b, c in pieces], "shard int, place long, ids array<long>").repartition(3), path)
    assert sorted(p.name for p in (tmp_path / "raw").glob("*")) == [f"shard-0000{i}.bin" for i in range(4)]
    assert [x for i in range(4) for x in np.fromfile(tmp_path / "raw" / f"shard-0000{i}.bin", "<u4").tolist()] == stream
    got = {(r["shard"], r["window"]): list(r["ids"]) for r in S.read_windows(spark, path, 16).collect()}
    assert got == {(s, w): stream[300 * s + 16 * w : 300 * s + 16 * w + 17] for s in range(4) for w in range((min(300, 1000 - 300 * s) - 1) // 16)}
    got = {r["window"]: list(r["ids"]) for r in S.read_windows(spark, path, 37, across=True).collect()}
    assert got == {w: stream[37 * w : 37 * w + 38] for w in range(999 // 37)}


def test_raw_shards_abort(spark, tmp_path):
    """A job that fails leaves no file behind."""
    from decisium.sources import raw_shards as S

    rows = spark.createDataFrame([(0, 0, [1, 2]), (1, 0, [-1])], "shard int, place long, ids array<long>")
    with pytest.raises(Exception, match="isn't a uint32"):
        S.write_raw(rows, f"file:{tmp_path}/raw")
    assert not list((tmp_path / "raw").glob("*"))


def test_requests(spark, tmp_path):
    """One answer or one error each over batches and restarts; a batch that is run again leaves one copy."""
    import json

    from decisium.operators.lexical import lexical_logits
    from decisium.streaming import requests as Q

    ask = lambda i, **kw: json.dumps({"id": i, "state": "red apples and a pear", "questions": {"q": {"type": "choice", "instructions": "what", "criteria": {"pear": None, "apples": "red"}}, "s": {"type": "score", "instructions": "how", "criteria": ["a", "b"]}}} | kw)
    first = [ask("1"), ask("1", state="other"), ask("2", model="m", permutations=3), "{", "[]", ask("3", questions={}), ask("4", state=None), ""]
    second = [ask("1", state="late"), "{", ask("5", permutations=0), ask("6", questions={"x": {"type": "noul", "instructions": "is it"}}), ask("7", state={"a": ["pear"]})]
    paths = [f"{tmp_path}/{x}" for x in ("in", "out", "ck")]
    for lines in (first, second):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(paths[0])
        Q.serve(spark, *paths, lambda r: lexical_logits(r, "key", flat=True), {"choice": 1.055})
    answers = {(r["request_id"], r["qid"]): r for r in spark.read.parquet(f"{tmp_path}/out/answers").collect()}
    assert sorted(answers) == [("1", "q"), ("1", "s"), ("2", "q"), ("2", "s"), ("6", "x"), ("7", "q"), ("7", "s")]
    assert answers["1", "q"]["answer"] == "apples" and answers["7", "q"]["answer"] == "pear" and answers["2", "q"]["model"] == "m" and answers["2", "q"]["orders"] == 2
    errors = [(r["error"], r["line"]) for r in spark.read.parquet(f"{tmp_path}/out/errors").collect()]
    assert sorted(e for e, _ in errors) == ["no question", "no state", "not an object", "not an object", "permutations must be 1 to 32"]


def test_lexical_many_options(spark, monkeypatch):
    """255 options; an index that is joined gives what a broadcast one gives."""
    from decisium.operators import lexical as X

    rows = [(i, f"word{i} common", [(f"Word{j}", "common" if j % 2 else None) for j in range(255)]) for i in range(9)] + [(9, None, [("a", None)]), (10, "x", [])]
    df = spark.createDataFrame(rows, "request_id long, state string, options array<struct<name:string,desc:string>>")
    got = {r["request_id"]: list(r["logits"]) for r in X.lexical_logits(df).collect()}
    assert all(max(range(255), key=got[i].__getitem__) == (i if i % 2 else max(range(255), key=got[i].__getitem__)) for i in range(9)) and got[3][3] > got[3][5] > got[3][4] == 0
    assert got[9] == [0.0] and got[10] == []
    monkeypatch.setattr(X, "INDEX_ROWS", 0)
    again = {r["request_id"]: list(r["logits"]) for r in X.lexical_logits(df).collect()}
    assert all(again[k] == pytest.approx(got[k]) for k in got)
