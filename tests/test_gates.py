"""Specs, gates, producers, zips and tasks on rows made for their edges."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from decisium.operators import records as R
from decisium.operators import tasks as K
from decisium.operators.driver import TASKS
from decisium.plans.converter_queries import DEFS
from decisium.sources.zipped import placed_lines, zipped
from decisium.streaming.producer import first_kept, produce


def spec(spark, question, label, **kw):
    df = spark.createDataFrame([(json.dumps(question), label)], "q string, l string")
    return df.select(R.question_to_spec(F.col("q"), F.col("l"), **kw).alias("s")).first()["s"]


CHOICE = {"type": "choice", "instructions": "which", "criteria": {"z": "last", "a": None, "m": "mid"}}


def test_question_to_spec(spark):
    s = spec(spark, CHOICE, "a")
    assert [o["name"] for o in s["options"]] == ["z", "a", "m"] and s["slot"] == 1 and s["error"] is None
    s = spec(spark, CHOICE, "a", drop=True)
    assert [o["name"] for o in s["options"]] == ["z", "m"] and s["slot"] == 255
    s = spec(spark, CHOICE, "m", order=F.array(F.lit(2), F.lit(0), F.lit(1)))
    assert ([o["name"] for o in s["options"]], s["order"], s["slot"]) == (["m", "z", "a"], [2, 0, 1], 0)
    s = spec(spark, CHOICE, "m", shuffle=True, key=F.lit("k"))
    assert sorted(s["order"]) == [0, 1, 2] and s["options"][s["slot"]]["name"] == "m"
    assert spec(spark, CHOICE, "q")["error"] == "label isn't an option"
    assert spec(spark, CHOICE | {"criteria": ["only"]}, "only", drop=True)["error"] == "can't drop the only option"
    assert spec(spark, CHOICE, None)["slot"] is None
    score = {"type": "score", "instructions": "how", "criteria": ["l", "m", "h"]}
    assert spec(spark, score, "2")["slot"] == 2 and spec(spark, score, "3")["error"] == "level out of range" and spec(spark, score, "-1")["error"] == "level out of range"
    assert spec(spark, score, "1", shuffle=True, drop=True)["order"] == [0, 1, 2]
    noul = {"type": "noul", "instructions": "is it"}
    assert spec(spark, noul, "true")["slot"] == 1 and spec(spark, noul, "False")["slot"] == 0 and spec(spark, noul, "x")["error"] == "label isn't true or false"
    assert spec(spark, {"type": "odd", "instructions": "x"}, "x")["error"] == "unknown type"


def test_gate_status(spark):
    asked = json.dumps({"c": CHOICE, "n": {"type": "noul", "instructions": "is it"}})
    own = {"c": "a", "n": True}
    rows = [(own, own, None), (own, {"c": " a ", "n": "yes"}, {"c": "a", "n": 1}), (own, {"c": "a"}, None), (own, own, {"c": "a", "n": False}), ({"c": "a"}, own, None), (None, own, None), (own, None, None)]
    df = spark.createDataFrame([(asked, *(None if x is None else json.dumps(x) for x in r)) for r in rows], "q string, a string, b string, c string")
    got = [r[0] for r in df.select(R.gate_status(F.col("q"), F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["ok", "leak", "disagree", "ok", "invalid", "invalid", "disagree"]
    assert df.select(R.gate_status(F.lit("[]"), F.col("a"), F.col("b"))).first()[0] == "invalid"


def test_producer(spark, tmp_path):
    """Kept is n, in order; launched little more than needed; a new start goes on."""
    rows = spark.range(5000).select(F.col("id").alias("place"))
    calls = []

    def gate(batch):
        calls.append(1)
        return batch.where("place % 4 = 0")

    done = produce(rows, gate, 100, str(tmp_path / "out"), cap=120, expected=0.5)
    assert done.kept >= 100 and done.launched <= 100 / 0.25 + 2 * 120 and max(n for n, _ in done.batches) <= 120
    kept = first_kept(spark.read.parquet(str(tmp_path / "out" / "batch=*")), 100)
    assert [r["place"] for r in kept.orderBy("place").collect()] == [4 * i for i in range(100)]
    before = len(calls)
    assert produce(rows, gate, 100, str(tmp_path / "out"), cap=120, expected=0.5).batches == done.batches and len(calls) == before
    none = produce(rows, lambda b: b.where("false"), 5, str(tmp_path / "none"), cap=2000, most=5000)
    assert (none.kept, none.launched) == (0, 5000)


def test_zip(spark, tmp_path):
    for name, n in (("a", 50), ("b", 47)):
        for part in range(3):
            rows = [(f"{name}{i}",) for i in range(n) if i * 3 // n == part]
            spark.createDataFrame(rows, "value string").coalesce(1).write.text(f"{tmp_path}/{name}/{part}")
    # small splits, so that files are read in several
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16b")
    try:
        a, b = placed_lines(spark, f"{tmp_path}/a"), placed_lines(spark, f"{tmp_path}/b")
        z = {r["place"]: (r["left"], r["right"]) for r in zipped(a, b).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert z == {i: (f"a{i}", f"b{i}" if i < 47 else None) for i in range(50)}
    assert zipped(a, b, "drop").count() == 47
    with pytest.raises(Exception, match="differ in length"):
        zipped(a, b, "forbid").collect()


def test_tasks_of_odd_objects(spark):
    """Objects of other forms are invalid, lists of other lengths drop what they should answer."""
    assert set(TASKS) == set(K.FIELDS)
    bad = [None, "", "nothing", "[]", '{"items": 3}', '{"items": [1, {"text": "x"}, {"text": 1, "unsafe": true}]}', '{"answerable_yesno": [{"q": "", "answer": "yes"}], "unanswerable": [{"q": "u"}]}']
    for name in TASKS:
        df = spark.createDataFrame([(i, "th" if i % 2 else "en", x, None, "p", "a", "d") for i, x in enumerate(bad)], "idx long, lang string, generated string, relabel string, passage string, article string, domain string")
        got = TASKS[name](df, DEFS).collect()
        assert [r["reason"] for r in got] == ["invalid"] * len(bad) and all(r["state"] is None and r["questions"] is None for r in got)
    one = json.dumps({"items": [{"text": "a", "unsafe": True}, {"text": "b", "unsafe": False}, {"text": "c", "unsafe": True}]})
    df = spark.createDataFrame([(1, "th", f"Here it is:\n```json\n{one}\n```", '{"unsafe": [true, 0]}')], "idx long, lang string, generated string, relabel string")
    got = {r["id"]: r for r in TASKS["safety"](df, DEFS).collect()}
    assert [got[f"1-{i}"]["reason"] for i in range(3)] == [None, "label differs", "unlabelled"]
    assert got["1-0"]["questions"][0]["instructions"] == K.TH["aegis2"][0] and json.loads(got["1-0"]["state"]) == {"user_message": "a"}


def test_seeds_change_draws(spark):
    """The same seed gives the same records, another one other draws; without one nothing changes."""
    from decisium.operators.driver import convert_all

    rows = spark.createDataFrame([(i, f"t{i}", i % 4) for i in range(40)], "row long, text string, label long")
    asked = lambda **kw: [r["questions"][0]["instructions"] for r in convert_all({"ag_news": (rows,)}, **kw)[0]["ag_news"].orderBy("id").collect()]
    assert asked(seed=1) == asked(seed=1) != asked(seed=2) and asked() == asked() != asked(seed=1)
