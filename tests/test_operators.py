"""Edges of the operators on small tables."""

from __future__ import annotations

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from decisium.functions import text as T
from decisium.functions.rand import hash32, uniform
from decisium.operators import decide as D
from decisium.operators import metrics as M
from decisium.operators import mixture as X
from decisium.operators import records as R
from decisium.sources import jsonl


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]


def test_hash_is_known(spark):
    assert one(spark, F.conv(F.substring(F.md5(F.lit("abc")), 1, 8), 16, 10).cast("long"))[0] == 2416005272
    u = spark.range(2000).select(uniform("s", "id").alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).collect()[0]
    assert 0.45 < u[0] < 0.55 and u[1] >= 0 and u[2] < 1
    assert one(spark, hash32("a", F.lit(1)) == hash32("b", F.lit(1)))[0] is False


@pytest.mark.parametrize(("k", "n", "want"), [(11, 8, [0, 1, 3, 4, 6, 7, 8, 10]), (20, 8, [0, 2, 5, 8, 10, 12, 15, 18]), (5, 2, [0, 2]), (1, 8, [0]), (3, 3, [0, 1, 2])])
def test_cyclic_shifts(spark, k, n, want):
    assert one(spark, D.cyclic_shifts(F.lit(k), F.lit(n)))[0] == want


@pytest.mark.parametrize(("counts", "asked", "want"), [([5], None, 1), ([20, 3], None, 8), ([11], None, 8), ([3], 8, 3), ([], 8, 1), ([20], 1, 1), ([300], 32, 32)])
def test_order_count(spark, counts, asked, want):
    assert one(spark, D.order_count(F.array(*[F.lit(c) for c in counts]).cast("array<int>"), F.lit(asked).cast("int")))[0] == want


def test_requested_orders(spark):
    assert list(one(spark, D.requested_orders(F.lit(4), F.lit(True)), D.requested_orders(F.lit(None).cast("int"), F.lit(True)), D.requested_orders(F.lit(None).cast("int"), F.lit(False)), D.requested_orders(F.lit(None).cast("int"), F.lit(None).cast("boolean")))) == [4, 8, 1, None]


def test_confidence_ends(spark):
    xs = [[1.0, 0.0, 0.0], [1 / 3] * 3, [1.0], [0.5, 0.5]]
    got = one(spark, *[D.confidence(F.array(*[F.lit(x) for x in xs_])) for xs_ in xs])
    assert [round(x, 6) for x in got] == [1.0, 0.0, 1.0, 0.0]


def test_first_tie_wins(spark):
    assert one(spark, D.best_slot(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))))[0] == 1


def test_probabilities_add_up_and_shift_free(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-900, 900) for _ in range(rng.randint(1, 255))], rng.uniform(-5, 5)) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, logits array<double>, abstain_logit double")
    for r in D.with_probabilities(df).collect():
        assert math.isclose(sum(r["p"]) + r["p_abstain"], 1, abs_tol=1e-9)
        assert sum(r["pk"]) < 1 + 1e-9


@pytest.mark.parametrize(("k", "n"), [(2, 3), (255, 256), (0, 2)])
def test_slot_mask(spark, k, n):
    assert one(spark, F.size(F.filter(F.sequence(F.lit(0), F.lit(255)), lambda j: D.slot_valid(F.lit(k), j))))[0] == n


def test_bins_next_to_bounds(spark):
    xs = [0.0, 0.1, 0.3, 0.6, 0.7, math.nextafter(0.9, 0), 0.9, 1.0]
    assert list(one(spark, *[M.bin_of(F.lit(x)) for x in xs])) == [0, 1, 3, 6, 7, 8, 9, 9]


def test_macro_f1_of_absent_labels(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 0, 0)], "g string, truth int, pred int")
    got = {r["g"]: (round(r["macro_f1"], 6), r["labels"]) for r in M.macro_f1(df, ["g"]).collect()}
    assert got == {"a": (round((2 / 3 + 0) / 2, 6), 2), "b": (1.0, 1)}


TH = "ทดสอบ" * 60


@pytest.mark.parametrize(("text", "ok"), [(TH, True), (TH[:100], False), ("a" * 300, False), ("\n".join([TH[:50]] * 10), False), (TH + " http" * 5, False), (TH + "สล็อต" * 4, False), (None, False), ("", False)])
def test_thai_quality(spark, text, ok):
    assert one(spark, T.quality(F.lit(text).cast("string")))[0] is ok


def test_text_functions(spark):
    got = one(spark, T.strip(F.lit("  a b \n")), T.sanitize(F.lit("x<|ts_q|>")), T.script_ratio(F.lit("กa")), T.occurrences(F.lit("aaaa"), "aa"), T.other_script(F.lit("日本")), T.other_script(F.lit("ไทยé😀")))
    assert list(got) == ["a b", "x<​|ts_q|>", 0.5, 2, True, False]


@pytest.mark.parametrize(
    ("text", "want"),
    [("```json\n{\"a\": 1}\n```", {"a": 1}), ("so: {\"a\": {\"b\": 2}} ok", {"a": {"b": 2}}), ("{broken", None), ("{\"a\": }", None), ("none", None), (None, None)],
)
def test_salvage(spark, text, want):
    got = one(spark, T.salvage_json(F.lit(text).cast("string")))[0]
    assert (json.loads(got) if got else None) == want


@pytest.mark.parametrize(
    ("qtype", "kind", "raw", "want"),
    [("choice", "string", "x", "x"), ("score", "string", "2.7", None), ("score", "number", "2.7", "2"), ("score", "number", "-1.5", "-1"), ("score", "boolean", "true", "1"), ("noul", "string", "ใช่", "true"), ("noul", "string", "no", "false"), ("noul", "number", "0", "false"), ("other", "string", "x", None)],
)
def test_normal_label(spark, qtype, kind, raw, want):
    assert one(spark, T.normal_label(F.lit(qtype), F.lit(kind), F.lit(raw)))[0] == want


@pytest.mark.parametrize(("n", "ok"), [(1, True), (255, True), (256, False), (0, False)])
def test_option_limits(spark, n, ok):
    names = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: i.cast("string"))
    assert (one(spark, R.request_error(F.lit("choice"), F.slice(names, 1, n)))[0] is None) is ok


def test_criteria_keep_their_order(spark):
    got = one(spark, F.map_keys(F.from_json(F.lit('{"z": null, "a": "q"}'), "map<string,string>")))[0]
    assert got == ["z", "a"]


def test_render_layout(spark):
    opts = F.array(F.struct(F.lit("a").alias("name"), F.lit("desc").alias("desc")), F.struct(F.lit("b").alias("name"), F.lit(None).cast("string").alias("desc")))
    assert one(spark, R.render(F.lit("choice"), F.lit("x"), opts))[0] == "<|ts_q|><|ts_choice|> x\n<|ts_opt_0|> a: desc\n<|ts_opt_1|> b\n<|ts_answer|>\n"


@pytest.mark.parametrize(("budget", "want"), [(10, [1, 2, 3, 4, 5]), (5, [1, 2, 3, 4, 5]), (3, [1, 4, 5]), (1, [1]), (0, [1]), (-4, [1])])
def test_head_and_tail(spark, budget, want):
    assert one(spark, R.head_and_tail(F.array(*[F.lit(i) for i in range(1, 6)]), budget))[0] == want


def test_label_slot(spark):
    names = F.array(F.lit("a"), F.lit("b"))
    assert list(one(spark, R.label_slot(names, F.lit("b")), R.label_slot(names, F.lit(None).cast("string")), R.label_slot(names, F.lit("q")))) == [1, -100, None]


def test_whole_families_equal_the_loop(spark):
    rng = random.Random(4)
    for limit in (5, 17):
        rows = [(i, f"f{rng.randrange(14)}", "xyz"[rng.randrange(3)]) for i in range(30)]
        df = spark.createDataFrame(rows, "id int, fam string, dom string")
        h = {r["fam"]: r["h"] for r in df.select("fam").distinct().withColumn("h", hash32("s", "fam")).collect()}
        fam: dict = {}
        for i, f, d in rows:
            fam.setdefault(f, [d, []])[1].append(i)
        queue = {d: sorted((f for f in fam if fam[f][0] == d), key=lambda f: (h[f], f)) for d in {v[0] for v in fam.values()}}
        want: list = []
        k = 0
        while True:
            turn = [queue[d][k] for d in sorted(queue) if k < len(queue[d])]
            stop = not turn
            for f in turn:
                if len(want) + len(fam[f][1]) > limit:
                    stop = True
                    break
                want += fam[f][1]
            if stop:
                break
            k += 1
        got = [r["id"] for r in X.whole_families(df, limit, "s", "id", "fam", "dom").collect()]
        assert sorted(got) == sorted(want)


def test_running_offset_and_shards(spark):
    rng = random.Random(3)
    rows = [(i * 7, rng.choice([0, 1, 5, 40])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, n long")
    got = {r["id"]: r["offset"] for r in X.running_offset(df, "id", "n", width=16).collect()}
    at = 0
    for i, n in rows:
        assert got[i] == at
        at += n
    parts = X.shards_of(X.running_offset(df, "id", "n", width=16), 64, "n").collect()
    assert sum(p["length"] for p in parts) == at
    fill: dict = {}
    for p in sorted(parts, key=lambda p: (p["shard"], p["first"])):
        assert fill.get(p["shard"], 0) == p["first"]
        fill[p["shard"]] = p["first"] + p["length"]
    assert all(v == 64 for s, v in fill.items() if s != max(fill))


def test_jsonl_overflow(spark, tmp_path):
    lines = ['{"id": "1", "source": "s", "lang": "th", "state": {"a": 1}, "questions": {}, "labels": {}, "x": 5, "meta": {"x": "old", "y": "z"}}', "  ", '{"id": "2", "source": "s", "split": "eval"}']
    (tmp_path / "s.train.jsonl").write_text("\n".join(lines))
    got = {r["id"]: r for r in jsonl.read_globs(spark, [f"{tmp_path}/*.jsonl"], None).collect()}
    assert got["1"]["split"] == "train" and got["1"]["meta"] == {"x": "5", "y": "z"} and json.loads(got["1"]["state"]) == {"a": 1}
    assert got["2"]["split"] == "eval" and len(got) == 2
    (tmp_path / "other.eval.jsonl").write_text("\n".join('{"id": "o%d", "split": "eval"}' % i for i in range(5)))
    got = jsonl.read_globs(spark, [f"{tmp_path}/*.jsonl"], "eval", ["other"], 3).collect()
    assert len(got) == 3 and {r["source"] for r in got} == {"other"}


def test_held_out_sources(spark):
    df = spark.createDataFrame([("wisesight", "train"), ("wisesight", "eval"), ("x", "train")], "source string, split string")
    assert sorted(map(tuple, R.not_held_out(df).collect())) == [("wisesight", "eval"), ("x", "train")]


@pytest.mark.parametrize("missing", ["decisium.llm", "decisium.llm.queries"])
def test_entry_without_llm(spark, monkeypatch, missing):
    """Without the subpackage, or if a library that it needs is missing, the other queries stay."""
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, missing, None)  # an import of it fails
    if missing == "decisium.llm":
        monkeypatch.delitem(sys.modules, "decisium.llm.queries", raising=False)
    with pytest.warns(UserWarning, match="without the training-data operators"):
        named, sql = e.queries(), e.oracle_sql()
    assert len(named) == len(sql) > 120 and not any(k.startswith("op") and k[2].isdigit() for k in named) and "pipeline" not in named
    assert e.entry(spark).count() == 500


def test_offsets_and_places_of_hashed_ids(spark):
    """Ids over the whole range of 64 bits, and a table of one row or none."""
    from decisium.operators import mixture as X

    df = spark.range(3000).selectExpr("xxhash64(id) as id", "cast(id % 7 as long) as n", "if(id % 5 = 0, null, id % 3) as g")
    at, seen = 0, {}
    want = {}
    for r in sorted(df.collect()):
        want[r["id"]] = (at, seen.get(r["g"], 0))
        at, seen[r["g"]] = at + r["n"], seen.get(r["g"], 0) + 1
    got = X.place_in(X.running_offset(df, "id", "n", width=16), ["g"], "id", "place", width=16).collect()
    assert {r["id"]: (r["offset"], r["place"]) for r in got} == want
    assert df.select(X._range_of(df, "id", 16).alias("b")).distinct().count() > 100
    assert [r["offset"] for r in X.running_offset(df.limit(1), "id", "n").collect()] == [0]
    assert X.running_offset(df.limit(0), "id", "n").collect() == []
