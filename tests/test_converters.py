"""Converters on small in-memory sources."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from decisium.operators import converters as C
from decisium.operators.records import CONVERTERS

DEFS = {
    **{k: {"INSTRUCTIONS": f"ask {k}", "CRITERIA": {"true": "t", "false": "f"}} for k in ("squad2", "boolq", "paws")},
    "civil_comments": {"INSTRUCTIONS": "c", "CRITERIA": {"true": "t", "false": "f"}, "THRESHOLD": 0.5},
    "aegis2": {"INSTRUCTIONS": "a", "CRITERIA": {"true": "t", "false": "f"}, "LABELS": {"safe": False, "unsafe": True}},
    "pubmedqa": {"INSTRUCTIONS": "p", "CRITERIA": {"yes": "y", "no": "n", "maybe": "m"}},
    "massive": {"INSTRUCTIONS": "m", "CRITERIA": {"alarm": "a", "news": "n"}},
    "multinli": {"INSTRUCTIONS": "n", "CRITERIA": {"entailment": "e", "neutral": "n", "contradiction": "c"}, "OPTIONS": C.NLI},
    "helpsteer2": {"INSTRUCTIONS": "h", "LEVELS": list("abcde")},
    "summeval": {"INSTRUCTIONS": {"relevance": "r"}, "LEVELS": {"relevance": list("abcde")}},
    "vitaminc": {"INSTRUCTIONS": "v", "CRITERIA": {"SUPPORTS": "s", "REFUTES": "r"}},
}


def rows(spark, schema, *data):
    return spark.createDataFrame([(i, *d) for i, d in enumerate(data)], f"row long, {schema}")


def run(name, df, *args):
    return {r["id"]: r for r in CONVERTERS[name](df, *args).collect()}


def labels(r):
    return {q["qid"]: q["label"] for q in r["questions"]}


def names(r, i=0):
    return [o["name"] for o in r["questions"][i]["options"]]


def test_all_are_registered():
    want = "wisesight wongnai prachathai xnli_th massive_th massive_en sib200_th thai_toxicity thai_exam iapp_wiki_qa banking77 clinc ag_news dbpedia mnli mmlu arc helpsteer2 mind2web xlam_tools squad2_train boolq_train paws_train pubmedqa_artificial aegis2_train toxicchat xquad_th massive_de"
    assert set(want.split()) <= set(CONVERTERS) and len(want.split()) == 28


def test_thai_sources(spark):
    r = run("wisesight", rows(spark, "texts string, category int", ("ดี", 0)))["wisesight-0"]
    assert (r["split"], labels(r)) == ("eval", {"sentiment": "pos"}) and r["questions"][0]["options"][0]["desc"] == "เชิงบวก"
    got = run("wongnai", rows(spark, "review_body string, star_rating int, split string", ("a", 4, "train"), ("b", 0, "test")))
    assert {k: (v["split"], labels(v)) for k, v in got.items()} == {"wongnai-train-0": ("train", {"rating": "4"}), "wongnai-test-1": ("eval", {"rating": "0"})}
    cols = ", ".join(f"{t} int" for t in C.TOPICS_TH)
    one, none = [int(t == "labor") for t in C.TOPICS_TH], [0] * 12
    got = run("prachathai", rows(spark, f"title string, body_text string, split string, {cols}", ("t", "b" * 4000, "train", *one), ("t", "b", "validation", *none), ("t", "b", "train", *[1] * 12)))
    a, b, c = got["prachathai-train-0"], got["prachathai-validation-1"], got["prachathai-train-2"]
    assert labels(a)["is_labor"] == "true" and labels(a)["topic"] == "แรงงาน" and len(labels(a)) == 3 and len(json.loads(a["state"])["body"]) == 3000
    assert list(labels(b).values()) == ["false"] and b["split"] == "eval" and list(labels(c).values()) == ["true"]
    r = run("xnli_th", rows(spark, "premise string, hypothesis string, label int, split string", ("p", "h", 0, "train")))["xnli-th-train-0"]
    assert labels(r) == {"nli": "entailment", "entails": "true"}
    got = run("massive_th", rows(spark, "text string, label_text string, split string", ("x", "set_alarm", "train"), ("y", "news", "train"), ("z", "news", "test")))
    assert set(got) == {"massive-th-train-0", "massive-th-train-1"} and labels(got["massive-th-train-0"]) == {"intent": "set alarm"} and set(names(got["massive-th-train-0"])) == {"set alarm", "news"}
    assert labels(run("sib200_th", rows(spark, "text string, category string", ("x", "travel")))["sib200-th-0"]) == {"topic": "travel"}
    got = run("thai_toxicity", rows(spark, "tweet_text string, is_toxic int", ("x", 1), ("TWEET_NOT_FOUND", 1), (None, 0)))
    assert {k: labels(v) for k, v in got.items()} == {"thaitox-0": {"toxic": "true"}}
    got = run("thai_exam", rows(spark, "config string, question string, a string, b string, c string, d string, e string, answer string", ("onet", "q", "1", "2", None, "", "5", "e"), ("ic", "q", "1", None, None, None, None, "a"), ("ic", "q", "1", "2", None, None, None, "c")))
    assert set(got) == {"thaiexam-onet-0"} and names(got["thaiexam-onet-0"]) == ["a", "b", "e"]


def test_negatives(spark):
    df = rows(spark, "context string, question string", *[(f"c{i % 3}", f"q{i}") for i in range(30)])
    got = run("iapp_wiki_qa", df)
    assert len(got) == 60 and all(labels(got[f"iappqa-{i}-0"])["relevant"] == "true" for i in range(30))
    assert all((json.loads(got[f"iappqa-{i}-1"]["state"])["passage"] == f"c{i % 3}") == (labels(got[f"iappqa-{i}-1"])["relevant"] == "true") for i in range(30))
    got = run("xquad_th", df)
    assert 30 < len(got) < 60 and all(labels(v)["answerable"] == ("true" if k.endswith("p") else "false") for k, v in got.items())


def test_english_sources(spark):
    df = rows(spark, "text string, label_text string", *[(f"t{i}", f"in_{i % 40}") for i in range(80)])
    for r in run("massive_en", df).values():
        assert labels(r)["intent"] in names(r) and len(names(r)) in (10, 30, 40) and len(set(names(r))) == len(names(r))
    r = run("banking77", df)["banking77-3"]
    assert r["split"] == "eval" and len(names(r)) == 40 and names(r) == sorted(names(r)) and labels(r) == {"intent": "in 3"}
    for r in run("clinc", df.withColumnRenamed("label_text", "intent")).values():
        assert labels(r)["intent"] in names(r) and len(names(r)) in (15, 40)
    assert labels(run("ag_news", rows(spark, "text string, label int", ("x", 3)))["agnews-0"]) == {"topic": "Sci/Tech"}
    assert labels(run("dbpedia", rows(spark, "title string, content string, label int", ("x", "y", 1)), ["A", "B"])["dbpedia-0"]) == {"type": "B"}
    assert labels(run("mnli", rows(spark, "premise string, hypothesis string, label int", ("p", "h", 2)))["mnli-0"]) == {"nli": "contradiction", "entails": "false"}
    got = run("mmlu", rows(spark, "question string, choices array<string>, answer int", ("q", ["a", "b"], 1), ("q", ["a", "a"], 0)))
    assert {k: labels(v) for k, v in got.items()} == {"mmlu-0": {"answer": "b"}}
    got = run("arc", rows(spark, "config string, question string, choices struct<text:array<string>,label:array<string>>, answerKey string", ("E", "q", (["x", "y"], ["A", "B"]), "B"), ("E", "q", (["x", "x"], ["A", "B"]), "B"), ("E", "q", (["x", "y"], ["A", "B"]), "C")))
    assert {k: labels(v) for k, v in got.items()} == {"arc-E-0": {"answer": "y"}}
    r = run("helpsteer2", rows(spark, "prompt string, response string, helpfulness int, correctness int, coherence int, verbosity int", ("p" * 5000, "r", 4, None, 0, 1)))["helpsteer2-0"]
    assert labels(r) == {"helpfulness": "4", "coherence": "0", "verbosity": "1"} and len(json.loads(r["state"])["prompt"]) == 3000


@pytest.mark.parametrize(
    ("attrs", "want"),
    [('{"title": "T", "id": "x", "foo": "y", "value": "' + "v" * 60 + '"}', 'a T id="x" value="' + "v" * 40 + '"'), ("{bad", "a"), (None, "a"), ('{"aria-label": "L", "title": "T"}', 'a L title="T"')],
)
def test_candidate_text(spark, attrs, want):
    assert spark.range(1).select(C.candidate_text(F.lit("a"), F.lit(attrs).cast("string"))).collect()[0][0] == want


def test_agents(spark):
    c = "struct<tag:string,attributes:string,backend_node_id:string>"
    act = lambda pos, neg, op: (pos, neg, (op,) if op else None)
    el = lambda i: ("b", '{"id": "e%d"}' % i, str(i))
    actions = [act([el(i)] if i != 3 else [], [el(100 + j) for j in range(70)], "TYPE" if i else None) for i in range(9)]
    df = rows(spark, f"confirmed_task string, website string, actions array<struct<pos_candidates:array<{c}>,neg_candidates:array<{c}>,operation:struct<op:string>>>", ("t", "w", actions))
    got = run("mind2web", df)
    assert set(got) == {f"mind2web-0-{i}" for i in range(9) if i != 3}
    r = got["mind2web-0-8"]
    assert json.loads(r["state"])["previous_actions"] == [f'TYPE b id="e{i}"' for i in (2, 4, 5, 6, 7)]
    assert labels(r) == {"target": '[8] b id="e8"', "operation": "TYPE"} and labels(r)["target"] in names(r) and len(names(r)) in (8, 16, 32, 64)
    assert labels(got["mind2web-0-0"])["operation"] == "CLICK"
    tools = json.dumps([{"name": "a", "description": "d" * 300}, {"name": "b"}])
    got = run("xlam_tools", rows(spark, "query string, tools string, answers string", ("q", tools, '[{"name": "b"}]'), ("q", tools, '[{"name": "z"}]'), ("q", "bad", "[]"), ("q", tools, "[]")))
    assert set(got) == {"xlam-0"} and got["xlam-0"]["split"] == "eval" and [len(o["desc"]) for o in got["xlam-0"]["questions"][0]["options"]] == [200, 0]


def test_training_sets_in_benchmark_wording(spark):
    got = run("squad2_train", rows(spark, "context string, question string, answers struct<text:array<string>>", ("c", "q", (["x"],)), ("c", "q", ([" "],))), DEFS)
    assert [labels(v)["answerable"] for _, v in sorted(got.items())] == ["true", "false"]
    assert labels(run("boolq_train", rows(spark, "passage string, question string, answer boolean", ("p", "q", True)), DEFS)["boolqtr-0"]) == {"yes": "true"}
    got = run("pubmedqa_artificial", rows(spark, "question string, contexts array<string>, final_decision string", ("q", ["a", None, " ", "b"], " Yes "), ("q", [], "no"), ("q", ["a"], "x")), DEFS)
    assert list(got) == ["pubmedart-0"] and json.loads(got["pubmedart-0"]["state"])["abstract_context"] == "a b"
    assert labels(run("paws_train", rows(spark, "sentence1 string, sentence2 string, label int", ("a", "b", 0)), DEFS)["pawstr-0"]) == {"same": "false"}
    got = run("aegis2_train", rows(spark, "prompt string, prompt_label string, reconstruction_id_if_redacted string", (" x ", "unsafe", None), ("x", "unsafe", "1"), ("x", "odd", None), (None, "safe", None)), DEFS)
    assert {k: (labels(v), v["state"]) for k, v in got.items()} == {"aegistr-0": ({"unsafe": "true"}, '{"user_message":"x"}')}
    assert labels(run("toxicchat", rows(spark, "user_input string, toxicity int", ("x", 1), (" ", 1)), DEFS)["toxicchat-0"]) == {"unsafe": "true"}
    assert list(run("massive_de", rows(spark, "text string, label_text string", ("x", "news"), ("y", "odd")), DEFS)) == ["massive-de-0"]


def test_benchmark_subsets(spark):
    def ids(subset, schema, *data):
        return {r["id"]: (r["domain"], r["family"], r["question"]["label"]) for r in C.benchmark_rows(subset, rows(spark, schema, *data), DEFS).collect()}

    assert list(ids("boolq", "question string, passage string, answer boolean", ("q", "p", True), ("q", "p", None)).values())[0][0::2] == ("boolq", "true")
    assert ids("multinli", "pairID string, promptID string, genre string, premise string, hypothesis string, label int", ("1", "2", "g", "p", "h", 1), ("3", "2", "g", "p", "h", -1)) == {"multinli-1": ("multinli-g", "2", "neutral")}
    assert ids("paws", "id int, sentence1 string, sentence2 string, label int", (7, "a", "b", 1)) == {"paws-7": ("paws", "7", "true")}
    assert ids("civil_comments", "text string, toxicity double", ("x", 0.5), (" ", 0.9)) == {"civil_comments-0": ("civil_comments", "civil_comments-0", "true")}
    assert list(ids("squad2", "id string, context string, question string, answers struct<text:array<string>>", ("i", "c", "q", ([],)))) == ["squad2-i"]
    assert ids("aegis2", "id string, prompt string, prompt_label string, prompt_label_source string, reconstruction_id_if_redacted string", ("1", "x", "safe", "human", None), ("2", "x", "safe", "llm", None)) == {"aegis2-1": ("aegis2", "aegis2-1", "false")}
    assert list(ids("helpsteer2", "prompt string, response string, helpfulness int", ("p", "r", 3)).values())[0][2] == "3"
    assert ids("summeval-relevance", "id string, text string, machine_summaries array<string>, relevance array<double>", ("a", "t", ["x", "y"], [2.5, 5.0])) == {"summeval-relevance-a-0": ("summeval-relevance", "a", "2"), "summeval-relevance-a-1": ("summeval-relevance", "a", "4")}
    assert list(ids("pubmedqa", "pubid int, question string, contexts array<string>, final_decision string", (5, "q", ["c"], "maybe"))) == ["pubmedqa-5"]
    assert ids("vitaminc-dev", "unique_id string, case_id string, revision_type string, evidence string, claim string, label string", ("u", "c", "real", "e", "x", "REFUTES"), ("v", "c", "real", "e", "x", "NONE")) == {"vitaminc-u": ("vitaminc-real", "c", "REFUTES")}
    assert ids("massive-en-US", "id string, text string, label_text string", ("9", "x", "alarm")) == {"massive-9": ("massive-en-US", "massive-9", "alarm")}
