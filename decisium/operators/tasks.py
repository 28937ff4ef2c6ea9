"""Targeted generation tasks: from one generated JSON object and the JSON of its
blind relabelling to decision records, with a reason for each item that goes.

A table function reads the two objects of a row and gives an item a row; which
columns it has follows from the task, so it is planned with their types. It is
joined laterally, and the records are put together from its columns. An object
that isn't of the task's form is one item with the reason `invalid`; where a
relabel list must answer every item, one of another length drops all of them
(`lengths differ`), and elsewhere items past its end are `unlabelled`.

Rows: idx, lang ('th', else English), generated, relabel (texts, which may hold
the JSON in a fence or among prose), and what the task's states need: passage
(grounded_qa), article (summary_rating), domain (finegrained_intent). Tasks give
id, source, lang, split, state, questions and reason (null: a record)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, IntegerType, MapType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.rand import hash32, uniform
from ..functions.text import salvage_json
from . import converters as C
from .driver import TASKS, task

#: Thai wordings and criteria; English ones come in as definitions.
TH = {
    "squad2": ("ย่อหน้านี้มีข้อมูลที่ตอบคำถามได้หรือไม่ ถ้าย่อหน้าพูดถึงเรื่องเดียวกันแต่ไม่ได้ระบุข้อเท็จจริงที่ถามให้ถือว่าตอบไม่ได้", {"true": "ย่อหน้าระบุคำตอบไว้อย่างชัดเจน", "false": "ย่อหน้าไม่ได้ระบุคำตอบ แม้จะพูดถึงเรื่องเดียวกัน"}),
    "boolq": ("ย่อหน้านี้ตอบคำถามว่า 'ใช่' หรือไม่ ใช้เฉพาะสิ่งที่ย่อหน้าระบุหรือสื่อโดยตรง", {"true": "ย่อหน้าระบุหรือสื่อโดยตรงว่าคำตอบคือใช่", "false": "ย่อหน้าระบุหรือสื่อโดยตรงว่าคำตอบคือไม่"}),
    "pubmedqa": ("จากย่อหน้าเท่านั้น คำตอบของคำถามคืออะไร", {"yes": "ข้อมูลในย่อหน้าสนับสนุนคำตอบว่าใช่", "no": "ข้อมูลในย่อหน้าสนับสนุนคำตอบว่าไม่", "maybe": "ข้อมูลไม่พอหรือก้ำกึ่ง ตัดสินไม่ได้"}),
    "aegis2": (
        "ผู้ช่วย AI ทั่วไปควรปฏิเสธข้อความนี้เพราะไม่ปลอดภัยหรือไม่ พิจารณาจากคำขอ ไม่ใช่คำตอบที่น่าจะได้",
        {
            "true": "ข้อความขอความช่วยเหลือหรือมีเนื้อหาที่เป็นอันตราย เช่น ความรุนแรง อาวุธ ยาเสพติด การล่วงละเมิด การหลอกลวง ข้อมูลส่วนบุคคล เนื้อหาทางเพศที่ไม่เหมาะสม",
            "false": "ข้อความเป็นคำขอที่ปลอดภัย รวมถึงหัวข้ออ่อนไหวที่ถามด้วยเหตุผลที่ชอบธรรม เช่น การแพทย์ กฎหมาย ความปลอดภัย นิยาย",
        },
    ),
    "paws": ("สองประโยคนี้มีความหมายเหมือนกันหรือไม่ ประโยคที่ใช้คำเดิมแต่สลับลำดับอาจมีความหมายต่างกันได้", {"true": "ทั้งสองประโยคบรรยายเหตุการณ์เดียวกัน ผู้กระทำและบทบาทเหมือนกัน", "false": "ความหมายต่างกัน รวมถึงกรณีที่คำเหมือนกันแต่สลับตำแหน่งจนความหมายเปลี่ยน"}),
}
INTENT = ["ผู้ใช้ต้องการอะไร (เลือก intent ที่ตรงที่สุด)", "What is the user's intent? Pick the single closest one."]
INTENT_SIZES, LEAST_INTENTS, LEAST_SUMMARIES = (20, 40, 77), 30, 4

STRING, INT, BOOLEAN = StringType(), IntegerType(), BooleanType()
FIELDS: dict[str, dict[str, DataType]] = {
    "grounded_qa": {"kind": STRING, "question": STRING, "answer": STRING},
    "summary_rating": {"dimension": STRING, "summary": STRING, "level": INT, "blind": INT},
    "finegrained_intent": {"text": STRING, "intent": STRING, "intents": MapType(STRING, STRING)},
    "safety": {"text": STRING, "unsafe": BOOLEAN},
    "paraphrase": {"a": STRING, "b": STRING, "same": BOOLEAN},
}
Item = tuple[tuple, str | None]


def _list(x: object, key: str) -> list:
    got = x.get(key) if isinstance(x, dict) else None
    return got if isinstance(got, list) else []


def _valid(x: object, key: str, **kinds: type) -> list[dict]:
    """Objects of a list that have all fields, of these kinds."""
    return [d for d in _list(x, key) if isinstance(d, dict) and all(isinstance(d.get(k), t) for k, t in kinds.items())]


def _grounded_qa(g: object, r: object) -> Iterator[Item]:
    asked = [("yesno", d["q"], d["answer"]) for d in _valid(g, "answerable_yesno", q=str, answer=str) if d["q"] and d["answer"] in ("yes", "no")]
    facts = [("fact", d["q"], None) for d in _valid(g, "answerable_fact", q=str) if d["q"]]
    beyond = [("unanswerable", d["q"], None) for d in _valid(g, "unanswerable", q=str) if d["q"]]
    if not asked or not beyond:
        return
    results, items, kept = _list(r, "results"), [*asked, *facts, *beyond], 0
    for i, (kind, q, answer) in enumerate(items):
        found = results[i] if i < len(results) and isinstance(results[i], dict) else {}
        if len(results) != len(items):
            why = "lengths differ"
        elif bool(found.get("answerable")) == (kind == "unanswerable"):
            why = "answerable" if kind == "unanswerable" else "not answerable"
        else:
            why = "other answer" if kind == "yesno" and str(found.get("yesno") or "").lower() != answer else None
        kept += why is None
        yield (kind, q, answer), why
    if kept:
        yield ("maybe", beyond[0][1], "maybe"), None


def _summary_rating(g: object, r: object) -> Iterator[Item]:
    scales = {d: g.get(d) if isinstance(g, dict) else None for d in ("relevance", "consistency")}
    if not all(isinstance(x, dict) for x in scales.values()):
        return
    items = [(d, s, int(k) - 1) for d, known in (("relevance", "12345"), ("consistency", "135")) for k, s in scales[d].items() if len(k) == 1 and k in known and isinstance(s, str) and s.strip()]
    if len(items) < LEAST_SUMMARIES:
        return
    ratings = _list(r, "ratings")
    for i, (d, s, level) in enumerate(items):
        blind = None
        if len(ratings) != len(items):
            why = "lengths differ"
        else:
            try:
                blind = int(ratings[i]) - 1
            except (TypeError, ValueError):
                why = "no rating"
            else:
                why = "rating differs" if abs(blind - level) > 1 else None
        yield (d, s, level, blind), why


def _finegrained_intent(g: object, r: object) -> Iterator[Item]:
    intents = g.get("intents") if isinstance(g, dict) else None
    if not isinstance(intents, dict) or len(intents) < LEAST_INTENTS:
        return
    intents = {k: str(v) if v else None for k, v in intents.items()}
    labels = _list(r, "labels")
    for i, u in enumerate(u for u in _valid(g, "utterances", text=str, intent=str) if u["intent"] in intents):
        yield (u["text"], u["intent"], intents), _differs(labels, i, u["intent"])


def _differs(labels: list, i: int, own: object) -> str | None:
    return "unlabelled" if i >= len(labels) else None if labels[i] == own and type(labels[i]) is type(own) else "label differs"


def _safety(g: object, r: object) -> Iterator[Item]:
    for i, d in enumerate(_valid(g, "items", text=str, unsafe=bool)):
        yield (d["text"], d["unsafe"]), _differs(_list(r, "unsafe"), i, d["unsafe"])


def _paraphrase(g: object, r: object) -> Iterator[Item]:
    for i, d in enumerate(_valid(g, "pairs", a=str, b=str, same_meaning=bool)):
        yield (d["a"], d["b"], d["same_meaning"]), _differs(_list(r, "same"), i, d["same_meaning"])


ITEMS: dict[str, Callable[[object, object], Iterator[Item]]] = {"grounded_qa": _grounded_qa, "summary_rating": _summary_rating, "finegrained_intent": _finegrained_intent, "safety": _safety, "paraphrase": _paraphrase}


class TaskItems:
    """Table function (task, generated, relabel): pos, the task's own columns, reason."""

    @staticmethod
    def analyze(task: AnalyzeArgument, generated: AnalyzeArgument, relabel: AnalyzeArgument) -> AnalyzeResult:
        if not task.isConstantExpression or task.value not in FIELDS:
            raise ValueError(f"no such task: {task.value}")
        return AnalyzeResult(StructType([StructField(k, t) for k, t in {"pos": INT, **FIELDS[task.value], "reason": STRING}.items()]))

    def eval(self, task: str, generated: str | None, relabel: str | None) -> Iterator[tuple]:
        n = 0
        for fields, why in ITEMS[task](_parsed(generated), _parsed(relabel)):
            yield (n, *fields, why)
            n += 1
        if not n:
            yield (0, *[None] * len(FIELDS[task]), "invalid")


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def items(rows: DataFrame, name: str) -> DataFrame:
    """rows with the items of each, by a lateral join."""
    from ..sources.scratch import ship

    ship(rows.sparkSession)
    expand = F.udtf(TaskItems)
    given = rows.withColumn("_generated", salvage_json(F.col("generated"))).withColumn("_relabel", salvage_json(F.col("relabel")))
    joined = given.lateralJoin(expand(F.lit(name), F.col("_generated").outer(), F.col("_relabel").outer()))
    return joined.drop("_generated", "_relabel")


def _worded(kind: str, qid: str, name: str, defs: dict, label: Column) -> Column:
    """A question in Thai or by the definition, by the row's language."""
    ask = lambda text, criteria: C.noul(qid, text, label, criteria["true"], criteria["false"]) if kind == "noul" else C.question(qid, kind, text, list(criteria), label, criteria)
    return F.when(F.col("lang") == "th", ask(*TH[name])).otherwise(ask(defs[name]["INSTRUCTIONS"], defs[name]["CRITERIA"]))


def _state(th: dict[str, str], en: dict[str, str]) -> Column:
    return F.when(F.col("lang") == "th", C.state_of(**th)).otherwise(C.state_of(**en))


def _records(rows: DataFrame, name: str, tag: Column, state: Column, *questions: Column) -> DataFrame:
    ok = F.col("reason").isNull()
    return rows.select(
        F.concat_ws("-", F.col("idx").cast("string"), tag).alias("id"), F.lit(f"targeted_{name}").alias("source"), "lang", F.lit("train").alias("split"),
        F.when(ok, state).alias("state"), F.when(ok, F.array_compact(F.array(*questions))).alias("questions"), "reason",
    )


@task("grounded_qa")
def grounded_qa(rows: DataFrame, defs: dict) -> DataFrame:
    """Whether a passage answers a question; yes or no and a verdict where it does so."""
    kind = F.col("kind")
    tag = F.when(kind == "maybe", "m").otherwise(F.concat(F.when(kind == "unanswerable", "u").otherwise("a"), F.col("pos").cast("string")))
    return _records(
        items(rows, "grounded_qa"), "grounded_qa", tag, _state({"ย่อหน้า": "passage", "คำถาม": "question"}, {"passage": "passage", "question": "question"}),
        F.when(kind != "maybe", _worded("noul", "answerable", "squad2", defs, kind != "unanswerable")),
        F.when(kind == "yesno", _worded("noul", "yes", "boolq", defs, F.col("answer") == "yes")),
        F.when(kind.isin("yesno", "maybe"), _worded("choice", "verdict", "pubmedqa", defs, F.col("answer"))),
    )


@task("summary_rating")
def summary_rating(rows: DataFrame, defs: dict) -> DataFrame:
    d = defs["summeval"]
    ask = lambda x: F.when(F.col("dimension") == x, C.score(x, d["INSTRUCTIONS"][x], d["LEVELS"][x], F.col("level")))
    return _records(items(rows, "summary_rating"), "summary_rating", F.concat(F.substring("dimension", 1, 1), F.col("pos").cast("string")), C.state_of(article="article", summary="summary"), ask("relevance"), ask("consistency"))


@task("finegrained_intent")
def finegrained_intent(rows: DataFrame, defs: dict) -> DataFrame:
    """Each utterance among all intents, and again among fewer of them."""
    names = F.map_keys("intents")
    drawn = F.element_at(F.array(*[F.lit(k) for k in INTENT_SIZES]), (hash32("intent-k", "idx", "pos") % len(INTENT_SIZES) + 1).cast("int"))
    sizes = F.array_sort(F.array_distinct(F.array(F.size(names), F.least(drawn, F.size(names)))))
    each = items(rows, "finegrained_intent").select("*", F.posexplode_outer(F.when(F.col("reason").isNull(), sizes)).alias("j", "k"))
    by = lambda seed, x: F.struct(hash32(seed, "idx", "pos", "j", x).alias("h"), x.alias("x"))
    plain = lambda xs: F.transform(F.array_sort(xs), lambda y: y["x"])
    others = plain(F.transform(F.filter(names, lambda x: x != F.col("intent")), lambda x: by("intent-pick", x)))
    chosen = plain(F.transform(F.concat(F.array("intent"), F.slice(others, F.lit(1), F.col("k") - 1)), lambda x: by("intent-order", x)))
    told = lambda name: F.when(uniform("intent-told", "idx", "pos", "j", name) < 0.6, F.try_element_at("intents", name))
    wording = F.element_at(F.array(*[F.lit(x) for x in INTENT]), (hash32("intent-ask", "idx", "pos", "j") % len(INTENT) + 1).cast("int"))
    return _records(each, "finegrained_intent", F.concat_ws("-", F.col("pos").cast("string"), F.col("j").cast("string")), F.col("text"), C.question("intent", "choice", wording, chosen, F.col("intent"), told))


@task("safety")
def safety(rows: DataFrame, defs: dict) -> DataFrame:
    return _records(items(rows, "safety"), "safety", F.col("pos").cast("string"), C.state_of(user_message="text"), _worded("noul", "unsafe", "aegis2", defs, F.col("unsafe")))


@task("paraphrase")
def paraphrase(rows: DataFrame, defs: dict) -> DataFrame:
    state = _state({"ประโยค_1": "a", "ประโยค_2": "b"}, {"sentence_1": "a", "sentence_2": "b"})
    return _records(items(rows, "paraphrase"), "paraphrase", F.col("pos").cast("string"), state, _worded("noul", "same", "paws", defs, F.col("same")))


__all__ = ["TASKS", "items"]
