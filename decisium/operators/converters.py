"""Converters from source tables to decision records.

Each takes the source's rows, with their number in `row` and their split in
`split` where it has several, and gives id, source, lang, split, state (JSON or
text) and questions. All are projections; those that draw negatives or a
vocabulary join or aggregate ids and names, never whole tables on the driver.
Definitions of the public benchmarks (instructions, criteria, levels, labels,
threshold) come in as a dict, as they are data of whoever runs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import hash32
from ..functions.text import digest, strip
from .mixture import negatives
from .records import converter, distractors, half_up_level, history, template

QUESTION = "struct<qid:string,qtype:string,instructions:string,options:array<struct<name:string,desc:string>>,label:string>"

#: Option names with their descriptions, level names, topics.
SENTIMENT_TH = {"pos": "เชิงบวก", "neu": "เป็นกลาง", "neg": "เชิงลบ", "q": "คำถาม"}
STARS_TH = ["แย่มาก (1 ดาว)", "แย่ (2 ดาว)", "ปานกลาง (3 ดาว)", "ดี (4 ดาว)", "ดีมาก (5 ดาว)"]
TOPICS_TH = {
    "politics": "การเมือง", "human_rights": "สิทธิมนุษยชน", "quality_of_life": "คุณภาพชีวิต", "international": "ต่างประเทศ", "social": "สังคม", "environment": "สิ่งแวดล้อม",
    "economics": "เศรษฐกิจ", "culture": "วัฒนธรรม", "labor": "แรงงาน", "national_security": "ความมั่นคง", "ict": "ไอซีที", "education": "การศึกษา",
}
NLI = ["entailment", "neutral", "contradiction"]
NLI_TH = {"entailment": "ประโยคที่สองสรุปได้จากประโยคแรก", "neutral": "ไม่สามารถสรุปได้", "contradiction": "ประโยคที่สองขัดแย้งกับประโยคแรก"}
SIB_TOPICS = ["science/technology", "travel", "politics", "sports", "health", "entertainment", "geography"]
NEWS_TOPICS = ["World", "Sports", "Business", "Sci/Tech"]
HELP_LEVELS = ["0 (worst)", "1", "2", "3", "4 (best)"]
HELP_DIMS = ["helpfulness", "correctness", "coherence", "verbosity"]
OPERATIONS = ["CLICK", "TYPE", "SELECT"]
ATTRIBUTES = ["id", "class", "name", "type", "role", "aria_label", "aria-label", "title", "placeholder", "value", "alt", "href"]


# ------------------------------------------------------------------ questions
def _names(names: list[str] | Column) -> Column:
    return F.array(*[F.lit(n) for n in names]) if isinstance(names, list) else names


def question(qid: str | Column, qtype: str, instructions: str | Column, names: list[str] | Column, label: Column, descs: dict | Column | Callable[[Column], Column] | None = None) -> Column:
    """descs: descriptions by name, or what gives a name's. A map is looked up for
    each name, so one that takes work to make is better given as a function."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    if isinstance(descs, dict):
        descs = F.create_map(*[F.lit(x) for kv in descs.items() for x in kv])
    if descs is None or isinstance(descs, Column):
        desc = (lambda n: F.lit(None).cast("string")) if descs is None else (lambda n: F.try_element_at(descs, n))
    else:
        desc = descs
    opts = F.transform(_names(names), lambda n: F.struct(n.alias("name"), desc(n).alias("desc")))
    return F.struct(text(qid).alias("qid"), F.lit(qtype).alias("qtype"), text(instructions).alias("instructions"), opts.alias("options"), label.cast("string").alias("label")).cast(QUESTION)


def noul(qid: str | Column, instructions: str | Column, label: Column, true: str | None = None, false: str | None = None) -> Column:
    return question(qid, "noul", instructions, ["no", "yes"], label, {"no": false, "yes": true} if true or false else None)


def score(qid: str, instructions: str | Column, levels: list[str], label: Column) -> Column:
    names = [str(i) for i in range(len(levels))]
    return question(qid, "score", instructions, names, label, dict(zip(names, levels, strict=True)))


def records(rows: DataFrame, prefix: str, source: str, lang: str, state: Column, *questions: Column, split: str | Column = "train", id_: Column | None = None) -> DataFrame:
    key = F.concat(F.lit(prefix), F.col("row").cast("string")) if id_ is None else id_
    return rows.select(
        key.alias("id"), F.lit(source).alias("source"), F.lit(lang).alias("lang"), (F.lit(split) if isinstance(split, str) else split).alias("split"),
        state.alias("state"), F.array_compact(F.array(*questions)).alias("questions"),
    )


def state_of(**fields: Column | str) -> Column:
    cols = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def _split() -> Column:
    return F.when(F.col("split") == "train", "train").otherwise("eval")


def _by_split(prefix: str) -> Column:
    return F.concat(F.lit(prefix + "-"), F.col("split"), F.lit("-"), F.col("row").cast("string"))


def _one_of(seed: str, *xs: str) -> Column:
    return F.element_at(_names(list(xs)), (hash32(seed, "row") % len(xs) + 1).cast("int"))


def label_text(rows: DataFrame, label: str = "label", names: list[str] | None = None) -> Column:
    """The label's own text, else its name by number, else as text."""
    own = [F.col("label_text")] if "label_text" in rows.columns else []
    if label not in rows.columns:
        return own[0]
    by_number = [F.try_element_at(_names(names), F.col(label).try_cast("int") + 1)] if names else []
    return F.coalesce(*own, *by_number, F.col(label).cast("string"))


def _with_vocabulary(rows: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Adds the sorted distinct names (of each split) as `vocabulary`."""
    by = by or []
    v = rows.groupBy(*by).agg(F.array_sort(F.collect_set(name)).alias("vocabulary"))  # class names: few
    return rows.join(F.broadcast(v), by) if by else rows.withColumn("vocabulary", v.select("vocabulary").scalar())


def _sampled(seed: str, correct: str, *sizes: int) -> Column:
    """The correct name among as many others as drawn; 0 stands for all."""
    k = F.element_at(F.array(*[F.lit(x) for x in sizes]), (hash32(seed + "-k", "row") % len(sizes) + 1).cast("int"))
    mixed = distractors(F.col("vocabulary"), F.col(correct), 1 << 20, seed, F.col("row"))
    others = F.filter(mixed, lambda x: x != F.col(correct))
    chosen = F.concat(F.array(F.col(correct)), F.when(k > 0, F.slice(others, F.lit(1), F.greatest(k - 1, F.lit(1)))).otherwise(others))
    keyed = F.array_sort(F.transform(chosen, lambda x: F.struct(hash32(seed + "-order", F.col("row"), x).alias("h"), x.alias("x"))))
    return F.transform(keyed, lambda x: x["x"])


def _spaced(x: Column) -> Column:
    return F.replace(x, F.lit("_"), F.lit(" "))


# ----------------------------------------------------------------------- Thai
@converter("wisesight")
def wisesight(rows: DataFrame) -> DataFrame:
    names = list(SENTIMENT_TH)
    return records(rows, "wisesight-", "wisesight", "th", F.col("texts"), question("sentiment", "choice", "ข้อความนี้แสดงความรู้สึกแบบใด", names, label_text(rows, "category", names), SENTIMENT_TH), split="eval")


@converter("wongnai")
def wongnai(rows: DataFrame) -> DataFrame:
    ask = _one_of("wongnai", "รีวิวนี้ให้คะแนนร้านกี่ดาว", "ประเมินความพึงพอใจของผู้รีวิว")
    return records(rows, "", "wongnai", "th", F.col("review_body"), score("rating", ask, STARS_TH, F.col("star_rating").cast("int")), split=_split(), id_=_by_split("wongnai"))


@converter("prachathai")
def prachathai(rows: DataFrame) -> DataFrame:
    """One topic it has, one it lacks, and the topic itself if it has just one."""
    has = F.array_compact(F.array(*[F.when(F.col(t) == 1, F.lit(t)) for t in TOPICS_TH]))
    names = F.create_map(*[F.lit(x) for kv in TOPICS_TH.items() for x in kv])
    rows = rows.withColumn("_has", has).withColumn("_lacks", F.array_except(_names(list(TOPICS_TH)), F.col("_has")))
    one = lambda xs, seed: F.try_element_at(xs, (hash32(seed, "row") % F.greatest(F.size(xs), F.lit(1)) + 1).cast("int"))

    def about(t: Column, label: bool) -> Column:
        ask = F.concat(F.lit("ข่าวนี้เกี่ยวข้องกับหัวข้อ '"), F.try_element_at(names, t), F.lit("' หรือไม่"))
        return F.when(t.isNotNull(), noul(F.concat(F.lit("is_"), t), ask, F.lit(label)))

    topic = F.try_element_at(names, F.try_element_at("_has", F.lit(1)))
    only = F.when(F.size("_has") == 1, question("topic", "choice", "ข่าวนี้อยู่ในหมวดหลักใด", list(TOPICS_TH.values()), topic))
    state = state_of(title="title", body=F.substring("body_text", 1, 3000))
    return records(rows, "", "prachathai", "th", state, about(one(F.col("_has"), "has"), True), about(one(F.col("_lacks"), "lacks"), False), only, split=_split(), id_=_by_split("prachathai"))


def _nli(rows: DataFrame, source: str, lang: str, ask: str, ask_noul: str, descs: dict | None, **kw) -> DataFrame:  # noqa: ANN003
    label = F.try_element_at(_names(NLI), F.col("label").cast("int") + 1)
    return records(rows, kw.pop("prefix", ""), source, lang, state_of(premise="premise", hypothesis="hypothesis"), question("nli", "choice", ask, NLI, label, descs), noul("entails", ask_noul, label == "entailment"), **kw)


@converter("xnli_th")
def xnli_th(rows: DataFrame) -> DataFrame:
    return _nli(rows, "xnli_th", "th", "ความสัมพันธ์ระหว่าง premise และ hypothesis คืออะไร", "hypothesis สรุปได้จาก premise หรือไม่", NLI_TH, split=_split(), id_=_by_split("xnli-th"))


@converter("massive_th")
def massive_th(rows: DataFrame) -> DataFrame:
    rows = _with_vocabulary(rows.withColumn("_name", label_text(rows)), "_name", ["split"]).where(F.size("vocabulary") >= 2)
    ask = _one_of("massive-th", "ผู้ใช้ต้องการทำอะไร (intent)", "What does the user want to do?")
    names = F.transform(_sampled("massive-th", "_name", 0, 20, 10, 5), _spaced)
    return records(rows, "", "massive_th", "mixed", F.col("text"), question("intent", "choice", ask, names, _spaced(F.col("_name"))), split=_split(), id_=_by_split("massive-th"))


@converter("sib200_th")
def sib200_th(rows: DataFrame) -> DataFrame:
    return records(rows, "sib200-th-", "sib200_th", "mixed", F.col("text"), question("topic", "choice", "ข้อความนี้เกี่ยวกับหัวข้อใด", SIB_TOPICS, F.col("category")), split="eval")


@converter("thai_toxicity")
def thai_toxicity(rows: DataFrame) -> DataFrame:
    kept = rows.where((F.coalesce("tweet_text", F.lit("")) != "") & (F.col("tweet_text") != "TWEET_NOT_FOUND"))
    ask = noul("toxic", "ข้อความนี้เป็นข้อความที่เป็นพิษ (toxic) หรือไม่", F.col("is_toxic").cast("int") != 0, "มีการด่าทอ เหยียดหยาม หรือคุกคาม", "สุภาพหรือเป็นกลาง")
    return records(kept, "thaitox-", "thai_toxicity", "th", F.col("tweet_text"), ask)


@converter("thai_exam")
def thai_exam(rows: DataFrame) -> DataFrame:
    """rows of all configurations, named in `config`; a missing one has no rows."""
    keys = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("")) != "", F.lit(c)) for c in "abcde"]))
    texts = F.create_map(*[x for c in "abcde" for x in (F.lit(c), F.col(c))])
    kept = rows.withColumn("_keys", keys).where((F.size("_keys") >= 2) & F.array_contains("_keys", F.col("answer")))
    key = F.concat(F.lit("thaiexam-"), F.col("config"), F.lit("-"), F.col("row").cast("string"))
    return records(kept, "", "thai_exam", "th", F.col("question"), question("answer", "choice", "ข้อใดคือคำตอบที่ถูกต้อง", F.col("_keys"), F.col("answer"), texts), id_=key)


def _with_negative(rows: DataFrame, seed: str) -> DataFrame:
    """Adds the context of a row drawn at random; only keys are drawn."""
    drawn = negatives(rows.select("row"), seed, "row")
    other = rows.select(F.col("row").alias("negative"), F.col("context").alias("other"))
    return rows.join(drawn, "row").join(other, "negative")


@converter("iapp_wiki_qa")
def iapp_wiki_qa(rows: DataFrame) -> DataFrame:
    both = _with_negative(rows, "iapp").select("row", "question", F.posexplode(F.array(F.struct(F.col("context").alias("c"), F.lit(True).alias("y")), F.struct(F.col("other").alias("c"), (F.col("other") == F.col("context")).alias("y")))).alias("j", "x"))
    key = F.concat(F.lit("iappqa-"), F.col("row").cast("string"), F.lit("-"), F.col("j").cast("string"))
    return records(both, "", "iapp_wiki_qa", "th", state_of(question="question", passage=F.substring("x.c", 1, 2000)), noul("relevant", "passage นี้มีคำตอบของคำถามหรือไม่", F.col("x.y")), id_=key)


@converter("xquad_th")
def xquad_th(rows: DataFrame) -> DataFrame:
    """The pair itself and, if its context differs, one with a random context."""
    sides = F.array(F.struct(F.lit("p").alias("s"), F.col("context").alias("c")), F.struct(F.lit("n").alias("s"), F.col("other").alias("c")))
    both = _with_negative(rows, "xquad").select("row", "question", "context", F.explode(sides).alias("x")).where((F.col("x.s") == "p") | (F.col("x.c") != F.col("context")))
    ask = "ย่อหน้านี้มีข้อมูลที่ตอบคำถามได้หรือไม่ ถ้าย่อหน้าพูดถึงเรื่องเดียวกันแต่ไม่ได้ระบุข้อเท็จจริงที่ถามให้ถือว่าตอบไม่ได้"
    key = F.concat(F.lit("xquadth-"), F.col("row").cast("string"), F.col("x.s"))
    state = state_of(**{"ย่อหน้า": F.col("x.c"), "คำถาม": F.col("question")})
    return records(both, "", "xquad_th", "th", state, noul("answerable", ask, F.col("x.s") == "p", "ย่อหน้าระบุคำตอบไว้อย่างชัดเจน", "ย่อหน้าไม่ได้ระบุคำตอบ"), id_=key)


# -------------------------------------------------------------------- English
@converter("massive_en")
def massive_en(rows: DataFrame) -> DataFrame:
    rows = _with_vocabulary(rows.withColumn("_name", label_text(rows)), "_name")
    names = F.transform(_sampled("massive-en", "_name", 0, 30, 10), _spaced)
    return records(rows, "massive-en-", "massive_en", "en", F.col("text"), question("intent", "choice", template(F.lit("en"), "choice", "intent", "massive-en", "row"), names, _spaced(F.col("_name"))))


@converter("banking77")
def banking77(rows: DataFrame) -> DataFrame:
    rows = _with_vocabulary(rows.withColumn("_name", label_text(rows)), "_name")
    return records(rows, "banking77-", "banking77", "en", F.col("text"), question("intent", "choice", "What is the customer's intent?", F.transform("vocabulary", _spaced), _spaced(F.col("_name"))), split="eval")


@converter("clinc")
def clinc(rows: DataFrame) -> DataFrame:
    rows = _with_vocabulary(rows.withColumn("_name", F.col("intent").cast("string")), "_name")
    return records(rows, "clinc-", "clinc", "en", F.col("text"), question("intent", "choice", template(F.lit("en"), "choice", "intent", "clinc", "row"), _sampled("clinc", "_name", 0, 50, 15), F.col("_name")))


@converter("ag_news")
def ag_news(rows: DataFrame) -> DataFrame:
    return records(rows, "agnews-", "ag_news", "en", F.col("text"), question("topic", "choice", template(F.lit("en"), "choice", "news topic", "ag", "row"), NEWS_TOPICS, F.try_element_at(_names(NEWS_TOPICS), F.col("label").cast("int") + 1)))


@converter("dbpedia")
def dbpedia(rows: DataFrame, names: list[str]) -> DataFrame:
    return records(rows, "dbpedia-", "dbpedia", "en", state_of(title="title", content="content"), question("type", "choice", "What kind of entity is this article about?", names, F.try_element_at(_names(names), F.col("label").cast("int") + 1)))


@converter("mnli")
def mnli(rows: DataFrame) -> DataFrame:
    return _nli(rows, "mnli", "en", "What is the relation between premise and hypothesis?", "Does the premise entail the hypothesis?", None, prefix="mnli-")


@converter("mmlu")
def mmlu(rows: DataFrame) -> DataFrame:
    kept = rows.where(F.size(F.array_distinct("choices")) == F.size("choices"))
    return records(kept, "mmlu-", "mmlu", "en", F.col("question"), question("answer", "choice", "Which option answers the question?", F.col("choices"), F.try_element_at("choices", F.col("answer").cast("int") + 1)))


@converter("arc")
def arc(rows: DataFrame) -> DataFrame:
    at = F.array_position("choices.label", F.col("answerKey"))
    kept = rows.where((at > 0) & (F.size(F.array_distinct("choices.text")) == F.size("choices.text")))
    key = F.concat(F.lit("arc-"), F.col("config"), F.lit("-"), F.col("row").cast("string"))
    return records(kept, "", "arc", "en", F.col("question"), question("answer", "choice", "Which option is correct?", F.col("choices.text"), F.try_element_at("choices.text", at.cast("int"))), id_=key)


@converter("helpsteer2")
def helpsteer2(rows: DataFrame) -> DataFrame:
    ask = [F.when(F.col(d).isNotNull(), score(d, f"How {a} is the response?", HELP_LEVELS, F.col(d).cast("int"))) for d, a in zip(HELP_DIMS, ["helpful", "correct", "coherent", "verbose"], strict=True)]
    return records(rows, "helpsteer2-", "helpsteer2", "en", state_of(prompt=F.substring("prompt", 1, 3000), response=F.substring("response", 1, 4000)), *ask)


# --------------------------------------------------------------------- agents
def candidate_text(tag: Column, attributes: Column) -> Column:
    """A page element in short: tag, its label, up to four other attributes."""
    m = F.coalesce(F.from_json(attributes, "map<string,string>"), F.create_map().cast("map<string,string>"))
    keep = F.filter(F.map_entries(m), lambda e: e["key"].isin(*ATTRIBUTES))
    at = lambda k: F.try_element_at(m, F.lit(k))
    label = F.coalesce(*[F.when(at(k) != "", at(k)) for k in ("aria_label", "aria-label", "title")])
    # the label comes from the first key that is there; only keys tried so far are used up
    used = F.when(at("aria_label") != "", F.array(F.lit("aria_label"))).when(at("aria-label") != "", _names(["aria_label", "aria-label"])).otherwise(_names(["aria_label", "aria-label", "title"]))
    rest = F.slice(F.filter(keep, lambda e: ~F.array_contains(used, e["key"])), 1, 4)
    parts = F.concat(F.array(tag, label), F.transform(rest, lambda e: F.concat(e["key"], F.lit('="'), F.substring(e["value"], 1, 40), F.lit('"'))))
    return F.substring(F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), " "), 1, 160)


@converter("mind2web")
def mind2web(rows: DataFrame) -> DataFrame:
    """A row per step with a target: the element to act on among others, and the
    operation. Earlier steps with a target are its history, the last five."""
    steps = rows.select("row", "confirmed_task", "website", F.posexplode("actions").alias("j", "a")).where(F.size("a.pos_candidates") > 0)
    element = lambda c: F.concat(F.lit("["), c["backend_node_id"].cast("string"), F.lit("] "), candidate_text(c["tag"], c["attributes"]))
    target = F.element_at("a.pos_candidates", 1)
    k = F.element_at(F.array(*[F.lit(x) for x in (8, 16, 32, 64)]), (hash32("m2w-k", "row", "j") % 4 + 1).cast("int"))
    op = F.coalesce("a.operation.op", F.lit("CLICK"))
    steps = steps.withColumn("_target", element(target)).withColumn("_op", op).withColumn("_did", F.concat("_op", F.lit(" "), candidate_text(target["tag"], target["attributes"])))
    others = F.coalesce(F.transform("a.neg_candidates", element), F.array().cast("array<string>"))
    ranked = lambda xs, seed: F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(hash32(seed, F.col("row"), F.col("j"), x).alias("h"), x.alias("x")))), lambda x: x["x"])
    names = ranked(F.array_distinct(F.concat(F.array("_target"), F.slice(ranked(others, "m2w"), F.lit(1), k - 1))), "m2w-order")
    steps = history(steps.withColumn("_names", names), "row", "j", "_did", 5)
    state = state_of(task="confirmed_task", website="website", previous_actions="history", candidate_elements="_names")
    known = F.when(F.col("_op").isin(*OPERATIONS), F.col("_op")).otherwise("CLICK")
    key = F.concat(F.lit("mind2web-"), F.col("row").cast("string"), F.lit("-"), F.col("j").cast("string"))
    return records(steps, "", "mind2web", "en", state, question("target", "choice", "Which element should the agent act on next?", F.col("_names"), F.col("_target")), question("operation", "choice", "Which operation should be performed on it?", OPERATIONS, known), id_=key)


@converter("xlam_tools")
def xlam_tools(rows: DataFrame) -> DataFrame:
    """tools and answers are JSON; rows whose first call isn't a tool go."""
    tools = F.filter(F.from_json("tools", "array<struct<name:string,description:string>>"), lambda t: t["name"].isNotNull())
    first = F.try_element_at(F.from_json("answers", "array<struct<name:string>>"), F.lit(1))["name"]
    rows = rows.withColumn("_tools", tools).withColumn("_first", first).withColumn("_names", F.array_distinct(F.transform("_tools", lambda t: t["name"])))
    kept = rows.where((F.size("_tools") >= 2) & F.array_contains("_names", F.col("_first")))
    said = lambda n: F.filter(F.col("_tools"), lambda t: t["name"] == n)
    descs = lambda n: F.substring(F.coalesce(F.try_element_at(said(n), F.lit(-1))["description"], F.lit("")), 1, 200)
    split = F.when(F.col("row") % 50 == 0, "eval").otherwise("train")
    return records(kept, "xlam-", "xlam_tools", "en", state_of(user_request="query"), question("tool", "choice", "Which tool should be called first?", F.col("_names"), F.col("_first"), descs), split=split)


# ------------------------------------------- training sets in benchmark wording
def _noul_def(qid: str, d: dict, label: Column) -> Column:
    return noul(qid, d["INSTRUCTIONS"], label, d["CRITERIA"]["true"], d["CRITERIA"]["false"])


def _choice_def(qid: str, d: dict, label: Column) -> Column:
    return question(qid, "choice", d["INSTRUCTIONS"], list(d["CRITERIA"]), label, d["CRITERIA"])


def _has_answer() -> Column:
    return F.exists("answers.text", lambda t: strip(t) != "")


@converter("squad2_train")
def squad2_train(rows: DataFrame, defs: dict) -> DataFrame:
    return records(rows, "squad2tr-", "squad2_train", "en", state_of(paragraph="context", question="question"), _noul_def("answerable", defs["squad2"], _has_answer()))


@converter("boolq_train")
def boolq_train(rows: DataFrame, defs: dict) -> DataFrame:
    return records(rows, "boolqtr-", "boolq_train", "en", state_of(passage="passage", question="question"), _noul_def("yes", defs["boolq"], F.col("answer")))


def _abstract(rows: DataFrame, d: dict) -> DataFrame:
    """Adds decision and context; rows without either go."""
    context = F.filter("contexts", lambda c: F.coalesce(strip(c), F.lit("")) != "")
    rows = rows.withColumn("_decision", F.lower(strip(F.coalesce("final_decision", F.lit(""))))).withColumn("_context", F.array_join(context, " "))
    return rows.where(F.col("_decision").isin(*d["CRITERIA"]) & (F.coalesce("_context", F.lit("")) != ""))


@converter("pubmedqa_artificial")
def pubmedqa_artificial(rows: DataFrame, defs: dict) -> DataFrame:
    d = defs["pubmedqa"]
    return records(_abstract(rows, d), "pubmedart-", "pubmedqa_artificial", "en", state_of(question="question", abstract_context="_context"), _choice_def("verdict", d, F.col("_decision")))


@converter("paws_train")
def paws_train(rows: DataFrame, defs: dict) -> DataFrame:
    return records(rows, "pawstr-", "paws_train", "en", state_of(sentence_1="sentence1", sentence_2="sentence2"), _noul_def("same", defs["paws"], F.col("label") == 1))


def _labels(d: dict, label: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in d["LABELS"].items() for x in kv]), F.col(label))


@converter("aegis2_train")
def aegis2_train(rows: DataFrame, defs: dict) -> DataFrame:
    d = defs["aegis2"]
    kept = rows.where((F.coalesce(strip(F.col("prompt")), F.lit("")) != "") & F.coalesce(F.col("prompt_label").isin(*d["LABELS"]), F.lit(False)) & F.col("reconstruction_id_if_redacted").isNull())
    return records(kept, "aegistr-", "aegis2_train", "en", state_of(user_message=strip(F.col("prompt"))), _noul_def("unsafe", d, _labels(d, "prompt_label")))


@converter("toxicchat")
def toxicchat(rows: DataFrame, defs: dict) -> DataFrame:
    kept = rows.where(F.coalesce(strip(F.col("user_input")), F.lit("")) != "")
    return records(kept, "toxicchat-", "toxicchat", "en", state_of(user_message=strip(F.col("user_input"))), _noul_def("unsafe", defs["aegis2"], F.col("toxicity").cast("int") != 0))


@converter("massive_de")
def massive_de(rows: DataFrame, defs: dict) -> DataFrame:
    d = defs["massive"]
    kept = rows.withColumn("_name", label_text(rows)).where(F.col("_name").isin(*d["CRITERIA"]))
    return records(kept, "massive-de-", "massive_de", "de", state_of(utterance="text", locale=F.lit("de-DE")), _choice_def("scenario", d, F.col("_name")))


# ---------------------------------------------------------- benchmark subsets
BENCHMARKS: dict[str, Callable[..., DataFrame]] = {}


def benchmark_rows(subset: str, rows: DataFrame, defs: dict) -> DataFrame:
    """id, domain, family, state and question of a public subset; what a subset
    can't use is left out. The whole-family sampler takes domain and family."""
    name = subset.split("-")[0]
    key, domain, family, state, ask, kept = BENCHMARKS[name](subset, rows, defs)
    return kept.select(key.alias("id"), domain.alias("domain"), family.alias("family"), state.alias("state"), ask.alias("question"))


def _benchmark(f: Callable) -> Callable:
    BENCHMARKS[f.__name__.removeprefix("b_")] = f
    return f


def _id(prefix: str, *cols: Column | str) -> Column:
    return F.concat(F.lit(prefix), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


@_benchmark
def b_boolq(subset, rows, defs):  # noqa: ANN001, ANN202
    ask = _noul_def("yes", defs["boolq"], F.col("answer"))
    return _id("boolq-", digest(F.concat("question", F.lit("\n"), "passage"))), F.lit("boolq"), digest(F.col("passage")), state_of(passage="passage", question="question"), ask, rows.where("answer is not null")


@_benchmark
def b_multinli(subset, rows, defs):  # noqa: ANN001, ANN202
    d = defs["multinli"]
    label = F.try_element_at(_names(d["OPTIONS"]), F.col("label").cast("int") + 1)
    state = state_of(premise=strip(F.col("premise")), hypothesis=strip(F.col("hypothesis")))
    return _id("multinli-", "pairID"), _id("multinli-", "genre"), F.col("promptID").cast("string"), state, _choice_def("nli", d, label), rows.where("label in (0, 1, 2)")


@_benchmark
def b_paws(subset, rows, defs):  # noqa: ANN001, ANN202
    return _id("paws-", "id"), F.lit("paws"), F.col("id").cast("string"), state_of(sentence_1="sentence1", sentence_2="sentence2"), _noul_def("same", defs["paws"], F.col("label") == 1), rows


@_benchmark
def b_squad2(subset, rows, defs):  # noqa: ANN001, ANN202
    return _id("squad2-", "id"), F.lit("squad2"), digest(F.col("context")), state_of(paragraph="context", question="question"), _noul_def("answerable", defs["squad2"], _has_answer()), rows


@_benchmark
def b_civil_comments(subset, rows, defs):  # noqa: ANN001, ANN202
    d, key = defs["civil_comments"], _id("civil_comments-", "row")
    return key, F.lit("civil_comments"), key, strip(F.col("text")), _noul_def("toxic", d, F.col("toxicity") >= d["THRESHOLD"]), rows.where(strip(F.col("text")) != "")


@_benchmark
def b_aegis2(subset, rows, defs):  # noqa: ANN001, ANN202
    d, key = defs["aegis2"], _id("aegis2-", "id")
    human = F.coalesce((F.col("prompt_label_source") == "human") & F.col("prompt_label").isin(*d["LABELS"]) & (strip(F.col("prompt")) != ""), F.lit(False))
    return key, F.lit("aegis2"), key, state_of(user_message=strip(F.col("prompt"))), _noul_def("unsafe", d, _labels(d, "prompt_label")), rows.where(human & F.col("reconstruction_id_if_redacted").isNull())


@_benchmark
def b_helpsteer2(subset, rows, defs):  # noqa: ANN001, ANN202
    d = defs["helpsteer2"]
    return _id("helpsteer2-", "row"), F.lit("helpsteer2"), _id("helpsteer2-", digest(F.col("prompt"))), state_of(prompt="prompt", response="response"), score("helpful", d["INSTRUCTIONS"], d["LEVELS"], F.col("helpfulness").cast("int")), rows


@_benchmark
def b_summeval(subset, rows, defs):  # noqa: ANN001, ANN202
    """A row per machine summary; its mean rating, half up, is the level."""
    dim, d = subset.split("-", 1)[1], defs["summeval"]
    each = rows.select("id", "text", F.posexplode("machine_summaries").alias("k", "summary"), dim).withColumn("mean", F.try_element_at(dim, F.col("k") + 1))
    ask = score(dim, d["INSTRUCTIONS"][dim], d["LEVELS"][dim], half_up_level(F.col("mean")).cast("int"))
    return _id(f"summeval-{dim}-", "id", F.lit("-"), "k"), F.lit(f"summeval-{dim}"), F.col("id").cast("string"), state_of(article="text", summary="summary"), ask, each


@_benchmark
def b_pubmedqa(subset, rows, defs):  # noqa: ANN001, ANN202
    d = defs["pubmedqa"]
    return _id("pubmedqa-", "pubid"), F.lit("pubmedqa"), F.col("pubid").cast("string"), state_of(question="question", abstract_context="_context"), _choice_def("verdict", d, F.col("_decision")), _abstract(rows, d)


@_benchmark
def b_vitaminc(subset, rows, defs):  # noqa: ANN001, ANN202
    d = defs["vitaminc"]
    return _id("vitaminc-", "unique_id"), _id("vitaminc-", "revision_type"), F.col("case_id").cast("string"), state_of(evidence="evidence", claim="claim"), _choice_def("verdict", d, F.col("label")), rows.where(F.col("label").isin(*d["CRITERIA"]))


@_benchmark
def b_massive(subset, rows, defs):  # noqa: ANN001, ANN202
    d, locale, key = defs["massive"], subset.split("-", 1)[1], _id("massive-", "id")
    kept = rows.withColumn("_name", label_text(rows)).where(F.col("_name").isin(*d["CRITERIA"]) & (strip(F.col("text")) != ""))
    return key, F.lit(f"massive-{locale}"), key, state_of(utterance="text", locale=F.lit(locale)), _choice_def("scenario", d, F.col("_name")), kept


def split_sink_counts(recs: DataFrame) -> DataFrame:
    """Manifest: records by source and split."""
    return recs.groupBy("source").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "eval").alias("eval"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Adds row, the place by `order` (small sources; large ones bring their own)."""
    return rows.withColumn("row", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1)
