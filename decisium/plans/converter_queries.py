"""Every converter and benchmark subset on stand-ins for its source, made from
the test tables, beside SQL that writes the records out anew.

A record is compared whole: id, source, language, split, a digest of its state,
and its questions as text (name, type, wording, options with descriptions,
label), one a line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rand import hash32_sql
from ..operators import converters as C
from ..operators import records as R
from .registry import ORACLES, QUERIES, table

#: Wordings, options, levels and labels of the public subsets, as a caller would give them.
DEFS = {
    **{k: {"INSTRUCTIONS": f"Is it so ({k})?", "CRITERIA": {"true": "it is", "false": "it is not"}} for k in ("squad2", "boolq", "paws")},
    "civil_comments": {"INSTRUCTIONS": "Is it toxic?", "CRITERIA": {"true": "toxic", "false": "civil"}, "THRESHOLD": 0.5},
    "aegis2": {"INSTRUCTIONS": "Is it unsafe?", "CRITERIA": {"true": "unsafe", "false": "safe"}, "LABELS": {"safe": False, "unsafe": True}},
    "pubmedqa": {"INSTRUCTIONS": "What is the verdict?", "CRITERIA": {"yes": "y", "no": "n", "maybe": "m"}},
    "massive": {"INSTRUCTIONS": "Which scenario?", "CRITERIA": {"en": "English", "de": "German"}},
    "multinli": {"INSTRUCTIONS": "Which relation?", "CRITERIA": {"entailment": "e", "neutral": "n", "contradiction": "c"}, "OPTIONS": C.NLI},
    "helpsteer2": {"INSTRUCTIONS": "How helpful?", "LEVELS": ["none", "little", "some", "much", "full"]},
    "summeval": {"INSTRUCTIONS": {"relevance": "How relevant?", "consistency": "How consistent?"}, "LEVELS": {"relevance": list("abcde"), "consistency": list("vwxyz")}},
    "vitaminc": {"INSTRUCTIONS": "Does it support?", "CRITERIA": {"SUPPORTS": "s", "REFUTES": "r"}},
}
KINDS = ["Company", "Artist", "Place"]


def _asked(q: Column) -> Column:
    opts = F.transform(q["options"], lambda o: F.concat(o["name"], F.lit("="), F.coalesce(o["desc"], F.lit(""))))
    return F.concat_ws("|", q["qid"], q["qtype"], q["instructions"], F.array_join(opts, ";"), F.coalesce(q["label"], F.lit("-")))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def ask(qid: str, qtype: str, wording: str, names: list[str] | str, label: str, descs: dict | None = None, when: str | None = None) -> str:
    """A question's line. wording, label and names that aren't a list are SQL."""
    if isinstance(names, list):
        opts = _text(";".join(f"{n}={(descs or {}).get(n) or ''}" for n in names))
    else:
        opts = f"list_aggregate(list_transform({names}, lambda n: n || '='), 'string_agg', ';')"
    line = f"{qid} || '|{qtype}|' || {wording} || '|' || {opts} || '|' || coalesce(({label})::VARCHAR, '-')"
    return f"CASE WHEN {when} THEN {line} END" if when else line


def yes_no(qid: str, wording: str, label: str, true: str = "", false: str = "", when: str | None = None) -> str:
    return ask(qid, "noul", wording, ["no", "yes"], label, {"no": false, "yes": true}, when)


def defined(qid: str, name: str, label: str) -> str:
    d = DEFS[name]
    if set(d["CRITERIA"]) == {"true", "false"}:
        return yes_no(_text(qid), _text(d["INSTRUCTIONS"]), label, d["CRITERIA"]["true"], d["CRITERIA"]["false"])
    return ask(_text(qid), "choice", _text(d["INSTRUCTIONS"]), list(d["CRITERIA"]), label, d["CRITERIA"])


def rated(qid: str, wording: str, levels: list[str], label: str, when: str | None = None) -> str:
    names = [str(i) for i in range(len(levels))]
    return ask(_text(qid), "score", wording, names, label, dict(zip(names, levels, strict=True)), when)


def pick(seed: str, xs: list[str], key: str = "row") -> str:
    return f"[{', '.join(map(_text, xs))}][({hash32_sql(seed, key)} % {len(xs)} + 1)::INT]"


def json(**fields: str) -> str:
    return f"to_json(struct_pack({', '.join(f'{k} := {v}' for k, v in fields.items())}))::VARCHAR"


def named(names: list[str], at: str) -> str:
    return f"[{', '.join(map(_text, names))}][{at}]"


def sampled(seed: str, *sizes: int) -> str:
    """The correct name `name` among drawn others of `vocabulary`, in hash order."""
    k = f"[{', '.join(map(str, sizes))}][({hash32_sql(seed + '-k', 'row')} % {len(sizes)} + 1)::INT]"
    by = lambda s, xs: f"list_transform(list_sort(list_transform({xs}, lambda x: {{'h': {hash32_sql(s, 'row', 'x')}, 'x': x}})), lambda s: s.x)"
    others = by(seed + "-mix", "list_filter(vocabulary, lambda x: x <> name)")
    return by(seed + "-order", f"list_concat([name], CASE WHEN {k} > 0 THEN ({others})[1:greatest({k} - 1, 1)] ELSE {others} END)")


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_TRAIN = "CASE WHEN split = 'train' THEN 'train' ELSE 'eval' END"
_D = "SELECT doc_id AS row, {cols} FROM {{documents}}"


def _add(kind: str, name: str, source: str, make: Callable[[DataFrame], DataFrame], sql: str, duck: str | None = None) -> None:
    """source: SQL of the stand-in, for Spark, with {documents}; duck: for DuckDB where it differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.sql(source, documents=table(spark, sf_dir, "documents"))
        return make(rows)

    run.__name__ = f"{kind}_{name.replace('-', '_').lower()}"
    QUERIES[run.__name__] = run
    ORACLES[run.__name__] = f"WITH src AS ({(duck or source).format(documents='documents')}) {sql}"


def convert(name: str, cols: str, key: str, lang: str, state: str, *questions: str, split: str = "'train'", where: str = "true", args: tuple = (), duck: str | None = None, source: str | None = None, frm: str = "src") -> None:
    def make(rows: DataFrame) -> DataFrame:
        got = R.CONVERTERS[name](rows, *args)
        return got.select("id", "source", "lang", "split", F.md5("state").alias("state_md5"), F.array_join(F.transform("questions", _asked), "\n").alias("questions"))

    lines = f"concat_ws(chr(10), {', '.join(questions)})"
    src = _D.format(cols=cols)
    sql = f"SELECT {key} AS id, '{source or name}' AS source, '{lang}' AS lang, {split} AS split, md5({state}) AS state_md5, {lines} AS questions FROM {frm} WHERE {where}"
    _add("source", name, src, make, sql, _D.format(cols=duck) if duck else None)


def bench(subset: str, cols: str, key: str, domain: str, family: str, state: str, question: str, where: str = "true", duck: str | None = None, frm: str = "src") -> None:
    def make(rows: DataFrame) -> DataFrame:
        got = C.benchmark_rows(subset, rows, DEFS)
        return got.select("id", "domain", "family", F.md5("state").alias("state_md5"), _asked(F.col("question")).alias("question"))

    sql = f"SELECT {key} AS id, {domain} AS domain, {family} AS family, md5({state}) AS state_md5, {question} AS question FROM {frm} WHERE {where}"
    _add("bench", subset, _D.format(cols=cols), make, sql, _D.format(cols=duck) if duck else None)


def _digest(x: str) -> str:
    return f"substr(sha256({x}), 1, 16)"


def _vocabulary(name: str, by: str = "") -> str:
    """src with name and the sorted distinct names (of each `by`)."""
    over = f"PARTITION BY {by}" if by else ""
    return f"(SELECT *, list_sort(list_distinct(list(name) OVER ({over}))) AS vocabulary FROM (SELECT *, {name} AS name FROM src))"


# ----------------------------------------------------------------------- Thai
_SPLIT = "CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split"
convert("wisesight", "text AS texts, CAST(doc_id % 5 AS INT) AS category", "'wisesight-' || row", "th", "texts", ask("'sentiment'", "choice", "'ข้อความนี้แสดงความรู้สึกแบบใด'", list(C.SENTIMENT_TH), f"coalesce({named(list(C.SENTIMENT_TH), 'category + 1')}, category::VARCHAR)", C.SENTIMENT_TH), split="'eval'")
convert("wongnai", f"text AS review_body, CAST(doc_id % 5 AS INT) AS star_rating, {_SPLIT}", "'wongnai-' || split || '-' || row", "th", "review_body", rated("rating", pick("wongnai", ["รีวิวนี้ให้คะแนนร้านกี่ดาว", "ประเมินความพึงพอใจของผู้รีวิว"]), C.STARS_TH, "star_rating"), split=_TRAIN)

_TOPIC_COLS = ", ".join(f"CAST(CASE WHEN (doc_id * {3 + i} + {i}) % 17 < 2 THEN 1 ELSE 0 END AS INT) AS {t}" for i, t in enumerate(C.TOPICS_TH))
_HAS = f"list_filter([{', '.join(map(_text, C.TOPICS_TH))}], lambda t: list_contains(given, t))"
_LACKS = f"list_filter([{', '.join(map(_text, C.TOPICS_TH))}], lambda t: NOT list_contains(given, t))"
_THAI = f"map([{', '.join(map(_text, C.TOPICS_TH))}], [{', '.join(map(_text, C.TOPICS_TH.values()))}])"


def _about(list_: str, seed: str, label: str) -> str:
    t = f"({list_})[({hash32_sql(seed, 'row')} % greatest(len({list_}), 1) + 1)::INT]"
    return yes_no(f"'is_' || {t}", f"'ข่าวนี้เกี่ยวข้องกับหัวข้อ ''' || {_THAI}[{t}] || ''' หรือไม่'", label, when=f"len({list_}) > 0")


convert(
    "prachathai", f"substr(text, 1, 30) AS title, text AS body_text, {_SPLIT}, {_TOPIC_COLS}", "'prachathai-' || split || '-' || row", "th", json(title="title", body="substr(body_text, 1, 3000)"),
    _about("has", "has", "true"), _about("lacks", "lacks", "false"), ask("'topic'", "choice", "'ข่าวนี้อยู่ในหมวดหลักใด'", list(C.TOPICS_TH.values()), f"{_THAI}[has[1]]", when="len(has) = 1"), split=_TRAIN,
    frm=f"(SELECT *, {_HAS} AS has, {_LACKS} AS lacks FROM (SELECT *, list_filter([{', '.join(f'CASE WHEN {t} = 1 THEN {_text(t)} END' for t in C.TOPICS_TH)}], lambda t: t IS NOT NULL) AS given FROM src))",
)


def _nli(name: str, key: str, lang: str, wording: str, wording2: str, descs: dict | None, **kw) -> None:  # noqa: ANN003
    label = named(C.NLI, "label + 1")
    convert(name, f"text AS premise, source AS hypothesis, CAST(doc_id % 3 AS INT) AS label, {_SPLIT}", key, lang, json(premise="premise", hypothesis="hypothesis"), ask("'nli'", "choice", _text(wording), C.NLI, label, descs), yes_no("'entails'", _text(wording2), f"{label} = 'entailment'"), **kw)


_nli("xnli_th", "'xnli-th-' || split || '-' || row", "th", "ความสัมพันธ์ระหว่าง premise และ hypothesis คืออะไร", "hypothesis สรุปได้จาก premise หรือไม่", C.NLI_TH, split=_TRAIN)
_SPACED = "replace(name, '_', ' ')"
convert("massive_th", f"text, source || '_' || lang AS label_text, {_SPLIT}", "'massive-th-' || split || '-' || row", "mixed", "text", ask("'intent'", "choice", pick("massive-th", ["ผู้ใช้ต้องการทำอะไร (intent)", "What does the user want to do?"]), f"list_transform({sampled('massive-th', 0, 20, 10, 5)}, lambda n: replace(n, '_', ' '))", _SPACED), split=_TRAIN, frm=_vocabulary("label_text", "split"), where="len(vocabulary) >= 2")
convert("sib200_th", f"text, {named(C.SIB_TOPICS, 'doc_id % 7 + 1')} AS category".replace("[", "element_at(array(", 1).replace("][", "), CAST(", 1).replace("]", " AS INT))", 1), "'sib200-th-' || row", "mixed", "text", ask("'topic'", "choice", "'ข้อความนี้เกี่ยวกับหัวข้อใด'", C.SIB_TOPICS, "category"), split="'eval'", duck=f"text, {named(C.SIB_TOPICS, 'doc_id % 7 + 1')} AS category")
convert("thai_toxicity", "CASE doc_id % 9 WHEN 0 THEN 'TWEET_NOT_FOUND' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE text END AS tweet_text, CAST(doc_id % 2 AS INT) AS is_toxic", "'thaitox-' || row", "th", "tweet_text", yes_no("'toxic'", "'ข้อความนี้เป็นข้อความที่เป็นพิษ (toxic) หรือไม่'", "is_toxic <> 0", "มีการด่าทอ เหยียดหยาม หรือคุกคาม", "สุภาพหรือเป็นกลาง"), where="coalesce(tweet_text, '') NOT IN ('', 'TWEET_NOT_FOUND')")
_KEYS = "list_filter(['a', 'b', 'c', 'd', 'e'], lambda k: coalesce(CASE k WHEN 'a' THEN a WHEN 'b' THEN b WHEN 'c' THEN c WHEN 'd' THEN d ELSE e END, '') <> '')"
_EXAM = "list_aggregate(list_transform(keys, lambda k: k || '=' || CASE k WHEN 'a' THEN a WHEN 'b' THEN b WHEN 'c' THEN c WHEN 'd' THEN d ELSE e END), 'string_agg', ';')"
convert("thai_exam", "lang AS config, text AS question, source AS a, CASE WHEN doc_id % 2 = 0 THEN lang END AS b, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'third' END AS c, CAST(NULL AS STRING) AS d, CASE WHEN doc_id % 5 = 0 THEN 'fifth' END AS e, substr('abcde', CAST(doc_id % 5 + 1 AS INT), 1) AS answer", "'thaiexam-' || config || '-' || row", "th", "question", f"'answer|choice|ข้อใดคือคำตอบที่ถูกต้อง|' || {_EXAM} || '|' || answer", frm=f"(SELECT *, {_KEYS} AS keys FROM src)", where="len(keys) >= 2 AND list_contains(keys, answer)")


def _negatives(seed: str) -> str:
    return f"""(SELECT a.*, o.context AS other FROM (SELECT src.*, count(*) OVER () AS n FROM src) a
 JOIN (SELECT row, row_number() OVER (ORDER BY {hash32_sql(seed, "row")}, row) - 1 AS place FROM src) p ON p.place = {hash32_sql(seed + "-draw", "a.row")} % a.n JOIN src o ON o.row = p.row)"""


convert("iapp_wiki_qa", "text AS context, 'What of ' || source || '?' AS question", "'iappqa-' || row || '-' || j", "th", json(question="question", passage="substr(c, 1, 2000)"), yes_no("'relevant'", "'passage นี้มีคำตอบของคำถามหรือไม่'", "j = 0 OR other = context"), frm=f"(SELECT row, question, context, other, j, CASE j WHEN 0 THEN context ELSE other END AS c FROM {_negatives('iapp')}, range(0, 2) r(j))")
convert(
    "xquad_th", "text AS context, 'What of ' || source || '?' AS question", "'xquadth-' || row || side", "th", json(**{"ย่อหน้า": "c", "คำถาม": "question"}),
    yes_no("'answerable'", "'ย่อหน้านี้มีข้อมูลที่ตอบคำถามได้หรือไม่ ถ้าย่อหน้าพูดถึงเรื่องเดียวกันแต่ไม่ได้ระบุข้อเท็จจริงที่ถามให้ถือว่าตอบไม่ได้'", "side = 'p'", "ย่อหน้าระบุคำตอบไว้อย่างชัดเจน", "ย่อหน้าไม่ได้ระบุคำตอบ"),
    frm=f"(SELECT row, question, context, side, CASE side WHEN 'p' THEN context ELSE other END AS c FROM {_negatives('xquad')}, (VALUES ('p'), ('n')) s(side))", where="side = 'p' OR c <> context",
)

# -------------------------------------------------------------------- English
_asks = lambda what: [x.replace("{what}", what) for x in R.CHOICE_EN]
convert("massive_en", "text, source || '_' || lang AS label_text", "'massive-en-' || row", "en", "text", ask("'intent'", "choice", pick("massive-en", _asks("intent")), f"list_transform({sampled('massive-en', 0, 30, 10)}, lambda n: replace(n, '_', ' '))", _SPACED), frm=_vocabulary("label_text"))
convert("banking77", "text, source || '_' || lang AS label_text", "'banking77-' || row", "en", "text", ask("'intent'", "choice", "'What is the customer''s intent?'", "list_transform(vocabulary, lambda n: replace(n, '_', ' '))", _SPACED), split="'eval'", frm=_vocabulary("label_text"))
convert("clinc", "text, source AS intent", "'clinc-' || row", "en", "text", ask("'intent'", "choice", pick("clinc", _asks("intent")), sampled("clinc", 0, 50, 15), "name"), frm=_vocabulary("intent"))
convert("ag_news", "text, CAST(doc_id % 4 AS INT) AS label", "'agnews-' || row", "en", "text", ask("'topic'", "choice", pick("ag", _asks("news topic")), C.NEWS_TOPICS, named(C.NEWS_TOPICS, "label + 1")))
convert("dbpedia", "source AS title, text AS content, CAST(doc_id % 3 AS INT) AS label", "'dbpedia-' || row", "en", json(title="title", content="content"), ask("'type'", "choice", "'What kind of entity is this article about?'", KINDS, named(KINDS, "label + 1")), args=(KINDS,))
_nli("mnli", "'mnli-' || row", "en", "What is the relation between premise and hypothesis?", "Does the premise entail the hypothesis?", None)
convert("mmlu", "text AS question, array(source, lang, CASE WHEN doc_id % 4 = 0 THEN lang ELSE 'other' END) AS choices, CAST(doc_id % 3 AS INT) AS answer", "'mmlu-' || row", "en", "question", ask("'answer'", "choice", "'Which option answers the question?'", "choices", "choices[answer + 1]"), where="len(list_distinct(choices)) = len(choices)", duck="text AS question, [source, lang, CASE WHEN doc_id % 4 = 0 THEN lang ELSE 'other' END] AS choices, CAST(doc_id % 3 AS INT) AS answer")
convert("arc", "lang AS config, text AS question, named_struct('text', array(source, lang, CASE WHEN doc_id % 4 = 0 THEN lang ELSE 'other' END), 'label', array('A', 'B', 'C')) AS choices, substr('ABCD', CAST(doc_id % 4 + 1 AS INT), 1) AS answerKey", "'arc-' || config || '-' || row", "en", "question", ask("'answer'", "choice", "'Which option is correct?'", "choices.text", "choices.text[list_position(choices.label, answerKey)]"), where="list_position(choices.label, answerKey) > 0 AND len(list_distinct(choices.text)) = 3", duck="lang AS config, text AS question, {{'text': [source, lang, CASE WHEN doc_id % 4 = 0 THEN lang ELSE 'other' END], 'label': ['A', 'B', 'C']}} AS choices, substr('ABCD', CAST(doc_id % 4 + 1 AS INT), 1) AS answerKey")
convert("helpsteer2", "source AS prompt, text AS response, " + ", ".join(f"CASE WHEN doc_id % {5 + i} > 0 THEN CAST((doc_id + {i}) % 5 AS INT) END AS {d}" for i, d in enumerate(C.HELP_DIMS)), "'helpsteer2-' || row", "en", json(prompt="substr(prompt, 1, 3000)", response="substr(response, 1, 4000)"), *[rated(d, f"'How {a} is the response?'", C.HELP_LEVELS, d, f"{d} IS NOT NULL") for d, a in zip(C.HELP_DIMS, ["helpful", "correct", "coherent", "verbose"], strict=True)])

# --------------------------------------------------------------------- agents
_TOOLS = "'[{{\"name\":\"' || lang || '\",\"description\":\"' || repeat('about ', CAST(doc_id % 50 AS INT)) || '\"}},{{\"name\":\"' || source || '\"}}]'"
convert(
    "xlam_tools", f"text AS query, CASE WHEN doc_id % 6 = 0 THEN '[]' ELSE {_TOOLS} END AS tools, CASE WHEN doc_id % 4 = 0 THEN '[{{{{\"name\":\"odd\"}}}}]' ELSE '[{{{{\"name\":\"' || source || '\"}}}}]' END AS answers, lang, source AS tool", "'xlam-' || row", "en", json(user_request="query"),
    "'tool|choice|Which tool should be called first?|' || lang || '=' || substr(repeat('about ', CAST(row % 50 AS INT)), 1, 200) || ';' || tool || '=|' || tool", split="CASE WHEN row % 50 = 0 THEN 'eval' ELSE 'train' END", where="row % 6 <> 0 AND row % 4 <> 0",
)

# ------------------------------------------- training sets in benchmark wording
_ANSWERS = "named_struct('text', CASE doc_id % 3 WHEN 0 THEN CAST(array() AS ARRAY<STRING>) WHEN 1 THEN array('  ') ELSE array(' ', source) END) AS answers"
_ANSWERS_DUCK = "{{'text': CASE doc_id % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['  '] ELSE [' ', source] END}} AS answers"
_FOUND = f"len(list_filter(answers.text, lambda t: {strip('t')} <> '')) > 0"
convert("squad2_train", f"text AS context, source AS question, {_ANSWERS}", "'squad2tr-' || row", "en", json(paragraph="context", question="question"), defined("answerable", "squad2", _FOUND), args=(DEFS,), duck=f"text AS context, source AS question, {_ANSWERS_DUCK}")
convert("boolq_train", "text AS passage, source AS question, doc_id % 2 = 0 AS answer", "'boolqtr-' || row", "en", json(passage="passage", question="question"), defined("yes", "boolq", "answer"), args=(DEFS,))
convert("paws_train", "text AS sentence1, source AS sentence2, CAST(doc_id % 2 AS INT) AS label", "'pawstr-' || row", "en", json(sentence_1="sentence1", sentence_2="sentence2"), defined("same", "paws", "label = 1"), args=(DEFS,))
_VERDICT = "CASE doc_id % 5 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'NO' WHEN 2 THEN 'maybe' WHEN 3 THEN 'odd' END AS final_decision"
_CONTEXTS = f"source AS question, CASE doc_id % 4 WHEN 0 THEN array(' ', CAST(NULL AS STRING)) ELSE array(text, CAST(NULL AS STRING), '  ', lang) END AS contexts, {_VERDICT}"
_CONTEXTS_DUCK = f"source AS question, CASE doc_id % 4 WHEN 0 THEN [' ', NULL] ELSE [text, NULL, '  ', lang] END AS contexts, {_VERDICT}"
_ABSTRACT = f"(SELECT *, lower({strip('final_decision')}) AS decision, array_to_string(list_filter(contexts, lambda c: coalesce({strip('c')}, '') <> ''), ' ') AS context FROM src)"
_DECIDED = "decision IN ('yes', 'no', 'maybe') AND coalesce(context, '') <> ''"
convert("pubmedqa_artificial", _CONTEXTS, "'pubmedart-' || row", "en", json(question="question", abstract_context="context"), defined("verdict", "pubmedqa", "decision"), args=(DEFS,), duck=_CONTEXTS_DUCK, frm=_ABSTRACT, where=_DECIDED)
_PROMPT = "CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE ' ' || text || ' ' END AS prompt, CASE doc_id % 4 WHEN 0 THEN 'safe' WHEN 1 THEN 'odd' ELSE 'unsafe' END AS prompt_label, CASE WHEN doc_id % 11 = 0 THEN 'x' END AS reconstruction_id_if_redacted"
_SAFE = f"coalesce({strip('prompt')}, '') <> '' AND prompt_label IN ('safe', 'unsafe') AND reconstruction_id_if_redacted IS NULL"
convert("aegis2_train", _PROMPT, "'aegistr-' || row", "en", json(user_message=strip("prompt")), defined("unsafe", "aegis2", "prompt_label = 'unsafe'"), args=(DEFS,), where=_SAFE)
convert("toxicchat", "CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE ' ' || text END AS user_input, CAST(doc_id % 3 AS INT) AS toxicity", "'toxicchat-' || row", "en", json(user_message=strip("user_input")), defined("unsafe", "aegis2", "toxicity <> 0"), args=(DEFS,), where=f"{strip('user_input')} <> ''")
convert("massive_de", "text, lang AS label_text", "'massive-de-' || row", "de", json(utterance="text", locale="'de-DE'"), defined("scenario", "massive", "label_text"), args=(DEFS,), where="label_text IN ('en', 'de')")

# ---------------------------------------------------------- benchmark subsets
bench("boolq", "text AS passage, source AS question, CASE WHEN doc_id % 5 > 0 THEN doc_id % 2 = 0 END AS answer", f"'boolq-' || {_digest('question || chr(10) || passage')}", "'boolq'", _digest("passage"), json(passage="passage", question="question"), defined("yes", "boolq", "answer"), "answer IS NOT NULL")
bench("multinli", "doc_id AS pairID, doc_id % 50 AS promptID, lang AS genre, ' ' || text AS premise, source AS hypothesis, CAST(doc_id % 4 AS INT) AS label", "'multinli-' || pairID", "'multinli-' || genre", "promptID::VARCHAR", json(premise=strip("premise"), hypothesis="hypothesis"), defined("nli", "multinli", named(C.NLI, "label + 1")), "label < 3")
bench("paws", "doc_id AS id, text AS sentence1, source AS sentence2, CAST(doc_id % 2 AS INT) AS label", "'paws-' || id", "'paws'", "id::VARCHAR", json(sentence_1="sentence1", sentence_2="sentence2"), defined("same", "paws", "label = 1"))
bench("squad2", f"doc_id AS id, text AS context, source AS question, {_ANSWERS}", "'squad2-' || id", "'squad2'", _digest("context"), json(paragraph="context", question="question"), defined("answerable", "squad2", _FOUND), duck=f"doc_id AS id, text AS context, source AS question, {_ANSWERS_DUCK}")
bench("civil_comments", "CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE text || ' ' END AS text, CAST(doc_id % 10 AS DOUBLE) / 10 AS toxicity", "'civil_comments-' || row", "'civil_comments'", "'civil_comments-' || row", strip("text"), defined("toxic", "civil_comments", "toxicity >= 0.5"), f"{strip('text')} <> ''")
bench("aegis2", f"doc_id AS id, {_PROMPT}, CASE WHEN doc_id % 3 = 0 THEN 'llm' ELSE 'human' END AS prompt_label_source", "'aegis2-' || id", "'aegis2'", "'aegis2-' || id", json(user_message=strip("prompt")), defined("unsafe", "aegis2", "prompt_label = 'unsafe'"), f"{_SAFE} AND prompt_label_source = 'human'")
bench("helpsteer2", "source AS prompt, text AS response, CAST(doc_id % 5 AS INT) AS helpfulness", "'helpsteer2-' || row", "'helpsteer2'", f"'helpsteer2-' || {_digest('prompt')}", json(prompt="prompt", response="response"), rated("helpful", _text(DEFS["helpsteer2"]["INSTRUCTIONS"]), DEFS["helpsteer2"]["LEVELS"], "helpfulness"))
for _dim in ("relevance", "consistency"):
    _means = "CAST(doc_id % 9 AS DOUBLE) / 2 + 1, CAST(doc_id % 5 AS DOUBLE) + 0.25"
    bench(
        f"summeval-{_dim}", f"doc_id AS id, text, array(source, lang) AS machine_summaries, array({_means}) AS {_dim}", f"'summeval-{_dim}-' || id || '-' || k", f"'summeval-{_dim}'", "id::VARCHAR", json(article="text", summary="machine_summaries[k + 1]"),
        rated(_dim, _text(DEFS["summeval"]["INSTRUCTIONS"][_dim]), DEFS["summeval"]["LEVELS"][_dim], f"least(4, greatest(0, floor({_dim}[k + 1] + 0.5) - 1))::INT"), duck=f"doc_id AS id, text, [source, lang] AS machine_summaries, [{_means}] AS {_dim}", frm="src, range(0, 2) r(k)",
    )
bench("pubmedqa", f"doc_id AS pubid, {_CONTEXTS}", "'pubmedqa-' || pubid", "'pubmedqa'", "pubid::VARCHAR", json(question="question", abstract_context="context"), defined("verdict", "pubmedqa", "decision"), _DECIDED, duck=f"doc_id AS pubid, {_CONTEXTS_DUCK}", frm=_ABSTRACT)
bench("vitaminc-dev", "doc_id AS unique_id, doc_id % 40 AS case_id, lang AS revision_type, text AS evidence, source AS claim, CASE doc_id % 3 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'REFUTES' ELSE 'NOT ENOUGH INFO' END AS label", "'vitaminc-' || unique_id", "'vitaminc-' || revision_type", "case_id::VARCHAR", json(evidence="evidence", claim="claim"), defined("verdict", "vitaminc", "label"), "label IN ('SUPPORTS', 'REFUTES')")
for _locale in ("de-DE", "en-US"):
    bench(f"massive-{_locale}", "doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE text END AS text, lang AS label_text", "'massive-' || id", f"'massive-{_locale}'", "'massive-' || id", json(utterance="text", locale=f"'{_locale}'"), defined("scenario", "massive", "label_text"), f"label_text IN ('en', 'de') AND {strip('text')} <> ''")
