"""The targeted tasks on objects made from the test tables, beside SQL that says
which items stay, why others go, and what the records hold.

An object's relabel list differs from it at some places, is too short for some
rows, and some objects aren't of the task's form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rand import hash32_sql, uniform_sql
from ..operators import tasks as K
from .converter_queries import DEFS, _asked, _text, ask, defined, json, yes_no
from .registry import query, table

_TURNS = "t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n, CASE WHEN conv_id % 3 = 0 THEN 'th' ELSE 'en' END AS lang FROM conversations)"
_NONE = "NULL AS state_md5, NULL AS asked"


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("id", "lang", F.md5("state").alias("state_md5"), F.array_join(F.transform("questions", _asked), "\n").alias("asked"), "reason")


def _object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a conversation, with its turns in order as x."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return c.withColumn("lang", F.when(F.col("idx") % 3 == 0, "th").otherwise("en"))


def _relabelled(make) -> Column:  # noqa: ANN001
    """An answer for each turn, but one too few where the conversation's number is divisible by four."""
    return F.transform(F.slice("x", F.lit(1), F.size("x") - (F.col("idx") % 4 == 0).cast("int")), make)


def _broken(generated: Column) -> Column:
    return F.when(F.col("idx") % 9 == 0, "There is nothing to give.").otherwise(F.concat(F.lit("```json\n"), generated, F.lit("\n```")))


def _thai_or(name: str, qid: str, label: str) -> str:
    text, criteria = K.TH[name]
    if set(criteria) == {"true", "false"}:
        th = yes_no(_text(qid), _text(text), label, criteria["true"], criteria["false"])
    else:
        th = ask(_text(qid), "choice", _text(text), list(criteria), label, criteria)
    return f"CASE WHEN lang = 'th' THEN {th} ELSE {defined(qid, name, label)} END"


def _flagged(state: str, asked: str) -> str:
    """SQL of the two tasks whose items are turns with a flag."""
    return f"""WITH {_TURNS}, r AS (SELECT *, CASE WHEN conv_id % 4 = 0 AND pos = n - 1 THEN 'unlabelled' WHEN turn % 5 = 3 THEN 'label differs' END AS reason FROM t WHERE conv_id % 9 <> 0)
SELECT conv_id || '-' || pos AS id, lang, CASE WHEN reason IS NULL THEN md5({state}) END AS state_md5, CASE WHEN reason IS NULL THEN {asked} END AS asked, reason FROM r
UNION ALL SELECT DISTINCT conv_id || '-0', lang, {_NONE}, 'invalid' FROM t WHERE conv_id % 9 = 0"""


@query(_flagged(json(user_message="text"), _thai_or("aegis2", "unsafe", "turn % 2 = 0")))
def task_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = lambda t: t["turn"] % 2 == 0
    c = _talks(spark, sf_dir)
    c = c.withColumn("generated", _broken(_object(items=F.transform("x", lambda t: F.struct(t["text"].alias("text"), even(t).alias("unsafe"))))))
    c = c.withColumn("relabel", _object(unsafe=_relabelled(lambda t: even(t) != (t["turn"] % 5 == 3))))
    return _told(K.TASKS["safety"](c, DEFS))


@query(_flagged(f"CASE WHEN lang = 'th' THEN {json(**{chr(34) + 'ประโยค_1' + chr(34): 'text', chr(34) + 'ประโยค_2' + chr(34): 'role'})} ELSE {json(sentence_1='text', sentence_2='role')} END", _thai_or("paws", "same", "turn % 2 = 0")))
def task_paraphrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = lambda t: t["turn"] % 2 == 0
    c = _talks(spark, sf_dir)
    c = c.withColumn("generated", _broken(_object(pairs=F.transform("x", lambda t: F.struct(t["text"].alias("a"), t["role"].alias("b"), even(t).alias("same_meaning"))))))
    c = c.withColumn("relabel", _object(same=_relabelled(lambda t: even(t) != (t["turn"] % 5 == 3))))
    return _told(K.TASKS["paraphrase"](c, DEFS))


_QA_STATE = f"md5(CASE WHEN lang = 'th' THEN {json(**{chr(34) + 'ย่อหน้า' + chr(34): 'passage', chr(34) + 'คำถาม' + chr(34): 'text'})} ELSE {json(passage='passage', question='text')} END)"
_ANSWER = "CASE WHEN turn % 2 = 0 THEN 'yes' ELSE 'no' END"


@query(
    f"""WITH {_TURNS},
k AS (SELECT *, ['yesno', 'fact', 'unanswerable'][turn % 3 + 1] AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3, turn) - 1 AS i, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS passage,
  (conv_id % 9 <> 0 AND count(*) FILTER (turn % 3 = 0) OVER c > 0 AND count(*) FILTER (turn % 3 = 2) OVER c > 0) AS good FROM t WINDOW c AS (PARTITION BY conv_id)),
r AS (SELECT *, CASE WHEN conv_id % 4 = 1 THEN 'lengths differ' WHEN kind = 'unanswerable' THEN CASE WHEN (turn + conv_id) % 4 <> 0 THEN 'answerable' END
  WHEN (turn + conv_id) % 4 = 0 THEN 'not answerable' WHEN kind = 'yesno' AND turn % 5 = 0 AND turn % 2 = 0 THEN 'other answer' END AS reason FROM k WHERE good)
SELECT conv_id || CASE WHEN kind = 'unanswerable' THEN '-u' ELSE '-a' END || i AS id, lang, CASE WHEN reason IS NULL THEN {_QA_STATE} END AS state_md5,
 CASE WHEN reason IS NULL THEN concat_ws(chr(10), {_thai_or("squad2", "answerable", "kind <> 'unanswerable'")}, CASE WHEN kind = 'yesno' THEN {_thai_or("boolq", "yes", "turn % 2 = 0")} END, CASE WHEN kind = 'yesno' THEN {_thai_or("pubmedqa", "verdict", _ANSWER)} END) END AS asked, reason FROM r
UNION ALL
SELECT conv_id || '-m', lang, {_QA_STATE}, {_thai_or("pubmedqa", "verdict", "'maybe'")}, NULL FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rk FROM r WHERE kind = 'unanswerable') WHERE rk = 1 AND conv_id IN (SELECT conv_id FROM r WHERE reason IS NULL)
UNION ALL SELECT DISTINCT conv_id || '-a0', lang, {_NONE}, 'invalid' FROM k WHERE NOT good"""
)
def task_grounded_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda i: F.filter("x", lambda t: t["turn"] % 3 == i)
    answer = lambda t: F.when(t["turn"] % 2 == 0, "yes").otherwise("no")
    q = lambda t: t["text"].alias("q")
    c = _talks(spark, sf_dir).withColumn("passage", F.element_at("x", 1)["text"])
    c = c.withColumn("generated", _broken(_object(answerable_yesno=F.transform(of(0), lambda t: F.struct(q(t), answer(t).alias("answer"))), answerable_fact=F.transform(of(1), lambda t: F.struct(q(t))), unanswerable=F.transform(of(2), lambda t: F.struct(q(t))))))
    result = lambda t: F.struct(((t["turn"] + F.col("idx")) % 4 != 0).alias("answerable"), F.when(t["turn"] % 5 == 0, "No").otherwise(F.upper(answer(t))).alias("yesno"))
    results = F.transform(F.concat(of(0), of(1), of(2)), result)
    c = c.withColumn("relabel", _object(results=F.slice(results, F.lit(1), F.greatest(F.lit(0), F.size(results) - (F.col("idx") % 4 == 1).cast("int")))))
    return _told(K.TASKS["grounded_qa"](c, DEFS))


_LEVELS = DEFS["summeval"]


def _rated(dim: str, pos: int, level: int, summary: str) -> str:
    line = ask(_text(dim), "score", _text(_LEVELS["INSTRUCTIONS"][dim]), [str(i) for i in range(5)], str(level), {str(i): x for i, x in enumerate(_LEVELS["LEVELS"][dim])})
    return f"SELECT doc_id, '{dim[0]}{pos}' AS tag, {pos} AS pos, {level} AS level, {summary} AS summary, {line} AS asked, text, lang FROM documents"


@query(
    f"""WITH i AS ({" UNION ALL ".join(_rated(*x) for x in [("relevance", 0, 4, "md5(text)"), ("relevance", 1, 3, "source"), ("relevance", 2, 2, "lang"), ("consistency", 3, 0, "source"), ("consistency", 4, 2, "lang"), ("consistency", 5, 4, "md5(source)")])}),
r AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'lengths differ' WHEN doc_id % 11 = 0 AND pos = 0 THEN 'no rating' WHEN (doc_id + pos) % 4 = 3 THEN 'rating differs' END AS reason FROM i WHERE text IS NOT NULL)
SELECT doc_id || '-' || tag AS id, lang, CASE WHEN reason IS NULL THEN md5({json(article="text", summary="summary")}) END AS state_md5, CASE WHEN reason IS NULL THEN asked END AS asked, reason FROM r"""
)
def task_summary_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("idx"), "lang", F.col("text").alias("article"), "source")
    scale = lambda *pairs: F.struct(*[v.alias(k) for k, v in pairs])
    given = _object(
        relevance=scale(("5", F.md5("article")), ("4", F.col("source")), ("3", F.col("lang")), ("2", F.lit(" ")), ("9", F.lit("x"))),
        consistency=scale(("1", F.col("source")), ("3", F.col("lang")), ("2", F.lit("x")), ("5", F.md5("source"))),
    )
    ratings = [F.when((F.col("idx") % 11 == 0) & F.lit(i == 0), "x").otherwise((lvl + (F.col("idx") + i) % 4).cast("string")) for i, lvl in enumerate([4, 3, 2, 0, 2, 4])]
    many = F.slice(F.array(*ratings), F.lit(1), 6 - (F.col("idx") % 5 == 0).cast("int"))
    return _told(K.TASKS["summary_rating"](d.withColumn("generated", given).withColumn("relabel", _object(ratings=many)), DEFS))


_KEY = ("conv_id", "pos", "j")
_SORTED = "list_transform(list_sort(list_transform({xs}, lambda x: {{'h': {h}, 'x': x}})), lambda s: s.x)"
_OTHERS = _SORTED.format(xs="list_filter(names, lambda x: x <> intent)", h=hash32_sql("intent-pick", *_KEY, "x"))
_CHOSEN = _SORTED.format(xs=f"list_concat([intent], ({_OTHERS})[1:k - 1])", h=hash32_sql("intent-order", *_KEY, "x"))
_SHOWN = f"x || '=' || CASE WHEN substr(x, 2)::INT % 3 <> 0 AND {uniform_sql('intent-told', *_KEY, 'x')} < 0.6 THEN 'about ' || substr(x, 2) ELSE '' END"


@query(
    f"""WITH {_TURNS}, m AS (SELECT *, CASE WHEN conv_id % 9 = 0 THEN 10 ELSE 30 + conv_id % 20 END AS size FROM t),
u AS (SELECT *, 'i' || (turn * 7 % size) AS intent, list_transform(range(size), lambda i: 'i' || i) AS names, CASE WHEN conv_id % 4 = 0 AND pos = n - 1 THEN 'unlabelled' WHEN turn % 5 = 3 THEN 'label differs' END AS reason FROM m WHERE size >= 30),
s AS (SELECT *, list_sort(list_distinct([size, least(size, [20, 40, 77][({hash32_sql("intent-k", "conv_id", "pos")} % 3 + 1)::INT])])) AS sizes FROM u WHERE reason IS NULL),
e AS (SELECT *, unnest(range(len(sizes))) AS j, unnest(sizes) AS k FROM s),
c AS (SELECT *, [{", ".join(map(_text, K.INTENT))}][({hash32_sql("intent-ask", *_KEY)} % 2 + 1)::INT] AS wording, {_CHOSEN} AS chosen FROM e)
SELECT conv_id || '-' || pos || '-' || j AS id, lang, md5(text) AS state_md5, 'intent|choice|' || wording || '|' || array_to_string(list_transform(chosen, lambda x: {_SHOWN}), ';') || '|' || intent AS asked, NULL AS reason FROM c
UNION ALL SELECT conv_id || '-' || pos, lang, {_NONE}, reason FROM u WHERE reason IS NOT NULL
UNION ALL SELECT DISTINCT conv_id || '-0', lang, {_NONE}, 'invalid' FROM m WHERE size < 30"""
)
def task_finegrained_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _talks(spark, sf_dir).withColumn("size", F.when(F.col("idx") % 9 == 0, 10).otherwise(30 + F.col("idx") % 20))
    named = lambda i: F.concat(F.lit("i"), i.cast("string"))
    intents = F.map_from_entries(F.transform(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), lambda i: F.struct(named(i), F.when(i % 3 != 0, F.concat(F.lit("about "), i.cast("string"))).otherwise(""))))
    own = lambda t: named(t["turn"] * 7 % F.col("size"))
    c = c.withColumn("generated", _object(intents=intents, utterances=F.transform("x", lambda t: F.struct(t["text"].alias("text"), own(t).alias("intent")))))
    c = c.withColumn("relabel", _object(labels=_relabelled(lambda t: F.when(t["turn"] % 5 == 3, "i-").otherwise(own(t)))))
    return _told(K.TASKS["finegrained_intent"](c, DEFS))
