"""Record queries: rendering, validation, converters, gates, sequences."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rand import hash32, hash32_sql, uniform, uniform_sql
from ..operators import mixture as X
from ..operators import records as R
from ..operators.decide import chance
from .registry import query, table


def _array(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


# ---------------------------------------------------------------- labels, JSON
_FENCED = "CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Here it is: ' || props || ' done' WHEN 2 THEN props ELSE 'no json ' || replace(props, '}', '') END"
_CUT = "nullif(regexp_extract(regexp_replace(trim(answer), '(?m)^```(?:json)?|```$', '', 'g'), '(?s)\\{.*\\}', 0), '')"


@query(f"WITH a AS (SELECT event_id, {_FENCED} AS answer FROM events), j AS (SELECT event_id, {_CUT} AS j FROM a) SELECT event_id, CASE WHEN json_valid(j) THEN j END AS json FROM j")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON out of fenced, wordy, bare and broken answers."""
    k, p = F.col("event_id") % 4, F.col("props")
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), p, F.lit(" done"))).when(k == 2, p).otherwise(F.concat(F.lit("no json "), F.replace(p, F.lit("}"), F.lit(""))))
    return table(spark, sf_dir, "events").select("event_id", T.salvage_json(answer).alias("json"))


_VARIANTS = [("choice", "string", "good"), ("score", "number", "2.7"), ("score", "number", "-1.5"), ("score", "string", " 3 "), ("score", "string", "2.7"), ("score", "boolean", "true"), ("noul", "boolean", "true"), ("noul", "string", " YES "), ("noul", "string", "nope"), ("noul", "number", "0"), ("noul", "number", "2"), ("noul", "string", None)]
_VALUES = ", ".join(f"({i}, '{q}', '{k}', {'NULL' if v is None else repr(v)})" for i, (q, k, v) in enumerate(_VARIANTS))


@query(
    f"""WITH v(i, qtype, kind, raw) AS (VALUES {_VALUES}) SELECT doc_id, qtype, CASE WHEN raw IS NULL THEN NULL WHEN qtype = 'choice' THEN raw
 WHEN qtype = 'score' THEN CASE kind WHEN 'boolean' THEN CASE WHEN raw = 'true' THEN '1' ELSE '0' END WHEN 'number' THEN trunc(raw::DOUBLE)::BIGINT::VARCHAR ELSE CASE WHEN regexp_matches(trim(raw), '^[+-]?\\d+$') THEN trim(raw)::BIGINT::VARCHAR END END
 ELSE CASE kind WHEN 'boolean' THEN raw WHEN 'string' THEN (lower(trim(raw)) IN ('true', 'yes', '1'))::VARCHAR ELSE (raw::DOUBLE <> 0)::VARCHAR END END AS label
FROM labels JOIN v ON doc_id % {len(_VARIANTS)} = i"""
)
def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every kind, made uniform by question type."""
    rows = F.array(*[F.struct(F.lit(q).alias("qtype"), F.lit(k).alias("kind"), F.lit(v).cast("string").alias("raw")) for q, k, v in _VARIANTS])
    x = table(spark, sf_dir, "labels").withColumn("x", F.element_at(rows, (F.col("doc_id") % len(_VARIANTS) + 1).cast("int")))
    return x.select("doc_id", F.col("x.qtype").alias("qtype"), T.normal_label(F.col("x.qtype"), F.col("x.kind"), F.col("x.raw")).alias("label"))


# ---------------------------------------------------------------- validation
@query(
    f"""WITH r AS (SELECT d.doc_id, text IS NOT NULL AS has_state, CASE doc_id % 5 WHEN 0 THEN ['quality'] WHEN 1 THEN [] ELSE ['quality', 'toxic'] END AS lk, l.quality AS q, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE l.toxic END AS t FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT CASE WHEN NOT has_state THEN 'no state' WHEN len(lk) = 0 THEN 'no labels' WHEN len(lk) <> 2 THEN 'keys differ' WHEN q IS NULL OR t IS NULL THEN 'null label' WHEN t NOT IN (0, 1) OR q NOT IN (0, 1) THEN 'label outside' ELSE 'ok' END AS status FROM r)
SELECT status, count(*) AS n FROM s GROUP BY status"""
)
def record_validate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records fail at each test, in the order of the tests."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    k = F.col("doc_id") % 5
    keys = F.when(k == 0, _array(["quality"])).when(k == 1, F.array().cast("array<string>")).otherwise(_array(["quality", "toxic"]))
    asked = _array(["quality", "toxic"])
    t = F.when(F.col("doc_id") % 7 == 0, 2).otherwise(F.col("toxic"))
    differ = (F.size(F.array_except(keys, asked)) > 0) | (F.size(F.array_except(asked, keys)) > 0)
    outside = ~t.isin(0, 1) | ~F.col("quality").isin(0, 1)
    status = F.when(F.col("text").isNull(), "no state").when(F.size(keys) == 0, "no labels").when(differ, "keys differ").when(F.col("quality").isNull() | t.isNull(), "null label").when(outside, "label outside").otherwise("ok")
    return d.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(
    """WITH q AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'choice' WHEN 1 THEN 'score' WHEN 2 THEN 'noul' ELSE 'other' END AS qtype, (p_partkey % 13)::INT AS n, (p_partkey % 40)::INT AS perms FROM part)
SELECT p_partkey, CASE WHEN qtype = 'other' THEN 'unknown type' WHEN qtype = 'choice' AND n < 1 THEN 'choice takes 1 to 255 options' WHEN qtype = 'choice' AND n >= 5 THEN 'blank option name' WHEN qtype = 'score' AND (n < 2 OR n > 10) THEN 'score takes 2 to 10 levels'
 WHEN qtype = 'noul' AND n > 0 THEN 'noul takes true and false' WHEN perms < 1 OR perms > 32 THEN 'permutations must be 1 to 32' END AS error FROM q"""
)
def request_validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule each request breaks. The fifth option name is blank."""
    k, n = F.col("p_partkey") % 4, (F.col("p_partkey") % 13).cast("int")
    qtype = F.when(k == 0, "choice").when(k == 1, "score").when(k == 2, "noul").otherwise("other")
    names = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.when(i == 4, "  ").otherwise(F.concat(F.lit("n"), i.cast("string"))))
    return table(spark, sf_dir, "part").select("p_partkey", R.request_error(qtype, F.slice(names, 1, n), (F.col("p_partkey") % 40).cast("int")).alias("error"))


# ---------------------------------------------------------------- questions
@query(
    """SELECT p_partkey, '<|ts_q|><|ts_choice|> Which brand is ' || p_name || '?' || chr(10) || '<|ts_opt_0|> ' || p_brand || ': size ' || p_size || chr(10) || '<|ts_opt_1|> ' || p_type || chr(10) || '<|ts_opt_2|> <' || chr(8203) || '|ts_x' || chr(10) || '<|ts_answer|>' || chr(10) AS block FROM part"""
)
def question_render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A choice question as text: described, bare and hostile options."""
    opt = lambda n, d: F.struct(n.alias("name"), d.cast("string").alias("desc"))
    opts = F.array(opt(F.col("p_brand"), F.concat(F.lit("size "), F.col("p_size").cast("string"))), opt(F.col("p_type"), F.lit(None)), opt(F.lit(" <|ts_x"), F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", R.render(F.lit("choice"), F.concat(F.lit(" Which brand is "), F.col("p_name"), F.lit("? ")), opts).alias("block"))


TYPES = ["ECONOMY", "STANDARD", "PROMO", "LARGE", "MEDIUM", "SMALL"]


@query(
    f"""WITH b AS (SELECT p_partkey, p_brand, {uniform_sql("drop", "p_partkey")} < 0.5 AS gone, list_filter(['Brand#1', 'Brand#2', 'Brand#3', p_brand], lambda x: true) AS o FROM part)
SELECT p_partkey, CASE WHEN gone THEN 255 ELSE list_position(o, p_brand) - 1 END AS label_slot, len(CASE WHEN gone THEN list_filter(o, lambda x: x <> p_brand) ELSE o END) AS options FROM b"""
)
def drop_label_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the questions lose their right option; abstain is then right."""
    opts = R.options(F.array(F.lit("Brand#1"), F.lit("Brand#2"), F.lit("Brand#3"), F.col("p_brand")))
    left, slot = R.drop_label(opts, F.col("p_brand"))
    gone = uniform("drop", "p_partkey") < 0.5
    names = F.transform(opts, lambda o: o["name"])
    return table(spark, sf_dir, "part").select("p_partkey", F.when(gone, slot).otherwise(R.label_slot(names, F.col("p_brand"))).alias("label_slot"), F.size(F.when(gone, left).otherwise(opts)).cast("long").alias("options"))


@query(
    f"""WITH v AS (SELECT list_sort(list(DISTINCT p_brand)) AS v FROM part), o AS (SELECT p_partkey, p_brand, unnest(v) AS x FROM part, v),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY x = p_brand DESC, {hash32_sql("dis", "p_partkey", "x")}, x) AS rk FROM o)
SELECT p_partkey, list(x ORDER BY {hash32_sql("dis-mix", "p_partkey", "x")}, x) AS options FROM r WHERE rk <= 6 GROUP BY p_partkey"""
)
def options_with_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right brand among five others of the vocabulary, by hash. The
    vocabulary, the distinct brands, is a scalar subquery."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    vocabulary = table(spark, sf_dir, "part").agg(F.array_sort(F.collect_set("p_brand"))).scalar()
    return p.withColumn("v", vocabulary).select("p_partkey", R.distractors(F.col("v"), F.col("p_brand"), 6, "dis", F.col("p_partkey")).alias("options"))


@query(f"SELECT p_partkey, list_transform(list_sort(list_transform(['a', 'b', 'c', p_brand], lambda x: {{'h': {hash32_sql('shuf', 'p_partkey', 'x')}, 'x': x}})), lambda s: s.x) AS options FROM part")
def shuffle_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options in hash order."""
    opts = R.options(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", F.transform(R.shuffled(opts, "shuf", F.col("p_partkey")), lambda o: o["name"]).alias("options"))


_TOK = "regexp_extract_all(text, '(<\\|ts_[a-z_0-9]+\\|>|[A-Za-z0-9_]+|[^A-Za-z0-9_\\s])')"
_IDS = f"list_transform({_TOK}, lambda x: ('0x' || substr(md5(x), 1, 4))::INT)"


def _ids() -> Column:
    """An id for each simple token of the whole text."""
    toks = F.regexp_extract_all("text", F.lit(r"(<\|ts_[a-z_0-9]+\|>|[A-Za-z0-9_]+|[^A-Za-z0-9_\s])"), F.lit(1))
    return F.transform(toks, lambda x: F.conv(F.substring(F.md5(x), 1, 4), 16, 10).cast("int"))


@query(
    f"""WITH t AS (SELECT doc_id, {_IDS} AS s FROM documents), n AS (SELECT *, len(s) AS n, least(100, 60 + (doc_id % 90)::INT) AS b FROM t),
c AS (SELECT *, CASE WHEN n > b THEN list_concat(s[1:1], CASE WHEN b > 1 THEN s[n - b + 2:n] ELSE [] END) ELSE s END AS cut FROM n)
SELECT doc_id, n > b AS truncated, array_to_string(list_concat(cut, [1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2]), ' ') AS input_ids, [least(n, b)::INT + 4, least(n, b)::INT + 11] AS answer_positions FROM c"""
)
def encode_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions of 5 and 7 ids after a state cut to its budget, which
    differs by document: its first and its last ids."""
    d = table(spark, sf_dir, "documents").select("doc_id", _ids().alias("state_ids"), F.array(F.array_repeat(F.lit(1), 5), F.array_repeat(F.lit(2), 7)).alias("question_ids"))
    b = F.least(F.lit(100), 60 + (F.col("doc_id") % 90).cast("int"))
    cut = d.withColumn("_cut", F.size("state_ids") > b).withColumn("state_ids", R.head_and_tail(F.col("state_ids"), b))
    e = R.encoded(cut, most_state=100, most=112)
    return e.select("doc_id", F.col("_cut").alias("truncated"), F.array_join("input_ids", " ").alias("input_ids"), "answer_positions")


@query(f"WITH t AS (SELECT doc_id, doc_id // 32 AS batch, {_IDS} AS s FROM documents), w AS (SELECT *, max(len(s)) OVER (PARTITION BY batch) AS w FROM t) SELECT doc_id, batch, md5(array_to_string(list_concat(s, list_transform(range(0, w - len(s)), lambda i: 0)), ' ')) AS padded, w - len(s) AS pad FROM w")
def collate_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids padded to the longest of their batch."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 32).alias("batch"), _ids().alias("ids"))
    width = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    return d.withColumn("width", width).select("doc_id", "batch", F.md5(F.array_join(R.padded(F.col("ids"), F.col("width")), " ")).alias("padded"), (F.col("width") - F.size("ids")).cast("long").alias("pad"))


@query("SELECT 262 AS tokens, count(*) AS options FROM range(0, 256)")
def special_token_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t in R.special_tokens()], "token string").distinct()
    return rows.agg(F.count("*").cast("int").alias("tokens"), F.count_if(F.col("token").startswith("<|ts_opt_")).alias("options"))


# ---------------------------------------------------------------- converters
def _record(id_: Column, source: str, state: Column, qtype: str, instructions: Column, names: list[str], label: Column) -> list[Column]:
    return [id_.alias("id"), F.lit(source).alias("source"), state.alias("state"), F.lit(qtype).alias("qtype"), instructions.alias("instructions"), _array(names).alias("options"), label.cast("string").alias("label")]


@R.converter("toxic")
def toxic(labels: DataFrame, documents: DataFrame) -> DataFrame:
    d = labels.join(documents, "doc_id")
    return d.select(*_record(F.concat(F.lit("toxic-"), F.col("doc_id").cast("string")), "toxic", F.col("text"), "noul", R.template(F.col("lang"), "noul", "toxic", "toxic", "doc_id"), ["no", "yes"], F.col("toxic") == 1))


@R.converter("quality")
def quality(labels: DataFrame, documents: DataFrame) -> DataFrame:
    d = labels.join(documents, "doc_id")
    return d.select(*_record(F.concat(F.lit("quality-"), F.col("doc_id").cast("string")), "quality", F.col("text"), "noul", F.lit("Is this text well written?"), ["no", "yes"], F.col("quality") == 1))


@R.converter("lang")
def language(documents: DataFrame) -> DataFrame:
    d = documents.where(F.col("lang").isin("en", "fr", "de", "es"))
    names = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}
    full = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in names.items()], F.col("lang"))
    return d.select(*_record(F.concat(F.lit("lang-"), F.col("doc_id").cast("string")), "lang", F.col("text"), "choice", R.template(F.col("lang"), "choice", "language", "lang", "doc_id"), list(names.values()), full))


@R.converter("priority")
def priority(orders: DataFrame) -> DataFrame:
    level = F.substring("o_orderpriority", 1, 1).try_cast("int") - 1
    state = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    return orders.where(level.isNotNull()).select(*_record(F.concat(F.lit("priority-"), F.col("o_orderkey").cast("string")), "priority", state, "score", F.lit("How urgent is this order?"), ["urgent", "high", "medium", "unset", "low"], level))


def _pick_sql(xs: list[str], what: str, seed: str, key: str) -> str:
    return f"{[x.replace('{what}', what) for x in xs]}[({hash32_sql(seed, key)} % {len(xs)} + 1)::INT]"


@query(f"SELECT 'toxic-' || doc_id AS id, 'toxic' AS source, text AS state, 'noul' AS qtype, {_pick_sql(R.NOUL_EN, 'toxic', 'toxic', 'doc_id')} AS instructions, ['no', 'yes'] AS options, (toxic = 1)::VARCHAR AS label FROM labels JOIN documents USING (doc_id)")
def convert_toxic_noul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.CONVERTERS["toxic"](table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


@query("SELECT 'quality-' || doc_id AS id, 'quality' AS source, text AS state, 'noul' AS qtype, 'Is this text well written?' AS instructions, ['no', 'yes'] AS options, (quality = 1)::VARCHAR AS label FROM labels JOIN documents USING (doc_id)")
def convert_quality_noul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.CONVERTERS["quality"](table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


@query(f"SELECT 'lang-' || doc_id AS id, 'lang' AS source, text AS state, 'choice' AS qtype, {_pick_sql(R.CHOICE_EN, 'language', 'lang', 'doc_id')} AS instructions, ['English', 'French', 'German', 'Spanish'] AS options, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE 'Spanish' END AS label FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')")
def convert_lang_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.CONVERTERS["lang"](table(spark, sf_dir, "documents"))


@query("SELECT 'priority-' || o_orderkey AS id, 'priority' AS source, '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS state, 'score' AS qtype, 'How urgent is this order?' AS instructions, ['urgent', 'high', 'medium', 'unset', 'low'] AS options, (left(o_orderpriority, 1)::INT - 1)::VARCHAR AS label FROM orders")
def convert_priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.CONVERTERS["priority"](table(spark, sf_dir, "orders"))


@query(
    f"""WITH t AS (SELECT doc_id, list_filter(['toxic', 'good', 'long', 'foreign'], lambda x: (x = 'toxic' AND toxic = 1) OR (x = 'good' AND quality = 1) OR (x = 'long' AND length(text) > 1000) OR (x = 'foreign' AND lang <> 'en')) AS pos FROM labels JOIN documents USING (doc_id)),
n AS (SELECT *, list_filter(['toxic', 'good', 'long', 'foreign'], lambda x: NOT list_contains(pos, x)) AS neg FROM t),
k AS (SELECT doc_id, len(pos) AS topics, CASE WHEN len(pos) > 0 THEN pos[({hash32_sql("pos", "doc_id")} % greatest(len(pos), 1) + 1)::INT] END AS yes, CASE WHEN len(neg) > 0 THEN neg[({hash32_sql("neg", "doc_id")} % greatest(len(neg), 1) + 1)::INT] END AS no, CASE WHEN len(pos) = 1 THEN pos[1] END AS sole FROM n)
SELECT doc_id, q.qid, q.topic, q.label FROM (SELECT doc_id, unnest([{{'qid': 'q1', 'topic': yes, 'label': 'true'}}, {{'qid': 'q2', 'topic': no, 'label': 'false'}}, {{'qid': 'q3', 'topic': sole, 'label': sole}}]) AS q FROM k) WHERE q.topic IS NOT NULL"""
)
def convert_multi_question_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three questions of a record: a topic it has, one it lacks, and the
    choice where it has exactly one."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    has = {"toxic": F.col("toxic") == 1, "good": F.col("quality") == 1, "long": F.length("text") > 1000, "foreign": F.col("lang") != "en"}
    topics = F.array_compact(F.array(*[F.when(c, t) for t, c in has.items()]))
    d = d.select("doc_id", topics.alias("pos")).withColumn("neg", F.array_except(_array(list(has)), F.col("pos")))
    one = lambda xs, seed: F.when(F.size(xs) > 0, F.try_element_at(xs, (hash32(seed, "doc_id") % F.greatest(F.size(xs), F.lit(1)) + 1).cast("int")))
    only = F.when(F.size("pos") == 1, F.try_element_at("pos", F.lit(1)))
    q = lambda qid, topic, label: F.struct(F.lit(qid).alias("qid"), topic.alias("topic"), label.alias("label"))
    out = d.select("doc_id", F.inline(F.array(q("q1", one(F.col("pos"), "pos"), F.lit("true")), q("q2", one(F.col("neg"), "neg"), F.lit("false")), q("q3", only, only))))
    return out.where("topic is not null")


@query(
    """WITH s AS (SELECT *, list(role || ':' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(h, ' > '), '') AS history, text AS action FROM s WHERE role = 'assistant'"""
)
def convert_agent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An agent's steps with the five turns before each."""
    c = table(spark, sf_dir, "conversations").withColumn("a", F.concat("role", F.lit(":"), "text"))
    h = R.history(c, "conv_id", "turn", "a", 5).where(F.col("role") == "assistant")
    return h.select("conv_id", "turn", F.array_join("history", " > ").alias("history"), F.col("text").alias("action"))


@query(
    """WITH a AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name END AS aria, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS title, p_brand AS id, repeat(p_name, 5) AS val FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'button' ELSE left(concat_ws(' ', 'button', coalesce(aria, title), 'id="' || id || '"', 'value="' || left(val, 40) || '"', CASE WHEN aria IS NOT NULL THEN 'title="' || left(title, 40) || '"' END), 160) END AS element FROM a"""
)
def candidate_element_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page elements as short text: tag, label, other attributes that count;
    values cut to 40 characters and the whole to 160. Some aren't JSON."""
    from ..operators.converters import candidate_text

    k = F.col("p_partkey")
    attrs = F.struct(F.lit("x").alias("style"), F.col("p_brand").alias("id"), F.when(k % 3 == 0, F.col("p_name")).alias("aria_label"), F.repeat("p_name", 5).alias("value"), F.when(k % 2 == 0, F.col("p_type")).alias("title"))
    return table(spark, sf_dir, "part").select("p_partkey", candidate_text(F.lit("button"), F.when(k % 7 == 0, "{odd").otherwise(F.to_json(attrs))).alias("element"))


@query("SELECT c_custkey, least(4, greatest(0, floor((c_acctbal / 2000) + 0.5) - 1))::INT AS level, c_acctbal >= 5000 AS rich FROM customer")
def level_and_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean as level, half up; a score as yes or no by threshold."""
    return table(spark, sf_dir, "customer").select("c_custkey", R.half_up_level(F.col("c_acctbal") / 2000).cast("int").alias("level"), (F.col("c_acctbal") >= 5000).alias("rich"))


_EMIT = ["four", "three", "five", "noul", "score"]


@query(
    f"""WITH s AS (SELECT event_id, event_type, list_transform(list_sort(list_transform({_EMIT}, lambda x: {{'h': {hash32_sql("scheme", "event_id", "x")}, 'x': x}})), lambda r: r.x) AS o, CASE WHEN {uniform_sql("k", "event_id")} < 0.666 THEN 1 ELSE 2 END AS k FROM events),
e AS (SELECT event_id, event_type, unnest(o[1:k]) AS scheme FROM s)
SELECT event_id, scheme, CASE scheme WHEN 'noul' THEN (event_type = 'error')::VARCHAR WHEN 'score' THEN CASE event_type WHEN 'error' THEN '0' WHEN 'view' THEN '2' ELSE '4' END ELSE event_type END AS label
FROM e WHERE NOT (scheme IN ('three', 'score') AND event_type = 'signup')"""
)
def sentiment_scheme_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two question schemes per event; some don't fit one of the types."""
    order = F.array_sort(F.transform(_array(_EMIT), lambda x: F.struct(hash32("scheme", F.col("event_id"), x).alias("h"), x.alias("x"))))
    k = F.when(uniform("k", "event_id") < 0.666, 1).otherwise(2)
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.explode(F.slice(F.transform(order, lambda r: r["x"]), F.lit(1), k)).alias("scheme"))
    t = F.col("event_type")
    label = F.when(F.col("scheme") == "noul", (t == "error").cast("string")).when(F.col("scheme") == "score", F.when(t == "error", "0").when(t == "view", "2").otherwise("4")).otherwise(t)
    return e.where(~(F.col("scheme").isin("three", "score") & (t == "signup"))).select("event_id", "scheme", label.alias("label"))


# ---------------------------------------------------------------- negatives
@query(
    f"""WITH d AS (SELECT doc_id, source, row_number() OVER (ORDER BY {hash32_sql("neg", "doc_id")}, doc_id) - 1 AS place FROM documents), n AS (SELECT count(*) AS n FROM documents),
p AS (SELECT x.doc_id, y.doc_id AS negative FROM d x, n JOIN d y ON y.place = {hash32_sql("neg-draw", "x.doc_id")} % n.n)
SELECT doc_id, negative, false AS label FROM p JOIN documents a USING (doc_id) JOIN documents b ON b.doc_id = negative WHERE a.text <> b.text"""
)
def random_negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a random other text. The shuffle carries ids and
    digests, not texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("t"))
    pairs = X.negatives(d.select("doc_id"), "neg", "doc_id")
    other = d.select(F.col("doc_id").alias("negative"), F.col("t").alias("t2"))
    return pairs.join(d, "doc_id").join(other, "negative").where("t <> t2").select("doc_id", "negative", F.lit(False).alias("label"))


# ---------------------------------------------------------------- gates
def _noisy(seed: str, col: str, rate: float) -> Column:
    return F.when(uniform(seed, "doc_id") < rate, 1 - F.col(col)).otherwise(F.col(col))


def _noisy_sql(seed: str, col: str, rate: float) -> str:
    return f"CASE WHEN {uniform_sql(seed, 'doc_id')} < {rate} THEN 1 - {col} ELSE {col} END"


@query(
    f"""WITH r AS (SELECT doc_id, quality, toxic, {_noisy_sql("rq", "quality", 0.1)} AS rq, {_noisy_sql("rt", "toxic", 0.1)} AS rt FROM labels)
SELECT CASE WHEN quality = rq AND toxic = rt THEN 'ok' ELSE 'disagree' END AS status, count(*) AS n FROM r GROUP BY 1"""
)
def self_consistency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose second labelling agrees on every question."""
    same = F.forall(F.zip_with(F.array("quality", "toxic"), F.array(_noisy("rq", "quality", 0.1), _noisy("rt", "toxic", 0.1)), lambda a, b: a.eqNullSafe(b)), lambda x: x)
    return table(spark, sf_dir, "labels").groupBy(F.when(same, "ok").otherwise("disagree").alias("status")).agg(F.count("*").alias("n"))


@query(
    f"""WITH r AS (SELECT conv_id, list(role ORDER BY turn) AS a, list(CASE WHEN {uniform_sql("rr", "conv_id", "turn")} < 0.2 THEN 'user' ELSE role END ORDER BY turn) AS b FROM conversations GROUP BY conv_id),
z AS (SELECT conv_id, unnest(range(1, least(len(a), greatest(len(b) - 1, 0)) + 1)) AS i, a, b FROM r)
SELECT conv_id, i - 1 AS pos, a[i] AS label FROM z WHERE a[i] = b[i]"""
)
def positional_relabel_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that agree with the relabel at their place; the shorter list ends it."""
    second = F.when(uniform("rr", "conv_id", "turn") < 0.2, "user").otherwise(F.col("role"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("a"), second.alias("b")))).alias("x"))
    n = F.least(F.size("x"), F.greatest(F.size("x") - 1, F.lit(0)))
    z = rows.select("conv_id", F.posexplode(F.slice("x", F.lit(1), n)).alias("pos", "y"))
    return z.where("y.a = y.b").select("conv_id", F.col("pos").cast("long").alias("pos"), F.col("y.a").alias("label"))


@query(
    f"""WITH q AS (SELECT p_partkey, 1.0 / greatest(2, p_size % 6) * (1.0 / greatest(2, p_size % 3)) AS chance, {uniform_sql("blind", "p_partkey")} < 0.3 AS guessed FROM part)
SELECT p_partkey, round(chance, 6) AS chance, chance < 0.34 AND guessed AS leaked FROM q"""
)
def leakage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that answers without the state get right though chance is low."""
    c = chance(F.array(F.col("p_size") % 6, F.col("p_size") % 3))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(c, 6).alias("chance"), ((c < 0.34) & (uniform("blind", "p_partkey") < 0.3)).alias("leaked"))


@query(
    f"""WITH p AS (SELECT doc_id // 2 AS pair, doc_id, toxic, {_noisy_sql("cp", "toxic", 0.1)} AS again FROM labels),
g AS (SELECT pair, count(*) AS n, count(DISTINCT toxic) AS labels, bool_and(toxic = again) AS agree FROM p GROUP BY pair)
SELECT pair, CASE WHEN n <> 2 THEN 'incomplete' WHEN labels <> 2 THEN 'same label' WHEN NOT agree THEN 'disagree' ELSE 'ok' END AS status FROM g"""
)
def contrastive_pair_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with both sides, opposite labels and agreeing relabels: a single
    aggregation by pair instead of a self-join."""
    p = table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 2).alias("pair"), "toxic", _noisy("cp", "toxic", 0.1).alias("again"))
    g = p.groupBy("pair").agg(F.count("*").alias("n"), (F.max("toxic") != F.min("toxic")).alias("differ"), F.bool_and(F.col("toxic") == F.col("again")).alias("agree"))
    return g.select("pair", F.when(F.col("n") != 2, "incomplete").when(~F.col("differ"), "same label").when(~F.col("agree"), "disagree").otherwise("ok").alias("status"))


@query(f"WITH r AS (SELECT o_orderkey, left(o_orderpriority, 1)::INT AS target, 1 + {hash32_sql('blind', 'o_orderkey')} % 5 AS blind FROM orders) SELECT target, count(*) AS n, count(*) FILTER (abs(blind - target) <= 1) AS kept FROM r GROUP BY target")
def rating_tolerance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, b = F.substring("o_orderpriority", 1, 1).cast("int"), 1 + hash32("blind", "o_orderkey") % 5
    return table(spark, sf_dir, "orders").groupBy(t.alias("target")).agg(F.count("*").alias("n"), F.count_if(F.abs(b - t) <= 1).alias("kept"))


@query(
    f"""WITH g AS (SELECT *, CASE WHEN text IS NULL OR length(text) < 150 THEN 'invalid' WHEN {uniform_sql("dis", "doc_id")} < 0.15 THEN 'disagree' WHEN regexp_matches(text, '[ñß]') THEN 'bad_script' WHEN {uniform_sql("leak", "doc_id")} < 0.05 THEN 'leak' ELSE 'ok' END AS status FROM documents)
SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM g GROUP BY status"""
)
def synthesis_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the gates in their order, with shares."""
    t = F.col("text")
    status = F.when(t.isNull() | (F.length(t) < 150), "invalid").when(uniform("dis", "doc_id") < 0.15, "disagree").when(T.other_script(t, "[ñß]"), "bad_script").when(uniform("leak", "doc_id") < 0.05, "leak").otherwise("ok")
    g = table(spark, sf_dir, "documents").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    return g.select("status", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("share"))  # a row per status


@query(
    "WITH q AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'unans' WHEN 1 THEN 'yesno' ELSE 'fact' END AS kind, quality, toxic FROM labels) SELECT kind, count(*) AS n, count(*) FILTER (CASE kind WHEN 'unans' THEN toxic = 0 WHEN 'yesno' THEN quality = 1 OR toxic = 1 ELSE quality = 1 AND toxic = 0 END) AS kept FROM q GROUP BY kind"
)
def answerability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    kind = F.when(k == 0, "unans").when(k == 1, "yesno").otherwise("fact")
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, sf_dir, "labels").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.when(k == 0, ~t).when(k == 1, q | t).otherwise(q & ~t)).alias("kept"))


@query(
    "SELECT source, split, count(*) AS n FROM (SELECT source, CASE WHEN doc_id % 50 = 0 THEN 'eval' ELSE 'train' END AS split FROM documents) GROUP BY ALL"
)
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 50 == 0, "eval").otherwise("train").alias("split"))
    return d.groupBy("source", "split").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sequences
@query(
    """WITH w AS (SELECT *, lag(event_type) OVER u AS before, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS h, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, coalesce(array_to_string(h, ','), '') AS history, coalesce(before IN ('view', 'click') AND lag(floor(value / 10)) OVER (PARTITION BY user_id ORDER BY ts, event_id) = floor(value / 10), false) AS stuck, round(m, 6) AS moving FROM w"""
)
def loop_history_and_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last four actions, whether a move left its place, and a moving mean of the last twenty."""
    from ..operators.timeseries import loop_state

    e = table(spark, sf_dir, "events").withColumn("x", F.floor(F.col("value") / 10))
    s = loop_state(e, "user_id", ["ts", "event_id"], "event_type", "value", ["x"], ["view", "click"])
    return s.select("event_id", F.array_join("history", ",").alias("history"), "stuck", F.round("moving", 6).alias("moving"))


_DIST = "list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))"


@query(
    f"WITH q AS (SELECT a.vec_id, b.vec_id AS other, {_DIST} AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS rk FROM q) SELECT vec_id, other, rk, round(d, 5) AS d FROM r WHERE rk <= 4"
)
def nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest of the same label. Each task keeps its best four per
    query before anything is shuffled."""
    from ..operators.timeseries import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", "vec_id", "embedding", "label", 4).select("vec_id", "other", "rk", F.round("d", 5).alias("d"))


@query(
    "WITH a AS (SELECT vec_id, degrees(atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE)) - 37 AS raw FROM embeddings), n AS (SELECT vec_id, ((raw + 180) - 360 * floor((raw + 180) / 360)) - 180 AS b FROM a) SELECT vec_id, round(b, 6) AS bearing, CASE WHEN abs(b) < 10 THEN 'ahead' WHEN b > 0 THEN 'left' ELSE 'right' END AS side FROM n"
)
def bearing_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.timeseries import bearing, side

    b = bearing(F.element_at("embedding", 1).cast("double"), F.element_at("embedding", 2).cast("double"), F.lit(37.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", b.alias("b")).select("vec_id", F.round("b", 6).alias("bearing"), side(F.col("b")).alias("side"))


@query("SELECT event_id, CASE WHEN value < 12 THEN 'near' WHEN value > 40 THEN 'far' ELSE 'middle' END AS depth FROM events")
def depth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.when(v < 12, "near").when(v > 40, "far").otherwise("middle").alias("depth"))


@query("WITH s AS (SELECT user_id, count(*) AS n, epoch(max(ts)) - epoch(min(ts)) AS span FROM events GROUP BY user_id) SELECT user_id, n, round(n / nullif(span, 0) * 3600, 6) AS per_hour, round((1000 - n) / (n / nullif(span, 0)) / 3600, 4) AS hours_left FROM s")
def throughput_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate so far and the time left to a thousand."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    span = (micros(F.max("ts")) - micros(F.min("ts"))) / 1e6
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.nullif(span, F.lit(0.0)).alias("span"))
    rate = F.col("n") / F.col("span")
    return s.select("user_id", "n", F.round(rate * 3600, 6).alias("per_hour"), F.round((1000 - F.col("n")) / rate / 3600, 4).alias("hours_left"))


# ---------------------------------------------------------------- files, streams
@query("SELECT doc_id::VARCHAR AS id, source, lang, CASE WHEN doc_id % 50 = 0 THEN 'eval' ELSE 'train' END AS split, n_chars::VARCHAR AS n_chars, md5(text) AS state_md5 FROM documents")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines by source and split and read back; a column
    that isn't a record's folds into meta."""
    from ..sources.jsonl import read_records, write_records
    from ..sources.scratch import scratch

    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("id"), "source", "lang", F.when(F.col("doc_id") % 50 == 0, "eval").otherwise("train").alias("split"), F.col("text").alias("state"), "n_chars")
    path = scratch(spark, "jsonl")
    write_records(rows, path)
    return read_records(spark, path).select("id", "source", "lang", "split", F.try_element_at("meta", F.lit("n_chars")).alias("n_chars"), F.md5("state").alias("state_md5"))


@query("SELECT shard, count(*) AS tokens, sum(token)::BIGINT AS checksum FROM (SELECT (p_partkey // 100) AS shard, (p_partkey * 7919 % 50000) AS token FROM part) GROUP BY shard")
def token_shard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uint32 shards written as binary rows and read back."""
    from ..sources.scratch import scratch
    from ..sources.shards import read_shards, write_shards

    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("shard"), F.col("p_partkey").alias("place"), (F.col("p_partkey") * 7919 % 50000).cast("int").alias("token"))
    path = scratch(spark, "shards")
    write_shards(rows, path)
    return read_shards(spark, path).groupBy("shard").agg(F.count("*").alias("tokens"), F.sum("token").alias("checksum"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'invalid' WHEN value < 10 THEN 'disagree' ELSE 'ok' END AS status FROM events) GROUP BY status")
def stream_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running status counters over a file stream, after all files were seen."""
    from ..streaming.requests import funnel

    return funnel(spark, f"{sf_dir}/events.parquet")


@query("SELECT event_id, event_type = 'purchase' AS answer, round(value / (1 + value), 6) AS confidence FROM events WHERE value >= 0")
def requests_stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from a file stream answered and appended to a table."""
    from ..streaming.requests import answers

    return answers(spark, f"{sf_dir}/events.parquet")


_BPE_QUESTIONS = [("noul", "is it", ["no", "yes"]), ("choice", "which language", ["en", "fr", "de", "es"])]


def _rendered(qtype: str, instructions: str, names: list[str]) -> str:
    lines = [f"<|ts_opt_{i}|> {n}" for i, n in enumerate(names)]
    return f"<|ts_q|><|ts_{qtype}|> {instructions}\n" + "\n".join([*lines, "<|ts_answer|>"])


@query(f"SELECT doc_id, md5('<|ts_state|>' || replace(text, '<|ts_', '<' || chr(8203) || '|ts_') || '{''.join(_rendered(*q) for q in _BPE_QUESTIONS)}') AS decoded, true AS answers FROM documents WHERE text IS NOT NULL")
def encode_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records encoded by an injected byte-level BPE with control tokens: the ids
    decode to the rendered record, and answers stand at their positions."""
    import public_tokenizers

    from ..operators.tokenizers import byte_bpe, decoded, small_batches, token_ids
    from ..sources.scratch import ship

    ship(spark)
    small_batches(spark)
    control = R.special_tokens()
    bpe = byte_bpe(public_tokenizers.path("byte_bpe_50k.json"), control)
    asked = F.array(*[token_ids(F.lit(_rendered(*q)), bpe) for q in _BPE_QUESTIONS])
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", token_ids(F.concat(F.lit(R.TOKENS["state"]), T.sanitize(F.col("text"))), bpe).alias("state_ids"), asked.alias("question_ids"))
    e = R.encoded(d, most_state=1 << 30, most=1 << 30)
    answer = token_ids(F.lit(R.TOKENS["answer"]), bpe)
    e = e.withColumn("answer", F.element_at(answer, 1))
    # without a lambda over the positions, which would put all ids together again for each of them
    at = [F.element_at("input_ids", F.element_at("answer_positions", i + 1) + 1) == F.col("answer") for i in range(len(_BPE_QUESTIONS))]
    right = reduce(and_, at, F.size("answer_positions") == len(_BPE_QUESTIONS))
    return e.select("doc_id", F.md5(decoded("input_ids", bpe)).alias("decoded"), right.alias("answers"))
