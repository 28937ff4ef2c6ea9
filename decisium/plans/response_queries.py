"""Queries of parsing, responses, reports and sinks, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rand import hash32, hash32_sql, uniform, uniform_sql
from ..operators import decide as D
from ..operators import metrics as M
from ..operators import records as R
from ..sources.scratch import scratch
from .decisions import NAMES, TEMPERATURE, _probs, choices, logits
from .registry import query, table

_KINDS = [
    ('{"type": "choice", "instructions": "which", "criteria": {"zeta": "last", "alpha": null}}', "choice|which|zeta=last;alpha=|ok"),
    ('{"type": "choice", "instructions": "which", "criteria": ["b", "a"]}', "choice|which|b=;a=|ok"),
    ('{"type": "score", "instructions": "how", "criteria": ["low", "mid", "high"]}', "score|how|0=low;1=mid;2=high|ok"),
    ('{"type": "score", "instructions": "how", "criteria": ["low"]}', "score|how|0=low|score takes 2 to 10 levels"),
    ('{"type": "noul", "instructions": "is it", "criteria": {"true": "yes it is"}}', "noul|is it|no=;yes=yes it is|ok"),
    ('{"type": "noul", "instructions": "is it"}', "noul|is it|no=;yes=|ok"),
    ('{"type": "noul", "instructions": "is it", "criteria": {"maybe": "x"}}', "noul|is it|no=;yes=|noul takes true and false"),
    ('{"type": "odd", "instructions": "x"}', "odd|x||unknown type"),
    ('{"type": "choice", "criteria": {"a": "b"}}', "choice|-|a=b|no instructions"),
    ("nothing", "-|-||not an object"),
]


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(f"SELECT p_partkey, [{', '.join(_literal(w) for _, w in _KINDS)}][(p_partkey % {len(_KINDS)} + 1)::INT] AS question FROM part")
def question_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of all types from JSON, in the caller's order, and why some aren't."""
    raw = F.element_at(F.array(*[F.lit(j) for j, _ in _KINDS]), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    q = R.parsed_question(raw)
    p = table(spark, sf_dir, "part").select("p_partkey", q.alias("q"))
    opts = F.array_join(F.transform("q.options", lambda o: F.concat(o["name"], F.lit("="), F.coalesce(o["desc"], F.lit("")))), ";")
    none = F.lit("-")
    return p.select("p_partkey", F.concat_ws("|", F.coalesce("q.qtype", none), F.coalesce("q.instructions", none), opts, F.coalesce("q.error", F.lit("ok"))).alias("question"))


_ASKED = '{"good": {"type": "noul", "instructions": "is it"}, "level": {"type": "score", "instructions": "how", "criteria": ["l", "m", "h"]}}'


@query(
    """WITH r AS (SELECT doc_id, doc_id % 8 AS k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'no state' WHEN 1 THEN 'no labels' WHEN 2 THEN 'keys differ' WHEN 3 THEN 'null label' WHEN 4 THEN 'label outside' WHEN 5 THEN 'bad question' END AS error FROM r"""
)
def record_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validator on whole records of JSON."""
    k = F.col("doc_id") % 8
    labels = F.when(k == 1, "{}").when(k == 2, '{"good": true}').when(k == 3, '{"good": true, "level": null}').when(k == 4, '{"good": true, "level": 3}').otherwise('{"good": true, "level": 2.0}')
    asked = F.when(k == 5, _ASKED.replace('"score"', '"rank"')).otherwise(_ASKED)
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", R.record_error(F.when(k != 0, F.col("text")), asked, labels).alias("error"))


_LEVELS = ["poor", None, "fair", "", "great"]


@query(
    f"""WITH {_probs(1, 5, str(TEMPERATURE["score"]))} SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'decisium' ELSE 'model-' || vec_id % 3 END AS model, (10 + vec_id % 7)::INT AS input_tokens, CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 1 END AS permutations,
 'poor,1,fair,3,great' AS legend, array_to_string(list_transform(pk, lambda x, i: (i - 1) || ':' || CAST(round(x, 4) AS DECIMAL(6, 4))), ' ') AS probabilities FROM d"""
)
def decision_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score responses: level texts, probabilities by level, the model asked
    for, and usage, which counts the ids of one order only."""
    d = D.scored(logits(spark, sf_dir, 1, 5).drop("logits", "abstain_logit"), lambda r: r.join(logits(spark, sf_dir, 1, 5).drop("label"), "vec_id"), TEMPERATURE["score"])
    levels = F.array(*[F.lit(x).cast("string") for x in _LEVELS])
    probs = F.transform("pk", lambda x, i: F.concat(i.cast("string"), F.lit(":"), F.round(x, 4).cast("decimal(6,4)").cast("string")))
    asked = F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("model-"), (F.col("vec_id") % 3).cast("string")))
    ids = F.array_repeat(F.lit(1), (10 + F.col("vec_id") % 7).cast("int"))
    answer = F.struct(F.array_join(D.legend(levels), ",").alias("legend"), F.array_join(probs, " ").alias("probabilities"))
    r = d.select("vec_id", D.response(answer, asked, ids, F.when(F.col("vec_id") % 2 == 0, 8).otherwise(1)).alias("r"))
    return r.select("vec_id", "r.model", "r.usage.input_tokens", "r.usage.permutations", "r.answer.legend", "r.answer.probabilities")


@query(f"WITH {_probs(1, 10, str(TEMPERATURE['choice']))} SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(pk, lambda x, i: {{'k': -x, 'i': i}})), lambda s: 'c' || (s.i - 1)), ' ') AS options FROM d")
def options_by_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options from the likeliest on."""
    return choices(spark, sf_dir).select("vec_id", F.array_join(D.by_probability(F.array(*[F.lit(n) for n in NAMES]), F.col("pk")), " ").alias("options"))


@query("SELECT doc_id, md5(coalesce(source, '') || chr(10) || coalesce(CASE WHEN doc_id % 3 > 0 THEN lang END, '') || chr(10) || coalesce(text, '')) AS digest FROM documents WHERE length(coalesce(source, '') || chr(10) || coalesce(CASE WHEN doc_id % 3 > 0 THEN lang END, '') || chr(10) || coalesce(text, '')) > 200")
def instruction_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction, input and output as lines; missing parts are empty."""
    t = R.instruction_text(F.col("source"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).where(F.length("t") > 200).select("doc_id", F.md5("t").alias("digest"))


@query(f"WITH r AS (SELECT source, quality::DOUBLE AS a, CASE WHEN {uniform_sql('after', 'doc_id')} < 0.3 THEN 1.0 ELSE quality END AS b FROM labels JOIN documents USING (doc_id)) SELECT source, round(avg(a), 6) AS before, round(avg(b), 6) AS after FROM r GROUP BY source")
def before_and_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' means by source, side by side."""
    r = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    q = F.col("quality").cast("double")
    runs = F.array(F.struct(F.lit("before").alias("run"), q.alias("v")), F.struct(F.lit("after").alias("run"), F.when(uniform("after", "doc_id") < 0.3, 1.0).otherwise(q).alias("v")))
    rows = r.select("source", F.inline(runs))
    return M.side_by_side(rows, "source", "run", ["before", "after"], F.col("v")).select("source", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query("SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS visible FROM orders")
def visible_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which objects are among the visible ids: a join that adds a flag."""
    seen = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("v")).distinct()
    return table(spark, sf_dir, "orders").join(seen, "o_custkey", "left").select("o_orderkey", F.coalesce("v", F.lit(False)).alias("visible"))


@query("WITH t AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) SELECT user_id, count(*) AS repeats, round(avg(value), 6) AS latency FROM t WHERE turn > 1 GROUP BY user_id")
def latency_after_warm_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latency(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "repeats", F.round("latency", 6).alias("latency"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0.00002 WHEN 1 THEN p_size * 1.0 WHEN 2 THEN -p_size / 2.0 END AS value FROM part")
def config_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration strings as numbers; null where they aren't."""
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    raw = F.when(k == 0, "2e-5").when(k == 1, F.concat(F.lit(" "), n)).when(k == 2, (-F.col("p_size") / 2).cast("string")).otherwise("auto")
    return table(spark, sf_dir, "part").select("p_partkey", R.number(raw).alias("value"))


@query("SELECT lang, string_agg(quality || ':' || n, ' ' ORDER BY quality) AS counts FROM (SELECT lang, quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL) GROUP BY lang")
def label_count_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by label as a map by language."""
    r = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    n = r.groupBy("lang", "quality").agg(F.count("*").alias("n"))
    m = n.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("quality", "n"))).alias("m"))  # a few labels each
    pairs = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))
    return m.select("lang", F.array_join(pairs, " ").alias("counts"))


@query("SELECT source, count(*) FILTER (doc_id % 50 <> 0) AS train, count(*) FILTER (doc_id % 50 = 0) AS eval FROM documents GROUP BY source")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by source and split, pivoted, written as a JSON manifest and read back."""
    from ..operators.converters import split_sink_counts
    from ..sources.jsonl import write_manifest

    d = table(spark, sf_dir, "documents").withColumn("split", F.when(F.col("doc_id") % 50 == 0, "eval").otherwise("train"))
    path = scratch(spark, "manifest")
    write_manifest(split_sink_counts(d), path)
    return spark.read.schema("source string, train long, eval long").json(path)


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS shard, doc_id FROM documents")
def rotating_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept rows in shards of 64, by id; places come from running sums in two phases."""
    from ..operators.mixture import running_offset
    from ..sources.jsonl import read_rotating, write_rotating

    d = table(spark, sf_dir, "documents").select("doc_id")
    path = scratch(spark, "rotating")
    write_rotating(d, path, 64, "doc_id")
    back = read_rotating(spark, path).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "shard")
    placed = running_offset(d.withColumn("one", F.lit(1).cast("long")), "doc_id", "one")
    return back.join(placed, "doc_id").select(F.col("offset").cast("long").alias("place"), "shard", "doc_id")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {hash32_sql('buffer', 'doc_id')}, doc_id) AS place FROM documents")
def seed_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seeds in one random order: places by counts of hash ranges, then within them."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("doc_id", hash32("buffer", "doc_id").alias("h")).withColumn("b", F.shiftright("h", 20))
    sizes = d.groupBy("b").agg(F.count("*").alias("n"))
    before = sizes.select("b", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # at most 4096 rows
    return d.join(before, "b").select("doc_id", (F.col("base") + F.row_number().over(Window.partitionBy("b").orderBy("h", "doc_id"))).cast("long").alias("place"))


@query("SELECT step, round(loss, 6) AS loss FROM (SELECT event_id AS step, value / 10 AS loss FROM events WHERE event_id % 10 = 0 UNION ALL SELECT event_id, value / 20 FROM events WHERE event_id % 10 = 5)")
def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs append to a log; all lines are read back."""
    from ..sources.jsonl import append_log

    e, path = table(spark, sf_dir, "events"), scratch(spark, "log")
    append_log(e.where("event_id % 10 = 0").select(F.col("event_id").alias("step"), (F.col("value") / 10).alias("loss")), path)
    append_log(e.where("event_id % 10 = 5").select(F.col("event_id").alias("step"), (F.col("value") / 20).alias("loss")), path)
    return spark.read.schema("step long, loss double").json(path).select("step", F.round("loss", 6).alias("loss"))


@query("SELECT 'failed' AS status, 'mmlu' AS name, NULL::BIGINT AS n UNION ALL SELECT 'done', 'ag_news', count(*) FROM documents UNION ALL SELECT 'done', 'wisesight', count(*) FROM documents")
def converter_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three converters picked by name, of which one fails; the others go on."""
    from ..operators.driver import convert_all

    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("row"), "text", F.col("text").alias("texts"), (F.col("doc_id") % 4).alias("label"), (F.col("doc_id") % 4).alias("category"))
    done, failed = convert_all({"wisesight": (rows,), "mmlu": (rows,), "ag_news": (rows,), "clinc": (rows,)}, only=["wisesight", "mmlu", "ag_news"])
    out = spark.createDataFrame([("failed", x, None) for x in failed], "status string, name string, n long")
    for name, got in done.items():
        out = out.union(got.agg(F.count("*").alias("n")).select(F.lit("done"), F.lit(name), "n"))
    return out


@query("SELECT (SELECT count(*) FROM documents) AS written, (SELECT count(*) FROM documents) AS read")
def jsonl_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sink's own count beside that of the lines read back."""
    from ..sources.jsonl import read_records, write_records

    d, path = table(spark, sf_dir, "documents"), scratch(spark, "jsonl-count")
    n = write_records(d.select(F.col("doc_id").cast("string").alias("id"), "source", "lang", F.lit("train").alias("split"), F.col("text").alias("state")), path)
    return read_records(spark, path).agg(F.lit(n).cast("long").alias("written"), F.count("*").alias("read"))


@query(f"SELECT doc_id FROM documents WHERE length(text) > 500 ORDER BY {hash32_sql('stop', 'doc_id')}, doc_id LIMIT 50")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 kept rows in random order: the least of each task, then of all."""
    return table(spark, sf_dir, "documents").where(F.length("text") > 500).orderBy(hash32("stop", "doc_id"), "doc_id").select("doc_id").limit(50)


@query(
    """WITH d AS (SELECT doc_id, text, lang FROM documents WHERE text IS NOT NULL)
SELECT 'ag_news' AS name, 'agnews-' || doc_id AS id, 'ok' AS status FROM d UNION ALL SELECT 'massive_de', 'massive-de-' || doc_id, 'ok' FROM d WHERE lang IN ('en', 'de') UNION ALL SELECT 'wisesight', NULL, 'failed'"""
)
def converter_driver_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converters picked by name, seeded, their records written; one fails while its job runs, and the others go on."""
    from ..operators.driver import convert_all
    from .converter_queries import DEFS

    d = table(spark, sf_dir, "documents").where("text is not null")
    rows = d.select(F.col("doc_id").alias("row"), "text", (F.col("doc_id") % 4).alias("label"), F.lit("train").alias("split"))
    broken = rows.withColumn("texts", F.raise_error(F.lit("the source ended"))).withColumn("category", F.col("label"))
    paths: dict[str, str] = {}

    def sink(name: str, got: DataFrame) -> None:
        paths[name] = scratch(spark, name)
        got.write.parquet(paths[name])

    done, failed = convert_all({"ag_news": (rows,), "wisesight": (broken,), "massive_de": (d.select(F.col("doc_id").alias("row"), "text", F.col("lang").alias("label_text")), DEFS), "clinc": (rows,)}, only=["ag_news", "wisesight", "massive_de"], sink=sink, seed=3)
    out = spark.createDataFrame([(x, None, "failed") for x in failed], "name string, id string, status string")
    for name in done:
        out = out.union(spark.read.parquet(paths[name]).select(F.lit(name), "id", F.lit("ok")))
    return out


@query("SELECT row_number() OVER (ORDER BY id) - 1 AS place, id FROM (SELECT conv_id || '/' || turn AS id FROM conversations)")
def records_sorted_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records sorted by id over all files of a folder of JSON lines."""
    from ..sources.zipped import placed_lines

    path = scratch(spark, "sorted")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "role", "text")
    c.repartitionByRange("id").sortWithinPartitions("id").select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return placed_lines(spark, path).select("place", F.get_json_object("value", "$.id").alias("id"))
