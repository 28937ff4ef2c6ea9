"""Question specs, gates on labels in JSON, producers, zips and file globs, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rand import hash32_sql
from ..operators import converters as C
from ..operators import records as R
from ..sources.scratch import scratch
from .converter_queries import _asked
from .registry import query, table

_SPECS = r"""c AS (SELECT conv_id, turn, role, conv_id || '-' || turn AS key, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations),
n AS (SELECT *, (turn % 4 = 0 AND conv_id % 3 = 0) AS scored, ['a ' || coalesce(w[1], '-'), 'b ' || coalesce(w[2], '-'), 'c ' || coalesce(w[3], '-')][1:CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 3 END] AS names FROM c),
l AS (SELECT *, CASE WHEN scored THEN turn % 5 WHEN turn % 7 = 6 THEN -1 ELSE least(len(names) - 1, turn % 3) END AS own, NOT scored AND turn % 4 = 1 AND turn % 7 <> 6 AS gone FROM n)"""


@query(
    f"""WITH {_SPECS},
e AS (SELECT *, CASE WHEN scored AND own > 2 THEN 'level out of range' WHEN own < 0 THEN 'label isn''t an option' WHEN gone AND len(names) < 2 THEN 'can''t drop the only option' END AS error,
  CASE WHEN scored THEN [0, 1, 2] WHEN gone THEN list_filter(range(len(names)), lambda i: i <> own) WHEN turn % 4 = 2 THEN list_filter([2, 0, 1], lambda i: i < len(names))
  WHEN turn % 4 = 3 THEN list_transform(list_sort(list_transform(range(len(names)), lambda i: {{'h': {hash32_sql("order", "key", "i")}, 'i': i}})), lambda s: s.i) ELSE range(len(names)) END AS placed FROM l)
SELECT key, CASE WHEN scored THEN 'score' ELSE 'choice' END AS qtype, CASE WHEN error IS NULL THEN array_to_string(list_transform(placed, lambda i: CASE WHEN scored THEN i::VARCHAR || '=' || ['low', 'mid', 'high'][i + 1] ELSE names[i + 1] || '=' || role END), ';') END AS options,
 CASE WHEN error IS NULL THEN CASE WHEN gone THEN 255 ELSE list_position(placed, own) - 1 END END AS slot, error FROM e"""
)
def question_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of JSON to specs: shuffled, in an order that is asked for, without the label's option, and what can't be."""
    w = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    turn, conv = F.col("turn"), F.col("conv_id")
    scored = (turn % 4 == 0) & (conv % 3 == 0)
    names = F.slice(F.array(*[F.concat(F.lit(f"{p} "), F.coalesce(F.try_element_at(w, F.lit(i + 1)), F.lit("-"))) for i, p in enumerate("abc")]), F.lit(1), F.when(conv % 7 == 0, 1).otherwise(3))
    t = table(spark, sf_dir, "conversations").withColumn("names", names)
    choice = F.to_json(F.struct(F.lit("choice").alias("type"), F.lit("which").alias("instructions"), F.map_from_entries(F.transform("names", lambda n: F.struct(n, F.col("role")))).alias("criteria")))
    raw = F.when(scored, F.lit('{"type": "score", "instructions": "how", "criteria": ["low", "mid", "high"]}')).otherwise(choice)
    label = F.when(scored, (turn % 5).cast("string")).when(turn % 7 == 6, "nothing").otherwise(F.element_at("names", F.least(F.size("names"), (turn % 3 + 1).cast("int"))))
    key = F.concat_ws("-", "conv_id", "turn")
    spec = R.question_to_spec(raw, label, turn % 4 == 1, F.when(turn % 4 == 2, F.array(F.lit(2), F.lit(0), F.lit(1))), turn % 4 == 3, "order", key)
    s = t.select(key.alias("key"), spec.alias("s"))
    shown = F.array_join(F.transform("s.options", lambda o: F.concat(o["name"], F.lit("="), o["desc"])), ";")
    return s.select("key", F.col("s.qtype").alias("qtype"), shown.alias("options"), F.col("s.slot").cast("long").alias("slot"), F.col("s.error").alias("error"))


_SIZE = "CASE WHEN length(text) < 300 THEN 0 WHEN length(text) < 2000 THEN 1 ELSE 2 END"
_GUESS = "CASE WHEN contains(text, ' der ') THEN 'de' WHEN contains(text, ' que ') THEN 'es' WHEN contains(text, ' le ') THEN 'fr' ELSE 'en' END"


@query(
    f"""WITH r AS (SELECT doc_id, lang, quality = 1 AS good, {_SIZE} AS size, {_GUESS} AS guess, length(text) > 150 AS good2 FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'invalid' WHEN good <> good2 OR lang <> guess THEN 'disagree' WHEN good AND lang = 'en' AND size = 1 THEN 'leak' ELSE 'ok' END AS status FROM r"""
)
def gates_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records' gates on three labellings in JSON: the tables' own, one by rules
    from the text, and one that doesn't see it."""
    asked = '{"good": {"type": "noul", "instructions": "is it good"}, "lang": {"type": "choice", "instructions": "which", "criteria": ["en", "fr", "de", "es"]}, "size": {"type": "score", "instructions": "how long", "criteria": ["short", "medium", "long"]}}'
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").where("text is not null"), "doc_id")
    own = F.to_json(F.struct((F.col("quality") == 1).alias("good"), F.when(F.col("doc_id") % 13 != 0, F.col("lang")).alias("lang"), F.expr(_SIZE).alias("size")))
    again = F.to_json(F.struct(F.when(F.length("text") > 150, " Yes").otherwise("no").alias("good"), F.expr(_GUESS).alias("lang"), F.expr(f"{_SIZE} + 0.5D").alias("size")))
    return d.select("doc_id", R.gate_status(F.lit(asked), own, again, F.lit('{"good": "true", "lang": "en", "size": "1"}')).alias("status"))


@query("WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents), r AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS place FROM conversations) SELECT coalesce(l.place, r.place) AS place, doc_id, conv_id || '-' || turn AS turn FROM l FULL JOIN r ON l.place = r.place")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of JSON lines zipped by place; the longer one's rest is there without the other."""
    from ..sources.zipped import placed_lines, zipped

    paths = [scratch(spark, "left"), scratch(spark, "right")]
    d = table(spark, sf_dir, "documents").select("doc_id").repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "conv_id", "turn").repartitionByRange(3, "conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    d.select(F.to_json(F.struct("doc_id")).alias("value")).write.text(paths[0])
    c.select(F.to_json(F.struct("key")).alias("value")).write.text(paths[1])
    z = zipped(placed_lines(spark, paths[0]), placed_lines(spark, paths[1]))
    return z.select("place", F.get_json_object("left", "$.doc_id").cast("long").alias("doc_id"), F.get_json_object("right", "$.key").alias("turn"))


@query(f"WITH p AS (SELECT doc_id, text, row_number() OVER (ORDER BY {hash32_sql('producer', 'doc_id')}, doc_id) - 1 AS place FROM documents) SELECT doc_id, place FROM p WHERE length(text) > 500 ORDER BY place LIMIT 40")
def producer_until_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in random order, launched in batches until forty were kept."""
    from ..operators.mixture import sum_before
    from ..streaming.producer import first_kept, produce

    placed = sum_before(table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1).cast("long")), ["_all"], "producer", "doc_id", "_one", "place")
    path = scratch(spark, "candidates")
    placed.select("doc_id", "text", F.col("place").cast("long").alias("place")).repartitionByRange("place").write.parquet(path)
    out = scratch(spark, "produced")
    produce(spark.read.parquet(path), lambda batch: batch.where(F.length("text") > 500), 40, out, cap=200)
    return first_kept(spark.read.schema("doc_id long, place long").parquet(f"{out}/batch=*"), 40)


@query(f"SELECT id, source, lang FROM (SELECT doc_id::VARCHAR AS id, source, lang, row_number() OVER (PARTITION BY source ORDER BY {hash32_sql('eval', 'doc_id::VARCHAR')}, doc_id::VARCHAR) AS rk FROM documents WHERE source IN ('src1', 'src10', 'src11') AND doc_id % 7 = 0) WHERE rk <= 4")
def globs_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records of the files that two globs match, some of each source."""
    from ..sources.jsonl import read_globs, write_records

    d = table(spark, sf_dir, "documents")
    path = scratch(spark, "by-split")
    write_records(d.select(F.col("doc_id").cast("string").alias("id"), "source", "lang", F.when(F.col("doc_id") % 7 == 0, "eval").otherwise("train").alias("split"), F.col("text").alias("state")), path)
    rows = read_globs(spark, [f"{path}/_source=src1/*/*", f"{path}/_source=src1[0-9]/*/*"], "eval", ["src1", "src10", "src11"], 4)
    return rows.select("id", "source", "lang")


_ELEMENT = "'[' || turn || '] button ' || role || ' id=\"n' || turn || '\"'"
_DID = "op || ' button ' || role || ' id=\"n' || turn || '\"'"
_RANKED = "list_transform(list_sort(list_transform({xs}, lambda x: {{'h': {h}, 'x': x}})), lambda s: s.x)"


@query(
    f"""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j, CASE WHEN turn % 3 = 0 THEN 'TYPE' ELSE 'CLICK' END AS op, {_ELEMENT} AS el FROM conversations),
a AS (SELECT *, list(el) OVER (PARTITION BY conv_id) AS els, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS site, list({_DID}) OVER (PARTITION BY conv_id ORDER BY j ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS did, [8, 16, 32, 64][({hash32_sql("m2w-k", "conv_id", "j")} % 4 + 1)::INT] AS k FROM t),
o AS (SELECT *, {_RANKED.format(xs="list_filter(els, lambda e: e <> el)", h=hash32_sql("m2w", "conv_id", "j", "x"))} AS others FROM a),
n AS (SELECT *, {_RANKED.format(xs="list_concat([el], others[1:k - 1])", h=hash32_sql("m2w-order", "conv_id", "j", "x"))} AS names FROM o)
SELECT 'mind2web-' || conv_id || '-' || j AS id, md5(to_json(struct_pack(task := 'task ' || conv_id, website := site, previous_actions := coalesce(did, []), candidate_elements := names))::VARCHAR) AS state_md5,
 'target|choice|Which element should the agent act on next?|' || array_to_string(list_transform(names, lambda x: x || '='), ';') || '|' || el || chr(10) || 'operation|choice|Which operation should be performed on it?|CLICK=;TYPE=;SELECT=|' || op AS asked FROM n"""
)
def source_mind2web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of an agent: the element to act on among others of the page, and the operation."""
    element = lambda t: F.struct(t["turn"].alias("backend_node_id"), F.lit("button").alias("tag"), F.to_json(F.struct(t["role"].alias("aria_label"), F.concat(F.lit("n"), t["turn"].cast("string")).alias("id"))).alias("attributes"))
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("row")).agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    step = lambda t: F.struct(F.array(element(t)).alias("pos_candidates"), F.transform(F.filter("x", lambda o: o["turn"] != t["turn"]), element).alias("neg_candidates"), F.struct(F.when(t["turn"] % 3 == 0, "TYPE").alias("op")).alias("operation"))
    rows = c.select("row", F.concat(F.lit("task "), F.col("row").cast("string")).alias("confirmed_task"), F.element_at("x", 1)["role"].alias("website"), F.transform("x", step).alias("actions"))
    return C.mind2web(rows).select("id", F.md5("state").alias("state_md5"), F.array_join(F.transform("questions", _asked), "\n").alias("asked"))
