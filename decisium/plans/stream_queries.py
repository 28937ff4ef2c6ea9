"""Queries over streams, lazy sources and raw shards, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators.lexical import lexical_logits
from ..sources.scratch import scratch, ship
from .registry import query, table

#: Options of a question that documents can be asked: the language, by common words.
LANGUAGES = [("en", "the of and to in is that with"), ("fr", "le la les de et du que une"), ("de", "der die und nicht sie das für auch"), ("es", "el los que una para con por del")]
_WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_OPTION_TERMS = f"""options(slot, name, descr) AS (VALUES {_values([(i, *o) for i, o in enumerate(LANGUAGES)])}),
terms AS (SELECT slot, name, unnest(list_distinct({_WORDS.format("name || ' ' || descr")})) AS term FROM options)"""


@query(
    f"""WITH {_OPTION_TERMS},
w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
size AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
tf AS (SELECT doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
parts AS (SELECT doc_id, slot, sum(ln(1 + (size.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tf.n / mean))) AS s FROM tf JOIN terms USING (term) JOIN df USING (term), size GROUP BY doc_id, slot),
scores AS (SELECT doc_id, slot, name, coalesce(s, 0) AS s FROM documents CROSS JOIN options LEFT JOIN parts USING (doc_id, slot)),
e AS (SELECT *, exp(s) / (1 + sum(exp(s)) OVER (PARTITION BY doc_id)) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, slot) AS rk FROM scores)
SELECT doc_id, name AS choice, round(s, 5) AS logit, round(p, 5) AS p FROM e WHERE rk = 1"""
)
def lexical_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From texts to answers without given logits: BM25 over an inverted index of the options' words."""
    options = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("desc")) for n, d in LANGUAGES])
    asked = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("options", options)
    d = D.scored(asked, lambda r: lexical_logits(r, "doc_id", "text"))
    best = D.best_slot(F.col("p")) + 1
    return d.select("doc_id", F.element_at("options", best)["name"].alias("choice"), F.round(F.element_at("logits", best), 5).alias("logit"), F.round(F.element_at("p", best), 5).alias("p"))


_REQUESTS = """lines AS (SELECT conv_id, turn, conv_id || '-' || turn AS id, text, (conv_id + turn) % 6 AS kind FROM conversations)"""


@query(
    f"""WITH {_REQUESTS}, {_OPTION_TERMS},
asked AS (SELECT id, {_WORDS.format("text")} AS w FROM lines WHERE kind IN (0, 1, 5)),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM asked) GROUP BY ALL),
parts AS (SELECT id, slot, sum(tf * 2.2 / (tf + 1.2)) AS s FROM tf JOIN terms USING (term) GROUP BY id, slot),
scores AS (SELECT id, slot, name, coalesce(s, 0) AS s FROM asked CROSS JOIN options LEFT JOIN parts USING (id, slot)),
best AS (SELECT id, arg_min(name, (-s, slot)) AS name FROM scores GROUP BY id)
SELECT id AS request_id, 'lang' AS qid, name AS answer, NULL AS error FROM best
UNION ALL
SELECT id, NULL, NULL, CASE kind WHEN 2 THEN 'no state' WHEN 3 THEN 'lang: unknown type' ELSE 'permutations must be 1 to 32' END FROM lines WHERE kind IN (2, 3, 4)
UNION ALL
SELECT md5('{{"id": "' || conv_id || '", "state": '), NULL, NULL, 'not an object' FROM (SELECT DISTINCT conv_id FROM lines)"""
)
def requests_free_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of any form in a stream, sent repeatedly and partly broken: one answer or one error each."""
    from ..streaming.requests import ANSWERS, ERRORS, serve

    t = table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    question = F.to_json(F.struct(F.when(kind == 3, "rank").otherwise("choice").alias("type"), F.lit("Which language?").alias("instructions"), F.create_map(*[F.lit(x) for o in LANGUAGES for x in o]).alias("criteria")))
    body = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(kind != 2, F.col("text")).alias("state"), F.from_json(F.concat(F.lit('{"lang":'), question, F.lit("}")), "map<string,struct<type:string,instructions:string,criteria:map<string,string>>>").alias("questions"), F.when(kind == 4, 99).alias("permutations"))
    lines = t.select(F.to_json(body).alias("value"), kind.alias("kind"))
    broken = t.select(F.concat(F.lit('{"id": "'), F.col("conv_id").cast("string"), F.lit('", "state": ')).alias("value"))
    inbox, out, checkpoint = scratch(spark, "inbox"), scratch(spark, "served"), scratch(spark, "served-state")
    for batch in (lines.select("value").union(lines.where("kind < 3").select("value")), broken.union(lines.where("kind >= 1").select("value"))):
        batch.write.mode("append").text(inbox)
        serve(spark, inbox, out, checkpoint, lambda r: lexical_logits(r, "key", flat=True), {"choice": 1.0})
    answers, errors = spark.read.schema(ANSWERS).parquet(f"{out}/answers"), spark.read.schema(ERRORS).parquet(f"{out}/errors")
    none = F.lit(None).cast("string")
    return answers.select("request_id", "qid", "answer", none.alias("error")).union(errors.select("request_id", none, none, "error"))

_BY_USER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_BY_EPISODE = "PARTITION BY user_id, episode ORDER BY ts, event_id"


@query(
    f"""WITH o AS (SELECT *, floor(value / 10) AS x, epoch_us(ts) - epoch_us(lag(ts) {_BY_USER}) AS gap FROM events),
n AS (SELECT *, count(*) FILTER (gap > 172800000000) {_BY_USER} AS k FROM o),
e AS (SELECT *, min(epoch_us(ts)) OVER (PARTITION BY user_id, k) AS episode FROM n),
w AS (SELECT *, list(event_type) OVER ({_BY_EPISODE} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS h, lag(x) OVER ({_BY_EPISODE}) AS x_before, lag(event_type) OVER ({_BY_EPISODE}) AS before,
  avg(value) OVER ({_BY_EPISODE} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM e)
SELECT event_id, episode, coalesce(array_to_string(h, ','), '') AS history, coalesce(x = x_before AND before IN ('view', 'click'), false) AS stuck, round(m, 6) AS moving FROM w"""
)
def loop_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed loop state in the state store: events come in three parts in order
    of time, and the query is started anew from its checkpoint for each."""
    from ..streaming.loop import OUT, loop_stream, state_store

    ship(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("step"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"), "value", F.floor(F.col("value") / 10).alias("x"), F.lit(0.0).alias("y"))
    lo, hi = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.least(F.lit(2), F.floor((F.unix_micros("ts") - F.lit(lo or 0)) * 3 / F.lit(max(1, (hi or 0) - (lo or 0)))))
    inbox, out, checkpoint = scratch(spark, "steps"), scratch(spark, "loop"), scratch(spark, "loop-state")
    for i in range(3):
        e.where(part == i).write.mode("append").parquet(inbox)
        with state_store(spark):
            rows = loop_stream(spark.readStream.schema(e.schema).parquet(inbox), ["view", "click"], idle=172800)
            rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(OUT).parquet(out)
    return done.select(F.col("step").alias("event_id"), "episode", F.array_join("history", ",").alias("history"), "stuck", F.round("moving", 6).alias("moving"))


_IDS = r"list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]'), lambda x: ('0x' || substr(md5(x), 1, 4))::INT)"
_SHARD, _SEQ = 8192, 256


@query(
    f"""WITH t AS (SELECT doc_id, unnest(list_append({_IDS}, 1)) AS id, unnest(range(len({_IDS}) + 1)) AS k FROM documents),
p AS (SELECT id, row_number() OVER (ORDER BY doc_id, k) - 1 AS pos FROM t),
s AS (SELECT pos // {_SHARD} AS shard, pos % {_SHARD} AS o, id FROM p),
n AS (SELECT shard, (count(*) - 1) // {_SEQ} AS windows FROM s GROUP BY shard),
w AS (SELECT s.shard, o // {_SEQ} AS win, o, id FROM s UNION ALL SELECT s.shard, o // {_SEQ} - 1, o, id FROM s WHERE o % {_SEQ} = 0 AND o > 0)
SELECT shard::INT AS shard, win AS "window", count(*)::INT AS n, md5(string_agg(id::VARCHAR, ' ' ORDER BY o)) AS ids FROM w JOIN n USING (shard) WHERE win < windows GROUP BY shard, win"""
)
def raw_shard_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into raw uint32 files, and windows read from them by byte range."""
    from ..operators.mixture import running_offset, shards_of
    from ..sources.raw_shards import read_windows, write_raw

    token = F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_\s])")
    tokens = F.regexp_extract_all("text", token, F.lit(1))
    ids = F.concat(F.transform(tokens, lambda x: F.conv(F.substring(F.md5(x), 1, 4), 16, 10).cast("long")), F.array(F.lit(1).cast("long")))
    # sizes are counted once, and hashes of tokens only made for the files
    d, counted = table(spark, sf_dir, "documents"), scratch(spark, "sizes")
    d.select("doc_id", (F.regexp_count("text", token) + 1).cast("long").alias("n_tokens")).write.parquet(counted)
    sizes = spark.read.parquet(counted)
    parts = shards_of(running_offset(sizes, "doc_id", "n_tokens"), _SHARD).join(d.select("doc_id", ids.alias("ids")), "doc_id")
    path = scratch(spark, "raw")
    write_raw(parts.select("shard", F.col("first").alias("place"), F.slice("ids", (F.col("begin") + 1).cast("int"), F.col("length").cast("int")).alias("ids")), path)
    w = read_windows(spark, path, _SEQ)
    return w.select("shard", "window", F.size("ids").alias("n"), F.md5(F.array_join("ids", " ")).alias("ids"))


_WEIGHTS = {"en": 0.5, "fr": 0.45, "de": 0.05}
_COUNT = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 1"


@query(
    f"""WITH d AS (SELECT doc_id, lang, {_COUNT} AS n FROM documents WHERE text IS NOT NULL),
total AS (SELECT sum(n) * 7 // 10 AS t FROM d),
w AS (SELECT * FROM (VALUES {_values(list(_WEIGHTS.items()))}) v(lang, weight)),
s AS (SELECT lang, n, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, floor(t * weight) AS budget FROM d JOIN w USING (lang), total)
SELECT lang AS source, count(*) AS docs, sum(n)::BIGINT AS tokens, sum(n) < any_value(budget) AS ended FROM s WHERE before < budget GROUP BY lang"""
)
def mixture_lazy_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by source of a lazy mixture, in which a source ends early."""
    from ..sources.lazy import budget, draw_mixture

    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + 1
    d = table(spark, sf_dir, "documents").where("text is not null")
    tokens, docs = d.agg(F.sum(n), F.count("*")).first()
    total, files = (tokens or 0) * 7 // 10, max(4, docs // 100_000)
    root, out = scratch(spark, "sources"), scratch(spark, "drawn")
    for k in _WEIGHTS:
        d.where(F.col("lang") == k).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id").select("text").write.option("parquet.block.size", 8 << 20).parquet(f"{root}/{k}")
    draw_mixture(spark, root, _WEIGHTS, total, n, out, draw=2000)
    limit = F.coalesce(*[F.when(F.col("source") == k, budget(total, w)) for k, w in _WEIGHTS.items()])
    rows = spark.read.parquet(out).where("kept").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    return rows.select("source", "docs", "tokens", (F.col("tokens") < limit).alias("ended"))
