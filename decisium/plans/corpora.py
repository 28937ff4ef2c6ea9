"""Corpus queries: quality, scripts, digests, sources, mixtures, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rand import hash32, hash32_sql, uniform, uniform_sql
from ..operators import mixture as X
from ..operators import sources as O
from .registry import query, table

#: Latin letters with accents stand for the script here: the tables hold no Thai.
ACCENTED = r"[\x{00C0}-\x{00FF}]"
BAD = ["Released under", "Copyright"]
WORDS = r"([A-Za-z0-9À-ÿ]+)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z0-9À-ÿ]+")).cast("long")


_N = "len(regexp_extract_all(text, '[A-Za-z0-9À-ÿ]+'))"
_SOLID = "list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\\S'))"


def _count(part: str) -> str:
    return f"((length(text) - length(replace(text, '{part}', ''))) / {len(part)})::INT"


_QUALITY = f"""SELECT doc_id, length(regexp_replace(text, '[^À-ÿ]', '', 'g'))::DOUBLE / greatest(1, length(text)) AS ratio,
 len(list_distinct({_SOLID}))::DOUBLE / nullif(len({_SOLID}), 0) AS uniq, {_count("http")} AS links, {" + ".join(map(_count, BAD))} AS bad, length(text) AS n FROM documents"""


@query(
    f"WITH q AS ({_QUALITY}) SELECT doc_id, round(ratio, 6) AS ratio, round(uniq, 6) AS uniq, links, bad, coalesce(n >= 200 AND ratio >= 0.05 AND uniq >= 0.7 AND links <= n / 200.0 AND bad <= 3, false) AS ok FROM q"
)
def text_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    bad = sum((T.occurrences(t, b) for b in BAD), F.lit(0))
    return docs(spark, sf_dir).select(
        "doc_id", F.round(T.script_ratio(t, ACCENTED), 6).alias("ratio"), F.round(T.unique_line_ratio(t), 6).alias("uniq"), T.occurrences(t, "http").alias("links"), bad.alias("bad"), T.quality(t, ACCENTED, 0.05, BAD).alias("ok")
    )


@query("SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents WHERE length(text) > CASE WHEN lang = 'en' THEN 300 ELSE 200 END AND lang IS NOT NULL AND lang <> '' GROUP BY source")
def text_min_length_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = F.when(F.col("lang") == "en", 300).otherwise(200)
    kept = docs(spark, sf_dir).where((F.length("text") > least) & F.col("lang").isNotNull() & (F.col("lang") != ""))
    return kept.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("SELECT lang, count(*) AS docs, count(*) FILTER (regexp_matches(text, '[À-ÿ]')) AS rejected FROM documents GROUP BY lang")
def script_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(T.other_script(F.col("text"), ACCENTED)).alias("rejected"))


@query("SELECT doc_id, md5(replace(text || '<|ts_q|> x <|ts_', '<|ts_', '<' || chr(8203) || '|ts_')) AS digest, length(replace(text || '<|ts_q|> x <|ts_', '<|ts_', '<' || chr(8203) || '|ts_')) AS n FROM documents")
def sanitize_control_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.sanitize(F.concat("text", F.lit("<|ts_q|> x <|ts_")))
    return docs(spark, sf_dir).select("doc_id", F.md5(t).alias("digest"), F.length(t).alias("n"))


@query("SELECT substr(sha256(text), 1, 16) AS family, count(*) AS members, arg_min(lang, doc_id) AS domain, min(doc_id) AS first_id FROM documents GROUP BY 1")
def content_digest_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy(T.digest(F.col("text")).alias("family")).agg(F.count("*").alias("members"), F.min_by("lang", "doc_id").alias("domain"), F.min("doc_id").alias("first_id"))


@query(
    f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS para FROM documents), f AS (SELECT doc_id, trim(para) AS para FROM p WHERE length(trim(para)) BETWEEN 300 AND 1400),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {hash32_sql("seed", "doc_id", "para")}, para) AS rk FROM f)
SELECT doc_id, length(para) AS n, md5(para) AS digest FROM r WHERE rk = 1"""
)
def paragraph_seed_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One passage of 300 to 1400 characters per document, by hash: a minimum
    with partial aggregation instead of a sort."""
    p = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("para")).select("doc_id", F.trim("para").alias("para")).where(F.length("para").between(300, 1400))
    best = p.groupBy("doc_id").agg(F.min(F.struct(hash32("seed", "doc_id", "para").alias("h"), "para")).alias("x"))
    return best.select("doc_id", F.length("x.para").alias("n"), F.md5("x.para").alias("digest"))


@query("SELECT doc_id, replace(text, chr(10), ' ') AS body FROM documents WHERE length(text) BETWEEN CASE WHEN lang = 'en' THEN 800 ELSE 600 END AND CASE WHEN lang = 'en' THEN 4500 ELSE 4000 END")
def article_seed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    en = F.col("lang") == "en"
    n = F.length("text")
    kept = docs(spark, sf_dir).where((n >= F.when(en, 800).otherwise(600)) & (n <= F.when(en, 4500).otherwise(4000)))
    return kept.select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("body"))


@query(f"SELECT page_id, kind, CASE WHEN kind = 'html' THEN md5(html) END AS digest FROM (SELECT *, CASE WHEN {uniform_sql('mux', 'page_id')} < 0.4 THEN 'ui' WHEN {uniform_sql('mux', 'page_id')} < 0.7 THEN 'json' WHEN length(html) > 200 AND length(html) < 20000 THEN 'html' ELSE 'ui' END AS kind FROM pages)")
def html_machine_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 % interface states, 30 % JSON, 30 % HTML of fitting length (whole, here
    as its digest), else interface."""
    u, n = uniform("mux", "page_id"), F.length("html")
    kind = F.when(u < 0.4, "ui").when(u < 0.7, "json").when((n > 200) & (n < 20000), "html").otherwise("ui")
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), F.when(kind == "html", F.md5("html")).alias("digest"))


#: Roles of interface elements.
ROLES = ["button", "link", "textbox", "checkbox", "combobox", "menuitem", "heading", "tab", "radio", "img"]


@query(
    f"""WITH s AS (SELECT id, 8 + {hash32_sql("n", "id")} % 33 AS n, {uniform_sql("th", "id")} < 0.7 AS th FROM range(0, 500) t(id)),
e AS (SELECT s.*, i, {ROLES}[({hash32_sql("role", "id", "i")} % 10 + 1)::INT] AS role FROM s, range(0, 40) r(i) WHERE i < n)
SELECT id, th, n AS elements, string_agg('[' || i || '] ' || role, chr(10) ORDER BY i) AS state FROM e GROUP BY ALL"""
)
def synthetic_ui_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface states of 8 to 40 elements, built in one array expression."""
    roles = F.array(*[F.lit(r) for r in ROLES])
    s = spark.range(500).select("id", (8 + hash32("n", "id") % 33).alias("elements"), (uniform("th", "id") < 0.7).alias("th"))
    line = F.transform(F.sequence(F.lit(0).cast("long"), F.col("elements") - 1), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.element_at(roles, (hash32("role", F.col("id"), i) % 10 + 1).cast("int"))))
    return s.select("id", "th", "elements", F.array_join(line, "\n").alias("state"))


@query(f"SELECT id, '{{\"order\":' || id || ',\"items\":' || (1 + {hash32_sql('it', 'id')} % 5) || ',\"paid\":' || CASE WHEN {uniform_sql('paid', 'id')} < 0.5 THEN 'true' ELSE 'false' END || '}}' AS state FROM range(0, 500) t(id)")
def synthetic_json_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.struct(F.col("id").alias("order"), (1 + hash32("it", "id") % 5).alias("items"), (uniform("paid", "id") < 0.5).alias("paid"))
    return spark.range(500).select("id", F.to_json(s).alias("state"))


@query(f"SELECT doc_id, CASE WHEN {uniform_sql('flip', 'doc_id')} < 0.5 THEN lang || ': ' || text || chr(10) || 'source: ' || source ELSE 'source: ' || source || chr(10) || lang || ': ' || text END AS body FROM documents WHERE coalesce(lang, '') <> '' AND coalesce(text, '') <> ''")
def parallel_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides, named and whole, in either order, by hash; both must be there."""
    a, b = F.concat("lang", F.lit(": "), "text"), F.concat(F.lit("source: "), "source")
    d = docs(spark, sf_dir).where((F.coalesce("lang", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))
    return d.select("doc_id", F.when(uniform("flip", "doc_id") < 0.5, F.concat_ws("\n", a, b)).otherwise(F.concat_ws("\n", b, a)).alias("body"))


SHARE = {"src0": 20000, "src1": 3000}


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "source", "lang", n_tokens(F.col("text")).alias("n_tokens"))


_SIZED = f"d AS (SELECT doc_id, source, lang, {_N} AS n_tokens FROM documents)"
_BUDGET = f"""{_SIZED}, b AS (SELECT *, CASE source WHEN 'src0' THEN 20000 WHEN 'src1' THEN 3000 ELSE 5000 END AS budget,
 coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY {hash32_sql("mix", "doc_id")}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS got FROM d)"""


@query(f"WITH {_BUDGET} SELECT doc_id, source, n_tokens, got FROM b WHERE got < budget")
def mixture_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = F.when(F.col("source") == "src0", 20000).when(F.col("source") == "src1", 3000).otherwise(5000)
    return X.token_budget(sized(spark, sf_dir), budget, "mix").select("doc_id", "source", "n_tokens", "got")


@query(f"WITH {_BUDGET} SELECT source, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM b WHERE got < budget GROUP BY source")
def mixture_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_token_budget(spark, sf_dir).groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))


@query(
    f"""WITH {_BUDGET}, u AS (SELECT *, {uniform_sql("hold", "doc_id")} < 0.1 AS drawn FROM b WHERE got < budget),
h AS (SELECT *, drawn AND coalesce(sum(n_tokens) OVER (PARTITION BY drawn ORDER BY {hash32_sql("hold", "doc_id")}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 2000 AS held FROM u)
SELECT doc_id, source, held FROM h"""
)
def mixture_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the mixture's rows within their budgets, those held out under one cap of tokens."""
    return X.holdout(mixture_token_budget(spark, sf_dir), 0.1, 2000, "hold").select("doc_id", "source", "held")


SHARD, SEQ = 10_000, 512
_OFFSET = f"{_SIZED}, o AS (SELECT *, coalesce(sum(n_tokens + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, n_tokens + 1 AS n FROM d)"
_PARTS = f"{_OFFSET}, s AS (SELECT *, unnest(range(off // {SHARD}, (off + n - 1) // {SHARD} + 1)) AS shard FROM o), q AS (SELECT doc_id, shard, greatest(off, shard * {SHARD}) AS lo, least(off + n, (shard + 1) * {SHARD}) AS hi, off FROM s)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", (n_tokens(F.col("text")) + 1).alias("n_tokens"))  # with its end token
    return X.shards_of(X.running_offset(d, "doc_id", "n_tokens", 64), SHARD)


@query(f"WITH {_PARTS} SELECT doc_id, shard, lo - shard * {SHARD} AS first, lo - off AS begin, hi - lo AS length FROM q")
def pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid end to end in shards; offsets come from sums by range."""
    return parts(spark, sf_dir).select("doc_id", "shard", "first", "begin", "length")


_SHARDS = f"{_PARTS}, t AS (SELECT shard, sum(hi - lo)::BIGINT AS n FROM q GROUP BY shard)"
_WINDOWS = f"{_SHARDS}, w AS (SELECT shard, unnest(range(0, (n - 1) // {SEQ})) AS win FROM t)"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.windows_of(parts(spark, sf_dir).groupBy("shard").agg(F.sum("length").alias("n_tokens")), SEQ)


@query(f'WITH {_WINDOWS} SELECT shard, win AS "window", win * {SEQ} AS begin, {SEQ + 1} AS length FROM w')
def pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).select("shard", "window", "begin", "length")


@query(f'WITH {_WINDOWS} SELECT shard, win AS "window", row_number() OVER (PARTITION BY shard ORDER BY {hash32_sql("win", "shard", "win")}, win) AS place FROM w')
def window_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each shard in hash order."""
    from pyspark.sql import Window

    order = Window.partitionBy("shard").orderBy(hash32("win", "shard", "window"), "window")
    return windows(spark, sf_dir).select("shard", "window", F.row_number().over(order).alias("place"))


DRAWS = 2000
_SHARES = """g AS (SELECT source, count(*) AS size FROM documents GROUP BY source), sh AS (SELECT source, size, (CASE WHEN source = 'src0' THEN 0.5 ELSE 1.0 END) * sqrt(size) AS w FROM g),
c AS (SELECT source, size, sum(w) OVER (ORDER BY source) / sum(w) OVER () AS hi FROM sh), l AS (SELECT source, size, hi, lag(hi, 1, 0.0) OVER (ORDER BY source) AS lo FROM c)"""


@query(
    f"""WITH {_SHARES}, dr AS (SELECT draw, {uniform_sql("sampler", "draw")} AS u FROM range(0, {DRAWS}) t(draw)),
k AS (SELECT draw, source, size, row_number() OVER (PARTITION BY source ORDER BY draw) - 1 AS n FROM dr JOIN l ON u >= lo AND u < hi),
e AS (SELECT draw, source, n // size AS epoch, n % size AS place FROM k),
r AS (SELECT d.source, epoch, doc_id, row_number() OVER (PARTITION BY d.source, epoch ORDER BY {hash32_sql("sampler", "epoch", "doc_id")}, doc_id) - 1 AS place FROM documents d JOIN (SELECT DISTINCT source, epoch FROM e) x ON d.source = x.source)
SELECT draw, e.source, e.epoch, e.place, doc_id FROM e JOIN r USING (source, epoch, place)"""
)
def weighted_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws by weight times root of size, each source cycling in shuffled epochs."""
    d = docs(spark, sf_dir).select("doc_id", "source")
    shares = X.cumulative_weights(d.groupBy("source").agg(F.count("*").alias("size")), F.when(F.col("source") == "src0", 0.5).otherwise(1.0))
    return X.weighted_draws(spark.range(DRAWS).withColumnRenamed("id", "draw"), shares, d, "sampler")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents) WHERE rk <= 10")
def source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.first_per_group(docs(spark, sf_dir).select("doc_id", "source"), "source", 10, "doc_id")


@query("SELECT source, count(*) FILTER (rk % 50 = 0) AS eval, count(*) FILTER (rk % 50 <> 0) AS train FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rk FROM documents) GROUP BY source")
def systematic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.place_in(docs(spark, sf_dir).select("source", "doc_id"), ["source"], "doc_id", "place").select("source", (F.col("place") % 50).alias("k"))
    return d.groupBy("source").agg(F.count_if(F.col("k") == 0).alias("eval"), F.count_if(F.col("k") != 0).alias("train"))


_FAMILY = f"""m AS (SELECT doc_id, lang, substr(sha256(text), 1, 16) AS family FROM documents WHERE {_N} <= 400),
f AS (SELECT family, arg_min(lang, doc_id) AS domain, count(*) AS size FROM m GROUP BY family),
t AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {hash32_sql("bench", "family")}, family) AS turn FROM f),
c AS (SELECT *, sum(size) OVER (ORDER BY turn, domain ROWS UNBOUNDED PRECEDING) AS upto FROM t)"""


@query(f"WITH {_FAMILY} SELECT doc_id, family, domain FROM m JOIN c USING (family) WHERE upto <= 100")
def family_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark subset of at most 100 rows, in whole families, after the
    length filter."""
    d = docs(spark, sf_dir).where(n_tokens(F.col("text")) <= 400).select("doc_id", "lang", T.digest(F.col("text")).alias("family"))
    return X.whole_families(d, 100, "bench", "doc_id", "family", "lang").select("doc_id", "family", F.col("family_domain").alias("domain"))


@query(f"WITH {_FAMILY}, k AS (SELECT domain FROM m JOIN c USING (family) WHERE upto <= 100), n AS (SELECT domain, count(*) AS selected FROM k GROUP BY domain), o AS (SELECT lang AS domain, count(*) AS n, count(*) FILTER ({_N} > 400) AS dropped_over_length FROM documents GROUP BY lang) SELECT domain, n, dropped_over_length, coalesce(selected, 0) AS selected FROM o LEFT JOIN n USING (domain)")
def benchmark_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, rows over the length limit and selected rows by domain."""
    picked = family_stratified_sample(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("selected"))
    whole = docs(spark, sf_dir).groupBy(F.col("lang").alias("domain")).agg(F.count("*").alias("n"), F.count_if(n_tokens(F.col("text")) > 400).alias("dropped_over_length"))
    return whole.join(picked, "domain", "left").select("domain", "n", "dropped_over_length", F.coalesce("selected", F.lit(0)).alias("selected"))


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT (d.doc_id % 10 <> 0 AND d.source IN ('src1', 'src2'))")
def holdout_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.records import not_held_out

    d = docs(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 10 == 0, "eval").otherwise("train"))
    return not_held_out(d, names=["src1", "src2"]).select("doc_id", "source")


@query("SELECT DISTINCT substr(sha256(text), 1, 16) AS family FROM documents WHERE doc_id % 10 = 0 INTERSECT SELECT substr(sha256(text), 1, 16) FROM documents WHERE doc_id % 10 <> 0")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that stand in both splits: what a disjointness check finds."""
    d = docs(spark, sf_dir).select(T.digest(F.col("text")).alias("family"), "doc_id")
    return d.where("doc_id % 10 = 0").select("family").intersect(d.where("doc_id % 10 <> 0").select("family"))


@query("SELECT d.doc_id, min(b.item_id) AS item_id, count(*) AS items FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.doc_id")
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text verbatim. An item's second to fifth
    word stand whole wherever the item does, so candidates come from a hash join
    on runs of four words; items too short for that are compared one by one."""
    item = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")).where(F.col("passage") != "").withColumn("w", F.split(F.trim("passage"), r"\s+"))
    keyed = item.where(F.size("w") > 5).select("item_id", F.array_join(F.slice("w", 2, 4), " ").alias("key"))
    d = docs(spark, sf_dir).select("doc_id", "text")
    w = F.split("text", r"\s+")
    shifted = [F.slice(w, i, F.greatest(F.lit(0), F.size(w) - 3)).alias(f"w{i}") for i in (1, 2, 3, 4)]
    runs = F.transform(F.arrays_zip(*shifted), lambda x: F.concat_ws(" ", x["w1"], x["w2"], x["w3"], x["w4"]))
    hit = d.where(F.size(w) > 3).select("doc_id", F.explode(F.array_distinct(runs)).alias("key")).join(keyed, "key").select("doc_id", "item_id").distinct()
    found = hit.join(item.select("item_id", "passage"), "item_id").join(d, "doc_id").where(F.contains("text", "passage")).select("doc_id", "item_id")
    short = item.where(F.size("w") <= 5)
    if not short.isEmpty():
        found = found.union(d.join(short, F.contains("text", "passage")).select("doc_id", "item_id"))
    return found.groupBy("doc_id").agg(F.min("item_id").alias("item_id"), F.count("*").alias("items"))


@query(f"SELECT doc_id, list_transform(range(0, 3), lambda i: CASE WHEN {uniform_sql('oc-k', 'doc_id * 3 + i')} < 0.6 THEN (2 + floor({uniform_sql('oc-u', 'doc_id * 3 + i')} * 11))::INT ELSE floor(exp(ln(2.0) + {uniform_sql('oc-u', 'doc_id * 3 + i')} * (ln(255.0) - ln(2.0))))::INT END) AS counts FROM documents")
def option_count_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.records import option_count

    d = docs(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).withColumn("k", F.col("doc_id") * 3 + F.col("i")).withColumn("n", option_count("oc", "k"))
    return d.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("x")).select("doc_id", F.col("x.n").alias("counts"))


@query(f"SELECT doc_id, CASE WHEN {uniform_sql('p-lang', 'doc_id')} < 0.7 THEN 'th' ELSE 'en' END AS ask, CASE WHEN length(text) > 4000 THEN 'long' WHEN {uniform_sql('p-style', 'doc_id')} < 0.25 THEN 'chat' WHEN {uniform_sql('p-style', 'doc_id')} < 0.75 THEN 'formal' ELSE 'log' END AS style FROM documents")
def prompt_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted categorical draws of a prompt, with a conditional override."""
    s = uniform("p-style", "doc_id")
    style = F.when(F.length("text") > 4000, "long").when(s < 0.25, "chat").when(s < 0.75, "formal").otherwise("log")
    return docs(spark, sf_dir).select("doc_id", F.when(uniform("p-lang", "doc_id") < 0.7, "th").otherwise("en").alias("ask"), style.alias("style"))


_PICK = lambda xs, seed: f"{xs}[({hash32_sql(seed, 'row', 'i')} % {len(xs)} + 1)::INT]"
_UI = f"""(SELECT string_agg('[' || i || '] ' || {_PICK(O.ROLES, 'ui-role')} || ' "' || CASE WHEN {uniform_sql('ui-th', 'row', 'i')} < 0.7 THEN {_PICK(O.NAMES_TH, 'ui-name')} ELSE {_PICK(O.NAMES_EN, 'ui-name')} END || '"', chr(10) ORDER BY i)
  FROM range(0, 40) t(i) WHERE i < 8 + {hash32_sql('ui-n', 'row')} % 33)"""


@query(
    f"""WITH q AS ({_QUALITY}), d AS (SELECT doc_id AS row, text, source, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang FROM documents WHERE text IS NOT NULL), p AS (SELECT page_id AS row, url, html, {uniform_sql('machine', 'page_id')} AS u FROM pages),
a AS (SELECT 'thai_web' AS source, row, text FROM d JOIN q ON doc_id = row WHERE n >= 200 AND ratio >= 0.05 AND uniq >= 0.7 AND links <= n / 200.0 AND bad <= 3
UNION ALL SELECT 'thai_wiki', row, coalesce(source, '') || chr(10) || chr(10) || text FROM d WHERE length(text) > 300
UNION ALL SELECT 'thai_edu', row, t FROM (SELECT row, coalesce(source, '') || chr(10) || coalesce(lang, '') || chr(10) || text AS t FROM d) WHERE length(t) > 200
UNION ALL SELECT 'parallel', row, CASE WHEN {uniform_sql('parallel', 'row')} < 0.5 THEN 'th: ' || text || chr(10) || 'en: ' || source ELSE 'en: ' || source || chr(10) || 'th: ' || text END FROM d WHERE coalesce(source, '') <> '' AND text <> ''
UNION ALL SELECT 'en_replay', row, text FROM d WHERE length(text) > 300
UNION ALL SELECT 'machine', row, CASE WHEN u < 0.4 OR (u >= 0.7 AND NOT (length(html) > 200 AND length(html) < 20000)) THEN {_UI} WHEN u < 0.7 THEN to_json(struct_pack(order_id := row, customer := url))::VARCHAR ELSE html END FROM p)
SELECT source, row::VARCHAR AS row, md5(text) AS digest FROM a"""
)
def sources_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six sources of a mixture, each rendered and filtered its own way, in one table."""
    d = docs(spark, sf_dir).where("text is not null").withColumnRenamed("doc_id", "row")
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("row"), "html", F.struct(F.col("page_id").alias("order_id"), F.col("url").alias("customer")).alias("record"))
    inputs = {
        "thai_web": d, "thai_wiki": d.withColumn("title", F.col("source")), "en_replay": d, "machine": p, "parallel": d.select("row", F.col("text").alias("th"), F.col("source").alias("en")),
        "thai_edu": d.select("row", F.col("source").alias("instruction"), F.when(F.col("row") % 3 > 0, F.col("lang")).alias("input"), F.col("text").alias("output")),
    }
    return O.all_sources(inputs, thai_web={"script": "[À-ÿ]", "least_ratio": 0.05, "boilerplate": BAD}).select("source", "row", F.md5("text").alias("digest"))
