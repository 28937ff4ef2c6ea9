"""URL filter, DataFrame functions only: a blocked Bloom filter of the listed
canonical URLs passes possible hits to an exact hash join.

A listed entry is (host, path, action) and fits a url if the url's host is the
entry's or a subdomain of it and the url's path starts with the entry's. The
longest entry wins, then the longer host, then block before allow.

A url's candidate keys are its host suffixes with its path prefixes of the
lengths that occur in the list. A key tests one 512-bit block, a bit in each of
eight words. Keys that pass are joined with the list itself, so false positives
of the filter go. Filter and list are broadcast only while their counted rows
stay under BROADCAST_ROWS; above, both joins shuffle.

A null url, or one without `://`, has empty host and path; repeated rows keep a
row each; an empty list lets everything pass with the default verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

WORDS, KEYS_IN_BLOCK, BROADCAST_ROWS = 8, 32, 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _bit(i: int) -> Column:
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h2, {6 * i}) & 63 as int))")


def _hashed(df: DataFrame, blocks: int) -> DataFrame:
    key = [F.col("host_key"), F.col("path_key")]
    return df.withColumn("block", F.pmod(F.xxhash64(*key), F.lit(blocks))).withColumn("h2", F.xxhash64(F.lit(7), *key))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w7 of the listed keys."""
    return _hashed(keys, blocks).groupBy("block").agg(*[F.bit_or(_bit(i)).alias(f"w{i}") for i in range(WORDS)])


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of each url.

    rules: host, path, action ('allow' or 'block')."""
    listed = stored(rules.select(F.col("host").alias("host_key"), F.col("path").alias("path_key"), F.col("action").alias("action")).where("host_key is not null and path_key is not null"), "rules")
    keys = listed.select("host_key", "path_key").distinct()
    lengths = sorted(r[0] for r in keys.select(F.length("path_key")).distinct().collect())
    n = keys.count()
    blocks = max(1, -(-n // KEYS_IN_BLOCK))
    small = n <= BROADCAST_ROWS
    side = F.broadcast if small else (lambda df: df)

    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not lengths:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", "\\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length("path")), lambda x: F.substring(F.col("path"), F.lit(1), x))
    one = urls.select("host", "path").distinct()
    candidates = one.withColumn("host_key", F.explode(hosts)).withColumn("path_key", F.explode(prefixes))
    possible = (
        _hashed(candidates, blocks)
        .join(side(bloom(keys, blocks)), "block")
        .where(" and ".join(f"(w{i} & shiftleft(1L, cast(shiftrightunsigned(h2, {6 * i}) & 63 as int))) <> 0" for i in range(WORDS)))
        .select("host", "path", "host_key", "path_key")
    )
    fits = possible.join(side(listed), ["host_key", "path_key"])
    rule = F.concat("host_key", "path_key")
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length(rule).alias("n"), F.length("host_key").alias("m"), (F.col("action") == "block").alias("b"), rule.alias("rule"), F.col("action").alias("action"))).alias("best")
    )
    best = stored(best.select("host", "path", "best.rule", F.col("best.action").alias("action")), "url-verdicts")
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP3_SQL = f"""
WITH rules(action, rhost, rpath) AS (VALUES {", ".join(str(r) for r in RULES)}),
p AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
u AS (SELECT DISTINCT host, path FROM q),
f AS (SELECT host, path, rhost || rpath AS rule, action,
             row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, action DESC) AS rk
      FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT q.page_id, q.host, q.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM q LEFT JOIN f ON q.host = f.host AND q.path = f.path AND f.rk = 1
"""
