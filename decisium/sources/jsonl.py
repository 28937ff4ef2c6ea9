"""Records as JSON lines, partitioned by source and split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.rand import hash32
from ..operators.mixture import first_per_group, running_offset

KNOWN = ["id", "source", "lang", "split", "state", "questions", "labels"]
#: Shards of rotating lines in one folder.
SHARDS = 256


def write_records(rows: DataFrame, path: str) -> int:
    """One JSON object a line, text unescaped, nulls kept; a folder for each
    source and split. Gives the number of records, which the write counts."""
    seen = Observation()
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "_line"]), {"ignoreNullFields": "false"})
    rows.observe(seen, F.count(F.lit(1)).alias("n")).select(F.col("source").alias("_source"), F.col("split").alias("_split"), line.alias("value")).write.partitionBy("_source", "_split").text(path)
    return seen.get["n"]


def write_manifest(counts: DataFrame, path: str) -> None:
    """Counts as JSON lines, one file: a row per source."""
    counts.coalesce(1).write.json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds lines to a log folder; readers see whole files only."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def write_rotating(rows: DataFrame, path: str, each: int, order: str) -> None:
    """JSON lines in shards of `each` rows by `order`, a unique whole number: a
    file a shard, a folder for SHARDS of them. The folders of one task are sorted,
    and the writer goes on to a new file after `each` rows."""
    placed = running_offset(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one")
    lines = placed.select(F.floor(F.col("offset") / (each * SHARDS)).alias("block"), "offset", F.to_json(F.struct(*rows.columns)).alias("value"))
    lines.repartition("block").sortWithinPartitions("block", "offset").select("block", "value").write.option("maxRecordsPerFile", each).partitionBy("block").text(path)


def read_rotating(spark: SparkSession, path: str) -> DataFrame:
    """value and shard of the lines that write_rotating wrote."""
    lines = spark.read.schema("value string, block long").text(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"\.c(\d+)\.", 1).cast("long")
    return lines.select("value", (F.col("block") * SHARDS + number).alias("shard"))


def parse_records(lines: DataFrame, *keep: str) -> DataFrame:
    """Lines (value) to records: blank lines go, a missing split is train, and
    keys that aren't a record's fold into meta over the line's own meta."""
    m = F.from_json("value", "map<string,string>")
    rows = lines.where(F.trim("value") != "").select(m.alias("m"), *keep).where("m is not null")
    own = F.coalesce(F.from_json(F.try_element_at("m", F.lit("meta")), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    extra = F.map_filter("m", lambda k, v: ~k.isin(*KNOWN, "meta"))
    clear = F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(extra), k))
    at = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return rows.select(at("id"), at("source"), at("lang"), F.coalesce(F.try_element_at("m", F.lit("split")), F.lit("train")).alias("split"), at("state"), at("questions"), at("labels"), F.map_concat(clear, extra).alias("meta"), *keep)


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", "true").text(list(paths))
    return parse_records(lines)


def read_globs(spark: SparkSession, globs: list[str], split: str | None = "train", sources: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Records of all files that the globs match. A record without a source has
    the file's name up to its first dot; `sources` picks some, and `limit` keeps
    so many of each, in hash order of their ids."""
    named = spark.read.text(globs).withColumn("_file", F.regexp_extract(F.input_file_name(), r"([^/.]+)[^/]*$", 1))
    rows = parse_records(named, "_file").withColumn("source", F.coalesce("source", "_file")).drop("_file")
    if split is not None:
        rows = rows.where(F.col("split") == split)
    if sources is not None:
        rows = rows.where(F.col("source").isin(sources))
    return first_per_group(rows, "source", limit, hash32("eval", "id"), "id") if limit else rows
