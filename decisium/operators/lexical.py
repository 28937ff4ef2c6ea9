"""A scorer that works without a model: BM25 of a state's words for each option.

An inverted index holds the words of all distinct option sets, a row for each
word of an option; requests that share their options share it. States' words
meet it by word, so only words that some option has go on, and their counts are
added up by request. The index is broadcast while it has INDEX_ROWS rows at
most; a larger one is joined by shuffle. Document frequencies are those of the
states given, unless `frequencies` brings others.

Words are runs of letters and digits in lower case. A null state has no words;
an option without words, or none of whose words occur, has a logit of 0, as has
abstain, so that a state that fits nothing leaves all open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
INDEX_ROWS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def option_index(requests: DataFrame, options: str) -> DataFrame:
    """set, slot, term: the distinct words of each option of each distinct set."""
    sets = requests.select(F.md5(F.to_json(options)).alias("set"), options).dropDuplicates(["set"])
    slots = sets.select("set", F.posexplode(options).alias("slot", "o"))
    return slots.select("set", "slot", F.explode(F.array_distinct(words(F.concat_ws(" ", "o.name", "o.desc")))).alias("term"))


def lexical_logits(requests: DataFrame, key: str = "request_id", state: str = "state", options: str = "options", frequencies: DataFrame | None = None, flat: bool = False, scale: float = 1.0) -> DataFrame:
    """requests with logits (by option) and abstain_logit. key: unique.

    frequencies: term, df and n_states of another corpus; flat: all words count
    alike, so that a request's logits depend on it alone."""
    rows = requests.select(F.col(key).alias("_key"), F.md5(F.to_json(options)).alias("set"), words(F.col(state)).alias("_words"))
    index = option_index(requests, options)
    small = index.limit(INDEX_ROWS + 1).count() <= INDEX_ROWS
    side = F.broadcast if small else (lambda df: df)
    told = rows.select("_key", "set", F.size("_words").alias("_n"), F.explode("_words").alias("term"))
    found = told.join(side(index.select("term").distinct()), "term", "left_semi").groupBy("_key", "set", "term", "_n").agg(F.count("*").alias("tf"))
    if flat:
        weighed = found.withColumn("idf", F.lit(1.0)).withColumn("_long", F.lit(1.0))
    else:
        size = rows.agg(F.count("*").alias("n_states"), F.avg(F.size("_words")).alias("_mean"))  # one row
        if frequencies is None:
            counts = found.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size.select("n_states")))
        else:
            counts = frequencies
        idf = F.log(1 + (F.col("n_states") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = found.join(counts.select("term", idf.alias("idf")), "term").crossJoin(F.broadcast(size.select("_mean"))).withColumn("_long", F.col("_n") / F.col("_mean"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("_long")))
    scores = weighed.join(side(index), ["set", "term"]).groupBy("_key", "slot").agg((F.sum(part) * scale).alias("s"))
    by_slot = scores.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "s"))).alias("_scores"))  # at most 255 each
    got = requests.join(by_slot, F.col(key) == F.col("_key"), "left")
    logits = F.transform(options, lambda _, j: F.coalesce(F.try_element_at("_scores", j), F.lit(0.0)))
    return got.withColumn("logits", logits).withColumn("abstain_logit", F.lit(0.0)).drop("_key", "_scores")
