"""File streams of requests: answers appended, counters kept.

Requests of any form are lines of JSON: id, state (text or JSON), questions by
id, and optionally model, permutations and order_invariant. Each has one answer
per question or one error, however often it is sent: repeats of an id (of the
same line, where there is no id) within `window` of arrival are dropped by the
state store, and each micro-batch overwrites its own folder, so that one that
is run again after a failure leaves no second copy. Requests that can't be
answered go to a dead-letter table with the reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators import records as R
from ..sources.scratch import scratch

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """A bounded number of new files per trigger holds the producer back."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(path if name and _is_folder(spark, path) else f"{folder}/{name}*")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _drain(writer) -> None:  # noqa: ANN001
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def answers(spark: SparkSession, path: str) -> DataFrame:
    out = scratch(spark, "answers")
    rows = stream(spark, path).where("value >= 0").select("event_id", (F.col("event_type") == "purchase").alias("answer"), F.round(F.col("value") / (1 + F.col("value")), 6).alias("confidence"))
    _drain(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "stream")))
    return spark.read.schema(rows.schema).parquet(out)


def funnel(spark: SparkSession, path: str) -> DataFrame:
    """Counters by status; each batch rewrites the small result table."""
    status = F.when(F.col("event_type") == "error", "invalid").when(F.col("value") < 10, "disagree").otherwise("ok")
    rows = stream(spark, path).groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    out = scratch(spark, "funnel")
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        last.append(f"{out}/{number}")

    _drain(rows.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(spark, "stream")))
    return spark.read.schema("status string, n long").parquet(last[-1])


ANSWERS = "request_id string, qid string, model string, qtype string, answer string, confidence double, orders int"
ERRORS = "request_id string, error string, line string"


def parsed_requests(lines: DataFrame) -> DataFrame:
    """request_id, state, model, orders (null: automatic), qs (questions as
    parsed) and error (null if the request is valid) of lines of JSON (value)."""
    m = F.from_json("value", "map<string,string>")
    rows = lines.withColumn("m", m)
    at = lambda k: F.try_element_at("m", F.lit(k))
    asked = at("permutations").try_cast("int")
    rows = rows.select(
        "*",
        F.coalesce(at("id"), F.md5("value")).alias("request_id"),
        at("state").alias("state"),
        at("model").alias("model"),
        D.requested_orders(asked, at("order_invariant").try_cast("boolean")).alias("orders"),
        R.parsed_questions(at("questions")).alias("qs"),
    )
    bad = F.element_at(F.filter("qs", lambda x: x["q"]["error"].isNotNull()), 1)
    error = (
        F.when(F.col("m").isNull(), "not an object").when(F.col("state").isNull(), "no state").when(F.coalesce(F.size("qs"), F.lit(0)) < 1, "no question")
        .when(F.exists("qs", lambda x: x["q"]["error"].isNotNull()), F.concat(bad["qid"], F.lit(": "), bad["q"]["error"]))
        .when(at("permutations").isNotNull() & ~F.coalesce(asked.between(1, 32), F.lit(False)), "permutations must be 1 to 32")
    )
    return rows.withColumn("error", error).drop("m")


def answered(requests: DataFrame, scorer: Callable[[DataFrame], DataFrame], temperatures: dict[str, float]) -> DataFrame:
    """ANSWERS of valid requests, a row a question. scorer: adds logits and
    abstain_logit to rows of key, state and options."""
    rows = requests.select("request_id", "state", "model", "orders", "qs", F.explode("qs").alias("x"))
    most = F.array_max(F.transform(F.filter("qs", lambda x: x["q"]["qtype"] == "choice"), lambda x: F.size(x["q"]["options"])))
    rows = rows.select("request_id", "state", F.coalesce("model", F.lit("decisium")).alias("model"), D.order_count(F.array(F.coalesce(most, F.lit(1))), F.col("orders")).cast("int").alias("orders"), F.col("x.qid").alias("qid"), F.col("x.q.qtype").alias("qtype"), F.col("x.q.options").alias("options"))
    rows = rows.withColumn("key", F.concat_ws("\n", "request_id", "qid"))
    t = F.coalesce(*[F.when(F.col("qtype") == k, F.lit(v)) for k, v in temperatures.items()], F.lit(1.0))
    d = D.scored(rows, scorer, t)
    best = D.best_slot(F.col("pk"))
    answer = F.when(F.col("qtype") == "score", F.round(D.expected_level(F.col("pk")), 6).cast("string")).otherwise(F.element_at(F.transform("options", lambda o: o["name"]), best + 1))
    return d.select("request_id", "qid", "model", "qtype", answer.alias("answer"), D.confidence(F.col("pk")).alias("confidence"), "orders")


def serve(spark: SparkSession, inbox: str, out: str, checkpoint: str, scorer: Callable[[DataFrame], DataFrame], temperatures: dict[str, float], window: str = "1 hour", files: int = 64) -> None:
    """Answers all requests that have arrived in inbox (text files of lines)
    since the checkpoint; out/answers and out/errors get a folder a batch.
    Repeats are told by the time of arrival, so none comes too late."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files).load(inbox).select("value", F.col("_metadata.file_modification_time").alias("arrived"))
    once = parsed_requests(lines.where(F.trim("value") != "")).withWatermark("arrived", window).dropDuplicatesWithinWatermark(["request_id"])

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            good = answered(batch.where("error is null"), scorer, temperatures)
            good.write.mode("overwrite").parquet(f"{out}/answers/batch={number}")
            batch.where("error is not null").select("request_id", "error", F.col("value").alias("line")).write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
        finally:
            batch.unpersist()

    _drain(once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint))
