"""Token shards: little-endian uint32 streams, one row per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_shards(tokens: DataFrame, path: str) -> None:
    """tokens: shard, place, token. A shard's size bounds the group."""

    def pack(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("place").to_numpy(), kind="stable")
        raw = t.column("token").to_numpy().astype("<u4")[order].tobytes()
        return pa.table({"shard": t.column("shard").slice(0, 1).cast(pa.int64()), "tokens": pa.array([raw], pa.binary())})

    tokens.groupBy("shard").applyInArrow(pack, "shard long, tokens binary").write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, place, token."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, raw in zip(b.column("shard").to_pylist(), b.column("tokens"), strict=True):
                ids = np.frombuffer(raw.as_py(), "<u4").astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(ids), shard)), pa.array(np.arange(len(ids))), pa.array(ids)], ["shard", "place", "token"])

    return spark.read.schema("shard long, tokens binary").parquet(path).mapInArrow(unpack, "shard long, place long, token long")


def metrics_with(log: DataFrame, key: str) -> DataFrame:
    """Rows of a metrics log that hold the key."""
    return log.where(F.col(key).isNotNull())
