"""Shared pieces of the training-data operators: scratch tables in the
cluster's shared folder and small helpers around Arrow batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in one Arrow batch sent to Python; long texts make rows large.
BATCH_ROWS = "1024"
_made: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for texts, unless the session says, and
    see that workers can import this package."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)
    _ship(spark)


def _ship(spark: SparkSession) -> None:
    """Send this package to Python workers that can't import it by PYTHONPATH."""
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or any("decisium-" in f for f in sc._python_includes):
        return
    path = Path(tempfile.mkdtemp()) / f"decisium-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "decisium").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset on one machine, as
    in tests, a folder of our own, which is then set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        root = sc.getCheckpointDir()
        if not root:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="decisium-"))
            root = sc.getCheckpointDir()
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when Python ends."""
    if not _made:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/decisium-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; its folder goes with it
            return


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back, which
    cuts lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """A column by its whole name, whatever that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def wrapped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the other columns as one, so that no name of docs can
    clash with those used inside an operator."""
    rest = [quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *rest).alias("row"))


def with_row(base: DataFrame, ddl: str) -> StructType:
    """row of a wrapped table, then the columns of ddl."""
    return StructType([base.schema["row"], *StructType.fromDDL(ddl).fields])


def unwrapped(df: DataFrame, docs: DataFrame, text_col: str, added: list[str]) -> DataFrame:
    """The columns of docs from a table with row and text, and the added ones.
    A column of docs with the name of an added one is named <name>_input."""
    own = []
    for i, c in enumerate(docs.columns):
        name = c
        while name in added or (name != c and name in docs.columns):
            name += "_input"
        own.append((F.col("text") if c == text_col else F.col("row").getField(f"c{i}")).alias(name))
    return df.select(*own, *added)


def task_id() -> int:
    """Number of the partition that this Python worker works on."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their len+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts together hold about `most` bytes; a longer
    text makes a part of its own."""
    _, o = text_buffer(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + most, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)


#: Bits of a Bloom filter that is broadcast: 16 a value, at most 16 MB.
MOST_BITS = 1 << 27


def bloom(hashes: DataFrame, most: int = MOST_BITS) -> Broadcast[np.ndarray]:
    """A Bloom filter, two bits a value, of the one column of `hashes` (64-bit
    hashes), broadcast as words of 64 bits. Spark sets the bits; only the words
    that aren't zero come to the driver, at most most / 64 whatever the rows.
    With more values than it has room for it passes more, and loses none."""
    h, n = F.col(hashes.columns[0]), hashes.count()
    size = min(most, max(1 << 10, 1 << (16 * n).bit_length()))
    places = F.explode(F.array(h.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(h, 27).bitwiseAND(F.lit(size - 1))))
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    words = hashes.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    table = np.zeros(size >> 6, np.uint64)
    table[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(table)


def maybe_in(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of a Bloom filter's table."""
    h, mask = h.astype(np.uint64), np.uint64((len(table) << 6) - 1)
    at = lambda p: (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return at(h & mask) & at((h >> np.uint64(27)) & mask)


def passing(df: DataFrame, h: Column, known: Broadcast[np.ndarray], inside: bool = True) -> DataFrame:
    """The rows whose hash may be in a Bloom filter, or else those whose isn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(maybe_in(known.value, b.column("_hash").to_numpy()) == inside)).drop_columns(["_hash"])

    return df.withColumn("_hash", h).mapInArrow(run, df.schema)
