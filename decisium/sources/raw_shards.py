"""Token shards as raw little-endian uint32 files: a sink and a source.

The sink's tasks write files under names of their own beside the final ones and
report them; the commit of the job gives each its final name, shard-00000.bin
and so on, and an aborted job removes what its tasks wrote. So readers see whole
shards only, and a task that is run twice leaves one. The source's partitions
are runs of windows that are read by byte range: a shard's tail shorter than a
window is left out, as training does, or windows run on over file ends
(`across`). Ids from 0 to 2**32 - 1. Paths are those that pyarrow can open."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .scratch import ship

#: Tokens that one partition of the source reads, about.
PARTITION_TOKENS = 1 << 22


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str, int]]  # shard, name, tokens


class ShardWriter(DataSourceArrowWriter):
    """Rows of shard, place and ids, each shard's together and in order."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = fs.FileSystem.from_uri(self.path)
        files.create_dir(folder, recursive=True)
        done: list[tuple[int, str, int]] = []
        out, shard, n = None, None, 0
        for b in iterator:
            for s, ids in zip(b.column("shard").to_pylist(), b.column("ids"), strict=True):
                if s != shard:
                    if out is not None:
                        out.close()
                        done[-1] = (*done[-1][:2], n)
                    shard, n = s, 0
                    done.append((s, f"_part-{s:05d}-{uuid.uuid4().hex}", 0))
                    out = files.open_output_stream(f"{folder}/{done[-1][1]}")
                x = ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int64)
                if len(x) and (x.min() < 0 or x.max() >= 1 << 32):
                    raise ValueError("a token id that isn't a uint32")
                out.write(x.astype("<u4").tobytes())
                n += len(x)
        if out is not None:
            out.close()
            done[-1] = (*done[-1][:2], n)
        return Written(done)

    def commit(self, messages: list) -> None:
        files, folder = fs.FileSystem.from_uri(self.path)
        seen: set[int] = set()
        for m in messages:
            for shard, name, _ in m.files if m else []:
                if shard in seen:
                    raise ValueError(f"shard {shard} was written by two tasks")
                seen.add(shard)
                files.move(f"{folder}/{name}", f"{folder}/shard-{shard:05d}.bin")

    def abort(self, messages: list) -> None:
        files, folder = fs.FileSystem.from_uri(self.path)
        for x in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if x.base_name.startswith("_part-"):
                files.delete_file(x.path)


@dataclass
class Run:
    """Tokens begin..end of a file; its windows are numbered from `window` on."""

    file: int
    name: str
    begin: int
    end: int
    window: int


@dataclass
class Windows(InputPartition):
    runs: list[Run]


def _by_number(name: str) -> list[tuple[int, str]]:
    """Order of names in which shard-99999 comes before shard-100000."""
    return [(int(x), "") if x.isdecimal() else (-1, x) for x in re.split(r"(\d+)", name)]


class ShardReader(DataSourceReader):
    def __init__(self, path: str, seq: int, across: bool):
        self.path, self.seq, self.across = path, seq, across

    def partitions(self) -> Sequence[InputPartition]:
        files, folder = fs.FileSystem.from_uri(self.path)
        found = sorted(((x.base_name, x.path, x.size // 4) for x in files.get_file_info(fs.FileSelector(folder)) if x.base_name.endswith(".bin") and x.base_name[0] != "_"), key=lambda x: _by_number(x[0]))
        each = max(1, PARTITION_TOKENS // self.seq)
        sized = [(name, size) for _, name, size in found]
        return [Windows(x) for x in (self._run_together(sized, each) if self.across else self._apart(sized, each))] or [Windows([])]

    def _apart(self, files: list[tuple[str, int]], each: int) -> Iterator[list[Run]]:
        """`each` windows a partition, of as many files as it takes."""
        runs, left = [], each
        for i, (name, size) in enumerate(files):
            at, n = 0, max(0, (size - 1) // self.seq)
            while at < n:
                to = min(n, at + left)
                runs.append(Run(i, name, at * self.seq, to * self.seq + 1, at))
                left -= to - at
                at = to
                if not left:
                    yield runs
                    runs, left = [], each
        if runs:
            yield runs

    def _run_together(self, files: list[tuple[str, int]], each: int) -> Iterator[list[Run]]:
        n = max(0, (sum(size for _, size in files) - 1) // self.seq)
        i, at = 0, 0  # the file that holds the first token, and the tokens before it
        for first in range(0, n, each):
            begin, end = first * self.seq, min(first + each, n) * self.seq + 1
            while at + files[i][1] <= begin:
                at += files[i][1]
                i += 1
            runs, j, to = [], i, at
            while to < end:
                name, size = files[j]
                if size:
                    runs.append(Run(0, name, max(0, begin - to), min(size, end - to), first))
                to += size
                j += 1
            yield runs

    def read(self, partition: Windows) -> Iterator[pa.RecordBatch]:
        if not partition.runs:
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        if self.across:
            run = partition.runs[0]
            yield self._windows(run.file, run.window, np.concatenate([_tokens(files, r) for r in partition.runs]))
        else:
            for run in partition.runs:
                yield self._windows(run.file, run.window, _tokens(files, run))

    def _windows(self, file: int, first: int, ids: np.ndarray) -> pa.RecordBatch:
        n = (len(ids) - 1) // self.seq
        windows = np.lib.stride_tricks.sliding_window_view(ids, self.seq + 1)[:: self.seq][:n]
        flat = pa.array(windows.astype(np.int64).ravel())
        lists = pa.ListArray.from_arrays(np.arange(0, n * (self.seq + 1) + 1, self.seq + 1, dtype=np.int32), flat)
        return pa.record_batch([pa.array(np.full(n, file, np.int32)), pa.array(np.arange(first, first + n)), lists], ["shard", "window", "ids"])


def _tokens(files: fs.FileSystem, run: Run) -> np.ndarray:
    with files.open_input_file(run.name) as f:
        return np.frombuffer(f.read_at(4 * (run.end - run.begin), 4 * run.begin), "<u4")


class Uint32Shards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "uint32_shards"

    def schema(self) -> str:
        return "shard int, window long, ids array<long>"

    def reader(self, schema) -> ShardReader:  # noqa: ANN001
        return ShardReader(self.options["path"], int(self.options.get("seq", "1024")), self.options.get("across", "false") == "true")

    def writer(self, schema, overwrite: bool) -> ShardWriter:  # noqa: ANN001
        return ShardWriter(self.options["path"])


def write_raw(tokens: DataFrame, path: str) -> None:
    """tokens: shard, place, ids (an array of some of the shard's tokens, from place on)."""
    spark = tokens.sparkSession
    ship(spark)
    spark.dataSource.register(Uint32Shards)
    rows = tokens.select(F.col("shard").cast("int").alias("shard"), F.col("place").cast("long").alias("window"), F.col("ids").cast("array<long>").alias("ids"))
    rows.repartition("shard").sortWithinPartitions("shard", "window").write.format("uint32_shards").mode("append").option("path", path).save()


def read_windows(spark: SparkSession, path: str, seq: int, across: bool = False) -> DataFrame:
    """shard (0 if across), window, ids (seq + 1 each; neighbours share one)."""
    ship(spark)
    spark.dataSource.register(Uint32Shards)
    return spark.read.format("uint32_shards").option("path", path).option("seq", seq).option("across", str(across).lower()).load()
