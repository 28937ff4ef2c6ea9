"""A lazy mixture of text sources: a stream that draws from several sources by
weight until each has given its tokens, and goes on without those that end.

A source is a folder of Parquet files, read in the order of their names; only
the files that the stream has come to are opened. What to read next follows
from a ledger alone, a file a batch that the sink leaves: rows taken and tokens
got of each source. So a batch that is planned again after a failure or a
restart is the same. Batches double their draws, so their number grows with the
logarithm of the rows; a partition is rows of one row group, so that no rows
before them are decoded again and again. Each draw splits DRAW rows by weight among the sources that
are under budget and not at their end, by a seeded multinomial, but no source
gets more rows than its mean tokens a row say it needs. A source's budget is its
weight's share of all tokens; a row goes on as long as the tokens before it are
under the budget, so the last one may go over. A source that ends early keeps
what it has, and its budget is closed at that; the others' budgets stay."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.mixture import _sum_by_range
from .scratch import scratch, ship

#: Rows of one draw, and rows that one partition reads.
DRAW, PARTITION_ROWS = 20_000, 5_000
#: Most times that batches double, and rows of a range in which tokens are summed in order.
DOUBLINGS, RANGE_ROWS = 20, 1 << 15


def read_ledger(path: str) -> tuple[int, dict[str, dict[str, int]]]:
    """The last batch and what it left: rows and tokens by source."""
    files, folder = fs.FileSystem.from_uri(path)
    names = sorted((x.base_name, x.path) for x in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.base_name.startswith("batch-"))
    if not names:
        return -1, {}
    with files.open_input_file(names[-1][1]) as f:
        return int(names[-1][0][6:-5]), json.loads(f.read())


def write_ledger(path: str, batch: int, state: dict) -> None:
    files, folder = fs.FileSystem.from_uri(path)
    files.create_dir(folder, recursive=True)
    with files.open_output_stream(f"{folder}/_new") as f:
        f.write(json.dumps(state).encode())
    files.move(f"{folder}/_new", f"{folder}/batch-{batch:09d}.json")


@dataclass
class Rows(InputPartition):
    source: str
    file: str
    group: int  # row group, from which first and last count
    place: int  # of the first row, in its source
    first: int
    last: int


class MixtureReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.ledger = options["path"], options["ledger"]
        self.weights: dict[str, float] = json.loads(options["weights"])
        self.tokens, self.seed, self.draw = int(options["tokens"]), int(options.get("seed", "0")), int(options.get("draw", str(DRAW)))
        self.files: dict[str, list[str]] = {}
        self.counts: dict[str, list[int]] = {}
        self.groups: dict[str, list[list[int]]] = {}

    def initialOffset(self) -> dict:
        return {k: 0 for k in self.weights}

    def latestOffset(self) -> dict:
        batch, state = read_ledger(self.ledger)
        at = {k: state.get(k, {}).get("rows", 0) for k in self.weights}
        got = {k: state.get(k, {}).get("tokens", 0) for k in self.weights}
        still = [k for k in sorted(self.weights) if got[k] < budget(self.tokens, self.weights[k]) and self._has(k, at[k])]
        if still:
            w = np.array([self.weights[k] for k in still])
            for k, n in zip(still, np.random.default_rng([self.seed, batch + 1]).multinomial(self.draw << min(batch + 1, DOUBLINGS), w / w.sum()).tolist(), strict=True):
                mean = got[k] / at[k] if at[k] else 0
                needs = -(-(budget(self.tokens, self.weights[k]) - got[k]) // mean) if mean else n
                at[k] = self._up_to(k, at[k] + int(max(1, min(n, needs))))
        return at

    def _has(self, source: str, place: int) -> bool:
        return self._up_to(source, place + 1) > place

    def _up_to(self, source: str, place: int) -> int:
        """place, or the source's end if that comes before; opens no file after it."""
        if source not in self.files:
            files, folder = fs.FileSystem.from_uri(f"{self.path}/{source}")
            self.files[source] = sorted(x.path for x in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.base_name.endswith(".parquet"))
            self.counts[source], self.groups[source] = [], []
        files, counts = fs.FileSystem.from_uri(self.path)[0], self.counts[source]
        while sum(counts) < place and len(counts) < len(self.files[source]):
            with files.open_input_file(self.files[source][len(counts)]) as f:
                m = pq.ParquetFile(f).metadata
                counts.append(m.num_rows)
                self.groups[source].append([m.row_group(g).num_rows for g in range(m.num_row_groups)])
        return min(place, sum(counts))

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for k in sorted(self.weights):
            self._up_to(k, end[k])
            at = 0
            for name, groups in zip(self.files[k], self.groups[k], strict=False):
                for g, n in enumerate(groups):
                    lo, hi = max(start[k], at), min(end[k], at + n)
                    out += [Rows(k, name, g, a, a - at, min(a + PARTITION_ROWS, hi) - at) for a in range(lo, hi, PARTITION_ROWS)]
                    at += n
        return out or [Rows("", "", 0, 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.last:
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        at = 0
        with files.open_input_file(partition.file) as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=1024, row_groups=[partition.group], columns=["text"]):
                lo, hi = max(partition.first, at), min(partition.last, at + b.num_rows)
                if lo < hi:
                    place = partition.place + lo - partition.first
                    yield pa.record_batch([pa.array([partition.source] * (hi - lo)), pa.array(np.arange(place, place + hi - lo)), b.column("text").slice(lo - at, hi - lo).cast(pa.string())], ["source", "place", "text"])
                at += b.num_rows
                if at >= partition.last:
                    return


class LazyMixture(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lazy_mixture"

    def schema(self) -> str:
        return "source string, place long, text string"

    def streamReader(self, schema) -> MixtureReader:  # noqa: ANN001
        return MixtureReader(dict(self.options))


def budget(tokens: int, weight: float) -> int:
    return int(tokens * weight)


def draw_mixture(spark: SparkSession, path: str, weights: dict[str, float], tokens: int, n_tokens, out: str, seed: int = 0, draw: int = DRAW, most_batches: int | None = None, home: str | None = None) -> dict[str, dict[str, int]]:  # noqa: ANN001
    """Writes source, place, text, n_tokens of the rows drawn to out, and gives
    rows read and tokens got by source. n_tokens: a column of text. home: folder
    of checkpoint and ledger, to go on after a stop (most_batches stops)."""
    ship(spark)
    spark.dataSource.register(LazyMixture)
    home = home or scratch(spark, "mixture")
    ledger = f"{home}/ledger"
    options = {"path": path, "ledger": ledger, "weights": json.dumps(weights), "tokens": tokens, "seed": seed, "draw": draw}
    limits = F.coalesce(*[F.when(F.col("source") == k, budget(tokens, w)) for k, w in weights.items()])
    done = 0

    def put(batch: DataFrame, number: int) -> None:
        nonlocal done
        last, state = read_ledger(ledger)
        if last >= number:  # it was all written before a failure
            return
        before = F.coalesce(*[F.when(F.col("source") == k, s["tokens"]) for k, s in state.items()], F.lit(0))
        # read once, for the sums by range and for the sums within one
        sized = batch.withColumn("n_tokens", n_tokens.cast("long")).persist(StorageLevel.DISK_ONLY)
        try:
            ranged = sized.withColumn("_b", F.floor(F.col("place") / RANGE_ROWS))
            placed = _sum_by_range(ranged, ["source"], ["place"], "n_tokens", "before").withColumn("before", before + F.col("before"))
            placed.withColumn("kept", F.col("before") < limits).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            sized.unpersist()
        seen = spark.read.parquet(f"{out}/batch={number}").groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.when(F.col("kept"), F.col("n_tokens"))).alias("tokens"))
        new = {k: dict(v) for k, v in state.items()}
        for r in seen.collect():  # a row a source
            s = new.setdefault(r["source"], {"rows": 0, "tokens": 0})
            new[r["source"]] = {"rows": s["rows"] + r["rows"], "tokens": s["tokens"] + (r["tokens"] or 0)}
        write_ledger(ledger, number, new)
        done += 1
        if most_batches is not None and done >= most_batches:
            raise StopDrawing

    q = spark.readStream.format("lazy_mixture").options(**options).load().writeStream.foreachBatch(put).option("checkpointLocation", f"{home}/checkpoint").start()
    try:
        q.processAllAvailable()
    except Exception as e:
        if "StopDrawing" not in str(e):
            raise
    finally:
        q.stop()
    return read_ledger(ledger)[1]


class StopDrawing(Exception):
    """Ends a stream after a number of batches."""
