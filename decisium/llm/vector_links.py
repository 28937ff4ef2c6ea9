"""Embedding near-duplicates by product quantisation with inverted lists.

Vectors are normalised in double precision; equal ones are one class. Coarse
centroids and residual codebooks are fitted on a bounded sample (SAMPLE classes
of least hash); every class is then indexed under its nearest centroid with one
byte for each of SUBSPACES parts of its residual, and probes its PROBES nearest
lists, less those that no link can reach (angle to the centroid over the list's
radius by more than the linking angle).

In a list, distances come from lookup tables of the query against the codes.
By Cauchy-Schwarz a table distance is wrong by at most the norm of the member's
coding error, which is kept, so a member is set aside only if even that error
can't bring it to the threshold. All others are reranked by exact cosine in
double precision, so links found are right; links can be missed only where
neither vector probes the other's list (recall is measured in the tests, with
some 20 times as many lists as probes). Above LIST_SIZE * MOST_LISTS classes the
lists grow longer, and work with them.

Long lists are cut into blocks of members and their queries into blocks too, so
a task's group is bounded. Within it links are counted and thinned to a
spanning forest: pairs are never emitted.

Vectors that are null, zero or hold null or non-finite components link with
nothing; neither do vectors of different lengths with each other. Repeated rows
count each; ties at the threshold link. A null vec_id is kept and linked with
nothing. Other columns of the input aren't read. Vectors of each length are
indexed apart, a job each. An empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, stored
from .components import Forest, components

SAMPLE, LIST_SIZE, MOST_LISTS, PROBES, SUBSPACES = 20_000, 256, 4096, 24, 8
MEMBER_BLOCK, QUERY_BLOCK, CHUNK = 2048, 8192, 256


@dataclass
class Codes:
    coarse: np.ndarray
    books: np.ndarray
    cuts: np.ndarray

    def lists(self, x: np.ndarray) -> np.ndarray:
        """Cosines with the centroids."""
        return x @ self.coarse.T

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the norm of what they leave out."""
        r = x - self.coarse[cell]
        code = np.empty((len(x), len(self.books)), np.uint8)
        left = np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = r[:, self.cuts[m] : self.cuts[m + 1]]
            b = book[:, : part.shape[1]]
            d = (b**2).sum(1) - 2 * part @ b.T
            code[:, m] = d.argmin(1)
            left += np.maximum(0, d.min(1) + (part**2).sum(1))
        return code, np.sqrt(left)


def _kmeans(x: np.ndarray, k: int, seed: int, spherical: bool, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T * 2 - (c**2).sum(1)).argmax(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = count == 0
        c = total / np.maximum(count, 1)[:, None]
        c[empty] = x[rng.choice(len(x), int(empty.sum()))]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return c


def train(sample: np.ndarray, n: int) -> Codes:
    """Fit on normalised rows of the sample, for an index of n classes."""
    dim, k = sample.shape[1], max(1, min(MOST_LISTS, n // LIST_SIZE, len(sample)))
    coarse = _kmeans(sample, k, 1, True)
    r = sample - coarse[(sample @ coarse.T).argmax(1)]
    parts = min(SUBSPACES, dim)
    cuts = np.linspace(0, dim, parts + 1).astype(int)
    size = min(256, len(sample))
    books = np.zeros((parts, size, int(np.diff(cuts).max())))
    for m in range(parts):
        books[m, :, : cuts[m + 1] - cuts[m]] = _kmeans(np.ascontiguousarray(r[:, cuts[m] : cuts[m + 1]]), size, 2 + m, False)
    return Codes(coarse, books, cuts)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vec_id with the key of its vector (null if it can't link), and per key
    the least vec_id, the number of rows, the length and the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for x in b.column("embedding").to_pylist():
                key = None
                if x and None not in x:
                    v = np.array(x, np.float64) + 0.0
                    if np.isfinite(v).all() and np.any(v):
                        key = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
                keys.append(key)
            yield pa.record_batch([b.column("vec_id"), pa.array(keys, pa.binary()), b.column("embedding")], ["vec_id", "key", "embedding"])

    keyed = rows.mapInArrow(run, "vec_id long, key binary, embedding array<double>").withColumn("key", F.when(F.col("vec_id").isNotNull(), F.col("key")))
    one = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("rows"), F.first("embedding").alias("v"))
    keys = stored(keyed.select("vec_id", "key"), "vector-keys")
    return keys, stored(one.withColumn("dim", F.size("v")), "vector-classes")


MEMBER = "rep long, rows long, cell int, code binary, error double, probes array<int>, v array<double>"


def _index(one: DataFrame, codes, radius, dim: int, angle: float):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codes.value
        far = radius.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                s = b.slice(i, 1024)
                x = _unit(_matrix(s.column("v"), dim))
                score = c.lists(x)
                cell = score.argmax(1)
                code, error = c.encode(x, cell)
                k = min(PROBES, score.shape[1])
                probes = np.argsort(-score, axis=1, kind="stable")[:, :k]
                turn = np.arccos(np.clip(np.take_along_axis(score, probes, 1), -1, 1))
                ok = turn <= far[probes] + angle + 1e-6 if far is not None else np.ones_like(turn, bool)
                ok[:, 0] = True
                yield pa.record_batch(
                    [s.column("rep"), s.column("rows"), pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(error), pa.array([p[q].astype(np.int32) for p, q in zip(probes, ok, strict=True)], pa.list_(pa.int32())), s.column("v")],
                    ["rep", "rows", "cell", "code", "error", "probes", "v"],
                )

    return one.mapInArrow(run, MEMBER)


def _radius(one: DataFrame, codes, dim: int, n: int) -> np.ndarray:  # noqa: ANN001
    """Largest angle of each list's members to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.full(n, -1.0)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                score = codes.value.lists(_unit(_matrix(b.column("v").slice(i, 1024), dim)))
                np.maximum.at(far, score.argmax(1), np.arccos(np.clip(score.max(1), -1, 1)))
        at = np.flatnonzero(far >= 0)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(far[at])], ["cell", "far"])

    got = one.select("v").mapInArrow(run, "cell int, far double").groupBy("cell").agg(F.max("far").alias("far")).collect()
    out = np.full(n, -10.0)  # a list without members is out of reach
    for r in got:
        out[r["cell"]] = r["far"]
    return out


def _search(codes, dim: int, least: float):  # noqa: ANN001, ANN202
    def run(key: tuple, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(queries):
            return pd.DataFrame({"kind": [], "a": [], "b": []}).astype("int64")
        c, cell = codes.value, int(key[0])
        mv, qv = np.array(members["v"].tolist()), np.array(queries["q_v"].tolist())
        mu, qu = _unit(mv), _unit(qv)
        code = np.frombuffer(b"".join(members["code"]), np.uint8).reshape(len(members), -1)
        error, m_rep, q_rep = members["error"].to_numpy(), members["rep"].to_numpy(), queries["q_rep"].to_numpy()
        m_rows, q_rows = members["rows"].to_numpy(), queries["q_rows"].to_numpy()
        lists, home = len(c.coarse), queries["home"].to_numpy().astype(np.int64)
        asked = np.sort(np.repeat(np.arange(len(members)) * lists, [len(p) for p in members["probes"]]) + np.concatenate(members["probes"].tolist()))
        ids, back = np.unique(np.concatenate([q_rep, m_rep]), return_inverse=True)
        forest = Forest(len(ids))
        n_q, n_m = np.zeros(len(queries), np.int64), np.zeros(len(members), np.int64)
        for i in range(0, len(queries), CHUNK):
            q = qu[i : i + CHUNK]
            near = np.repeat((q @ c.coarse[cell])[:, None], len(members), 1)
            for m in range(len(c.books)):
                part = slice(c.cuts[m], c.cuts[m + 1])
                near += (q[:, part] @ c.books[m][:, : c.cuts[m + 1] - c.cuts[m]].T)[:, code[:, m]]
            x, y = np.nonzero(near + error >= least - 1e-9)
            for s in range(0, len(x), 1 << 16):
                xs, ys = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
                cos = np.einsum("ij,ij->i", qu[i + xs], mu[ys])
                ok = (cos >= least) & (q_rep[i + xs] != m_rep[ys])
                xs, ys = i + xs[ok], ys[ok]
                np.add.at(n_q, xs, m_rows[ys])
                # a member that asks the query's list counts the link there
                back_asked = ys * lists + home[xs]
                own = asked[np.minimum(np.searchsorted(asked, back_asked), len(asked) - 1)] != back_asked
                np.add.at(n_m, ys[own], q_rows[xs[own]])
                forest.join(back[xs], back[len(queries) + ys])
        tied = np.flatnonzero(forest.label != np.arange(len(ids)))
        a, b = np.concatenate([q_rep, m_rep]), np.concatenate([n_q, n_m])
        have = b > 0
        return pd.DataFrame(
            {"kind": np.repeat([0, 1], [int(have.sum()), len(tied)]), "a": np.concatenate([a[have], ids[tied]]), "b": np.concatenate([b[have], ids[forest.label[tied]]])}
        ).astype("int64")

    return run


def links(one: DataFrame, dim: int, n: int, least: float) -> DataFrame:
    """kind 0: a has b further linked rows; kind 1: a and b are joined by links."""
    spark = one.sparkSession
    sample = np.array([r["v"] for r in one.orderBy(F.xxhash64("rep"), "rep").select("v").limit(SAMPLE).collect()], np.float64)
    model = train(_unit(sample), n)
    codes = spark.sparkContext.broadcast(model)
    lists = len(model.coarse)
    radius = spark.sparkContext.broadcast(_radius(one, codes, dim, lists))
    index = stored(_index(one.select("rep", "rows", "v"), codes, radius, dim, float(np.arccos(least))), "vector-index")
    # at most MOST_LISTS rows each
    size = index.groupBy("cell").agg(F.ceil(F.count("*") / MEMBER_BLOCK).cast("int").alias("m_blocks"))
    asked = index.select(F.explode("probes").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("q_blocks"))
    blocks = F.broadcast(stored(size.join(asked, "cell"), "blocks"))
    salt = lambda name: F.pmod(F.xxhash64("rep"), F.col(name)).cast("int")
    members = index.join(blocks, "cell").withColumn("mb", salt("m_blocks")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))).select("cell", "mb", "qb", "rep", "rows", "code", "error", "probes", "v")
    queries = index.select("rep", "rows", "v", F.col("cell").alias("home"), F.explode("probes").alias("cell")).join(blocks, "cell").withColumn("qb", salt("q_blocks")).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)))
    queries = queries.select(F.col("cell").alias("q_cell"), F.col("mb").alias("q_mb"), F.col("qb").alias("q_qb"), F.col("rep").alias("q_rep"), F.col("rows").alias("q_rows"), F.col("v").alias("q_v"), "home")
    return members.groupBy("cell", "mb", "qb").cogroup(queries.groupBy("q_cell", "q_mb", "q_qb")).applyInPandas(_search(codes, dim, least), "kind long, a long, b long")


def linked_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    keys, one = classes(rows)
    found = None
    for r in sorted(one.groupBy("dim").count().collect()):  # a row per vector length
        got = stored(links(one.where(F.col("dim") == r["dim"]), r["dim"], r["count"], least), "vector-links")
        found = got if found is None else found.union(got)
    if found is None:
        return keys.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    more = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("more"))
    label = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "rep")
    named = stored(one.select("key", "rep", "rows").join(more, "rep", "left").join(label, "rep", "left").select("key", (F.col("rows") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "vector-named")
    out = keys.join(named, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op10_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
