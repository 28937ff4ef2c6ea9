"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Texts are reduced to lower-case letters (with the marks of scripts that need
them) and single blanks between words; the n-grams are runs of 1 to 3 characters
of that form, hashed into BUCKETS. Counting covers every labelled training text.
The log-probabilities are a matrix of languages by buckets. It is fitted and
broadcast in blocks of LANGS languages, so each is of bounded size, and texts
pass all blocks in turn: every label is learned, however many there are. A batch
is scored in numpy by looking up its n-grams and adding by document.

lang_pred has the greatest posterior; ties go to the first label by name. score
is its posterior after the log-likelihoods of all languages are scaled to at
most SCORE_GRAMS n-grams, as those of a text aren't independent. A null text, or
one without a letter, is `und` with score 0. Without training rows every text is
`und`. Repeated rows count each; a row with a null id is never held out; long
texts count whole. An input column with the name of an added one comes back as
<name>_input."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import forget
from .common import prepare, quoted, slices, stored, text_buffer, unwrapped, with_row, wrapped
from .words import mix

BUCKETS, ORDERS, LANGS, SCORE_GRAMS = 1 << 15, (1, 2, 3), 64, 200.0
TEXT_BYTES = 200_000
_SHIFT, _PLANE = np.uint64(64 - 15), 1 << 16
_tables: list[np.ndarray] = []


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _folded(c: str) -> int:
    """A letter's or mark's lower case, a blank for all else."""
    return ord(c.lower()[0]) if c.isalpha() or unicodedata.category(c)[0] == "M" else 0x20


def _fold(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters, and which are letters."""
    if not _tables:
        chars = [chr(i) for i in range(_PLANE)]
        _tables.extend([np.array([_folded(c) for c in chars], np.uint32), np.array([c.isalpha() for c in chars], bool)])
    low = np.minimum(code, _PLANE - 1)
    out, letter = _tables[0][low], _tables[1][low]
    high = np.flatnonzero(code >= _PLANE)
    if len(high):
        one, back = np.unique(code[high], return_inverse=True)
        out[high] = np.array([_folded(chr(i)) for i in one], np.uint32)[back]
        letter[high] = np.array([chr(i).isalpha() for i in one], bool)[back]
    return out, letter


def buckets(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Buckets of all n-grams of the texts, by order, with their documents'
    offsets; and which texts have a letter."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    folded, letter = _fold(code)
    letters = np.concatenate([[0], np.cumsum(letter)])[offsets]
    # a blank before each text, and after the last: no n-gram of letters crosses texts
    doc = np.full(len(code) + n + 1, 0x20, np.uint64)
    keep = np.ones(len(doc), bool)
    begins = offsets + np.arange(n + 1)
    keep[begins] = False
    doc[keep] = folded
    blank = doc == 0x20
    drop = np.zeros(len(doc), bool)
    drop[1:] = blank[1:] & blank[:-1]
    drop[begins] = False
    at = np.cumsum(~drop) - 1
    doc, begins = doc[~drop], at[begins]
    blank = doc == 0x20
    h, grams, owners = np.zeros(len(doc), np.uint64), [], []
    for k in ORDERS:
        m = len(doc) - k + 1
        if m <= 0:
            break
        h = (h[:m] << np.uint64(21)) | doc[k - 1 : k - 1 + m]
        ok = ~(blank[:m] & blank[k - 1 : k - 1 + m])
        for j in range(1, k - 1):  # blanks only as the first or the last character
            ok &= ~blank[j : j + m]
        where = np.flatnonzero(ok)
        grams.append((mix(h[where]) >> _SHIFT).astype(np.int32))
        owners.append(np.searchsorted(where, begins))
    return grams, owners, np.diff(letters) > 0


def counts(rows: DataFrame) -> DataFrame:
    """lang, bucket, n over all labelled texts: summed by task, then by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                langs = b.column("lang").to_pylist()
                names = sorted(set(langs))
                if total and len(total) + len(names) > 2 * LANGS:
                    yield from flush(total)
                    total = {}
                which = np.array([names.index(x) for x in langs])
                grams, owners, _ = buckets(b.column("text"))
                for k, name in enumerate(names):
                    mine = which == k
                    got = np.zeros(BUCKETS, np.int64)
                    for g, o in zip(grams, owners, strict=True):
                        got += np.bincount(g[o[0] : o[-1]][np.repeat(mine, np.diff(o))], minlength=BUCKETS)
                    total[name] = total[name] + got if name in total else got
        yield from flush(total)

    def flush(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Block:
    """Log-probabilities of some languages."""

    langs: list[str]
    logp: np.ndarray
    prior: np.ndarray


@dataclass
class Model:
    """Labels by name with their texts' number, and their n-gram counts as a table."""

    langs: list[str]
    texts: list[int]
    grams: DataFrame | None

    def blocks(self) -> Iterator[Block]:
        """One block after the other, so that the driver holds one at a time."""
        for i in range(0, len(self.langs), LANGS):
            names = self.langs[i : i + LANGS]
            got = self.grams.where(F.col("lang").isin(names)).toPandas()
            n = np.full((len(names), BUCKETS), 0.5)
            n[got["lang"].map({x: k for k, x in enumerate(names)}).to_numpy(np.int64), got["bucket"].to_numpy(np.int64)] += got["n"].to_numpy()
            prior = np.log(np.array(self.texts[i : i + LANGS], float) / sum(self.texts))
            yield Block(names, np.log(n / n.sum(1, keepdims=True)).astype(np.float32), prior)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from text and label of rows that aren't held out."""
    prepare(docs.sparkSession)
    train = docs.where(~held_out(quoted(id_col)) & quoted(text_col).isNotNull() & quoted(lang_col).isNotNull()).select(quoted(text_col).alias("text"), quoted(lang_col).alias("lang"))
    texts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per label
    langs = sorted(texts)
    return Model(langs, [texts[x] for x in langs], stored(counts(train), "gram-counts") if langs else None)


STATE = "lang_pred string, total double, scaled double, most double, mass double"


def _pass(shared, base: DataFrame):  # noqa: ANN001, ANN202
    """Scores texts by a block's languages. total: the best language's log
    posterior; scaled: its scaled one; most, mass: the greatest scaled one so
    far and the sum of all over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m: Block = shared.value
        for batch in batches:
            for b in slices(batch, "text", TEXT_BYTES):
                n = b.num_rows
                grams, owners, ok = buckets(b.column("text"))
                like, size = np.zeros((n, len(m.langs))), np.zeros(n)
                for g, o in zip(grams, owners, strict=True):
                    size += np.diff(o)
                    for k in range(len(m.langs)):
                        s = np.concatenate([[0.0], np.cumsum(m.logp[k][g], dtype=np.float64)])
                        like[:, k] += s[o[1:]] - s[o[:-1]]
                post = like + m.prior
                low = like * np.minimum(1, SCORE_GRAMS / np.maximum(size, 1))[:, None] + m.prior
                best, rows = post.argmax(1), np.arange(n)
                total, scaled, most, mass = (b.column(c).to_numpy(zero_copy_only=False) for c in ("total", "scaled", "most", "mass"))
                better = ok & (post[rows, best] > total)
                names = np.where(better, np.array(m.langs, object)[best], np.array(b.column("lang_pred").to_pylist(), object))
                top = np.maximum(most, low.max(1))
                mass = mass * np.exp(most - top) + np.exp(low - top[:, None]).sum(1)
                yield pa.record_batch(
                    [b.column("row"), b.column("text"), pa.array(names, pa.string()), pa.array(np.where(better, post[rows, best], total)), pa.array(np.where(better, low[rows, best], scaled)), pa.array(top), pa.array(mass)],
                    ["row", "text", "lang_pred", "total", "scaled", "most", "mass"],
                )

    return run, with_row(base, f"text string, {STATE}")


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with lang_pred and score; a text alone decides them."""
    spark = docs.sparkSession
    prepare(spark)
    base = wrapped(docs, id_col, text_col)
    least = "cast(-1e300 as double)"
    out = base.selectExpr("row", "text", "'und' lang_pred", f"{least} total", "0d scaled", f"{least} most", "0d mass")
    for block in model.blocks():
        out = out.mapInArrow(*_pass(spark.sparkContext.broadcast(block), base))
    score = F.when(F.col("total") > -1e300, F.exp(F.col("scaled") - F.col("most")) / F.col("mass")).otherwise(F.lit(0.0))
    return unwrapped(out.select("row", "text", "lang_pred", score.alias("score")), docs, text_col, ["lang_pred", "score"])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
