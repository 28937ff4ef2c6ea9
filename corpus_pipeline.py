"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents.

Texts without a letter go, and those whose predicted language has a posterior
under LEAST_SCORE (of clean documents in the test data none has; short texts in
one of many close languages may). Where nothing could be learned, as no row has
a label, all texts with a letter stay. Rows that repeat a doc_id stay or go each
by its text; rows with a null doc_id are never taken for copies, and are judged
by all other stages like the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decisium.llm import decontaminate, language_id, line_dedup, near_dup, packing
from decisium.llm.common import stored

LEAST_SCORE = 0.5


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id, text and the rest of the row as one column, so that no column of
    docs can clash with one that an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("row"))


def _columns(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs from a table with packed rows, some of them new."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")} | new
    return df.select(*[(own[c] if c in own else F.col("row").getField(c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts whose language is unsure."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    scored = language_id.predict(_whole(docs), model)
    return _columns(scored.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated blocks of lines; documents with no line left go."""
    out = line_dedup.line_dedup(_whole(docs)).where("not (n_removed > 0 and text is null)")
    new = {}
    if "n_chars" in docs.columns:
        old = F.col("row").getField("n_chars")
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(old)
    return _columns(out, docs, **new)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group."""
    gone = near_dup.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(stored(gone, "near-copies"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark passage."""
    found = decontaminate.contamination(_whole(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _columns(found.where(F.size("marks") == 0), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("minhash_near_dup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packed),
]

#: Tokens, hashed n-grams and patience diff aren't SQL; tests hold run() to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
