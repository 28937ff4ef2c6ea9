"""The pipeline beside its stages in plain Python."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

pytest.importorskip("decisium.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from . import helpers as H  # noqa: E402


def brute(rows, items):
    """doc_id and text of what is packed."""
    lang = H.languages(rows)
    rows = [r for r in rows if lang[r[0]][0] != "und" and lang[r[0]][1] >= pipeline.LEAST_SCORE]
    left = H.deduped_lines(rows)
    rows = [(r[0], left[r[0]][1], *r[2:]) for r in rows if not (left[r[0]][0] and left[r[0]][1] is None)]
    near = H.near(rows, 5)
    rows = [r for r in rows if near[r[0]][2]]
    bad = H.contaminated(rows, items)
    return [r for r in rows if not bad[r[0]][4]]


@pytest.mark.parametrize("seed", [11, 12])
def test_run_equals_brute_force(spark, tmp_path, seed):
    rows = H.corpus(seed)
    items = [(1, " ".join((rows[5][1] or "a").split()[:12])), (2, "nothing of this kind"), (3, None)]
    spark.createDataFrame(rows, H.SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(rows, items)
    assert 20 < len(want) < len(rows)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    pieces, counts = {}, {}
    for d, text, *_ in want:
        ids, at, k = [*t.encode(text or "", add_special_tokens=False).ids, 2], 0, 0
        while at < len(ids):
            n = 1024 if k else (len(ids) - 1) % 1024 + 1
            pieces[d, k] = (at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))
            counts[n] = counts.get(n, 0) + 1
            at, k = at + n, k + 1
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == pieces
    fill: dict = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert sorted(fill.values()) == H.best_fit(counts, 1024)


def test_odd_rows(spark, tmp_path):
    """Without a label all texts with a letter stay; null ids and repeated rows are kept; long texts pass whole."""
    say = lambda x, n: " ".join(f"{x}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i // 676}" for i in range(n))
    rows = [(None, say("a", 30), None, "s", 0), (None, say("a", 30), None, "s", 0), (1, say("b", 30), None, "s", 0), (1, say("b", 30), None, "s", 0), (2, "1 2 3", None, "s", 0), (3, say("c", 90_000), None, "s", 0), (4, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, H.SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r["doc_id"], r["piece"]) for r in pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(d or 0 for d, k in got if k == 0) == [0, 0, 1, 1, 3] and sum(d == 3 for d, _ in got) > 90


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(H.corpus(13), H.SCHEMA).selectExpr("*", "1 as score", "2 as marks", "3 as sig")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
