"""The registered queries, with their production parameters, beside their SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

pytest.importorskip("decisium.llm")
from decisium.llm.queries import ORACLES, QUERIES  # noqa: E402

from . import helpers as H  # noqa: E402

DATA = "/root/testdata/sf0.001"


def compare(spark, name, folder):
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cur = c.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(x)] for x in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr) == want
    return want


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert len(compare(spark, name, DATA)) > 0


@pytest.mark.parametrize("name", sorted(x for x in ORACLES if x[:4] in ("op2_", "op4_", "op5_", "op7_", "op9_")))
def test_odd_texts_equal_sql(spark, tmp_path, name):
    """Nulls, empty texts, other scripts, copies; with columns the queries don't know."""
    rows = H.corpus(21)
    rows += [(2000 + i, t, "en", "s", 0) for i, t in enumerate(["我们在城市的公园里看见了许多不同颜色的花和树\na", "b\n我们在城市的公园里看见了许多不同颜色的花和树", "ภาษาไทยเขียนติดกันโดยไม่มีช่องว่างระหว่างคำในประโยคยาวๆ", "ภาษาไทยเขียนติดกันโดยไม่มีช่องว่างระหว่างคำในประโยคยาวๆ\nx", "x" * 250, "  \n \n" * 9])]
    items = [(i % 7, " ".join((r[1] or "a").split()[i : i + 4 + 3 * i])) for i, r in enumerate(rows[:14])] + [(None, "a b"), (9, None)]
    spark.createDataFrame(rows, H.SCHEMA).selectExpr("*", "1 as h", "2 as rep").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(compare(spark, name, str(tmp_path))) == len(rows)
