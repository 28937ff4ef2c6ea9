"""Line dedup against all earlier documents, held to a comparison of all runs."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("decisium.llm")
from decisium.llm import line_dedup  # noqa: E402

from . import helpers as H  # noqa: E402


def all_pairs(rows: list[tuple]) -> dict:
    return {d: n for d, (n, _) in H.deduped_lines(rows).items()}


def removed(spark, rows):
    df = line_dedup.line_dedup(spark.createDataFrame(rows, H.SCHEMA))
    return {r["doc_id"]: r["n_removed"] for r in df.collect()}


def rows_of(texts):
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


def line(name: str, k: int = 12) -> str:
    return " ".join(f"{name}{i}" for i in range(k))


def others(n: int) -> list[str]:
    return [line(f"other{i}x") for i in range(n)]


def test_further_holders(spark):
    p, q, short = line("p"), line("q"), [line(x, 6) for x in "abc"]
    rows = rows_of([*short, f"{p}\n{q}", p, f"{q}\n{p}", "\n".join(short) + "\n" + line("t"), line("u") + "\n" + "\n".join(short), *others(12)])
    want = all_pairs(rows)
    assert (want[5], want[7]) == (2, 3)
    assert removed(spark, rows) == want


def test_many_holders(spark):
    """The block that a document has in another order is in one late holder only."""
    p, q = line("p"), line("q")
    texts = [f"{p}\n{q}\n{line(f'm{i}x')}" for i in range(20)] + [f"{p}\n{line('end')}", f"{q}\n{p}", *others(60)]
    rows = rows_of(texts)
    want = all_pairs(rows)
    assert want[21] == 2
    assert removed(spark, rows) == want


@pytest.mark.parametrize("seed", [6, 7, 11])
def test_corpus_equals_all_pairs(spark, seed):
    rows = H.corpus(seed)
    assert removed(spark, rows) == all_pairs(rows)


def test_runs_cover_blocks():
    """Each line of a shared block is in a key that both sides have."""
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 12)
        h, w = np.array([rng.randrange(5) for _ in range(n)], np.int64), np.array([rng.choice([0, 1, 3, 4, 7, 12]) for _ in range(n)], np.int32)
        i = rng.randrange(n)
        j = rng.randrange(i, n) + 1
        both = np.concatenate([h, h[i:j]]), np.concatenate([w, w[i:j]])
        key, doc, s, e = line_dedup.runs(*both, np.array([0, n, n + j - i]), 10)
        assert all(both[1][a:b].sum() >= 10 for a, b in zip(s, e, strict=True))
        assert set(key[doc == 1].tolist()) <= set(key[doc == 0].tolist())
        covered = {k for a, b, d in zip(s, e, doc, strict=True) if d == 1 for k in range(a, b)}
        if w[i:j].sum() >= 10:
            assert covered == set(range(n, n + j - i))


def test_blocks_of_short_lines(spark):
    menu = "\n".join(line(f"dish{i}x", 3) for i in range(10))
    rows = rows_of([line("a") + "\n" + menu, line("b") + "\n" + menu, *others(6)])
    want = all_pairs(rows)
    assert want[1] == 10
    assert removed(spark, rows) == want


def test_texts_without_blanks(spark):
    same = {"zh": "我们在城市的公园里看见了许多不同颜色的花和树", "th": "ภาษาไทยเขียนติดกันโดยไม่มีช่องว่างระหว่างคำในประโยคยาวๆ", "few": "花和树"}
    rows = rows_of([x for k, t in same.items() for x in (line(f"{k}a") + "\n" + t, line(f"{k}b") + "\n" + t)] + others(8))
    assert {d: n for d, n in removed(spark, rows).items() if n} == {1: 1, 3: 1}


def test_block_in_most_documents(spark):
    rows = rows_of([f"{line(f'own{i}x')}\n{line('footer')}" for i in range(6)])
    want = all_pairs(rows)
    assert want == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}
    assert removed(spark, rows) == want
    assert removed(spark, rows[:3]) == all_pairs(rows[:3])


def test_first_holders_of_single_lines(spark):
    """The lines of a shared block were each held alone by unrelated documents before."""
    a, b = line("a", 6), line("b", 6)
    rows = rows_of([a, b, f"{a}\n{b}", f"{a}\n{b}\n{line('more')}"])
    assert removed(spark, rows) == all_pairs(rows) == {0: 0, 1: 0, 2: 0, 3: 2}


def test_repeated_and_crossing_blocks(spark):
    """Lines that repeat on both sides, blocks in another order, overlapping runs."""
    x, y, z, p = line("x", 6), line("y", 6), line("z", 6), line("p")
    rows = rows_of(["\n".join(t) for t in ([x, y, x, x, p, p], [x, x, z], [z, p, x, p, x, x], [y, x, x, x, y, x, x, x], [z, x, x, y, z], [x, y, z, y, z])])
    assert removed(spark, rows) == all_pairs(rows)
    rng = random.Random(4)
    for _ in range(3):
        rows = rows_of(["\n".join(rng.choice([x, y, z, p, "", line("q", 3)]) for _ in range(rng.randrange(9))) for _ in range(60)])
        assert removed(spark, rows) == all_pairs(rows)


def test_rows_that_repeat_an_id(spark):
    p, q, r = line("p"), line("q"), line("r")
    rows = [(1, p, "en", "s", 0), (1, p, "en", "s", 0), (1, f"{q}\n{p}", "en", "s", 0), (2, q, "en", "s", 0), (None, p, "en", "s", 0), (2, f"{p}\n{r}", "en", "s", 0), (3, f"{r}\n{q}", "en", "s", 0)]
    got = sorted((tuple(x) for x in line_dedup.line_dedup(spark.createDataFrame(rows, H.SCHEMA)).select("doc_id", "n_lines", "n_removed", "text").collect()), key=repr)
    assert got == sorted([(1, 1, 0, p), (1, 1, 0, p), (1, 2, 0, f"{q}\n{p}"), (2, 1, 1, None), (2, 2, 1, r), (3, 2, 2, None), (None, 1, 0, p)], key=repr)


def test_very_long_texts(spark):
    """A text of 200,000 lines, one of a single line of 2 MB, and later parts of both."""
    many = [line(f"n{i}x", 3) for i in range(200_000)]
    wide = " ".join(f"w{i}" for i in range(250_000))
    rows = rows_of(["\n".join(many), wide, "\n".join(many[5000:6000]) + "\nown", f"{wide}\nown"])
    assert removed(spark, rows) == {0: 0, 1: 0, 2: 1000, 3: 1}


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, line("p"), 7, 8, 9)], "doc_id long, text string, n_lines int, cut int, `a.b` int")
    (got,) = line_dedup.line_dedup(df).collect()
    assert got.asDict() == {"doc_id": 1, "text": line("p"), "n_lines_input": 7, "cut": 8, "a.b": 9, "n_lines": 1, "n_removed": 0}


@pytest.mark.parametrize("letters", [3, 8, 40])
def test_patience_finds_all_shared_runs(monkeypatch, letters):
    """Blocks that cross, overlap and repeat all go; without patience nothing does."""
    import numpy as np

    rng = random.Random(letters)
    for _ in range(60):
        first = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
        later: list[int] = []
        for _ in range(rng.randrange(1, 5)):
            i = rng.randrange(len(first))
            later += first[i : i + rng.randrange(1, 12)] + [rng.randrange(letters + 3) for _ in range(rng.randrange(0, 3))]
        words = [x % 4 + 1 for x in later]
        w = np.array(words, np.int32)
        _, _, s, e = line_dedup.runs(np.array(later, np.int64), w, np.array([0, len(later)]), 6)
        order = np.lexsort((e, s))
        spans = list(zip(s[order].tolist(), e[order].tolist(), strict=True))
        has = lambda run: any(first[i : i + len(run)] == run for i in range(len(first)))
        want = {k for i in range(len(later)) for j in range(i + 1, len(later) + 1) if sum(words[i:j]) >= 6 and has(later[i:j]) for k in range(i, j)}
        assert set(line_dedup.common_lines(first, later, words, spans, 6)) == want
        with monkeypatch.context() as m:
            m.setattr(line_dedup, "patience", lambda a, b: [])
            assert line_dedup.common_lines(first, later, words, spans, 6) == []


def test_popular_holder_in_blocks(spark, monkeypatch):
    """A long holder of a run that many documents share goes to blocks of them."""
    monkeypatch.setattr(line_dedup, "HELD_TOGETHER", 3)
    long = [line(f"l{i}") for i in range(200)]
    rows = rows_of(["\n".join(long)] + [f"{line(f'own{i}')}\n{long[7]}\n{line(f'more{i}')}" for i in range(50)])
    assert removed(spark, rows) == {0: 0} | {i: 1 for i in range(1, 51)}
